"""Sieveline: evidence-resolution analytics expressed as Spark DataFrame plans."""
