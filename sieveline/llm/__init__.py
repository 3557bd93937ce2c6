"""Training-data operators: filters, deduplication, scoring, packing, mixing and media columns.

Nothing outside this subpackage imports it. `registry` lists its queries.
"""
