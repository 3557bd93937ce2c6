"""Set-up of Python workers, and how many tasks share the work."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reach(spark: SparkSession) -> None:
    """Let workers import this package where only the driver's sys.path holds it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def tasks(spark: SparkSession) -> int:
    """A shuffle width that keeps every core busy."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all tasks: a small file is few tasks otherwise, however many rows each of its rows becomes."""
    return df.repartition(tasks(df.sparkSession))
