"""Shared-folder tables, worker set-up and grouped streaming for the training-data operators."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm._text import release

_written: list[tuple[SparkSession, str]] = []
_tables: dict[str, str] = {}


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers import this package even when only the driver's sys.path holds it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own in the warehouse where it is unset and
    driver and executors are one process; elsewhere the warehouse may be a machine's own folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/_sieveline"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sieveline-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(sweep)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, partition_by: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost
    executor costs only the tasks that read the files again. rows_per_file: for rows of megabytes, as writers
    and readers hold many rows of a file at once (0: no limit)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """materialize() to a table bucketed by key: a join by that key reads it without a shuffle. A task whose
    rows have one value of key writes one file."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"sieveline_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    _tables[path] = table
    return spark.table(table)


def drop_path(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside go when the block ends: for drivers that live long. The results read them, so store these first."""
    n = len(_written)
    yield
    while len(_written) > n:
        drop_path(*_written.pop())


def sweep() -> None:
    """Remove the tables of this process from the shared folder."""
    while _written:
        spark, path = _written.pop()
        try:
            drop_path(spark, path)
        except Exception:  # the session is already gone: its folder is the cluster's to clean
            return


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Shuffle width that keeps `per_partition` rows a task, never under the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def stream_groups(
    df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]], schema: str, parts: int
) -> DataFrame:
    """Apply fn to each group of equal keys, one group in memory at a time.

    Rows are dealt by the keys and sorted inside a partition, so that a task walks its groups in
    turn: many small groups cost one Python call each, not one Spark group each. Callers bound
    the size of a group."""
    ensure_workers(df.sparkSession)
    dealt = df.repartition(parts, *keys).sortWithinPartitions(*keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []
        now: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k) for k in keys]
            cut = np.zeros(b.num_rows, bool)
            for c in cols:
                v = c.to_numpy(zero_copy_only=False)
                cut[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(cut)
            edges = [0, *starts.tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                key = tuple(c[lo].as_py() for c in cols)
                if now is not None and key != now:
                    yield from fn(now, pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(b.slice(lo, hi - lo))
        if now is not None:
            yield from fn(now, pa.Table.from_batches(held))
        held = []
        release()

    return dealt.mapInArrow(walk, schema)


def with_row_text(df: DataFrame, text: str = "text") -> DataFrame:
    """The text column with null as empty."""
    return df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, root): root is the smallest node reachable. Alternates large-star and small-star, which
    ends after O(log^2 n) rounds; each round is aggregated map-side and written to the shared folder."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, before = materialize(e, "edges"), None
    for _ in range(rounds):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            e.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        # written first, so that both sides of the join are plain shuffles, whose hot keys (a star's centre) Spark splits
        low = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "least")
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        small = materialize(small.where("u <> v").distinct(), "small-star")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.sum(F.xxhash64("v", "u") % (1 << 40))).first()
        e = small
        if now == before:  # as many edges, and the same sums of their hashes
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
