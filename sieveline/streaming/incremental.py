"""Evidence as a stream: each micro-batch joins the evidence table and renews only the entities it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.functions import normalize as N
from sieveline.operators import evidence as E


def distinct_stream(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """A stream without repeats of keys; what is known of a key is dropped once the watermark passes it."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def verify_into(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: appends a batch's evidence under its batch number, so that a repeated batch replaces
    itself, and writes the winners of the entities it touches as that batch's version of them. Evidence lies in
    `buckets` folders by entity, so that a batch reads back only the folders of its entities."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("bucket", F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int"))
        own.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/evidence/batch={number}")
        batch = spark.read.schema(own.schema).parquet(f"{path}/evidence/batch={number}")
        busy = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most `buckets` numbers
        every = spark.read.schema(own.withColumn("batch", F.lit(number)).schema).parquet(f"{path}/evidence").where((F.col("batch") <= number) & F.col("bucket").isin(busy)).drop("batch", "bucket")
        touched = batch.select("entity_id").distinct()
        own = every.join(touched, "entity_id", "left_semi")
        E.winners(E.verified(own, N.canonical(F.col("field"), F.col("value")))).write.mode("overwrite").parquet(f"{path}/winners/batch={number}")

    return sink


def current_winners(spark: SparkSession, path: str) -> DataFrame:
    """Of each entity and field, the latest version."""
    rows = spark.read.parquet(f"{path}/winners")
    cols = [c for c in rows.columns if c not in ("entity_id", "field", "batch")]
    return rows.groupBy("entity_id", "field").agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("entity_id", "field", *[f"r.{c}" for c in cols])


def start(spark: SparkSession, source: str, path: str, files_per_batch: int = 1) -> StreamingQuery:
    """Evidence files of a folder, verified as they come."""
    rows = spark.readStream.schema(E.SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(verify_into(path)).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
