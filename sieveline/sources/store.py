"""The entity store as Parquet that a batch renews in part.

Rows lie in buckets by their key's hash. A merge reads and rewrites the buckets of its batch alone, as a new version folder beside
the old ones; a bucket's rows are those of its newest complete version, so that a merge cut short changes nothing and is
simply made again, and readers of an older version are not disturbed until `vacuum`. What a merge costs follows its batch: choose
`buckets` so that one is some hundred megabytes, and keep it.

Defined results: those of `feeds.upsert`; a null key is the empty one; an empty batch writes no version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.stored import stored
from sieveline.sources.feeds import upsert

SCHEMA = "{key} string, payload string, seen_in_run_ids array<string>, created_at long, updated_at long"


@dataclass
class Store:
    spark: SparkSession
    path: str
    buckets: int = 64
    key: str = "business_key"

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        fs, p = self._fs()
        if not fs.exists(p(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p(self.path))]
        return sorted(int(n[8:]) for n in names if n.startswith("version=") and fs.exists(p(f"{self.path}/{n}/_SUCCESS")))

    def newest(self) -> dict[int, int]:
        """Of each bucket its newest version."""
        fs, p = self._fs()
        out: dict[int, int] = {}
        for v in self.versions():
            out |= {int(s.getPath().getName()[7:]): v for s in fs.listStatus(p(f"{self.path}/version={v}")) if s.getPath().getName().startswith("bucket=")}
        return out

    def folders(self, buckets: list[int] | None = None) -> list[str]:
        return [f"{self.path}/version={v}/bucket={b}" for b, v in sorted(self.newest().items()) if buckets is None or b in buckets]

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The store's rows, of all buckets or of some."""
        schema = SCHEMA.format(key=self.key)
        folders = self.folders(buckets)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, run: str, now: int, order: str | None = None) -> list[int]:
        """batch(key, payload) into the store as of `run`; the buckets that were renewed."""
        own = stored(batch.withColumn(self.key, F.coalesce(F.col(self.key).cast("string"), F.lit(""))), "batch")
        busy = sorted(r["b"] for r in own.select(self.bucket().alias("b")).distinct().collect())  # at most `buckets` numbers
        if not busy:
            return []
        new = upsert(self.read(busy), own, F.lit(run), F.lit(now).cast("long"), self.key, order)
        version = max(self.versions(), default=0) + 1
        new.withColumn("bucket", self.bucket()).repartition(len(busy), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")
        return busy

    def vacuum(self) -> int:
        """Remove folders that newer versions replace; how many."""
        fs, p = self._fs()
        kept, gone = self.newest(), 0
        for v in self.versions():
            for s in fs.listStatus(p(f"{self.path}/version={v}")):
                name = s.getPath().getName()
                if name.startswith("bucket=") and kept[int(name[7:])] != v:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone
