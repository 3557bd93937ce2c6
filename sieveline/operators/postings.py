"""A kept index for questions in number: which chunks hold a term, and the chunks themselves.

Postings lie in buckets by their term's hash, so that a search reads the buckets of its questions' terms alone; chunks that share no term with
a question are not looked at. Scores and order are those of `retrieval.lexical_top` for each question.

A question's frequent terms are not followed: chunks found by its rarest terms (PROBE) tell how many terms the k-th best chunk shares at least, say s.
A chunk that shares s of m terms misses m - s at most, so at least SPARE of the m - s + SPARE rarest are in it: these postings give all candidates, and their
kept terms decide. So no chunk is lost, and a term that half the chunks hold costs nothing unless even the best chunks share little.

Defined results: a question without terms gets the last chunks with score 0, as do the places that too few hits leave; a null question or
chunk is empty; equal chunks are chunks each; an empty index answers nothing. Question ids must differ; chunk ids too."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions import normalize as N
from sieveline.functions.stored import stored
from sieveline.operators.retrieval import _overlap_score

PROBE, SPARE = 6, 3


@dataclass
class LexicalIndex:
    """An index in a folder; make it by `save`."""

    spark: SparkSession
    path: str
    key: str = "chunk_id"
    buckets: int = 64

    @classmethod
    def save(cls, chunks: DataFrame, path: str, key: str = "chunk_id", buckets: int = 64) -> LexicalIndex:
        """chunks(key, chunk, ...) with all their columns, their terms, and the terms' postings and numbers of chunks."""
        own = cls(chunks.sparkSession, path, key, buckets)
        chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        own.chunks().select(key, N.terms(F.col("chunk")).alias("terms")).write.mode("overwrite").parquet(f"{path}/terms")
        held = own._terms().select(key, F.explode("terms").alias("term")).withColumn("bucket", own._bucket())
        held.repartition("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        held.groupBy("term").count().write.mode("overwrite").parquet(f"{path}/counts")
        return own

    def _bucket(self):
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def _terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def postings(self, buckets: list[int]) -> DataFrame:
        kind = self.chunks().schema[self.key].dataType.simpleString()
        return self.spark.read.schema(f"{self.key} {kind}, term string, bucket int").parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets))

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """questions(qid, question) -> (qid, key, score, rn): the k best chunks of each, later ones first among equals."""
        asked = questions.select("qid", N.terms(F.col("question")).alias("asked"))
        each = asked.select("qid", F.explode("asked").alias("term")).withColumn("bucket", self._bucket())
        busy = sorted(r["bucket"] for r in each.select("bucket").distinct().collect())  # at most `buckets` numbers
        rarest = Window.partitionBy("qid").orderBy("count", "term")
        known = each.join(self.spark.read.parquet(f"{self.path}/counts"), "term")
        known = stored(known.select("qid", "bucket", "term", F.row_number().over(rarest).alias("nth"), F.count("*").over(Window.partitionBy("qid")).alias("m")), "asked-terms")

        def met(terms: DataFrame) -> DataFrame:
            return terms.join(self.postings(busy), ["bucket", "term"]).groupBy("qid", self.key).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in terms.columns if c == "need"))

        def shared(found: DataFrame) -> DataFrame:
            rows = found.select("qid", self.key).join(self._terms(), self.key).join(asked, "qid")
            return rows.select("qid", self.key, F.size(F.array_intersect("asked", "terms")).alias("both"), F.size("asked").alias("of"))

        most = Window.partitionBy("qid").orderBy(F.desc("n"), F.desc(self.key))
        probed = met(known.where(F.col("nth") <= PROBE)).withColumn("rn", F.row_number().over(most)).where(F.col("rn") <= 4 * k)
        probed = shared(stored(probed.select("qid", self.key), "probed"))
        kth = Window.partitionBy("qid").orderBy(F.desc("both"))
        least = stored(probed.withColumn("rn", F.row_number().over(kth)).where(F.col("rn") == k).select("qid", F.col("both").alias("s")), "least-shared")
        bound = known.join(least, "qid", "left").withColumn("s", F.coalesce("s", F.lit(0)))
        bound = bound.withColumn("need", F.least(F.lit(SPARE), F.greatest(F.lit(1), "s"))).where(F.col("nth") <= F.col("m") - F.col("s") + F.col("need"))
        hits = shared(met(bound.select("qid", "bucket", "term", "need")).where(F.col("n") >= F.col("need")))
        hits = hits.select("qid", self.key, _overlap_score(F.col("both"), F.col("of")).alias("score"))
        last = self.chunks().select(self.key).orderBy(F.desc(self.key)).limit(2 * k)  # fewer than k of them are hits where hits are too few
        rest = questions.select("qid").crossJoin(F.broadcast(last)).join(hits.select("qid", self.key), ["qid", self.key], "left_anti").withColumn("score", F.lit(0.0))
        best = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc(self.key))
        return hits.unionByName(rest).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)
