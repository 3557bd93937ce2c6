"""Importance resampling of documents towards a target distribution of hashed n-grams.

Each task hands its texts, some megabytes at a time, to a DuckDB of its own: SQL splits them into words, unnests them, joins up to
`most` consecutive ones by windows, and hashes the different n-grams of the lot with a registered CRC-32 function. Bucket counts
by document and by task are spilled to Parquet in the shared folder. Spark merges the tasks' counts into those of all documents and of
the target, takes each bucket's gain (a table as long as there are buckets), scores the documents' bucket counts by it, and draws the
highest scores: a document's weight plus Gumbel noise from its id's hash, so that reruns draw the same.

Ranks run over the whole corpus without one task seeing it all: scores are dealt by ranges and stored, ranges are counted (a
number for each), and a row's rank is its place in its range after the ranges before.

Texts over PIECE characters go through DuckDB in pieces cut between words, each followed by the words its last n-grams reach into.

Defined results: a null or empty text has no words, weighs 0 and is never drawn where `least_words` is over 0; equal scores rank by
doc_id, null last, then as they lie; a null doc_id hashes as the empty string; repeated rows are documents each; an empty table gives an
empty result, an empty target leaves gains to the smoothing; other columns are ignored, whatever their names."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm._shared import ensure_workers, materialize
from sieveline.llm._text import release

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # digits, letters of A-Z once lower-cased, and all beyond ASCII
OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # what is in no word before lower-casing
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK = 1 << 22
PIECE = 1 << 20
COUNTED = "kind string, doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>, bucket int, n long"
_ARROW = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("bucket", pa.int32()), ("n", pa.int64())])


@dataclass(frozen=True)
class Features:
    """Runs of 1 to `most` words, hashed into `buckets`."""

    most: int = 1
    buckets: int = 10_000


def pieces(text: str, most: int, size: int = PIECE) -> Iterator[tuple[str, str]]:
    """(own, tail): the text in parts of about `size` characters cut between words, and the most - 1 words after each."""
    at, gap, word = 0, re.compile(rf"[{OTHER}]"), re.compile(rf"[^{OTHER}]+")
    while len(text) - at > size and (m := gap.search(text, at + size)):
        yield text[at : m.start()], " ".join(w[0] for w in islice(word.finditer(text, m.start()), most - 1))
        at = m.start()
    yield text[at:], ""


def _grams(k: int) -> str:
    if k == 1:
        return "SELECT row, word AS gram FROM words WHERE i <= n_own"
    return f"""SELECT row, gram FROM (
        SELECT row, i, n_own, string_agg(word, ' ') OVER w AS gram, count(*) OVER w AS long FROM words
        WINDOW w AS (PARTITION BY row, piece ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)) WHERE long = {k} AND i <= n_own"""


class _Counter:
    """A task's DuckDB: one thread, bounded memory, nothing on disk but what it spills and removes itself."""

    def __init__(self, features: Features):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "384MB", "preserve_insertion_order": False})
        crc = lambda grams: pa.array([zlib.crc32(g) for g in grams.cast(pa.binary()).to_pylist()], pa.uint32())
        self.con.create_function("crc", crc, ["VARCHAR"], "UINTEGER", type="arrow")
        self.con.execute("CREATE TABLE totals (bucket INTEGER, n BIGINT)")
        split = lambda c: f"regexp_extract_all(translate({c}, '{UPPER}', '{LOWER}'), '{WORD}')"
        grams = " UNION ALL ".join(_grams(k) for k in range(1, features.most + 1))
        self.steps = [
            f"CREATE OR REPLACE TEMP TABLE words AS WITH split AS (SELECT row, piece, {split('own')} AS own, {split('tail')} AS tail FROM chunk) SELECT row, piece, len(own) AS n_own, unnest(own || tail) AS word, generate_subscripts(own || tail, 1) AS i FROM split",
            f"CREATE OR REPLACE TEMP TABLE found AS SELECT row, gram, count(*) AS n FROM ({grams}) GROUP BY row, gram",
            f"CREATE OR REPLACE TEMP TABLE hashed AS SELECT gram, CAST(crc(gram) % {features.buckets} AS INTEGER) AS bucket FROM (SELECT DISTINCT gram FROM found)",
            "CREATE OR REPLACE TEMP TABLE counted AS SELECT row, bucket, CAST(sum(n) AS INTEGER) AS n FROM found JOIN hashed USING (gram) GROUP BY row, bucket",
            "INSERT INTO totals SELECT bucket, sum(n) FROM counted GROUP BY bucket",
        ]
        self.documents = """
            WITH sums AS (SELECT row, sum(n) AS n_features, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM counted GROUP BY row),
            long AS (SELECT row, count(*) AS n_words FROM words WHERE i <= n_own GROUP BY row)
            SELECT 'document' AS kind, id AS doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts, NULL AS bucket, NULL AS n
            FROM (SELECT DISTINCT row, id FROM chunk) LEFT JOIN sums USING (row) LEFT JOIN long USING (row)"""
        self.sums = "SELECT 'total' AS kind, NULL AS doc_id, NULL AS n_words, NULL AS n_features, NULL AS buckets, NULL AS counts, bucket, sum(n) AS n FROM totals GROUP BY bucket"

    def rows(self, sql: str) -> Iterator[pa.RecordBatch]:
        yield from self.con.sql(sql).to_arrow_table().cast(_ARROW).to_batches()

    def add(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The document rows of a chunk of (row, id, piece, own, tail)."""
        cols = zip(*rows, strict=True)
        self.con.register("chunk", pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["row", "id", "piece", "own", "tail"]))
        for step in self.steps:
            self.con.execute(step)
        yield from self.rows(self.documents)
        self.con.unregister("chunk")


def count_features(docs: DataFrame, features: Features = Features()) -> DataFrame:
    """Rows of kind document (doc_id, n_words, n_features, buckets, counts) and, for each task, of kind total (bucket, n); stored."""
    ensure_workers(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held, size = _Counter(features), [], 0
        row = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row += 1
                for k, (own, tail) in enumerate(pieces(text.as_py(), features.most)):
                    held.append((row, doc_id, k, own, tail))
                    size += len(own) + 64
                if size >= CHUNK:  # a document's pieces stay together
                    yield from counter.add(held)
                    held, size = [], 0
        if held:
            yield from counter.add(held)
        yield from counter.rows(counter.sums)
        counter.con.close()
        release()

    return materialize(plain.mapInArrow(run, COUNTED), "buckets", partition_by="kind")


def totals(counted: DataFrame) -> DataFrame:
    """(bucket, n) over all tasks."""
    return counted.where("kind = 'total'").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, features: Features) -> list[int]:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the documents: as many numbers as there are buckets."""
    spark = docs.sparkSession
    both = spark.range(features.buckets).select(F.col("id").cast("int").alias("bucket")).join(docs.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    sums = both.agg(*((F.sum(c) + features.buckets).alias(c.upper()) for c in ("s", "t")))
    gain = F.floor(F.lit(1000.0) * F.log((F.col("t") + 1) * F.col("S_all") / ((F.col("s") + 1) * F.col("T_all"))))
    rows = both.crossJoin(F.broadcast(sums.toDF("S_all", "T_all"))).select("bucket", gain.alias("gain")).collect()  # sums: one row
    return [r["gain"] for r in sorted(rows)]


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise, in thousandths, from the first 32 bits of the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: int) -> DataFrame:
    """scored with rank: 1, 2, 3... by score of the highest floor(percent / 100) of the rows marked `able`, else null. Adds part and uid."""
    spark = scored.sparkSession
    stored = materialize(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
    order = (F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("uid"))
    placed = materialize(stored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = sorted(map(tuple, placed.where("able").groupBy("part").count().collect()))  # a row for each range
    most, before, seen = sum(n for _, n in sizes) * percent // 100, [], 0
    for part, n in sizes:
        before.append((part, seen))
        seen += n
    ahead = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return placed.join(ahead, "part", "left").withColumn("rank", place).withColumn("rank", F.when(F.col("able") & (F.col("rank") <= most), F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, features: Features = Features(), percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of all docs (doc_id, text), drawn towards the target's texts."""
    counted = count_features(docs, features)
    aim = count_features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), features)
    worth = F.split(F.lit(",".join(map(str, gains(totals(counted), totals(aim), features)))), ",").cast("array<bigint>")
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: worth[b] * n), F.lit(0).cast("long"), lambda a, x: a + x)
    mine = counted.where("kind = 'document'").select("doc_id", "n_words", "n_features", total.alias("total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    scored = mine.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)).withColumn("able", F.col("n_words") >= least_words)
    return draw(scored, percent).select("doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


#: CRC-32 by its table, made from its polynomial, over the bytes of each different word.
ORACLE_SQL = r"""
WITH crcs AS (SELECT list(c ORDER BY b) AS t FROM (
       SELECT b, list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(b))),
words AS (SELECT 'S' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
          UNION ALL
          SELECT 'T', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
hashed AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(w))), lambda j: CAST('0x' || substr(hex(encode(w)), CAST(2 * j + 1 AS INTEGER), 2) AS BIGINT))),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
           FROM (SELECT DISTINCT w FROM words), crcs),
found AS (SELECT side, doc_id, bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY ALL),
sides AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'S'), 0) AS s, coalesce(sum(n) FILTER (side = 'T'), 0) AS t FROM found GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM sides) + 10000 AS DOUBLE)
                 / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM sides) + 10000 AS DOUBLE)))) AS gain FROM sides),
sums AS (SELECT doc_id, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM found JOIN gains USING (bucket) WHERE side = 'S' GROUP BY doc_id),
scored AS (SELECT d.doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                  CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM documents d LEFT JOIN sums s USING (doc_id)),
noisy AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM noisy WHERE n_features >= 20)
SELECT n.doc_id, n_features, weight, score, CASE WHEN place <= able * 10 // 100 THEN place END AS rank FROM noisy n LEFT JOIN placed p USING (doc_id)
"""
