"""Mixing sources to target weights by permuted block indices.

A source's texts, in a fixed order, are one stream of words cut into blocks of `block_words`. Targets
follow weights over all sizes and stop at `cap` times a source's size, the excess being shared anew.
A source's target, rounded to words, becomes slots, of which the last takes only the words still missing; slots fall on output shards by a multinomial draw, slot
k of a source takes block perm(k mod n) of its n blocks, perm a seeded permutation of indices by
source and pass, and slots join blocks by index. As each pass takes a block once and a target is at
most `cap` sizes, no text is taken more than `cap` times.

Streams are numbered by (salt of doc_id, doc_id, size, text hash), so a hot source is spread over
many tasks; draws are seeded by source and shard, so reruns agree.

Defined results: null text has size 0 and nothing is taken of it; null sources are one source, last
in order; equal rows each own a stretch of the stream; an empty table gives an empty mix; columns
other than doc_id, source and text are carried by `mix_documents` and ignored by `mix`."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sieveline.llm._shared import ensure_workers, materialize, with_row_text
from sieveline.llm._text import mix as mix_bits
from sieveline.llm._text import rows_of, word_counts

WEIGHTS = (5.0, 2.0, 1.0)
STRETCH = 1 << 16
SALT_ROWS = 1 << 18
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def permuted(k: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at k: four Feistel rounds, walking until inside."""
    half = max(1, -(-(max(n - 1, 1)).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    out = k.astype(np.uint64)
    todo = np.arange(len(k))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for r in range(4):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
            left, right = right, left ^ (mix_bits(right ^ key) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def place_of(block: int, n: int, seed: int) -> int:
    """The k whose permuted() is block."""
    half = max(1, -(-(max(n - 1, 1)).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    x = np.array([block], np.uint64)
    while True:
        left, right = x >> np.uint64(half), x & low
        for r in (3, 2, 1, 0):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
            left, right = right ^ (mix_bits(left ^ key) & low), left
        x = left << np.uint64(half) | right
        if x[0] < n:
            return int(x[0])


def slots_for(want: int, size: int, block_words: int, seed: int) -> tuple[int, int]:
    """(slots, words of the last) that hold `want` words of a source: a pass takes all its blocks, the last of
    which may be short, and the last slot takes what is still missing."""
    n = -(-size // block_words)
    full, rest = divmod(want, size)
    tail = size - (n - 1) * block_words
    if not rest:  # the last pass ends with the block that comes last in it
        return full * n, tail if full and place_of(n - 1, n, seed + full - 1) == n - 1 else block_words
    at = place_of(n - 1, n, seed + full)
    if rest <= at * block_words:
        k = -(-rest // block_words)
        return full * n + k, rest - (k - 1) * block_words
    if rest <= at * block_words + tail:
        return full * n + at + 1, rest - at * block_words
    rest += block_words - tail
    k = -(-rest // block_words)
    return full * n + k, rest - (k - 1) * block_words


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, no_source, source, size, text_hash) of each row."""
    ensure_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 4000):
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(word_counts(b.column(4)))], names=["doc_id", "no_source", "source", "text_hash", "size"])

    plain = with_row_text(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")).select(
        "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("text_hash"), "text"
    )
    return plain.mapInArrow(count, "doc_id long, no_source boolean, source string, text_hash long, size long")


def numbered(by_source: DataFrame) -> DataFrame:
    """by_source with `n`: the number of a source in the order of code points, null last, from 0. Sources are sorted by
    ranges; a row's number is its place in its range, and the sizes of the ranges before."""
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialize(by_source.orderBy("no_source", "source").withColumn("at", F.monotonically_increasing_id()), "ordered-sources")
    rows = rows.withColumn("part", F.shiftright("at", 33)).withColumn("inside", inside)
    counts = rows.groupBy("part").agg(F.count("*").alias("held"))  # a row for each range of the sort
    base = counts.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(base, "part").withColumn("n", F.col("base") + F.col("inside")).drop("part", "inside", "at", "base")


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(no_source, source, source_size, target) from (no_source, source, source_size), one row a source.

    Shares are level * weight, or cap * size where that is less. The level starts as if no source were capped and
    is worked out again without those that are, until no more are: each time one sum over all sources."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    w = materialize(numbered(by_source).withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap))).drop("n"), "weights")
    total, each = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    level, before = float(total) / each, None
    while level != before:
        over = F.col("limit") < F.col("weight") * F.lit(level)
        taken, left = w.agg(F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        level, before = max(level, (float(total) - taken) / left if left else level), level
    return w.select("no_source", "source", "source_size", F.least("limit", F.col("weight") * F.lit(level)).alias("target"))


def streams(sized: DataFrame, salts: int | None = None) -> DataFrame:
    """sized with `start`: where a row's words begin in its source's stream. A source is sorted in `salts` parts, by
    default one for each SALT_ROWS of all rows, and 64 at least."""
    salts = salts or max(64, 1 << (sized.count() // SALT_ROWS).bit_length())
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(salts)))
    keys = ["no_source", "source", "salt"]
    inside = Window.partitionBy(*keys).orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    totals = salted.groupBy(*keys).agg(F.sum("size").alias("n"))
    across = Window.partitionBy("no_source", "source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    begun = salted.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return begun.join(base, keys).withColumn("start", F.col("start") + F.col("base")).drop("base", "salt")


def own_seed(source: str, no_source: bool, seed: int) -> int:
    return zlib.crc32(source.encode()) * 2 + no_source + seed * 0x1F123BB5


def slots(goal: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    """(no_source, source, shard, slot, pass, block, words) for each slot of each source, drawn in stretches of STRETCH
    slots from (no_source, source, source_size, want); a slot takes the first `words` of its block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            no, src, size, want = (c.to_pylist() for c in b.columns)
            got = [slots_for(w, n, block_words, own_seed(s, x, seed) * 31) for x, s, n, w in zip(no, src, size, want, strict=True)]
            k, last = (pa.array([g[i] for g in got], pa.int64()) for i in (0, 1))
            n = pa.array([-(-x // block_words) for x in size], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, k, last], names=["no_source", "source", "n", "k", "last"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, src, n, k, last, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = own_seed(src, no, seed)
                ends = np.cumsum(np.random.default_rng(own).multinomial(k, np.full(shards, 1 / shards)))
                i = np.arange(at, min(k, at + STRETCH))
                block = np.zeros(len(i), np.int64)
                for p in np.unique(i // n):
                    here = i // n == p
                    block[here] = permuted(i[here] % n, n, own * 31 + int(p))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([no] * len(i), pa.bool_()), pa.array([src] * len(i), pa.string()), pa.array(np.searchsorted(ends, i, side="right").astype(np.int32)), pa.array(i), pa.array((i // n).astype(np.int32)), pa.array(block), pa.array(np.where(i == k - 1, last, block_words))],
                    names=["no_source", "source", "shard", "slot", "pass", "block", "words"],
                )

    rows = goal.where("source_size > 0 and want > 0").select("no_source", "source", "source_size", "want").mapInArrow(count, "no_source boolean, source string, n long, k long, last long")
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("k") - 1, F.lit(STRETCH))))
    return rows.repartition("source", "at").mapInArrow(draw, "no_source boolean, source string, shard int, slot long, pass int, block long, words long")


def takes(docs: DataFrame, block_words: int = 64, shards: int = 64, seed: int = 1, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, source, size, source_size, target, taken and
    segments, an array of (pass, first, last) words of the row that the mix takes, each with the shard, slot and
    block that they lie in and their place `at` in the block."""
    sized = materialize(sizes(docs), "sizes")
    placed = materialize(streams(sized), "streams")
    goal = materialize(targets(sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    want = F.least(F.round("target"), F.floor(F.col("source_size") * F.lit(float(cap)) + 1e-9)).cast("long")
    drawn = slots(goal.withColumn("want", want), block_words, shards, seed)
    chosen = drawn.groupBy("no_source", "source", "block").agg(F.collect_list(F.struct("pass", "words", "shard", "slot")).alias("passes"))  # at most `cap` passes
    b = F.lit(block_words)
    held = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    lo, hi = F.greatest(F.col("block") * b, "start") - F.col("start"), F.least((F.col("block") + 1) * b, F.col("start") + F.col("size")) - F.col("start")
    joined = held.join(chosen.hint("merge"), ["no_source", "source", "block"]).withColumn("p", F.explode("passes"))
    hi = F.least(hi, F.col("block") * b + F.col("p.words") - F.col("start"))
    parts = joined.select("no_source", "source", "start", F.struct(F.col("p.pass").alias("pass"), lo.alias("first"), hi.alias("last"), "p.shard", "p.slot", "block", (F.col("start") + lo - F.col("block") * b).alias("at")).alias("s")).where("s.last > s.first")
    got = parts.groupBy("no_source", "source", "start").agg(F.sum(F.col("s.last") - F.col("s.first")).alias("taken"), F.sort_array(F.collect_list("s")).alias("segments"))
    got = got.withColumn("owns", F.lit(True))
    out = placed.withColumn("owns", F.col("size") > 0).join(got.hint("merge"), ["no_source", "source", "start", "owns"], "left").join(goal, ["no_source", "source"])
    return out.select("doc_id", "text_hash", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "segments")


def whole(segments: Column, size: Column) -> Column:
    """segments by pass, neighbours joined: array of (pass, array of (first, last))."""
    passes = F.array_distinct(F.transform(segments, lambda s: s["pass"]))
    return F.transform(passes, lambda p: F.struct(p.alias("pass"), F.filter(segments, lambda s: s["pass"] == p).alias("runs")))


def mix_blocks(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus by output shard: (shard, slot, source, pass, block, n_words, text) for each slot drawn; slot
    numbers the slots of a source, so a shard's blocks in the order of slot, then source, are the mix."""
    got = takes(docs, **how).select("doc_id", "text_hash", "source", F.explode("segments").alias("s"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("__sv_id"), text.alias("text"), F.xxhash64(text).alias("__sv_h")).dropDuplicates(["__sv_id", "__sv_h"])
    j = got.join(texts, got["doc_id"].eqNullSafe(texts["__sv_id"]) & (got["text_hash"] == texts["__sv_h"]))

    @F.pandas_udf(StringType())
    def cut(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(text, first, last, strict=True):
            at = [(m.start(), m.end()) for m in WORD.finditer(t)]
            out.append(t[at[a][0] : at[b - 1][1]])
        return pd.Series(out, dtype=object)

    j = j.withColumn("part", cut("text", "s.first", "s.last"))
    parts = F.sort_array(F.collect_list(F.struct("s.at", "part")))
    got = j.groupBy("s.shard", "s.slot", "source", "s.pass", "s.block").agg(F.sum(F.col("s.last") - F.col("s.first")).alias("n_words"), F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("text"))
    return got.select("shard", "slot", "source", "pass", "block", "n_words", "text")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus, in the columns of docs: a row for each text and pass, its text the words taken
    in that pass (the text itself where that is all of them) and n_chars, if there, their length."""
    # rows of equal id, text and source are interchangeable, others are not: numbers run inside these three
    got = takes(docs, **how).where("taken > 0")
    got = got.withColumn("__sv_n", F.row_number().over(Window.partitionBy("doc_id", "text_hash", "source").orderBy("taken")))
    got = got.select(F.col("doc_id").alias("__sv_id"), F.col("text_hash").alias("__sv_h"), F.col("source").alias("__sv_source"), "__sv_n", F.col("size").alias("__sv_size"), F.explode(whole(F.col("segments"), F.col("size"))).alias("__sv_take"))
    own = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # texts without words, which nothing is taken of, may be many of one kind
    rows = docs.where(text.rlike(r"[^\x20\x09-\x0D]")).withColumn("__sv_h", F.xxhash64(text))
    rows = rows.withColumn("__sv_n", F.row_number().over(Window.partitionBy("doc_id", "__sv_h", "source").orderBy("source")))
    same = rows["doc_id"].cast("long").eqNullSafe(got["__sv_id"]) & (rows["__sv_h"] == got["__sv_h"]) & rows["source"].cast("string").eqNullSafe(got["__sv_source"]) & (rows["__sv_n"] == got["__sv_n"])
    j = rows.join(got, same).select(*[rows[c] for c in own], "__sv_size", "__sv_take")

    @F.pandas_udf(StringType())
    def cut(text: pd.Series, first: pd.Series, last: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for t, lo, hi, n in zip(text, first, last, size, strict=True):
            if len(lo) == 1 and lo[0] == 0 and hi[0] == n:
                out.append(t)
                continue
            at = [(m.start(), m.end()) for m in WORD.finditer(t)]
            out.append("\n".join(t[at[a][0] : at[b - 1][1]] for a, b in zip(lo, hi, strict=True)))
        return pd.Series(out, dtype=object)

    runs = F.col("__sv_take.runs")
    # blocks that follow each other are one run: a run starts where no other ends and ends where no other starts
    first = F.array_except(F.transform(runs, lambda s: s["first"]), F.transform(runs, lambda s: s["last"]))
    last = F.array_except(F.transform(runs, lambda s: s["last"]), F.transform(runs, lambda s: s["first"]))
    j = j.withColumn("__sv_first", F.array_sort(first)).withColumn("__sv_last", F.array_sort(last))
    j = j.withColumn("text", cut("text", "__sv_first", "__sv_last", "__sv_size"))
    if "n_chars" in own:
        j = j.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return j.select(*own)
