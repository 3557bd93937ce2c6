"""Best-fit packing by minimum bin slack.

Every text becomes token ids and one end id, cut into pieces of at most `capacity` tokens. Sequences
are planned over the histogram of piece lengths, which has at most `capacity` entries whatever the
corpus: for the longest length left, a bitset subset-sum over the lengths still available finds the
fullest bin, and that combination is removed as often as the counts allow. Pieces of a length are
numbered across the corpus (a running number inside the task that made them, plus the counts of the
tasks before), and a piece's number picks its bin and offset. Pieces are stored bucketed by the task that
made them and meet that task's numbers, one row, where they lie: no piece moves through a shuffle and no group of
equal lengths meets in one task.

Defined results: a null or empty text is its end id alone; an empty table packs into nothing; equal
rows are packed each; columns other than the id and text are ignored, whatever their names."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm._shared import ensure_workers, materialize, materialize_bucketed, with_row_text
from sieveline.llm._text import rows_of, word_chunks

CACHE_WORDS = 500_000
CHUNK_BYTES = 1 << 21
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts by the tokenizer at `path`.

    The vocabulary's splitter never crosses white space and lower-cases, so the ids of a text are those
    of its words, whatever the case of A-Z. Words are told apart by their 64-bit hash; of each chunk of
    texts only the different words are looked up, and only those not seen before are encoded. Texts
    with special tokens, whose case counts, are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # word hashes in order, and where their ids are
        self.flat, self.off = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    @staticmethod
    def at(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        """Slots of new words; past CACHE_WORDS they are good until the next call only."""
        ids = [x for i in range(0, len(words), 10_000) for x in self.plain(words[i : i + 10_000])]
        n, lens = len(self.keys), np.array([len(x) for x in ids], np.int64)
        used = int(self.off[n]) + int(lens.sum())
        if n + len(keys) + 1 > len(self.off):
            self.off = np.concatenate((self.off, np.zeros(max(len(keys) + 1, len(self.off) // 2), np.int64)))
        if used > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(used - len(self.flat), len(self.flat) // 2), np.uint32)))
        self.off[n + 1 : n + 1 + len(keys)] = self.off[n] + np.cumsum(lens)
        if lens.sum():
            self.flat[int(self.off[n]) : used] = np.concatenate(ids)
        slots = np.arange(n, n + len(keys))
        if n + len(keys) <= CACHE_WORDS:
            at = np.searchsorted(self.keys, keys)
            self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        return slots

    def __call__(self, col: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row of a text column."""
        for w in word_chunks(col, CHUNK_BYTES):
            special = _holds(w.raw, b"<|")
            keys, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
            slot = np.zeros(len(keys), np.int64)
            slot[known] = self.slots[at[known]] if len(self.keys) else 0
            if not known.all():
                new = np.flatnonzero(~known)
                slot[new] = self._learn(keys[new], [w.raw[w.starts[j] : w.ends[j]].tobytes().decode() for j in first[new].tolist()])
            slot = slot[inverse]
            lo, n = self.off[slot], self.off[slot + 1] - self.off[slot]
            ends = np.concatenate(([0], np.cumsum(n)))
            ids = self.flat[np.repeat(lo - ends[:-1], n) + np.arange(ends[-1])]
            cuts = ends[w.cuts].tolist()
            for i in range(w.hi - w.lo):
                if special and b"<|" in (text := (col[w.lo + i].as_py() or "")).encode():
                    yield self.plain([text])[0]
                else:
                    yield ids[cuts[i] : cuts[i + 1]]


def _holds(raw: np.ndarray, pair: bytes) -> bool:
    return bool(((raw[:-1] == pair[0]) & (raw[1:] == pair[1])).any())


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank[, ids]); rank numbers equal lengths inside a part."""
    ensure_workers(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, ranks = Encoder.at(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in rows_of(batches, 1000):
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                raw = ids.astype("<u4").tobytes() + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    one = raw[at : at + 4 * capacity]
                    n = len(one) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(one), part, ranks[n], one))
                    ranks[n] += 1
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(cols[:7], (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()), strict=True)]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return with_row_text(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and their uses that fill `room` best, within counts: subset-sum over bitsets."""
    reach, steps = 1, []
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    for n in sorted((n for n in counts if n <= room), reverse=True):
        left, k = min(counts[n], room // n), 1
        while left > 0:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left -= k
            k *= 2
            if reach & goal:
                break
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + k
            at -= n * k
    return used


def plan_bins(hist: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, lengths with uses) for each kind of bin; all lengths of hist are used up."""
    left = {n: c for n, c in hist.items() if c > 0}
    plan = []
    while left:
        top = max(left)
        left[top] -= 1
        rest = {n: c for n, c in left.items() if c > 0}
        used = fullest(rest, capacity - top) if capacity > top else {}
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(left[n] // c for n, c in used.items())
        plan.append((times, used))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return plan


def layout(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, uses in a bin, offset in it), by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    seq = 0
    for times, used in plan:
        offset = 0
        for n, c in sorted(used.items(), reverse=True):
            rows.setdefault(n, []).append((taken.get(n, 0), seq, c, offset))
            taken[n] = taken.get(n, 0) + times * c
            offset += n * c
        seq += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """The pieces of `docs` with sequence_id and offset; with_ids adds the token ids themselves."""
    spark = docs.sparkSession
    made = pieces(docs, tokenizer, capacity, end_id, with_ids)
    tasks = min(max(made.rdd.getNumPartitions(), 1), 50_000)
    cut = materialize_bucketed(made, "pieces", "part", tasks)
    by_part = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    hist = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = spark.sparkContext.broadcast(layout(plan_bins(hist, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a row for each task: what its numbers of each length start from
    first = first.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("bases"))
    numbered = cut.join(first.hint("shuffle_hash"), "part").withColumn("rank", F.col("rank") + F.element_at("bases", F.col("length"))).drop("bases", "part")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = where.value[int(n)]
                r = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                k = rank[at] - r[:, 0]
                seq[at], off[at] = r[:, 1] + k // r[:, 2], r[:, 3] + k % r[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return numbered.select(*keep, "rank").mapInArrow(place, schema)
