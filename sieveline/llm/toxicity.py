"""Toxicity by nearest labelled examples.

Texts are unit TF-IDF vectors over all their words (runs of letters), document frequencies counted over all
documents, and over the word beginnings that labelled rows tie to toxicity. Examples lie in an inverted index
in blocks that knows each feature's largest weight in every block: the blocks of the highest bounds
are compared first, and a block is left out only if its bound is below the k-th nearest found, so the k
nearest by cosine are exact. Votes weigh by nearness, are drawn towards the share of toxic examples, and
name their evidence.

Features tied to toxicity (chi-squared over the sample's different texts) weigh BOOST times their TF-IDF, so that
a few such words count against the hundreds of others in a long text. Forms that no label has shown meet their
examples by a tied beginning; one that several words of a text share is a feature of its own, as one such
word may be chance. Examples of equal vectors are one point whose label is their mean. A word that no
example holds cannot bring a text nearer to any; it counts in the text's length as a word of one document.

The model is fitted on at most `sample` labelled rows, those of smallest hash: a documented bound.

Defined results: a text that shares nothing with any example, the empty and null ones too, has the share of
toxic examples that hold no word, or of all if there is none; rows without usable labels do not teach; without labels every
score is 0; an empty table gives an empty result; only text is read by the score; words and beginnings are
known by 64-bit hashes, beginnings counted in bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm._shared import ensure_workers, materialize, with_row_text
from sieveline.llm._text import Words, mix, rows_of, word_chunks
from sieveline.llm.quality import labelled_sample

SAMPLE = 10_000
BLOCK = 64
#: Blocks compared before the bounds are tried, and at most one by one after; more are compared feature by feature.
FIRST, FEW = 1, 3
#: A query whose largest weight is less is led by no feature.
LED = 0.3
#: Features that so large a share of the examples hold, at most so many, have their lists written out in full,
#: and are multiplied with so many queries at a time.
COMMON, COMMON_MOST, TOGETHER = 0.05, 256, 64
#: Chi-squared that ties a feature to toxicity: chance gives it to fewer than one of ten million features.
CHI = 60.0
#: Share of the toxic examples that must hold a tied feature, so that no one group of near copies makes one.
SUPPORT = 0.01
BOOST = 40.0
PREFIXES = (4, 5, 6, 7, 8)
SHARED = np.uint64(0x2545F4914F6CDD1D)


def letters(col: pa.Array) -> pa.Array:
    """Texts in lower case, all but letters as single spaces."""
    return pc.replace_substring_regex(pc.utf8_lower(col), pattern=r"[^\pL]+", replacement=" ")


def counted(of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, times) of the different pairs, in order."""
    different, number = np.unique(keys, return_inverse=True)
    pair, times = np.unique(of * len(different) + number, return_counts=True)
    row, number = np.divmod(pair, max(len(different), 1))
    return row, different[number], times


def beginnings(w: Words, of: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, times) of the beginnings of a chunk's longer words, and of those that two words or more
    of a row share, their times less one; only the keys in the sorted array `known`, if given."""
    out = []
    _, one, of_word = np.unique(w.hashes, return_index=True, return_inverse=True)  # different words are looked at once
    starts, lens = w.starts[one], w.ends[one] - w.starts[one]
    for n in PREFIXES:
        long = np.flatnonzero(lens > n)
        packed = np.zeros((len(long), 8), np.uint8)
        packed[:, :n] = w.raw[starts[long][:, None] + np.arange(n)]
        own = mix(packed.view(np.uint64).reshape(-1) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        if known is not None:
            some = is_in(own, known) | is_in(own ^ SHARED, known)
            long, own = long[some], own[some]
        number = np.full(len(one), -1)
        number[long] = np.arange(len(long))
        at = np.flatnonzero(number[of_word] >= 0)
        keys = own[number[of_word[at]]]
        rows, keys, times = counted(of[at], keys)
        twice = times > 1
        out += [(rows, keys, times), (rows[twice], keys[twice] ^ SHARED, times[twice] - 1)]
    rows, keys, times = (np.concatenate(x) for x in zip(*out, strict=True))
    if known is not None:
        some = is_in(keys, known)
        rows, keys, times = rows[some], keys[some], times[some]
    return rows, keys, times


def places(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(among, keys), max(len(among) - 1, 0))


def is_in(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    return among[places(keys, among)] == keys if len(among) else np.zeros(len(keys), bool)


def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers lo..hi of every span, one span after the other."""
    n = hi - lo
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - n), n)


def runs(values: np.ndarray, lo: list[int], hi: list[int]) -> np.ndarray:
    """values[lo:hi] of every span, one after the other: copies of whole runs, far cheaper than single places."""
    return np.concatenate([values[:0], *(values[a:b] for a, b in zip(lo, hi, strict=True))])


@dataclass
class Vocabulary:
    """Features in order of their keys and what one occurrence weighs; `rare` is the weight of a word outside."""

    keys: np.ndarray
    worth: np.ndarray
    tied: np.ndarray
    rare: float

    def vectors(self, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(feature numbers in order, weights) of each row; the whole vector has length 1 with the words outside."""
        for w in word_chunks(letters(col)):
            rows = w.hi - w.lo
            of = np.repeat(np.arange(rows), np.diff(w.cuts))
            got = [counted(of, w.hashes), beginnings(w, of, self.tied)]
            row, key, times = (np.concatenate([g[i] for g in got]) for i in range(3))
            at, known = places(key, self.keys), is_in(key, self.keys)
            weight = (1 + np.log(times)) * (np.where(known, self.worth[at], self.rare) if len(self.keys) else self.rare)
            norm = np.sqrt(np.bincount(row, weight * weight, rows))
            row, at, weight = row[known], at[known], weight[known]
            order = np.lexsort((at, row))
            row, at, weight = row[order], at[order], weight[order]
            cuts = np.searchsorted(row, np.arange(rows + 1))
            weight = weight / np.maximum(norm[row], 1e-300)
            for i in range(rows):
                yield at[cuts[i] : cuts[i + 1]], weight[cuts[i] : cuts[i + 1]]


@dataclass
class Index:
    """Examples as unit vectors, numbered so that those alike are in one block, their labels and ids."""

    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray
    feature: np.ndarray
    weight: np.ndarray
    features: int
    without: float
    share: float
    neighbours: int = 15
    built: bool = False

    def build(self) -> Index:
        """The lists and bounds, worked out by each worker once: only the vectors travel."""
        if self.built:
            return self
        self.built, self.query = True, np.zeros(self.features)
        example = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.starts))
        order = np.argsort(self.feature, kind="stable")  # by feature, then example
        self.by_example, self.by_weight = example[order], self.weight[order].astype(np.float32)
        self.posting = np.stack([self.by_example, self.by_weight.view(np.int32)], 1).reshape(-1).view(np.int64)  # both at once, as one number
        feature = self.feature[order]
        self.lists = np.searchsorted(feature, np.arange(self.features + 1))
        block = self.by_example // BLOCK
        first = np.flatnonzero(np.concatenate(([len(block) > 0], (feature[1:] != feature[:-1]) | (block[1:] != block[:-1])))) if len(block) else np.zeros(0, int)
        self.bound_block = block[first]
        self.bound = np.maximum.reduceat(self.by_weight, first) if len(first) else self.by_weight
        self.bounds = np.searchsorted(feature[first], np.arange(self.features + 1))
        held = np.diff(self.lists)
        common = np.argsort(-held, kind="stable")[:COMMON_MOST]
        common = common[held[common] > COMMON * len(self.ids)]
        self.row = np.full(self.features, -1)
        self.row[common] = np.arange(len(common))
        self.full = np.zeros((len(common), len(self.ids)), np.float32)
        for r, a in enumerate(common.tolist()):
            at = slice(self.lists[a], self.lists[a + 1])
            self.full[r, self.by_example[at]] = self.by_weight[at]
        return self

    def compared(self, query: np.ndarray, examples: np.ndarray) -> np.ndarray:
        """Cosines of examples with a query given as its weight by feature."""
        lo, hi = self.starts[examples], self.starts[examples + 1]
        at = spans(lo, hi)
        return np.add.reduceat(self.weight[at] * query[self.feature[at]], np.cumsum(hi - lo) - (hi - lo)) if len(examples) else np.zeros(0)

    def heads(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common features add to the cosine of each query with each example, in single precision."""
        weight = np.zeros((len(queries), len(self.full)), np.float32)
        for i, (f, w) in enumerate(queries):
            row = self.row[f]
            weight[i, row[row >= 0]] = w[row >= 0]
        return weight @ self.full

    def by_feature(self, f: np.ndarray, w: np.ndarray, head: np.ndarray, k: int) -> np.ndarray:
        """The examples that may be among the k nearest, by the lists of all features, in single precision."""
        rare = self.row[f] < 0
        lo, hi = self.lists[f[rare]], self.lists[f[rare] + 1]
        weight = np.repeat(w[rare].astype(np.float32), hi - lo)
        found = runs(self.posting, lo.tolist(), hi.tolist())
        sim = np.bincount(found.view(np.int32)[::2], weight * found.view(np.float32)[1::2], len(self.ids)) + head
        return np.flatnonzero(sim >= max(np.partition(sim, -k)[-k] if k < len(sim) else 0, 1e-5) - 1e-5)

    def nearest(self, f: np.ndarray, w: np.ndarray, k: int, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the k nearest with a cosine above 0, ties by number; `head` is the query's row of heads()."""
        n, query = len(self.ids), self.query
        head = self.heads([(f, w)])[0] if head is None else head
        query[f] = w
        if w.max() < LED:  # bounds of many like weights are like in all blocks
            number = self.by_feature(f, w, head, k)
            return self.chosen(number, self.compared(query, number), f, k)
        lo, hi = self.bounds[f], self.bounds[f + 1]
        weight = np.repeat(w, hi - lo)
        lo, hi = lo.tolist(), hi.tolist()
        bound = np.bincount(runs(self.bound_block, lo, hi), weight * runs(self.bound, lo, hi), -(-n // BLOCK))
        ranked = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound > 0)]
        members = lambda blocks: spans(blocks * BLOCK, np.minimum(n, (blocks + 1) * BLOCK))
        # where bounds fall slowly they leave many blocks, which a first comparison would only delay
        steep = len(ranked) <= FIRST + FEW or bound[ranked[FIRST + FEW]] < 0.2 * bound[ranked[0]]
        number = members(ranked[:FIRST]) if steep else np.zeros(0, int)
        sim = self.compared(query, number)
        least = np.partition(sim, -k)[-k] if len(sim) >= k else 0.0
        rest = ranked[FIRST:][bound[ranked[FIRST:]] >= least - 1e-9] if steep else ranked
        if len(rest) <= FEW:
            number = np.concatenate((number, members(rest)))
            sim = np.concatenate((sim, self.compared(query, members(rest))))
        else:
            number = self.by_feature(f, w, head, k)
            sim = self.compared(query, number)
        return self.chosen(number, sim, f, k)

    def chosen(self, number: np.ndarray, sim: np.ndarray, f: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        self.query[f] = 0
        some = np.flatnonzero(sim > 1e-9)
        if len(some) > k:
            some = some[sim[some] >= np.partition(sim[some], -k)[-k]]
        some = some[np.lexsort((number[some], -sim[some]))][:k]
        return number[some], sim[some]

    def scores(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[int]]]:
        """score() of each query."""
        for i in range(0, len(queries), TOGETHER):
            some = queries[i : i + TOGETHER]
            for (f, w), head in zip(some, self.heads(some), strict=True):
                yield self.score(f, w, head)

    def score(self, f: np.ndarray, w: np.ndarray, head: np.ndarray | None = None) -> tuple[float, list[int]]:
        """Calibrated vote in 0..1 and the ids of the nearest examples."""
        at, sims = self.nearest(f, w, self.neighbours, head) if len(f) else (np.zeros(0, int), np.zeros(0))
        if not len(at):
            return self.without, []
        near = np.clip(sims, 0, 1)
        votes = near * near / (1.05 - near)  # many far examples are not to outvote a near one
        return float((votes @ self.labels[at] + self.share) / (votes.sum() + 1)), self.ids[at].tolist()


def profiles(rows: DataFrame) -> DataFrame:
    """(doc_id, label, words, times): different words with their times, of (doc_id, text, label)."""
    fields = "doc_id long, label int, words array<long>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 500):
            words, times = [], []
            for w in word_chunks(letters(b.column(1))):
                row, key, n = counted(np.repeat(np.arange(w.hi - w.lo), np.diff(w.cuts)), w.hashes)
                cuts = np.searchsorted(row, np.arange(1, w.hi - w.lo))
                words += np.split(key.view(np.int64), cuts)
                times += np.split(n.astype(np.int32), cuts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(words, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))], names=[x.split()[0] for x in fields.split(", ")])

    return rows.mapInArrow(run, fields)


def tied_features(rows: DataFrame, examples: DataFrame) -> np.ndarray:
    """Sorted keys of the features that toxic examples hold far more often than others; texts of the same words count once."""
    one = examples.groupBy(F.xxhash64("words"), "label").agg(F.min("doc_id").alias("doc_id"))
    kinds = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = kinds.get(1, 0), kinds.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, np.uint64)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 2000):
            sides = []
            for side in (1, 0):
                held = [np.zeros(0, np.uint64)]
                for w in word_chunks(letters(b.filter(pc.equal(b.column(0), side)).column(1))):
                    of = np.repeat(np.arange(w.hi - w.lo), np.diff(w.cuts))
                    held += [counted(of, w.hashes)[1], beginnings(w, of)[1]]
                sides.append(np.unique(np.concatenate(held), return_counts=True))
            (p, a), (q, c) = sides
            keys = np.union1d(p, q)
            pos, neg = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            pos[np.searchsorted(keys, p)], neg[np.searchsorted(keys, q)] = a, c
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(neg)], names=["feature", "pos", "neg"])

    rows = rows.join(F.broadcast(one.select("doc_id").distinct()), "doc_id").select("label", "text")  # at most `sample` rows
    counts = rows.mapInArrow(seen, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b")).where(F.col("a") >= max(4, SUPPORT * n1))
    a, b, c, d = F.col("a"), F.col("b"), F.lit(n1) - F.col("a"), F.lit(n0) - F.col("b")
    chi = F.lit(float(n1 + n0)) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * F.lit(float(n1)) * F.lit(float(n0)) + F.lit(1e-9))
    tied = counts.where((chi >= CHI) & (a * F.lit(n0) > b * F.lit(n1) * 3)).select("feature")
    return np.sort(tied.toArrow().column(0).to_numpy().view(np.uint64))  # at most 1 / SUPPORT times the features of one text, on average


def document_counts(docs: DataFrame, keys: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents that hold each feature of the sorted keys, documents), counted over all of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, tied))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tied = shared.value
        total, rows = np.zeros(len(own), np.int64), 0
        for b in rows_of(batches, 1000):
            rows += b.num_rows
            for w in word_chunks(letters(b.column(0))):
                of = np.repeat(np.arange(w.hi - w.lo), np.diff(w.cuts))
                key = np.concatenate((counted(of, w.hashes)[1], beginnings(w, of, tied)[1]))
                if len(own):
                    total += np.bincount(places(key, own)[is_in(key, own)], minlength=len(own))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], names=["feature", "n"])

    got = with_row_text(docs.select("text")).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # at most a row a feature
    at, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    out = np.zeros(len(keys), np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, neighbours: int = 15) -> tuple[Vocabulary, Index]:
    """Vocabulary and index of at most `sample` labelled rows of docs; only these reach the driver."""
    ensure_workers(docs.sparkSession)
    chosen = F.broadcast(labelled_sample(labels, "toxic", sample))
    rows = with_row_text(docs.select(F.col("doc_id").cast("long"), "text")).join(chosen, "doc_id").select("doc_id", "text", "label")
    examples = materialize(profiles(rows), "examples")
    tied = tied_features(rows, examples)
    # examples of the same words as often are one point: its label is their mean, its id the least
    points = examples.groupBy(F.xxhash64("words", "times").alias("point")).agg(F.min("doc_id").alias("doc_id"), F.avg("label").alias("label"))
    texts = rows.dropDuplicates(["doc_id"]).join(F.broadcast(points), "doc_id").select("doc_id", points["label"], "text")
    keys = np.union1d(np.sort(examples.select(F.explode("words").alias("w")).distinct().toArrow().column(0).to_numpy().view(np.uint64)), tied)
    df, n = document_counts(docs, keys, tied)
    worth = np.log(max(n, 1) / np.maximum(df, 1)) + 1
    worth[is_in(keys, tied)] *= BOOST
    own = Vocabulary(keys, worth, tied, float(np.log(max(n, 1)) + 1))
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def rep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 500):
            got = list(shared.value.vectors(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f.astype(np.int32) for f, _ in got], pa.list_(pa.int32())), pa.array([w.astype(np.float32) for _, w in got], pa.list_(pa.float32()))], names=["doc_id", "label", "f", "w"])

    held = texts.mapInArrow(rep, "doc_id long, label double, f array<int>, w array<float>").toArrow().combine_chunks()  # at most `sample` rows
    ids, label = held.column(0).to_numpy(), held.column(1).to_numpy()
    f, w = (held.column(k).combine_chunks() for k in (2, 3))
    off = f.offsets.to_numpy() if len(ids) else np.zeros(1, int)
    f, w = (f.flatten().to_numpy(), w.flatten().to_numpy()) if len(ids) else (np.zeros(0, np.int32), np.zeros(0, np.float32))
    lens = np.diff(off)
    lead = np.array([f[a + np.argmax(w[a:b])] if b > a else -1 for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], int)
    order = np.lexsort((ids, lead))
    order = order[lens[order] > 0]
    at = spans(off[:-1][order], off[1:][order])
    rest = label[lens == 0]
    share = float(label.mean()) if len(label) else 0.0
    index = Index(ids[order], label[order], np.concatenate(([0], np.cumsum(lens[order]))), f[at], w[at], len(keys), float(rest.mean()) if len(rest) else share, share, neighbours)
    return own, index


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, predicted, evidence): evidence holds the ids of the nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = shared.value
        index.build()
        memo: dict[bytes, tuple[float, list[int]]] = {}
        for b in rows_of(batches, 1000):
            queries = list(vocabulary.vectors(b.column(1)))
            keys = [hashlib.blake2b(f.tobytes() + w.tobytes(), digest_size=16).digest() for f, w in queries]
            if len(memo) > 20_000:
                memo.clear()
            fresh = {key: q for key, q in zip(keys, queries, strict=True) if key not in memo}
            memo.update(zip(fresh, index.scores(list(fresh.values())), strict=True))
            out = [memo[key] for key in keys]
            s = np.array([x for x, _ in out], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array([e for _, e in out], pa.list_(pa.int64()))], names=["doc_id", "score", "predicted", "evidence"])

    plain = with_row_text(docs.select(F.col("doc_id").cast("long"), "text"))
    return plain.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<long>")
