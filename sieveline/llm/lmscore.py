"""Language-model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of its bigram and its unigram and a
uniform share; the three weights depend on how often the context was seen, in octaves, and are
learned by expectation-maximisation on counts held out of the estimates. Words are lower-cased runs of
other than white space, then one end token a text.

Counts are exact over all learning texts and grow with the corpus, so they never leave the
executors: texts become blocks of tokens (numbers into the block's own vocabulary); a block asks
for the counts of its different words and bigrams, the asks are dealt by hash ranges, summed, and
answered to each block, which then scores its texts alone. A word or pair asked by every block is
one number of each, so common words make no hot task. A block sends at most FAN messages of a kind: where
there are more hash ranges than that, blocks form teams, a team's asks of one wide range are merged in one task and go on to
the ranges inside it, and the answers come back the same way. A team has as many blocks as there are wide
ranges, about the square root of the ranges, so a task merges what one block holds and messages grow
far slower than blocks times ranges. Teams store all asks and shuffle them twice, so they are left to some 8 billion
tokens and more. What EM needs of the held-out tokens is
a table over context octaves and quarter-octaves of both estimates, of bounded size.

Memory follows the size of a block and of a hash range, not the corpus: integers are compressed in their rows, blocks are few
to a file and read one at a time, and a task scores some BLOCKS_PER_TASK blocks.

Words are known by 64-bit hashes, bigrams by PAIR_BITS bits.

Defined results: a null or empty text is its end token alone; equal rows are scored and counted
each; a null doc_id teaches; an empty table gives an empty result; without held-out counts the
weights stay equal; other columns are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm._shared import ensure_workers, materialize, stream_groups, with_row_text
from sieveline.llm._text import doc_words, mix, release, rows_of

BLOCK_TOKENS = 1 << 20
ASKS_PER_TASK = 1 << 21
PAIR_BITS = 56
#: Messages of a kind that a block sends at most, some 256 pairs in each then; more hash ranges than that are reached through teams.
FAN = 4096
#: Blocks in a file: Spark's reader holds up to 4,096 rows of a file at once, and a block is one row of megabytes.
BLOCKS_PER_FILE = 4
#: Blocks that a task scores, about.
BLOCKS_PER_TASK = 8
CORE, HELD, TEST, TEAM = 0, 1, 2, 3
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)
OCTAVES = 40
MARKS = "block long, role int, doc_ids array<long>, lens binary, vocab binary, tokens binary, n_tokens long"


@cache
def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def squeeze(x: np.ndarray) -> bytes:
    """Integers as planes of bytes, which compress well where high bytes are alike; compressed here, as rows would
    otherwise stand at full length in Arrow batches, sorts and readers of files."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return len(x).to_bytes(4, "little") + _zstd().compress(planes, asbytes=True)


def spread(raw: bytes, kind: type) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(_zstd().decompress(memoryview(raw)[4:], n * size), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(-1)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left ^ np.uint64(0xA5A5A5A5A5A5A5A5)) + right * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - PAIR_BITS)


def role_of(doc_id: int | None, parts: int, test: int, held: int) -> int:
    if doc_id is None:
        return CORE
    k = zlib.crc32(str(doc_id).encode()) % parts
    return TEST if k == test else HELD if k == held else CORE


def blocks(docs: DataFrame, parts: int, test: int, held: int, block_tokens: int) -> DataFrame:
    """Texts as blocks of tokens, each of one role."""
    ensure_workers(docs.sparkSession)
    names = [x.split()[0] for x in MARKS.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[list, list[np.ndarray]]]] = {CORE: [], HELD: [], TEST: []}
        size = dict.fromkeys(waiting, 0)

        def flush(role: int) -> pa.RecordBatch:
            nonlocal number
            ids = [d for d, _ in waiting[role]]
            words = [w for _, w in waiting[role]]
            lens = np.array([len(w) for w in words], np.uint32)
            vocab, tokens = np.unique(np.concatenate(words), return_inverse=True)
            row = [number, role, ids, squeeze(lens), squeeze(np.diff(vocab, prepend=np.uint64(0))), squeeze(tokens.astype(np.uint32)), int(lens.sum())]
            number += 1
            waiting[role], size[role] = [], 0
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

        for b in rows_of(batches, 2000):
            h, off = doc_words(b.column(1))
            for i, doc in enumerate(b.column(0).to_pylist()):
                role = role_of(doc, parts, test, held)
                waiting[role].append((doc, np.append(h[off[i] : off[i + 1]], END)))
                size[role] += int(off[i + 1] - off[i]) + 1
                if size[role] >= block_tokens:
                    yield flush(role)
        for role in waiting:
            if waiting[role]:
                yield flush(role)

    return with_row_text(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(cut, MARKS)


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lens, vocab, tokens, different pairs, pair of each token, context of each token: its number in vocab, -1 at a start)."""
    lens, vocab, tokens = spread(row["lens"], np.uint32).astype(np.int64), np.cumsum(spread(row["vocab"], np.uint64)), spread(row["tokens"], np.uint32).astype(np.int64)
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[np.concatenate(([0], np.cumsum(lens)[:-1]))] = -1
    left = np.where(context < 0, START, vocab[context])
    pairs, of = np.unique(pair_keys(left, vocab[tokens]), return_inverse=True)
    return lens, vocab, tokens, pairs, of, context


ASK = "kind int, bucket int, block long, role int, hashes binary, counts binary, core binary"
ANSWER = "block long, role int, kind int, bucket int, counts binary, core binary, n long, n_core long, v long, v_core long"


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in fields.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], names=list(names))


def _small(x: np.ndarray) -> bytes:
    return squeeze(np.minimum(x, 2**32 - 1).astype(np.uint32))


def _cut(keys: np.ndarray, bits: int, low: int, high: int) -> Iterator[tuple[int, slice]]:
    """(range, where its keys are) of each range low..high - 1, a range being the keys of equal top bits, that holds any of the sorted keys."""
    edge = np.searchsorted(keys >> np.uint64(bits), np.arange(low, high + 1, dtype=np.uint64)) if bits < 64 else np.array([0, len(keys)])
    for k in range(high - low):
        if edge[k] < edge[k + 1]:
            yield low + k, slice(int(edge[k]), int(edge[k + 1]))


def _shift(kind: int, buckets: int) -> int:
    return (64 if kind == 1 else PAIR_BITS) - (buckets - 1).bit_length()


def asks(marked: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, block, role, hashes, counts, core): a block's different words (1) and pairs (2) with their counts in it, none in core."""

    def of_block(row: dict) -> pa.RecordBatch:
        _, vocab, tokens, pairs, of, _ = _open(row)
        rows = []
        for kind, keys, counts in ((1, vocab, np.bincount(tokens, minlength=len(vocab))), (2, pairs, np.bincount(of, minlength=len(pairs)))):
            for k, at in _cut(keys, _shift(kind, buckets), 0, buckets):
                rows.append((kind, k, row["block"], row["role"], squeeze(np.diff(keys[at], prepend=np.uint64(0))), squeeze(counts[at].astype(np.uint32)) if row["role"] != TEST else None, None))
        return _batch(rows, ASK)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield of_block(b.slice(i, 1).to_pylist()[0])
        release()

    return marked.select("block", "role", "lens", "vocab", "tokens").mapInArrow(ask, ASK)


def _summed(t: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends of the asks' hashes, different hashes, number of each hash asked among them, learning counts, those of them not held out)."""
    hashes = [np.cumsum(spread(x, np.uint64)) for x in t.column("hashes").to_pylist()]
    ends = np.cumsum([0, *map(len, hashes)])
    hashes = np.concatenate(hashes)
    keys, of = np.unique(hashes, return_inverse=True)
    every, core = np.zeros(len(hashes)), np.zeros(len(hashes))
    for i, (role, c, own) in enumerate(zip(t.column("role").to_pylist(), t.column("counts").to_pylist(), t.column("core").to_pylist(), strict=True)):
        if c is not None:
            every[ends[i] : ends[i + 1]] = spread(c, np.uint32)
            if role == CORE:
                core[ends[i] : ends[i + 1]] = spread(own or c, np.uint32)
            elif own is not None:
                core[ends[i] : ends[i + 1]] = spread(own, np.uint32)
    return ends.tolist(), keys, of, np.bincount(of, every, len(keys)), np.bincount(of, core, len(keys))


def answers(asked: DataFrame, parts: int) -> DataFrame:
    """(block, role, kind, bucket, counts, core, n, n_core, v, v_core): counts of all learning texts for each hash
    asked, in its order; for held-out blocks and teams those without the held-out texts too. Rows of block -1 carry totals."""

    def answer(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, bucket = key
        ends, _, of, every, core = _summed(t)
        rows = [(-1, -1, kind, bucket, None, None, int(every.sum()), int(core.sum()), int((every > 0).sum()), int((core > 0).sum()))]
        for i, (b, r) in enumerate(zip(t.column("block").to_pylist(), t.column("role").to_pylist(), strict=True)):
            here = of[ends[i] : ends[i + 1]]
            rows.append((b, r, kind, bucket, _small(every[here]), _small(core[here]) if r in (HELD, TEAM) else None, 0, 0, 0, 0))
        yield _batch(rows, ANSWER)

    return stream_groups(asked, ["kind", "bucket"], answer, ANSWER, parts)


def answers_by_teams(asked: DataFrame, wide: int, buckets: int, teams: int, parts: int) -> DataFrame:
    """answers() to asks of `wide` ranges, worked out over `buckets` ranges: teams of blocks merge what they ask."""
    teamed = asked.withColumn("team", F.pmod(F.xxhash64("block"), F.lit(teams)))
    inside = buckets // wide

    def merge(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, bucket, team = key
        _, keys, _, every, core = _summed(t)
        yield _batch([(kind, k, team, TEAM, squeeze(np.diff(keys[at], prepend=np.uint64(0))), _small(every[at]), _small(core[at])) for k, at in _cut(keys, _shift(kind, buckets), bucket * inside, (bucket + 1) * inside)], ASK)

    told = materialize(answers(stream_groups(teamed, ["kind", "bucket", "team"], merge, ASK, parts), parts), "team-counts")

    def hand_out(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, bucket, _ = key
        own, told = t.filter(pc.is_valid(t.column("hashes"))), t.filter(pc.is_null(t.column("hashes"))).sort_by("range")
        if not own.num_rows:
            return
        ends, _, of, _, _ = _summed(own)
        every, core = (np.concatenate([spread(x, np.uint32) for x in told.column(c).to_pylist()]) for c in ("counts", "core"))
        rows = []
        for i, (b, r) in enumerate(zip(own.column("block").to_pylist(), own.column("role").to_pylist(), strict=True)):
            here = of[ends[i] : ends[i + 1]]
            rows.append((b, r, kind, bucket, _small(every[here]), _small(core[here]) if r == HELD else None, 0, 0, 0, 0))
        yield _batch(rows, ANSWER)

    back = told.where("block >= 0").select("kind", F.col("bucket").alias("range"), (F.col("bucket") / inside).cast("int").alias("bucket"), F.col("block").alias("team"), F.lit(None).cast("long").alias("block"), "role", F.lit(None).cast("binary").alias("hashes"), "counts", "core")
    both = teamed.withColumn("range", F.lit(-1)).select(*back.columns).unionByName(back)
    return stream_groups(both, ["kind", "bucket", "team"], hand_out, ANSWER, parts).unionByName(told.where("block = -1"))


def _gathered(right: pa.Table, column: str) -> dict[int, np.ndarray]:
    """kind -> counts in the order of the block's sorted hashes."""
    out = {}
    for kind in (1, 2):
        rows = sorted((b, c) for k, b, c in zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column(column).to_pylist(), strict=True) if k == kind)
        out[kind] = np.concatenate([spread(c, np.uint32) for _, c in rows]).astype(np.float64)
    return out


def _estimates(row: dict, got: dict[int, np.ndarray], n: float) -> tuple[np.ndarray, ...]:
    """(bigram estimate, unigram estimate, context octave, unigram count, lens) of each token."""
    lens, vocab, tokens, _, of, context = _open(row)
    one, two = got[1][tokens], got[2][of]
    starts = got[1][np.searchsorted(vocab, END)]  # as many starts as ends
    seen = np.where(context < 0, starts, got[1][context])
    f2 = np.divide(two, seen, out=np.zeros(len(two)), where=seen > 0)
    octave = np.where(seen > 0, np.minimum(np.log2(np.maximum(seen, 1)).astype(int) + 1, OCTAVES - 1), 0)
    return np.minimum(f2, 1), one / max(n, 1), octave, one, lens


def learn_weights(table: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) by context octave, from rows (octave, f2, f1, tokens)."""
    weights = np.full((OCTAVES, 3), 1 / 3)
    if not len(table):
        return weights
    octave, n = table[:, 0].astype(int), table[:, 3]
    f = np.stack([table[:, 1], table[:, 2], np.full(len(table), uniform)], 1)
    for _ in range(rounds):
        part = weights[octave] * f
        part *= (n / np.maximum(part.sum(1), 1e-300))[:, None]
        total = np.stack([np.bincount(octave, part[:, k], OCTAVES) for k in range(3)], 1)
        mass = total.sum(1)
        fresh = np.where(mass[:, None] > 0, (total + 1e-3) / (mass[:, None] + 3e-3), weights)
        if np.abs(fresh - weights).max() < 1e-9:
            break
        weights = fresh
    seen = np.flatnonzero(np.bincount(octave, n, OCTAVES) > 0)
    for k in range(OCTAVES):  # octaves without held-out tokens follow the nearest that has some
        if k not in seen:
            weights[k] = weights[seen[np.argmin(np.abs(seen - k))]]
    return weights


def exchanged(marked: DataFrame, asks_per_task: int = ASKS_PER_TASK, fan: int = FAN) -> DataFrame:
    """answers() to all blocks, by one step of messages or by two."""
    total, blocks_n = marked.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    least = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max(3, (max(total // asks_per_task, 1) - 1).bit_length())
    if buckets <= fan:
        return answers(asks(marked, buckets), max(2 * buckets, least))
    wide = max(fan, 1 << ((buckets - 1).bit_length() + 1) // 2)
    teams = max(1, -(-blocks_n // wide))
    return answers_by_teams(materialize(asks(marked, wide), "asks"), wide, buckets, teams, max(2 * buckets, least))


def _dealt(own: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and what they were told, dealt by block to more tasks than usual where a task would have many blocks."""
    tasks = -(-own.count() // BLOCKS_PER_TASK)
    if tasks <= int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return own, told
    return own.repartition(tasks, "block"), told.repartition(tasks, "block")


def score(docs: DataFrame, parts: int = 7, test: int = 2, held: int = 6, block_tokens: int = BLOCK_TOKENS, asks_per_task: int = ASKS_PER_TASK, fan: int = FAN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learned from texts whose
    crc32(doc_id as text) mod parts is not `test`, weights from those where it is `held`."""
    spark = docs.sparkSession
    marked = materialize(blocks(docs, parts, test, held, block_tokens), "blocks", rows_per_file=BLOCKS_PER_FILE)
    replies = materialize(exchanged(marked, asks_per_task, fan), "counts")
    sums = replies.where("block = -1 and kind = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_core", "v", "v_core"))).first()
    uniform, uniform_core = 1 / (sums["v"] + 1), 1 / (sums["v_core"] + 1)
    n_all, n_core = sums["n"], sums["n_core"]

    def events(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            f2, f1, octave, _, _ = _estimates(left.to_pylist()[0], _gathered(right, "core"), n_core)
            q = lambda f: np.where(f > 0, np.round(-4 * np.log2(np.maximum(f, 1e-30))).astype(int), 999)
            key, of = np.unique((octave * 1000 + q(f2)) * 1000 + q(f1), return_inverse=True)
            out = [key // 1_000_000, key // 1000 % 1000, key % 1000, np.bincount(of), np.bincount(of, f2), np.bincount(of, f1)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out or [[]] * 6, kinds, strict=True)], names=["octave", "q2", "q1", "n", "s2", "s1"])

    own, told = _dealt(marked.where(F.col("role") == HELD), replies.where(F.col("role") == HELD))
    seen = own.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(events, "octave long, q2 long, q1 long, n long, s2 double, s1 double")
    table = seen.groupBy("octave", "q2", "q1").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).orderBy("octave", "q2", "q1").toPandas()  # bounded by the octaves and steps
    weights = learn_weights(np.stack([table["octave"], table["s2"] / table["n"], table["s1"] / table["n"], table["n"]], 1).astype(float) if len(table) else np.zeros((0, 4)), uniform_core)

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list = [[]] * 7
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            f2, f1, octave, one, lens = _estimates(row, _gathered(right, "counts"), n_all)
            p = weights[octave, 0] * f2 + weights[octave, 1] * f1 + weights[octave, 2] * uniform
            at = np.concatenate(([0], np.cumsum(lens)[:-1]))
            base = np.log10((one + 1) / (n_all + sums["v"] + 1))
            cols = [row["doc_ids"], [row["role"] == TEST] * len(lens), lens, np.add.reduceat((one > 0).astype(np.int64), at), np.full(len(lens), n_all), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    own, told = _dealt(marked, replies.where("block >= 0").select("block", "kind", "bucket", "counts"))
    return own.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
