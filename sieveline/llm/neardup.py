"""MinHash near-duplicates over compressed HyperMinHash registers.

A text's shingles fall into REGISTERS buckets; a bucket keeps of its least hash only the number of
leading zeros and some mantissa bits (16 bits in all). Runs of ROWS registers are band keys. Texts
that share a band key are candidates; a Jaccard estimate from equal registers, corrected for
values that agree by chance, drops the hopeless ones, and full shingle sets decide about the rest.

A set of few shingles leaves most buckets empty, and a band of one shingle and five empty buckets would put all short
texts with one common sentence in one list. Sets of up to SHORT shingles so have the keys of SHORT_BANDS bands whose registers
each hold the least of another hash over the whole set; sets of larger ones, and of sizes that can be similar to
these, have the keys of the buckets. Sets too small to be similar enough to any other set have no key.

No pair list is made. Texts of one shingle set are one class from the start. A band key's classes
are a list; equal lists are one. A list of more than LIST_MOST classes or LIST_SHINGLES shingles is long: it is
dealt twice at random into parts within these bounds, which joins groups of near copies, and then every class
outside the list's largest component is dealt against all parts, so every two classes meet that are
not one component already. Within a list the exact sets are
compared with one leader after another, skipping texts already linked, and only the links of a
spanning forest leave the task; components join them. A long list of near copies so costs its length; one
of texts that share a key and little else costs its square over LIST_MOST.

Two texts at the threshold of 0.85 share none of the 32 keys of 6 registers with a chance of 3e-7, at 0.80 of
6e-5 (short texts, with 40 keys: 6e-9 and 5e-6); no other step loses a link. Shingles and sets are known by 64-bit hashes.

Defined results: null and empty texts have 0 shingles and link with nothing; copies link, however
short; equal rows and repeated ids are judged each; a null doc_id never represents others unless all
are null; an empty table gives an empty result; other columns are ignored by `near_duplicates`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm._shared import connected_components, ensure_workers, materialize, partitions_for, stream_groups, with_row_text
from sieveline.llm._text import doc_words, mix, rows_of

ROWS, BANDS = 6, 32
REGISTERS = ROWS * BANDS
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
SHORT = 2 * REGISTERS
SHORT_BANDS = 40
LIST_MOST = 2_000
LIST_SHINGLES = 4_000_000  # 8 bytes each


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Different shingle hashes of a text's word hashes, sorted; the whole text is one if it is shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    h = mix(words[: len(words) - size + 1] + np.uint64(size))
    for k in range(1, size):
        h = mix(h * np.uint64(3) + words[k : len(words) - size + 1 + k])
    return np.unique(h)


def registers(sets: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """(rows, REGISTERS) of 16 bits: leading zeros and mantissa of the least hash in each bucket, EMPTY without any."""
    bucket = (sets % np.uint64(REGISTERS)).astype(np.int64)
    value = mix(sets ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(12)  # 52 bits, exact as doubles
    least = np.full(rows * REGISTERS, np.uint64(1 << 52), np.uint64)
    np.minimum.at(least, of * REGISTERS + bucket, value)
    return packed(least).reshape(rows, REGISTERS)


def packed(least: np.ndarray) -> np.ndarray:
    """Hashes of 52 bits as leading zeros and mantissa; EMPTY for 1 << 52."""
    full = least < np.uint64(1 << 52)
    fraction, exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    zeros = np.minimum(52 - exponent, 62)
    low = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return np.where(full, (zeros << MANTISSA) | low, int(EMPTY)).astype(np.uint16)


def short_registers(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(rows, registers) of 16 bits: of each set, none of them empty, the least of each of SHORT_BANDS * ROWS hashes."""
    least = np.empty((len(starts), len(FACTORS)), np.uint64)
    for k, factor in enumerate(FACTORS):
        least[:, k] = np.minimum.reduceat(sets * factor, starts)
    return packed(least >> np.uint64(12))


def band_keys(regs: np.ndarray, columns: np.ndarray, first: int = 1) -> np.ndarray:
    """(rows, bands) of 64-bit keys, bands numbered from `first`; 0 where a band has no value at all."""
    out = np.zeros((len(regs), len(columns)), np.uint64)
    for b, cols in enumerate(columns):
        part = regs[:, cols]
        h = np.full(len(regs), np.uint64(b + first), np.uint64)
        for k in range(part.shape[1]):
            h = mix(h * np.uint64(5) + part[:, k].astype(np.uint64))
        out[:, b] = np.where((part == EMPTY).all(1), np.uint64(0), h | np.uint64(1))
    return out


SHALLOW = np.arange(REGISTERS).reshape(BANDS, ROWS)
WHOLE = np.arange(SHORT_BANDS * ROWS).reshape(SHORT_BANDS, ROWS)
FACTORS = mix(np.arange(1, WHOLE.size + 1, dtype=np.uint64)) | np.uint64(1)  # a shingle's hash times an odd number is another hash


def octaves(n: np.ndarray) -> np.ndarray:
    """(rows, 60): how likely a register's least hash has so many leading zeros, for sets of sizes n."""
    i = np.arange(60)
    n = np.asarray(n, float)[:, None] / REGISTERS
    return np.exp(-n * 0.5 ** (i + 1)) - np.exp(-n * 0.5**i)


def estimate(regs: np.ndarray, zeros: np.ndarray, i: int) -> np.ndarray:
    """Estimated Jaccard similarity of row i with every row: the share of equal registers, less those of
    different least hashes that agree by chance, in zeros (octaves() of the sizes) and mantissa."""
    used = (regs != EMPTY) | (regs[i] != EMPTY)
    same = ((regs == regs[i]) & used).sum(1) / np.maximum(used.sum(1), 1)
    chance = zeros @ zeros[i] / (1 << MANTISSA)
    return (same - chance) / (1 - chance)


def set_keys(flat: np.ndarray, lens: np.ndarray, regs: np.ndarray, numerator: int, denominator: int) -> list[np.ndarray]:
    """The band keys of each set. Of two sets similar enough, both have the keys of short sets or both those of the buckets."""
    links = (lens > 0) & (denominator * lens >= numerator * (lens + 1))  # most similar is a set of one shingle more
    short, long = links & (lens <= SHORT), links & (denominator * lens >= numerator * SHORT)
    out = [np.zeros(0, np.int64)] * len(lens)
    if short.any():
        rows, own = np.flatnonzero(short), flat[np.repeat(short, lens)]
        keys = band_keys(short_registers(own, np.cumsum(lens[rows]) - lens[rows]), WHOLE, BANDS + 1)
        for i, k in zip(rows.tolist(), keys.astype(np.int64), strict=True):
            out[i] = k
    rows = np.flatnonzero(long)
    for i, k in zip(rows.tolist(), band_keys(regs[rows], SHALLOW).astype(np.int64), strict=True):
        out[i] = np.concatenate((out[i], k[k != 0]))
    return out


def signatures(docs: DataFrame, size: int, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """(doc_id, n_shingles, node, text_hash, regs, keys) of each row; node is the hash of the set, null without one."""
    ensure_workers(docs.sparkSession)
    fields = "doc_id long, text_hash long, n_shingles long, node long, regs binary, keys array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1000):
            h, off = doc_words(b.column(2))
            sets = [shingles(h[off[i] : off[i + 1]], size) for i in range(b.num_rows)]
            lens = np.array([len(s) for s in sets], np.int64)
            flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), lens)
            regs = registers(flat, of, len(sets))
            keys = set_keys(flat, lens, regs, numerator, denominator)
            ends = np.concatenate(([0], np.cumsum(lens)))
            sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(flat + np.uint64(7)))))  # a set's sum of mixed hashes names it
            node = mix((sums[ends[1:]] - sums[ends[:-1]]) ^ lens.astype(np.uint64)).astype(np.int64)
            empty = lens == 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lens), pa.array(node, mask=empty), pa.array([None if e else r.tobytes() for e, r in zip(empty, regs, strict=True)], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[x.split()[0] for x in fields.split(", ")],
            )

    plain = with_row_text(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return plain.mapInArrow(sign, fields)


def _parts(n: str, weight: str, most: int, heavy: int) -> Column:
    return F.ceil(F.greatest(F.col(n) / max(most // 2, 1), F.col(weight) / max(heavy // 2, 1))).cast("int")


def candidate_lists(signed: DataFrame, most: int = LIST_MOST, heavy: int = LIST_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """((list, node, comp), long): nodes that share a band key are in a list together, but for those of the long
    keys (key, node, n_shingles, parts), whose lists are only two random dealings; comp is the node itself."""
    keyed = signed.where("node is not null").select("node", "n_shingles", F.explode("keys").alias("key"))
    busy = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key")
    members = materialize(keyed.join(busy.hint("shuffle_hash"), "key").select("key", "node", "n_shingles").distinct(), "members")
    counted = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    sized = members.join(counted.hint("shuffle_hash"), "key")
    fits = (F.col("n") <= most) & (F.col("weight") <= heavy)
    short = sized.where(fits).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    short = short.select(F.xxhash64("nodes").alias("list"), "nodes").dropDuplicates(["list"]).select("list", F.explode("nodes").alias("node"))
    long = materialize(sized.where(~fits).select("key", "node", "n_shingles", _parts("n", "weight", most, heavy).alias("parts")), "long-lists")
    for deal in (1, 2):
        short = short.unionByName(long.select(F.xxhash64("key", F.lit(deal), _part(deal)).alias("list"), "node"))
    return materialize(short.withColumn("comp", F.col("node")), "lists"), long


def _part(deal: int, parts: str = "parts") -> Column:
    return F.pmod(F.xxhash64("node", F.lit(deal)), F.col(parts)).cast("int")


def remaining_lists(long: DataFrame, roots: DataFrame, most: int = LIST_MOST, heavy: int = LIST_SHINGLES) -> DataFrame:
    """(list, node, comp): every two nodes of a long key that are of different components are in a list together."""
    known = materialize(long.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), "long-components")
    groups = known.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = groups.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    marked = known.join(main, "key").withColumn("rest", F.col("comp") != F.col("main"))
    left = marked.where("rest").groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    left = left.select("key", _parts("n", "weight", most, heavy).alias("turns"))
    marked = marked.join(left, "key").withColumn("p", _part(1)).withColumn("r", _part(3, "turns"))
    name = lambda r, p: F.xxhash64("key", F.lit(9), r, p).alias("list")
    every = marked.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select(name(F.col("turn"), F.col("p")), "node", "comp")
    rest = marked.where("rest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(name(F.col("r"), F.col("part")), "node", "comp")
    return materialize(every.unionByName(rest).distinct(), "remaining-lists")


def promising(lists: DataFrame, nodes: DataFrame, numerator: int, denominator: int, parts: int) -> DataFrame:
    """The members of each list that some member of another component may be similar enough to, by the corrected estimate."""
    slack = 5 * np.sqrt(numerator / denominator * (1 - numerator / denominator) / REGISTERS) + 1e-9

    def keep(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        n, zeros = t.num_rows, octaves(t.column("n_shingles").to_numpy())
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        if n == 1:
            return
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        # few registers in use make a rough estimate: its error follows their number
        few = np.minimum(np.maximum((regs != EMPTY).sum(1), 1), REGISTERS)
        near = np.zeros(n, bool)
        for i in range(n):
            if not near.all():
                close = estimate(regs, zeros, i) >= numerator / denominator - slack * np.sqrt(REGISTERS / np.minimum(few, few[i]))
                close[comp == comp[i]] = False
                near |= close
                near[i] |= close.any()
        if near.any():
            kept = np.flatnonzero(near)
            name = int(mix(np.cumsum(mix(node[kept].astype(np.uint64)))[-1:])[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), name)), pa.array(node[kept]), pa.array(comp[kept])], names=["list", "node", "comp"])

    joined = lists.join(nodes.select("node", "n_shingles", "regs"), "node")
    return stream_groups(joined, ["list"], keep, "list long, node long, comp long", parts).distinct()


def forest(sets: list[np.ndarray], comp: np.ndarray, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Links that join all sets which chains of similar pairs join, given their components so far: each leader is
    compared with all sets still open, and only sets of other components can tell anything new."""
    lens = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    comp, open_, links = comp.copy(), np.ones(len(sets), bool), []
    mark = np.zeros(flat.max() + 1, np.int64)
    while True:
        names, sizes = np.unique(comp[open_], return_counts=True)
        if len(names) < 2:
            return links
        lead = int(np.flatnonzero(open_ & (comp == names[np.argmin(sizes)]))[0])
        own = flat[starts[lead] : starts[lead] + lens[lead]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        hits = np.flatnonzero(open_ & (denominator * both >= numerator * (lens + lens[lead] - both)) & (comp != comp[lead]))
        for j in hits.tolist():
            if comp[j] != comp[lead]:
                links.append((lead, j))
                comp[comp == comp[j]] = comp[lead]
        open_[lead] = False


def confirmed(lists: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, numerator: int, denominator: int, parts: int) -> DataFrame:
    """(a, b): links between nodes, confirmed on full sets, that span each list's components."""
    wanted = lists.select("node").distinct().join(nodes.select("node", "row"), "node")
    # one text of each set that some list holds; at scale Spark filters the scan by the hashes wanted
    texts = with_row_text(docs.select(F.col("doc_id").cast("long"), "text")).select(F.xxhash64(F.xxhash64("text"), "doc_id").alias("row"), "text")
    # copies have rows of their own, and so go to many tasks and meet nothing there; repeated rows go where the join
    # put them, before their sets are made: sets, larger than texts, are not shuffled for it
    texts = texts.join(wanted.hint("shuffle_hash"), "row").dropDuplicates(["row"]).select("node", "text")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1000):
            h, off = doc_words(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(h[off[i] : off[i + 1]], size).tobytes() for i in range(b.num_rows)], pa.binary())], names=["node", "members"])

    sets = materialize(texts.mapInArrow(fill, "node long, members binary"), "sets")

    def link(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        node = t.column("node").to_numpy()
        links = forest([np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()], t.column("comp").to_numpy(), numerator, denominator)
        if links:
            a, b = np.array(links).T
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return stream_groups(lists.join(sets, "node"), ["list"], link, "a long, b long", parts)


def near_duplicates(docs: DataFrame, size: int = 5, numerator: int = 80, denominator: int = 100, most: int = LIST_MOST, heavy: int = LIST_SHINGLES) -> DataFrame:
    """(doc_id, text_hash, node, n_shingles, component_id, kept) of each row of docs: links are pairs of texts
    with denominator * |A and B| >= numerator * |A or B| over shingles of `size` words."""
    spark = docs.sparkSession
    signed = materialize(signatures(docs, size, numerator, denominator), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.min("n_shingles").alias("n_shingles"))
    # of a set's least text, one row stands for all copies; it is known by its hash and id
    regs = signed.where("node is not null").groupBy("node", "text_hash").agg(F.first("regs").alias("regs"), F.xxhash64("text_hash", F.min("doc_id")).alias("row"))
    nodes = materialize(nodes.join(regs, ["node", "text_hash"]), "nodes")
    lists, long = candidate_lists(signed, most, heavy)

    def linked(lists: DataFrame) -> DataFrame:
        good = materialize(promising(lists, nodes, numerator, denominator, partitions_for(spark, lists.count(), 20_000)), "promising")
        return materialize(confirmed(good, docs, nodes, size, numerator, denominator, partitions_for(spark, good.count(), 10_000)), "links")

    links = linked(lists)
    roots = connected_components(links)
    if not long.isEmpty():
        links = links.unionByName(linked(remaining_lists(long, roots, most, heavy)))
        roots = connected_components(links)
    comp = nodes.select("node", "least").join(roots.hint("shuffle_hash"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rep = comp.groupBy("root").agg(F.min("least").alias("component_id"))
    comp = comp.join(rep, "root").select("node", "component_id")
    out = signed.select("doc_id", "text_hash", "node", "n_shingles").join(comp, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "node", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each group of near-duplicates, in its columns; rows without words all stay."""
    got = near_duplicates(docs, **how)
    kept = got.where("kept and node is not null").select(F.col("doc_id").alias("__sv_id"), F.col("text_hash").alias("__sv_h"), "node").distinct()
    kept = kept.groupBy("node", "__sv_id").agg(F.min("__sv_h").alias("__sv_h"))  # texts that differ only in spaces or case under one id
    rows = docs.withColumn("__sv_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("__sv_hash", F.xxhash64("__sv_text"))
    wordless = rows.where(~F.col("__sv_text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
    one = rows.join(kept.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(kept["__sv_id"]) & (rows["__sv_hash"] == kept["__sv_h"])).select(*[rows[c] for c in docs.columns], "__sv_hash")
    return wordless.unionByName(one.dropDuplicates(["doc_id", "__sv_hash"]).select(*docs.columns))
