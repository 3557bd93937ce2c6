"""Alignment of two tokenizers over the same texts: groups of tokens that cover the same bytes, and links of tokens that end together.

A text is encoded on both sides; the cumulative byte ends of its tokens are two rising lists, merged by two pointers: where both
lists hold an end, the tokens since the last such place are a group, and the tokens ending there are linked. Tasks emit a row for each
document (counts, the digest of its groups, the groups themselves if asked for) and, for each block of documents, a row for
each linked id pair with the documents that hold it. Spark adds up the pairs' counts over the corpus and takes each id's highest; counts and
maxima are joined back to the blocks' rows, which meet by block to give sums by document. A pair that every document holds is one row
a block, not one a document.

Side A reads a space and the text, side B the text (its tokenizer adds the space). Special tokens inside texts are plain text on both sides.

Defined results: a text that is null or empty, or that one side's tokens do not give back byte by byte, has no tokens and zeros;
where tokens without bytes end together, all pairs of them are links; repeated rows are documents each; an empty table gives an
empty result; other columns are ignored, whatever their names. Texts are encoded whole: a document must fit a task's memory."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm._shared import ensure_workers, materialize, partitions_for, stream_groups
from sieveline.llm._text import release

BLOCK_CHARS = 1 << 22
BLOCK_DOCS = 1 << 15
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: how byte-level vocabularies cut texts
LONG_RUN = re.compile(r"\S{400}|\s{400}")
TOLD = "kind string, block long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, a int, b int, n long, docs binary, times binary"
_tokenizers: dict[tuple[str, str], Side] = {}


def byte_characters() -> dict[str, int]:
    """The characters of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes for 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer: ids of texts, and each id's bytes, their number, and its decimal form."""

    def __init__(self, pieces: list[bytes]):
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.pieces = pieces
        names = [str(i) for i in range(len(pieces))]
        self.cells, self.digits = _cells(names), np.array(list(map(len, names)))

    @staticmethod
    def at(path: str, kind: str) -> Side:
        if (path, kind) not in _tokenizers:
            _tokenizers[path, kind] = (ByteLevel if kind == "byte_level" else Pieces)(path)
        return _tokenizers[path, kind]

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError


class ByteLevel(Side):
    """A byte-level vocabulary in JSON. Where its ids are in the order of its merges, which the file shows, texts go
    through a faster encoder made of its entries; those with very long runs, and any other vocabulary, through the file's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, split = whole["model"], whole.get("pre_tokenizer") or {}
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        of = byte_characters()
        vocab = self.slow.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            pieces[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        super().__init__(pieces)
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        made = [model["vocab"][m] for m in joined]
        self.fast = None
        plain = {k: v for k, v in split.items() if k != "trim_offsets"} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if made == sorted(merged := set(made)) and plain and not model.get("ignore_merges"):
            import tiktoken

            ranks = {pieces[i]: i for token, i in model["vocab"].items() if len(token) == 1 or i in merged}
            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            if self.fast is None or LONG_RUN.search(text):
                out.append(self.slow.encode(text, add_special_tokens=False).ids)
            else:
                out.append(self.fast.encode_ordinary(text))
        return out


class Pieces(Side):
    """A sentencepiece model: U+2581 is a space, <0xHH> a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in named])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def merge_ends(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Two pointers over the rising ends of both sides: (groups, links). A group is (first and end place in a, then in b) of the
    tokens up to a common end; a link is a pair of places whose tokens end together."""
    groups, links = [], []
    i = j = from_a = from_b = 0
    na, nb = len(a), len(b)
    while i < na and j < nb:
        x, y = a[i], b[j]
        if x < y:
            i += 1
        elif y < x:
            j += 1
        else:
            i1, j1 = i + 1, j + 1
            while i1 < na and a[i1] == x:
                i1 += 1
            while j1 < nb and b[j1] == x:
                j1 += 1
            if i1 - i == 1 and j1 - j == 1:
                links.append((i, j))
            else:
                links.extend((p, q) for p in range(i, i1) for q in range(j, j1))
            groups.append((from_a, i1, from_b, j1))
            i, j = from_a, from_b = i1, j1
    return groups, links


def merge_runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """merge_ends for strictly rising ends: the places (in a, in b) of the ends they share. Both lists one after the other are two
    rising runs, which a stable sort merges in one pass, as two pointers would, equal ends next to each other."""
    order = np.argsort(np.concatenate((a, b)), kind="stable")
    ends = np.concatenate((a, b))[order]
    at = np.flatnonzero(ends[1:] == ends[:-1])
    return order[at], order[at + 1] - len(a)


def _cells(names: list[str]) -> np.ndarray:
    """Each name as bytes with a place for the sign after it, padded by zeros."""
    wide = max(map(len, names)) + 1
    out = np.zeros((len(names), wide), np.uint8)
    for i, name in enumerate(names):
        out[i, : len(name)] = np.frombuffer(name.encode(), np.uint8)
    return out


def _written(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, sides: tuple[Side, Side]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): `a1,a2|b1;a3|b2,b3;` for the ids a and b whose groups end at at_a and at_b, and where each group's text ends."""
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[at_a] = last_b[at_b] = True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    place_a = np.arange(len(a)) + np.concatenate(([0], at_b + 1))[group_a]  # after the b of the groups before
    place_b = np.arange(len(b)) + (at_a + 1)[group_b]  # after the a of its own group
    wide = max(s.cells.shape[1] for s in sides)
    text = np.zeros((len(a) + len(b), wide), np.uint8)
    for place, ids, side, last, sign in ((place_a, a, sides[0], last_a, b"|"), (place_b, b, sides[1], last_b, b";")):
        rows = np.zeros((len(ids), wide), np.uint8)
        rows[:, : side.cells.shape[1]] = side.cells[ids]
        rows[np.arange(len(ids)), side.digits[ids]] = np.where(last, sign[0], b","[0])
        text[place] = rows
    kept = text != 0
    lengths = np.cumsum(kept.sum(1))
    return text[kept], lengths[place_b[at_b]]


def _block(rows: list[tuple], block: int, sides: tuple[Side, Side], with_groups: bool) -> Iterator[pd.DataFrame]:
    """The rows of one block of (doc_id, text)."""
    one, two = sides
    texts = [t for _, t in rows]
    ids_a, ids_b = one.encode([" " + t for t in texts]), two.encode(texts)
    good = np.zeros(len(rows), bool)
    for k, text in enumerate(texts):
        want = b" " + text.encode()
        good[k] = bool(text) and b"".join(map(one.pieces.__getitem__, ids_a[k])) == want and b"".join(map(two.pieces.__getitem__, ids_b[k])) == want
    flat = lambda ids: np.fromiter((x for k in np.flatnonzero(good).tolist() for x in ids[k]), np.int64)
    many = lambda ids: np.array([len(x) for x in ids], np.int64) * good
    n_a, n_b, a, b = many(ids_a), many(ids_b), flat(ids_a), flat(ids_b)
    del ids_a, ids_b
    # a document's ends go on from those before it: both sides of it are as long
    ends_a, ends_b = np.cumsum(one.lengths[a]), np.cumsum(two.lengths[b])
    doc_a, doc_b = np.repeat(np.arange(len(rows)), n_a), np.repeat(np.arange(len(rows)), n_b)
    if (one.lengths[a] > 0).all() and (two.lengths[b] > 0).all():
        group_a, group_b = link_a, link_b = merge_runs(ends_a, ends_b)
    else:  # a vocabulary with tokens of no bytes
        groups, links = merge_ends(ends_a.tolist(), ends_b.tolist())
        group_a, group_b = np.array([(q - 1, s - 1) for _, q, _, s in groups], np.int64).reshape(-1, 2).T
        link_a, link_b = np.array(links, np.int64).reshape(-1, 2).T
    text, cuts = _written(a, b, group_a, group_b, sides)
    n_groups, n_links = np.bincount(doc_a[group_a], minlength=len(rows)), np.bincount(doc_a[link_a], minlength=len(rows))
    upto = np.concatenate(([0], cuts))[np.concatenate(([0], np.cumsum(n_groups)))].tolist()
    said = [text[x : max(x, y - 1)].tobytes() for x, y in zip(upto, upto[1:], strict=False)]  # without the last sign
    digests = [hashlib.sha256(x).hexdigest() if ok else "" for x, ok in zip(said, good.tolist(), strict=True)]
    told = {"at": np.arange(len(rows)), "doc_id": [d for d, _ in rows], "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests}
    yield _shaped(pd.DataFrame(told | ({"groups": [x.decode() for x in said]} if with_groups else {})), "document", block)
    if not len(link_a):
        return
    # equal (pair, document) are counted, then each pair's documents are one row
    kinds, which = np.unique(a[link_a] << 32 | b[link_b], return_inverse=True)
    held, times = np.unique(which.astype(np.int64) * len(rows) + doc_a[link_a], return_counts=True)
    which, doc = np.divmod(held, len(rows))
    cuts = np.searchsorted(which, np.arange(len(kinds) + 1))
    docs, many_times = doc.astype("<u2").tobytes(), times.astype("<u4").tobytes()
    edges = cuts.tolist()
    link = pd.DataFrame({"a": kinds >> 32, "b": kinds & 0xFFFFFFFF, "n": np.add.reduceat(times, cuts[:-1])})
    link["docs"] = [docs[2 * x : 2 * y] for x, y in zip(edges, edges[1:], strict=False)]
    link["times"] = [many_times[4 * x : 4 * y] for x, y in zip(edges, edges[1:], strict=False)]
    yield _shaped(link, "links", block)


def _shaped(df: pd.DataFrame, kind: str, block: int) -> pd.DataFrame:
    """All columns of TOLD: what df lacks is null; texts and bytes as plain objects."""
    df["kind"], df["block"] = kind, block
    for name, kind_of in (c.split() for c in TOLD.split(", ")):
        if name not in df:
            df[name] = pd.Series([None] * len(df), dtype="Int64" if kind_of in ("int", "long") else object)
        else:
            df[name] = df[name].astype("Int64" if kind_of in ("int", "long") else object)
    return df


def align_blocks(docs: DataFrame, a: str, b: str, with_groups: bool = False) -> DataFrame:
    """Rows of kind document and of kind links, as tasks emit them; stored."""
    ensure_workers(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sides = Side.at(a, "byte_level"), Side.at(b, "pieces")
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for frame in frames:
            for doc, text in zip(frame["doc_id"].astype("Int64").tolist(), frame["text"].tolist(), strict=True):
                held.append((doc, text))
                size += len(text)
                if size >= BLOCK_CHARS or len(held) == BLOCK_DOCS:
                    yield from _block(held, block, sides, with_groups)
                    block, held, size = block + 1, [], 0
        if held:
            yield from _block(held, block, sides, with_groups)
        release()

    return materialize(plain.mapInPandas(run, TOLD), "aligned", partition_by="kind")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, most_a, most_b): how many links hold the pair, and the highest count of each of its ids."""
    counts = materialize(blocks.where("kind = 'links'").groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    most = lambda side: counts.groupBy(side).agg(F.max("count").alias(f"most_{side}"))
    return counts.join(most("a"), "a").join(most("b"), "b").select("a", "b", "count", "most_a", "most_b")


def document_sums(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block, at, n_best_a, n_best_b, count_sum) of each document: its links whose count is the highest of their A or B id, and the sum of counts."""
    spark = blocks.sparkSession
    links = blocks.where("kind = 'links'").select("a", "b", "block", "docs", "times")
    known = links.join(pairs.select("a", "b", "count", (F.col("count") == F.col("most_a")).alias("best_a"), (F.col("count") == F.col("most_b")).alias("best_b")), ["a", "b"])

    def add(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        raw = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        doc, times = raw("docs", "<u2").astype(np.int64), raw("times", "<u4").astype(np.int64)
        many = np.array([len(x) for c in rows.column("docs").chunks for x in c.to_pylist()], np.int64) // 2
        n = int(doc.max()) + 1
        sums = []
        for worth in (rows.column("best_a"), rows.column("best_b"), rows.column("count")):
            out = np.zeros(n, np.int64)
            np.add.at(out, doc, np.repeat(np.asarray(worth.to_numpy(), np.int64), many) * times)
            sums.append(out)
        at = np.unique(doc)
        yield pa.record_batch([pa.array(np.full(len(at), key[0])), pa.array(at.astype(np.int32)), *(pa.array(s[at]) for s in sums)], ["block", "at", "n_best_a", "n_best_b", "count_sum"])

    parts = partitions_for(spark, blocks.where("kind = 'document'").count(), 20_000)
    return stream_groups(known.select("block", "docs", "times", "count", "best_a", "best_b"), ["block"], add, "block long, at int, n_best_a long, n_best_b long, count_sum long", parts)


def align(docs: DataFrame, a: str, b: str, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a[, groups]) of each document. a: a byte-level vocabulary, b: a sentencepiece model.
    n_best counts the links whose pair is the most frequent one of its B id, n_best_a those of its A id, ties included."""
    blocks = align_blocks(docs, a, b, with_groups)
    sums = document_sums(blocks, pair_counts(blocks))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", zero(F.col("n_best_b"), "n_best"), zero(F.col("count_sum"), "count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"), zero(F.col("n_best_a"), "n_best_a")]
    return blocks.where("kind = 'document'").join(sums, ["block", "at"], "left").select(*cols, *(["groups"] if with_groups else []))
