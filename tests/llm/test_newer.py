"""Importance resampling, cross-tokenizer alignment and chat formatting against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import align, chat, media, mixing, resample

TURN = "conv_id long, turn long, role string, text string, turns int, formatted string"
BITS = ["</s>", "[INST]", "[/INST]", "<s>", "[SEP]", "[ROLE] ", " [/ROLE]", "<\\/s>", "<\\\\s>", "[\\INST]", "\\", "<", "[", "]", "a", "é", "\n", " ", "[/SYS]", "SEP]", "/s>", "𝄞"]


def plain_chat(rows):
    """conv_id -> (turns, trained texts) as the table says."""
    out = {}
    for conv, some in groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        turns = sorted(((t is not None, t or 0, role or "", text or "") for _, t, role, text in some))
        out[conv] = [(role, text) for _, _, role, text in turns]
    return out


def test_formatted_turns_can_be_read_back(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "assistant", "system", "tool", None, "", "[SEP]", word()]), rng.choice([None, word(), word()])) for c in range(120) for _ in range(rng.choice([1, 2, 5, 17]))]
    rows += [(500, i, "assistant", f"{i}é") for i in range(700)] + [(501, 0, "user", "x" * 300_000 + "</s>"), (502, 1, "user", "a"), (502, 1, "user", "a"), (502, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], TURN).repartition(5)
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    digests = {r["conv_id"]: r for r in chat.digests(chat.read_back(out)).collect()}
    want = plain_chat(rows)
    assert got.keys() == want.keys() == digests.keys()
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv]["turns"]] == turns
        texts = [t for role, t in turns if role == "assistant"]
        assert got[conv]["trained"] == texts
        d = digests[conv]
        assert (d["n_turns"], d["loss_chars"], d["formatted_chars"]) == (len(turns), len("".join(texts)), len(got[conv]["formatted"]))
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert d["loss_sha256"] == hashlib.sha256("".join(texts).encode()).hexdigest()


def test_adjacent_turns_of_a_role_share_marks(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "a"), (1, 2, "user", "b [INST]"), (1, 3, "assistant", "é"), (1, 4, "assistant", "</s>"), (1, 5, "tool", "t")]
    got = chat.format_conversations(spark.createDataFrame([(*r, 0, "") for r in rows], TURN)).first()
    assert got["formatted"] == "<s>[SYS] S [/SYS][INST] a[SEP]b [\\INST] [/INST] é[SEP]<\\/s></s>[ROLE] tool[SEP]t [/ROLE]"
    raw = got["formatted"].encode()
    assert [raw[s["start"] : s["end"]].decode() for s in got["loss_spans"]] == ["é", "<\\/s>"]


def test_rows_without_a_conversation_stand_alone(spark):
    df = spark.createDataFrame([(None, 3, "user", "a", 0, ""), (None, 3, "user", "a", 0, ""), (None, None, None, None, 0, "")], TURN)
    assert sorted(r["formatted"] for r in chat.format_conversations(df).collect()) == ["<s>[INST] a [/INST]", "<s>[INST] a [/INST]", "<s>[ROLE] [SEP] [/ROLE]"]
    assert chat.digests(chat.read_back(chat.format_conversations(df.limit(0)))).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=12).map("".join), min_size=1, max_size=30))
def test_escapes_are_undone(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(m in r["e"] for m in ("</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[SEP]", "[/SEP]"))


def test_chat_runs_without_python(spark):
    df = chat.digests(chat.read_back(chat.format_conversations(spark.createDataFrame([(1, 0, "user", "a", 0, "")], TURN))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resample(docs, target, most, buckets, percent, least, seed):
    """doc_id -> rows (n_words, n_features, weight, score, rank), in order."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: WORDS.findall((t or "").translate(lower))
    found = lambda t: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for w in [words(t)] for k in range(1, most + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(b for _, x in docs for b in found(x)), Counter(b for x in target for b in found(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for doc, text in docs:
        f = found(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r, ranks.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize(("most", "percent", "least"), [(1, 10, 20), (3, 50, 2), (2, 100, 0)])
def test_resampling_is_the_plain_one(spark, most, percent, least, monkeypatch):
    rng = random.Random(most)
    words = ["a", "B", "été", "1x", "zz", "Ａ", " ", "x\x00y", "it's", "q@r", "", "\n"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)] + [(None, "a a B"), (None, None), (900, ""), (901, "a" * 5000), (902, text(9000)), (903, None)]
    target = [text(30) for _ in range(9)] + [None, ""]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in docs], "doc_id long, text string, rank int, kind string").repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    monkeypatch.setattr(resample, "PIECE", 700)
    monkeypatch.setattr(resample, "CHUNK", 3000)
    got = resample.resample(df, aim, resample.Features(most, 97), percent, least, 5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(docs, target, most, 97, percent, least, 5)


def test_resampling_of_nothing_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b " * 20)] * 6 + [(2, "a " * 30)] * 4, "doc_id long, text string").repartition(3)
    none = df.where("doc_id is null").select("text")
    got = resample.resample(df, none, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5] and len({(r["doc_id"], r["score"]) for r in got}) == 2
    assert resample.resample(df.where("false"), df.select("text")).count() == 0


def test_pieces_are_cut_between_words():
    text = "aa bb-cc  dd " * 500
    for most in (1, 3):
        parts = list(resample.pieces(text, most, 100))
        assert "".join(own for own, _ in parts) == text and len(parts) > 50
        after = [len(WORDS.findall(tail)) for _, tail in parts]
        assert after[-1] == 0 and set(after[:-2]) == {most - 1}
        assert sum(len(WORDS.findall(own)) for own, _ in parts) == 2000
    assert list(resample.pieces("x" * 1000, 2, 100)) == [("x" * 1000, "")]


def plain_align(docs, one, two):
    """Rows of the contract from sets of byte ends."""
    per, pairs = [], Counter()
    for doc, text in docs:
        want = b" " + (text or "").encode()
        a, b = (one.encode([" " + (text or "")])[0], two.encode([text or ""])[0]) if text else ([], [])
        if not text or b"".join(one.pieces[i] for i in a) != want or b"".join(two.pieces[i] for i in b) != want:
            per.append((doc, 0, 0, 0, [], ""))
            continue
        ends = lambda side, ids: [sum(len(side.pieces[i]) for i in ids[: k + 1]) for k in range(len(ids))]
        ea, eb = ends(one, a), ends(two, b)
        links = [(x, y) for x, p in zip(a, ea, strict=True) for y, q in zip(b, eb, strict=True) if p == q]
        groups, low = [], 0
        for end in sorted(set(ea) & set(eb)):
            part = lambda ids, e: ",".join(str(i) for i, p in zip(ids, e, strict=True) if low < p <= end)  # noqa: E731, B023
            groups.append(f"{part(a, ea)}|{part(b, eb)}")
            low = end
        pairs.update(links)
        per.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, y), n in pairs.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(((d, na, nb, g, len(ls), sum(pairs[x] == most[x[1]] for x in ls), sum(pairs[x] for x in ls), h) for d, na, nb, g, ls, h in per), key=str)


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    return align.Side.at(A, "byte_level"), align.Side.at(B, "pieces")


ODD = [None, "", " ", "a", "  a  b\n\n\tc ", "<|endoftext|> x </s> <s> <0x0A> <unk>", "x▁y", "▁", "naïve — 𝄞𝄞 日本語テキスト", "\x00\x01", "a" * 3000, " " * 2000 + "b", "it's they'll 123 4567", "﻿z​", "é é ﬁ ①", "\r\n\r\n"]


def test_alignment_is_the_plain_one(spark, sides, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()]
    docs = [(i, (t or "")[:900]) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "of the"), (7, "of the"), (7, "of the")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, block int, kind string").repartition(3)
    want = plain_align(docs, *sides)
    for size in (align.BLOCK_CHARS, 2000):
        monkeypatch.setattr(align, "BLOCK_CHARS", size)
        got = align.align(df, A, B, with_groups=True)
        assert sorted((tuple(r)[:8] for r in got.collect()), key=str) == want
        assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] if r["n_a"] else r["groups"] == r["groups_sha256"] == "" for r in got.collect())
    assert align.align(df.where("false"), A, B).count() == 0


def test_both_encoders_of_a_vocabulary_agree(sides):
    rng = random.Random(1)
    texts = [" " + t for t in ODD if t] + ["".join(rng.choice(["a", "B ", " ", "\n", "'s", "é", "𝄞", "9", ".", "ſ", " ", "的", "\t"]) for _ in range(200)) for _ in range(300)]
    plain = [sides[0].slow.encode(t, add_special_tokens=False).ids for t in texts]
    assert sides[0].fast is not None and sides[0].encode(texts) == plain


def test_ends_are_merged():
    assert align.merge_ends([1, 3, 4], [2, 3, 4]) == ([(0, 2, 0, 2), (2, 3, 2, 3)], [(1, 1), (2, 2)])
    assert align.merge_ends([2, 2, 3], [2, 3, 3]) == ([(0, 2, 0, 1), (2, 3, 1, 3)], [(0, 0), (1, 0), (2, 1), (2, 2)])
    assert align.merge_ends([], []) == ([], [])
    rng = random.Random(2)
    for n in (0, 1, 5, 40, 300):
        a, b = (sorted(rng.sample(range(1, 400), n)) for _ in range(2))
        ga, gb = align.merge_runs(np.array(a, np.int64), np.array(b, np.int64))
        assert list(zip(ga.tolist(), gb.tolist(), strict=True)) == align.merge_ends(a, b)[1]


def test_tokens_without_bytes(sides):
    """Each side's vocabulary gets a token of no bytes, which then ends where the one before it does."""

    class Odd(align.Side):
        def __init__(self, side):
            super().__init__([*side.pieces, b""])
            self.side = side

        def encode(self, texts):
            return [[x for i, t in enumerate(ids) for x in ([t, len(self.pieces) - 1] if i % 3 == 0 else [t])] for ids in self.side.encode(texts)]

    odd = Odd(sides[0]), Odd(sides[1])
    docs = [(i, t) for i, t in enumerate(["of the people", "", None, "a  b", "x▁y", "it's 12"])]
    per = plain_align(docs, *odd)
    got = pd.concat(align._block([(d, t or "") for d, t in docs], 0, odd, False))
    rows = got[got["kind"] == "document"]
    assert [tuple(r) for r in rows[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].to_numpy().tolist()] == [(*r[:5], r[7]) for r in per]
    assert got["n"].sum() == rows["n_links"].sum() > rows["n_groups"].sum()


def test_words_come_from_their_own_source(spark):
    """Equal rows in two sources, of which the larger one gives to some rows only: what is mixed is what was taken, source by source."""
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, words(i), "a") for i in range(400)] + [(i, words(i), "b") for i in range(20)] + [(i, words(i), None) for i in range(5)] + [(1, words(1), "b")] * 3 + [(7, "", "a"), (None, None, "b"), (None, words(9), "a")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, shard string")
    taken = {r["source"]: r["n"] for r in mixing.takes(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    count = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    mixed = {r["source"]: r["n"] for r in mixing.mix_documents(df).withColumn("n", count).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    blocks = {r["source"]: r["n"] for r in mixing.mix_blocks(df).groupBy("source").agg(F.sum("n_words").alias("n")).collect()}
    assert mixed == blocks == {k: v for k, v in taken.items() if v} and len(mixed) == 3


def test_folders_as_pyarrow_knows_them():
    want = {"/a/b": "file:///a/b", "file:/a/b": "file:///a/b", "file:///a/b": "file:///a/b", "hdfs://n:8020/a": "hdfs://n:8020/a", "s3a://bucket/a": "s3://bucket/a", "s3n://bucket/a": "s3://bucket/a", "gs://b/a": "gs://b/a"}
    assert {k: media.arrow_uri(k) for k in want} == want
    assert media.arrow_uri("s3a://bucket/a", "http://store:9000") == "s3://bucket/a?endpoint_override=store:9000&scheme=http"
    assert media.arrow_uri("s3a://bucket/a", "store") == "s3://bucket/a?endpoint_override=store"
    with pytest.raises(ValueError, match="wasb"):
        media.arrow_uri("wasb://x/y")
    files, base = pyarrow.fs.FileSystem.from_uri(media.arrow_uri("s3a://bucket/a", "http://store:9000") + "&region=x")
    assert type(files).__name__ == "S3FileSystem" and base == "bucket/a"
