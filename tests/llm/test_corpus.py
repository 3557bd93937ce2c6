"""Corpus-wide operators against brute force on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_rowwise import odd
from tokenizers import Tokenizer

import corpus_pipeline
from sieveline.llm import lattice, lmscore, mixing, neardup, packing, pii
from sieveline.llm._shared import materialize

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# packing


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=8), st.integers(40, 64))
def test_bins_use_every_length_once(hist, capacity):
    plan = packing.plan_bins(hist, capacity)
    used = Counter()
    for times, lengths in plan:
        assert times > 0 and sum(n * c for n, c in lengths.items()) <= capacity
        used.update({n: c * times for n, c in lengths.items()})
    assert used == Counter(hist)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 3), max_size=6), st.integers(0, 60))
def test_fullest_bin_is_the_fullest(counts, room):
    best = {0}
    for n, c in counts.items():
        best = {b + n * k for b in best for k in range(c + 1) if b + n * k <= room}
    used = packing.fullest(counts, room)
    assert sum(n * c for n, c in used.items()) == max(best) and all(c <= counts[n] for n, c in used.items())


def test_packed_ids_are_the_tokenizers(spark):
    rows = [(i, t, "x") for i, t in enumerate(["", None, "Don't STOP.. <|endoftext|>. <|ENDOFTEXT|> a\x1cb É. İ. ǅ.", "word " * 5000, "Hello, hello HELLO", "ß é., Σς ١٢. %%%."])]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = packing.pack(df, TOKENIZER, capacity=100).collect()
    tok = Tokenizer.from_file(TOKENIZER)
    for i, text, _ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) and r["start"] == 100 * r["piece"]
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_seq.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 100
    assert len(by_seq) <= math.ceil(sum(r["length"] for r in got) / 100) + 1
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0


def test_pieces_are_placed_without_a_shuffle(spark):
    rows = [(i, "word " * (i * 37 % 500)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = packing.pack(df, TOKENIZER, capacity=100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        scan = [x for x in plan.splitlines() if "ids_crc32" in x]
        moved = [x for x in scan if "Exchange" in x]
        assert "ShuffledHashJoin" in plan and not moved and "Bucketed: true" in plan
        seen = {(r["sequence_id"], r["offset"]) for r in out.collect()}
        assert len(seen) == out.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)


# near-duplicates


def brute_near(texts, size, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def planted_texts(n=60, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    out = [None, "", " \n", "one", "One", "two words", "TWO  words", "a b c d e f g h", "a b c d e f g i"]
    passage = [word() for _ in range(60)]
    for _ in range(n):
        base = [word() for _ in range(rng.choice((5, 20, 80, 200)))] + (passage if rng.random() < 0.3 else [])
        out.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 3))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 2, len(base) // 30 + 1))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("most", [2000, 6])
def test_near_duplicates_against_brute_force(spark, most):
    texts = planted_texts()
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for k in range(25):  # one large group of near copies, so that small list limits split it
        copy = list(base)
        copy[k * 4] = f"x{k}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean").repartition(3)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df, size=3, numerator=85, denominator=100, most=most).collect()}
    sizes, roots = brute_near(texts, 3, 85, 100)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert all(got[i]["kept"] == (roots[i] == i) for i in range(len(texts)))


@pytest.mark.parametrize(("size", "share", "n", "changed"), [(5, 80, 900, 20), (3, 85, 925, 25)])
@pytest.mark.parametrize("bounds", [{"most": 8}, {"heavy": 6_000}])
def test_pairs_at_the_threshold_link_in_long_lists(spark, size, share, n, changed, bounds):
    """Each text is exactly at the threshold to the first, and far from all others; a second group is just below it."""
    rng = random.Random(size)
    base = [f"b{rng.randrange(10**9)}" for _ in range(n + size - 1)]
    texts = [" ".join(base)]
    for k in range(60):
        copy = list(base)
        spots = rng.sample(range(1, (n - size) // size), changed + (k >= 40))
        for at in spots:
            copy[at * size] = f"c{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, size=size, numerator=share, denominator=100, **bounds).collect()}
    _, roots = brute_near(texts, size, share, 100)
    assert roots[:41] == [0] * 41 and roots[41:] == list(range(41, 61))
    assert [got[i] for i in range(61)] == roots


def test_nodes_of_a_long_list_meet_unless_joined_already(spark):
    long = spark.createDataFrame([(7, n, 10, 5) for n in range(1, 31)], "key long, node long, n_shingles long, parts int")
    roots = spark.createDataFrame([(n, 1) for n in range(2, 21)] + [(22, 21)], "node long, root long")
    comp = {n: 1 if n <= 20 else 21 if n <= 22 else n for n in range(1, 31)}
    lists = {}
    for r in neardup.remaining_lists(long, roots, most=6).collect():
        lists.setdefault(r["list"], set()).add(r["node"])
        assert r["comp"] == comp[r["node"]]
    assert all(comp[a] == comp[b] or any({a, b} <= own for own in lists.values()) for a in range(1, 31) for b in range(1, a))
    joined = roots.unionByName(spark.createDataFrame([(n, 1) for n in range(21, 31) if n != 22], "node long, root long"))
    assert neardup.remaining_lists(long, joined.where("root = 1").unionByName(spark.createDataFrame([(22, 1)], "node long, root long")), most=6).count() == 0


def test_short_texts_with_a_common_sentence_share_no_list_for_it(spark):
    rng = random.Random(6)
    sentence = [f"s{k}" for k in range(12)]
    texts = [" ".join([f"w{rng.randrange(10**9)}" for _ in range(n)] + sentence) for n in range(20, 60) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[0] + " end"])), "doc_id long, text string")
    lists, long = neardup.candidate_lists(neardup.signatures(df, 3))
    assert lists.groupBy("list").count().agg(F.max("count")).first()[0] < 10 and long.isEmpty()
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 3).collect()} == {i: i % 320 for i in range(321)}


def test_copies_are_not_gathered_to_find_one_of_them(spark, monkeypatch):
    dealt = []
    held = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: held(df, name) if name != "sets" else dealt.append(df) or held(df, name))
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (5, text), (5, text), (4, text.upper()), *((i, text) for i in range(10, 60)), (None, text + " end"), (None, text + " end"), (3, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    assert [r["component_id"] for r in got.collect()] == [4] * (len(rows) - 1) + [3]
    assert dealt[0].count() == 2 and "hashpartitioning(row" in dealt[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("num", "a", "b"), [(85, 6, 7), (80, 4, 5), (85, 60, 70), (85, 327, 384), (85, 328, 385), (85, 384, 385), (85, 384, 451), (80, 308, 385), (80, 384, 480)])
def test_sets_at_the_threshold_share_a_key_at_any_size(num, a, b):
    rng = np.random.default_rng(a)
    for _ in range(50):
        large = rng.integers(1, 1 << 63, b, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, b, dtype=np.uint64)
        flat, lens = np.concatenate((np.sort(large[:a]), np.sort(large))), np.array([a, b])  # the one is part of the other
        assert 100 * a >= num * b
        one, other = neardup.set_keys(flat, lens, neardup.registers(flat, np.repeat([0, 1], lens), 2), num, 100)
        assert set(one.tolist()) & set(other.tolist())


def test_near_duplicates_of_odd_rows(spark):
    for df in (odd(spark), odd(spark).limit(0)):
        assert neardup.near_duplicates(df).count() == df.count()
    kept = neardup.drop_near_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r["text"] or "")[:4] for r in kept.collect()) == ["", "", "  \n", "Same", "word", "yyyy"]


def test_jaccard_estimate_is_centred():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.85):
        est = []
        for _ in range(60):
            both = rng.integers(1, 1 << 62, int(1500 * share), dtype=np.uint64)
            a = np.concatenate((both, rng.integers(1, 1 << 62, int(750 * (1 - share)), dtype=np.uint64)))
            b = np.concatenate((both, rng.integers(1, 1 << 62, int(750 * (1 - share)), dtype=np.uint64)))
            regs = neardup.registers(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2)
            est.append(neardup.estimate(regs, neardup.octaves(np.array([len(a), len(b)])), 0)[1])
        assert abs(np.mean(est) - share) < 0.02


# personal data

FORMS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(d := re.sub("[ -]", "", m)) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(text):
    found = [(m.start(), k, m.end(), name) for k, (name, form, ok) in enumerate(FORMS) for m in form.finditer(text or "") if ok(m[0])]
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(found))


def test_base_spans_against_plain_expressions(spark):
    rng = random.Random(7)
    texts = ["", None, "a@b.c", "a@b.com+x@y.com.", "x@y@z.w.v", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.255", "4111 1111-1111 1111", "4111111111111111 4111111111111112", "+1 (555) 123-4567 +12", "é😀 a@b.c 😀+44 20 7946 0958", "1 " * 6000, "9" * 30_000, "a." * 20_000, "@" * 5000]
    texts += ["".join(rng.choice("ab.@+- 0123456789()é\n") for _ in range(rng.randrange(80))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    for i, t in enumerate(texts):
        assert got[i]["spans"] == base_spans(t) or got[i]["n_found"], t


def test_contexts_discover_what_no_form_takes(spark):
    seeds = [(i, f"word{i} please dial +1 555 010 {1000 + i} thanks a lot") for i in range(30)]
    hidden = [(100 + i, f"other{i} please dial 555010{2000 + i} thanks a lot") for i in range(5)]
    clean = [(200 + i, f"plain text number 555010{3000 + i} stays as it is") for i in range(5)]
    df = spark.createDataFrame(seeds + hidden + clean, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    for i, t in hidden:
        at = t.index("555010")
        assert got[i]["spans"] == f"phone:{at}:{at + 10}" and got[i]["n_phone"] == 0
    assert all(got[i]["spans"] == "" for i, _ in clean) and all(got[i]["n_phone"] == 1 for i, _ in seeds)
    text = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert text[100] == "other0 please dial [PHONE] thanks a lot" and text[0].startswith("word0 please dial [PHONE] thanks")
    assert [text[i] for i, _ in clean] == [t for _, t in clean]


def test_personal_data_of_odd_rows(spark):
    for df in (odd(spark), odd(spark).limit(0)):
        assert pii.find(df).count() == df.count() == pii.redact(df).count()
    assert pii.redact(odd(spark)).columns == odd(spark).columns


# language model


def test_base_scores_against_counts(spark):
    rng = random.Random(3)
    texts = [None, "", "A a b"] + [" ".join(rng.choice(["the", "The", "of", "x", "yy", f"r{rng.randrange(40)}"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens double").repartition(3)
    got = {r["doc_id"]: r for r in lmscore.score(df, block_tokens=300).collect()}
    count = Counter()
    tokens = [(t or "").encode().lower().split() + [None] for t in texts]
    for i, own in enumerate(tokens):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(own)
    n, v = sum(count.values()), len(count)
    for i, own in enumerate(tokens):
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[x] > 0 for x in own), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_bigram_estimates_against_dictionaries(spark):
    texts = ["a b a b a c", "a b", "b a c", "c c a b", "a b c a b"] * 8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lmscore.score(df, block_tokens=64).collect()}
    blocks = lmscore.blocks(df, 7, 2, 6, 64)
    assert blocks.select(F.sum("n_tokens")).first()[0] == sum(len(t.split()) + 1 for t in texts)
    held = [i for i in got if zlib.crc32(str(i).encode()) % 7 == 2]
    same = {}
    for i in held:  # equal texts have equal scores, and a model of such a language beats counting words
        assert math.isclose(same.setdefault(texts[i], got[i]), got[i], rel_tol=1e-12)
    base = {r["doc_id"]: r["base_score"] for r in lmscore.score(df, block_tokens=64).collect()}
    assert sum(got[i] for i in held) > sum(base[i] for i in held)


def test_teams_bring_the_same_counts_by_fewer_messages(spark):
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 900}"
    sent = []
    for n in (150, 600):
        texts = [" ".join(word() for _ in range(30)) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        how = {"block_tokens": 100, "asks_per_task": 100}
        plain = {r["doc_id"]: tuple(r) for r in lmscore.score(df, **how, fan=1 << 20).collect()}
        teams = {r["doc_id"]: tuple(r) for r in lmscore.score(df, **how, fan=4).collect()}
        assert plain == teams
        marked = materialize(lmscore.blocks(df, 7, 2, 6, 100), "marked")
        blocks = marked.count()
        ranges = 1 << ((sum(len(t.split()) + 1 for t in texts) // 100) - 1).bit_length()
        wide = 1 << ((ranges - 1).bit_length() + 1) // 2
        messages = lmscore.asks(marked, wide).count()
        assert messages <= 2 * blocks * wide and wide * wide <= 4 * ranges
        sent.append(messages / blocks)
    assert sent[1] <= 2.2 * sent[0]  # four times the blocks and ranges: twice the messages a block, not four times


def test_rows_of_many_tokens_are_packed_and_few_to_a_file(spark, monkeypatch):
    rng, stored = random.Random(8), {}
    monkeypatch.setattr(lmscore, "materialize", lambda df, name, *a, **b: stored.setdefault(name, materialize(df, name, *a, **b)))
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(30)) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    assert lmscore.score(df, block_tokens=100, asks_per_task=100).count() == 250
    assert "asks" not in stored  # some 100 ranges need no table of all messages, which is larger than the texts
    in_file = [r["count"] for r in stored["blocks"].groupBy(F.input_file_name().alias("file")).count().collect()]
    assert max(in_file) <= 4 and sum(in_file) > 40  # Spark's reader holds thousands of rows of a file at once
    keys = np.unique(np.random.RandomState(1).randint(0, 1 << 56, 1 << 18).astype(np.uint64))
    raw = lmscore.squeeze(np.diff(keys, prepend=np.uint64(0)))
    assert len(raw) < 6 * len(keys) and (np.cumsum(lmscore.spread(raw, np.uint64)) == keys).all()
    assert not len(lmscore.spread(lmscore.squeeze(keys[:0]), np.uint64))


def test_weights_follow_held_out_counts():
    rows = np.array([[3, 0.5, 0.01, 90], [3, 0.0, 0.01, 10], [8, 0.0, 0.2, 100]], float)
    w = lmscore.learn_weights(rows, 1e-6)
    assert np.allclose(w.sum(1), 1, atol=1e-6) and w[3, 0] > 0.8 and w[8, 1] > 0.99 and np.allclose(w[5], w[3])
    assert (lmscore.learn_weights(np.zeros((0, 4)), 0.1) == 1 / 3).all()


def test_language_model_of_odd_rows(spark):
    for df in (odd(spark), odd(spark).limit(0)):
        assert lmscore.score(df).count() == df.count()


# embeddings


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    p = lattice.decode(x)
    near = ((x[:, None] - (p[:, None] + lattice.SHORTEST)) ** 2).sum(2).min(1)
    assert (((x - p) ** 2).sum(1) <= near + 1e-12).all() and (((x - p) ** 2).sum(1) <= 1 + 1e-9).all()
    assert (np.round(p.sum(1) * 2) % 4 == 0).all() and len(lattice.SHORTEST) == 240


@pytest.mark.parametrize("most", [1024, 8])
def test_near_vectors_against_brute_force(spark, most):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(150, 64)))
    side = rng.normal(size=x.shape)
    side = unit(side - (side * x).sum(1, keepdims=True) * x)
    cos = rng.uniform(0.9, 0.93, (150, 1))
    centre = unit(rng.normal(size=64))
    many = unit(centre + 0.02 * rng.normal(size=(40, 64)))
    every = np.concatenate((x, cos * x + np.sqrt(1 - cos**2) * side, many, many[:3]))
    rows = [(i, v.tolist()) for i, v in enumerate(every)] + [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [1.0] * 3), (1004, []), (1005, [None] * 64)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links string")
    got = {r["vec_id"]: r for r in lattice.near_vectors(df, most=most).collect()}
    link = (every @ every.T / np.outer(np.linalg.norm(every, axis=1), np.linalg.norm(every, axis=1))) >= 0.9
    np.fill_diagonal(link, False)
    found, true = sum(got[i]["n_links"] for i in range(len(every))), int(link.sum())
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(len(every))) and found >= 0.95 * true
    assert [got[300 + k]["n_links"] for k in range(40)] == [int(link[300 + k].sum()) for k in range(40)]
    assert {got[300 + k]["component_id"] for k in range(43)} == {300}
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004, 1005))
    assert lattice.near_vectors(df.limit(0)).count() == 0


# mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, capped = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in capped]
        if not open_:
            return capped
        share = {s: (left - sum(capped.values())) * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(cap * sizes[s]) for s in over}


def test_mixture_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, f"s{rng.choice((0, 0, 0, 1, 2, 3, 4))}", " ".join("w" for _ in range(rng.randrange(0, 300)))) for i in range(600)]
    rows += [(1000, None, "a b c"), (1001, "", "x y"), (1002, "s1", None), (5, "s2", rows[5][2])]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, source string, text string, target string")
    got = mixing.takes(df).collect()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert sum(s["last"] - s["first"] for s in r["segments"] or []) == r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 2 * 64 + 0.02 * want[s]
    key = lambda rows: sorted((r["doc_id"], r["source"] or "", r["size"], r["taken"]) for r in rows)
    assert key(got) == key(mixing.takes(df.repartition(5)).collect())
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    words = sum(len(r["text"].split()) for r in mixed.collect())
    assert words == sum(taken.values())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=40), st.booleans())
def test_targets_against_sharing_in_rounds(spark, counts, none):
    rows = [(False, f"s{i * 7919 % 1000:03}é"[: 4 + i % 2], n) for i, n in enumerate(counts)] + [(True, "", 50)] * none
    want = brute_targets({None if no else s: n for no, s, n in rows})
    got = {None if r["no_source"] else r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "no_source boolean, source string, source_size long").repartition(3)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_small_sources_meet_their_targets(spark):
    rows = [(i, f"s{i:03}", " ".join("w" for _ in range(1 + i * 7 % 130))) for i in range(90)] + [(900 + i, "big", "w " * 100) for i in range(20)]
    got = mixing.takes(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 0.5 + 1e-6 for r in got)


def test_shards_hold_the_mix(spark):
    rows = [(i, f"s{i % 3}", " ".join(f"d{i}w{k}" for k in range(1 + i * 13 % 150))) for i in range(60)] + [(3, "s0", "d3w0 again"), (None, None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken, got = Counter(), mixing.mix_blocks(df, shards=4).collect()
    for r in mixing.takes(df, shards=4).collect():
        taken[r["source"]] += r["taken"]
    held = Counter()
    for r in got:
        held[r["source"]] += r["n_words"]
        assert len(r["text"].split()) == r["n_words"] <= 64
    assert held == taken and {r["shard"] for r in got} == {0, 1, 2, 3}
    for s in taken:
        own = sorted((r["slot"], r["shard"]) for r in got if r["source"] == s)
        assert [x for x, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)
    assert len({r["shard"] for r in mixing.mix_blocks(df, shards=2).collect()}) == 2


def test_slots_hold_the_words_wanted():
    for size in (1, 5, 63, 64, 65, 200, 640, 1001):
        n = -(-size // 64)
        for want in range(1, 3 * size + 1, max(1, size // 50)):
            k, last = mixing.slots_for(want, size, 64, 5)
            blocks = [mixing.permuted(np.array([i % n]), n, 5 + i // n)[0] for i in range(k)]
            words = [min(64, size - 64 * b) for b in blocks]
            assert sum(words[:-1]) + min(words[-1], last) == want and 0 < last <= 64


def test_mixture_of_nothing_and_permutations(spark):
    for df in (odd(spark), odd(spark).limit(0)):
        assert mixing.takes(df).count() == df.count()
    for n in (1, 2, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 1).tolist() != mixing.permuted(np.arange(1000), 1000, 2).tolist()


# pipeline


def test_pipeline_stages_keep_the_columns_of_documents(spark):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, base).cache()
        assert docs.columns == columns and docs.count() > 0.3 * n
        n = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, base)
    assert out.agg(F.sum("length")).first()[0] > 0 and {"doc_id", "ids", "sequence_id", "offset"} <= set(out.columns)
