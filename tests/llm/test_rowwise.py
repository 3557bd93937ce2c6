"""URL rules, quality, toxicity, media and words against plain versions."""

import hashlib
import io
import math
import re
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import media, quality, toxicity, urls
from sieveline.llm._text import doc_words, word_counts

DATA = "/root/testdata/sf0.01"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t\x0b\x1c\u00a0é.", max_size=40)), max_size=8))
def test_words_are_those_of_bytes(texts):
    col = pa.array(texts, pa.string())
    want = [(t or "").encode().lower().split() for t in texts]
    h, off = doc_words(col)
    assert np.diff(off).tolist() == [len(w) for w in want] == word_counts(col).tolist()
    seen = {}
    for w, k in zip([x for ws in want for x in ws], h.tolist(), strict=True):
        assert seen.setdefault(w, k) == k
    assert len(set(seen.values())) == len(seen)


def test_words_of_a_long_text():
    text = "x" * 3_000_000 + " Y y" + " ab" * 1_000_000
    h, off = doc_words(pa.array([text, "y"]))
    assert off.tolist() == [0, 1_000_003, 1_000_004] and h[1] == h[2] == h[-1]
    assert word_counts(pa.array([text])).tolist() == [1_000_003]


URLS = ["http://Shop.Example.com/en/a?q", "https://www.example.com/en/", "http://a.www.example.com/en/x#y", "http://example.com", "ftp://x.net/es/1", "http://x.net/de/casino", "https://casino.org/x", "notes.com/en/", None, "", "http://xnet/es/", "http://EXAMPLE.COM/en/x", "http://u@h:1/p://q", "http://a.org/\n/x", "http://a.com?x://y/"]


def plain_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    words = re.findall("[a-z0-9]+", (url or "").lower())
    bad = {r.name for r in urls.PATTERN_RULES} & set(words)
    return host, path, None, "block" if bad else "allow"


def test_url_rules_by_index_and_by_join(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    want = {i: plain_judge(u) for i, u in enumerate(URLS)}
    for limit in (urls.MAX_RULES, 0):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, max_rules=limit).collect()}
        assert got == want
    assert urls.judge(df.limit(0)).count() == 0


def test_tokens_that_patterns_need():
    want = {r"^(?:[^/]*\.)?example\.com/en/": ("example", "com", "en"), r"casino": (), r"\bcasino\b": ("casino",), r"(?<![a-z0-9])a1(?![a-z0-9])": ("a1",), r"/(wp-login|xmlrpc)\.php$": ("php",), r"[/?]ads?/x/": ("x",), r"/(?:track/)+id=": ("track", "id"), r"(?:track/)+id=": ("id",), r"/a(b)?c/": (), r"(?P<w>/org/)z?": ("org",), r"/x{2}/yes/": ("yes",), r"": (), r"^": (), r"[^/]+/Us/": (  # noqa: RUF027
        "us",), r"\.(?:com|net)/": (), r"/a|/b/": (), r"(?=/q/)/w/": ("w",)}
    assert {p: urls.literal_tokens(p) for p in want} == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1/.-", max_size=14), st.sampled_from([r"/a/", r"(?:^|/)b1\b", r"a(?:/b)?/", r"(?<![a-z0-9])ab(?![a-z0-9])", r"^a[/.]b[/.]", r"(?:1\.)+a/", r"\Ab/", r"-(a|b)-1/", r"[^a]/b1/", r"\.1?a\."]))
def test_urls_that_fit_hold_the_tokens(text, pattern):
    if re.search(pattern, text, re.ASCII):
        assert set(urls.literal_tokens(pattern)) <= set(re.findall(urls.TOKEN, text))


def test_one_dialect_on_both_ways(spark):
    rules = urls.HOST_RULES + (urls.UrlRule("named", "block", r"(?P<w>/org/)"), urls.UrlRule("behind", "block", r"(?<=//)x\.net/q"), urls.UrlRule("none", "review", r"^$"), urls.UrlRule("twice", "block", r"(b)\1"), urls.word_rule("block", "hot"))
    texts = [*URLS, "http://a.b/org/", "https://x.net/q", "http://abba", "http://hot/", "HTTP://HOT.hot/"] + [f"http://hot/{i % 3}" for i in range(40)]
    df = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(texts)], "page_id long, url string, verdict string, rule int").repartition(3)
    ways = [sorted(map(tuple, urls.judge(df, rules, max_rules=n).collect())) for n in (100, 0)]
    assert ways[0] == ways[1] and {r[4] for r in ways[0] if texts[r[0]] is None} == {"review"}
    table = spark.createDataFrame([(i, r.name, r.verdict, r.pattern, r.length, r.on_host) for i, r in enumerate(rules)], urls.RULES_TABLE)
    assert urls.rules_of(table) == rules and isinstance(urls.rules_of(table, 3), type(table))
    assert sorted(map(tuple, urls.judge(df, urls.rules_of(table, 3)).collect())) == ways[0]


def test_rules_lie_under_their_rarest_token():
    index = urls.rarest(urls.HOST_RULES, {"com": 100, "example": 5, "www": 2, "en": 50, "net": 7, "es": 9, "fr": 1})
    assert index == {"com": [0], "example": [1], "www": [2], "net": [3], "fr": [4]}


def test_quality_learns_from_teaching_rows_only(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score(docs.select("doc_id", "text"), labels).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] in got]
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score(docs.select("doc_id", "text"), flipped).collect()}
    assert again == {k: r["score"] for k, r in got.items()}


def test_bradley_terry_orders_and_cuts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.NAMES)))
    y = (x[:, 0] - 2 * x[:, 3] > 0.3).astype(int)
    m = quality.bradley_terry(x, y, pairs=20_000)
    s = m.score(x)
    assert ((s >= 0.7) == y).mean() > 0.97 and s.min() >= 0 and s.max() <= 1
    assert (quality.bradley_terry(x, np.ones(400)).score(x) == 0.7).all()


def odd(spark):
    rows = [(1, None, None, 0.5), (2, "", "a", 0.5), (None, "word " * 5, None, 0.5), (3, "  \n", "b", None), (4, "Same text here", "a", 1.0), (4, "Same text here", "a", 1.0), (5, "y" * 200_000, None, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double")


def test_scores_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, 1), (99, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for df in (odd(spark), odd(spark).limit(0)):
        n = df.count()
        for got in (quality.score(df, labels).collect(), toxicity.score(df, labels).collect(), toxicity.score(df, labels.limit(0)).collect()):
            assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("spread", [0.15, 0.6])
def test_nearest_examples_are_exact(spread):
    rng = np.random.default_rng(3)
    n, f = 2400, 60
    dense = np.where(rng.random((n, f)) < spread, rng.random((n, f)), 0)
    dense[1200:, 40:] *= 30  # a rare group that bounds can tell apart
    dense[:1200, 40:] = 0
    dense = dense[dense.any(1)]
    dense = (dense / np.linalg.norm(dense, axis=1)[:, None]).astype(np.float32)
    rows = [np.flatnonzero(r) for r in dense]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    index = toxicity.Index(np.arange(len(rows)), np.zeros(len(rows)), starts, np.concatenate(rows), np.concatenate([d[r] for d, r in zip(dense, rows, strict=True)]), f, 0.0, 0.1).build()
    for i in range(40):
        v = np.where(rng.random(f) < 0.2, rng.random(f), 0)
        v[40 if i % 2 else 0 :] *= 10
        if not v.any():
            continue
        v /= np.linalg.norm(v)
        at, sims = index.nearest(np.flatnonzero(v), v[np.flatnonzero(v)], 7)
        every = dense.astype(float) @ v
        want = np.sort(every)[::-1][:7]
        assert np.allclose(sims, want[: len(sims)]) and (want[len(sims) :] <= 1e-9).all()
        assert np.allclose(every[at], sims)


def test_vectors_are_tf_idf_of_whole_texts(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["the", "Of", "fox", "hen", "x'y", "éa", f"w{'abcdefghij'[rng.integers(10)]}"], rng.integers(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (900, "the unseenword"), (901, ""), (902, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(200)], "doc_id long, toxic int")
    own, index = toxicity.fit(docs, labels)
    index.build()
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    every = [words(t) for t in [*texts, "the unseenword", "", None]]
    n = len(every)
    df = {w: sum(w in set(e) for e in every) for e in every for w in e}
    teach = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    known = {w for i in teach for w in every[i]}
    weigh = lambda e: {w: (1 + np.log(e.count(w))) * (np.log(n / (df[w] if w in known else 1)) + 1) for w in set(e)}
    unit = lambda e: (lambda x: {w: v / np.sqrt(sum(u * u for u in x.values())) for w, v in x.items()})(weigh(e))
    assert len(own.tied) == 0 and len(own.keys) == len(known)
    point = {i: unit(every[i]) for i in teach}
    seen = {}
    for i in teach:
        seen.setdefault(tuple(sorted(every[i])), i)
    for text, (f, w) in zip(texts[200:230], own.vectors(pa.array(texts[200:230])), strict=True):
        a = unit(words(text))
        want = sorted((sum(a[x] * point[i].get(x, 0) for x in a) for i in seen.values()), reverse=True)[:15]
        assert np.allclose(index.nearest(f, w, 15)[1], want, atol=1e-6)


def test_copies_of_examples_are_one_point_and_evidence(spark):
    rows = [(i, "zorn zorn pfui", 1) for i in range(40)] + [(100 + i, f"guten tag {chr(97 + i)}", 0) for i in range(20)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(500, "Zorn! pfui zorn"), (501, "guten tag z"), (502, "42")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert got[500]["predicted"] == 1 and got[500]["evidence"] == [0] and got[501]["predicted"] == 0 and got[502]["evidence"] == []


def test_examples_in_other_scripts_all_teach(spark):
    word = lambda i: "".join(chr(0x430 + i // 32**k % 32) for k in range(4)) + "слово"
    rows = [(i, f"{word(3 * i)} {word(3 * i + 1)} {'привет' if i % 5 else 'мерзость'} {word(3 * i + 2)}", int(i % 5 == 0)) for i in range(800)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1001, "эта мерзость тут"), (1002, "этот привет тут")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert got[1001]["predicted"] == 1 and len(got[1001]["evidence"]) == 15 and got[1002]["predicted"] == 0


def test_toxicity_on_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    marked = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    got = toxicity.score(docs, labels).join(marked, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n.get((0, 1), 0) / sum(v for k, v in n.items() if k[0] == 0) < 0.02
    assert n[(1, 1)] / sum(v for k, v in n.items() if k[0] == 1) > 0.9


@pytest.mark.parametrize("text", [b"", b"a", bytes(range(256)) * 3, b"x" * 64, b"\x00" * 65])
def test_png_round_trip(text):
    png = media.encode(text)
    payload = media.decode(png)
    assert payload[: len(text)] == text and not any(payload[len(text) :]) and len(payload) % 64 == 0 and payload
    assert media.header(png[: media.HEADER]) == (64, len(payload) // 64, 8)


def test_media_columns_read_back(spark, tmp_path):
    df = odd(spark)
    got = media.media_columns(df).collect()
    assert len(got) == df.count()
    for r in got:
        text = next((x["text"] or "").encode() for x in df.collect() if x["doc_id"] == r["doc_id"] and len((x["text"] or "").encode()) == r["n_bytes"])
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    folder = tmp_path / "shards"
    rows = media.write_shards(df.coalesce(1), f"file://{folder}", shard_bytes=2_000).collect()
    for r in rows:
        with tarfile.open(folder / r["shard"]) as t:
            png = t.extractfile(f"{r['digest']}.png").read()
        assert hashlib.sha256(png).hexdigest() == r["digest"] and len(png) == r["length"]
        assert io.open(folder / r["shard"], "rb").read()[r["offset"] :][: r["length"]] == png
    assert media.media_columns(df.limit(0)).count() == 0


def plain_quality(text):
    """The features of quality.NAMES, character by character."""
    b = text.encode()
    words = b.split()
    if not words:
        return [0.0] * len(quality.NAMES)
    n, solid = len(words), sum(c not in b" \t\n\x0b\x0c\r" for c in b)
    upper, digits = sum(65 <= c <= 90 for c in b), sum(48 <= c <= 57 for c in b)
    letters = upper + sum(97 <= c <= 122 or c >= 192 for c in b)
    lines = [x for x in b.split(b"\n") if x]
    top, kinds = max(words.count(w) for w in words), len(set(words))
    return [
        sum(chr(c) in "#$%&*+/<=>@[\\]^_`{|}~" for c in b) / solid, b.count(b"!") / n, b.count(b"|") / n, upper / max(letters, 1), digits / solid,
        sum(words[i] == words[i - 1] for i in range(1, n)) / n, 1 - len(set(lines)) / len(lines), (top - 1) / (n + 10), 1 - (math.log(kinds) / math.log(n) if n > 1 else 1),
        sum(len(w) <= 3 for w in words) / n, sum(len(w) > 14 for w in words) / n, min(1.0, (b.count(b".") + b.count(b"?")) / n), 1 / (1 + n / 8),
    ]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB9 \n\t!|#.?é\x1c", max_size=60))
def test_quality_features_against_plain_version(text):
    assert np.allclose(quality.features(text.encode()), plain_quality(text))


def test_op7_against_plain_version(spark):
    from sieveline.llm.registry import op7_quality_classifier

    small = DATA.replace("0.01", "0.001")
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    m = quality.fit(docs, labels)
    again = quality.fit(docs.repartition(7), labels)
    assert (m.weights == again.weights).all() and m.threshold == again.threshold
    got = {r["doc_id"]: r for r in op7_quality_classifier(spark, small).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        z = [min(8, max(-8, (x - mean) / scale)) for x, mean, scale in zip(plain_quality(r["text"] or ""), m.mean, m.scale, strict=True)]
        want = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, m.weights, strict=True)) - m.threshold)) * 3 / 7)
        g = got[r["doc_id"]]
        assert abs(g["score"] - want) < 1e-9 and g["predicted"] == int(g["score"] >= 0.7) and g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    clash = quality.score(docs.selectExpr("doc_id", "text", "'x' as score", "1 as predicted"), labels)
    assert clash.columns == ["doc_id", "text", "score", "predicted"] and dict(clash.dtypes)["score"] == "double"


def test_quality_ties_at_the_cut():
    """Equal texts of both labels: no cut lies between them, and all score exactly the cut."""
    x = np.tile(quality.features(b"same words here."), (6, 1))
    assert np.allclose(quality.bradley_terry(x, np.array([1, 0, 1, 0, 1, 0]), pairs=100).score(x), 0.7)


def test_clashing_names_are_replaced_or_ignored(spark):
    pages = spark.createDataFrame([(1, "http://A.com/x", "z", 5), (2, None, "z", 5)], "page_id long, url string, host string, verdict int")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["verdict"], got[2]["host"]) == ("a.com", "/x", "allow", "")
    docs = spark.createDataFrame([(1, "abc", 9), (2, None, 9)], "doc_id long, text string, n_bytes int")
    assert {r["doc_id"]: r["n_bytes"] for r in media.media_columns(docs).select("doc_id", "n_bytes").collect()} == {1: 3, 2: 0}
