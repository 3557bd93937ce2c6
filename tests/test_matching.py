"""Entity matching: what meets, how much of it, and that clusters are those of one global fold."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sieveline.operators import dedupe as D
from test_operators import fold_by_rule

RECORD = "ord long, business_name string, address string, phone string, website string"


def changed(rng, text, most):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        i = rng.randrange(len(out) + 1)
        match rng.randrange(3):
            case 0:
                out.insert(i, rng.choice("abcxyz 12"))
            case 1:
                out[i : i + 1] = []
            case 2:
                out[i : i + 1] = [rng.choice("abcxyz 12")]
    return "".join(out)


@pytest.mark.parametrize("most", [2000, 12])
def test_all_alike_texts_meet(spark, most):
    rng = random.Random(4)
    texts = {changed(rng, t, n // 3) for n in (1, 2, 3, 4, 5, 6, 8, 12, 20, 40) for t in ["".join(rng.choice("abcde") for _ in range(n)) for _ in range(3)] for _ in range(6)} | {"aaaaaaaa", "aaaaaaa", "abababab", "babababa"}
    texts = sorted(t for t in texts if t)
    rows = spark.createDataFrame([(t, True) for t in texts], "text string, need boolean")
    for r in (0.69, 0.872):
        met = {(x["x"], x["y"]) for x in D.alike_texts(rows, r, most).collect()}
        assert met == {(a, b) for i, b in enumerate(texts) for a in texts[:i] if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= r}


def made(seed, n, gaps):
    """Records whose names repeat across streets, with small changes and the given share of empty fields."""
    rng = random.Random(seed)
    names = ["blue fox bakery", "blue fox bakery", "red hen", "zed dental", "fox"]
    streets = ["12 north road", "400 oak avenue west", "9 hill", "12 north road east"]
    out = []
    for i in range(n):
        keep = lambda x: "" if rng.random() < gaps else x
        out.append((i, keep(changed(rng, rng.choice(names), 2)), keep(changed(rng, rng.choice(streets), 3)), keep(rng.choice([f"555 000 {rng.randrange(12):04d}", ""])), keep(rng.choice([f"s{rng.randrange(12)}.com", "", ""]))))
    return out


@pytest.mark.parametrize(("seed", "gaps", "most", "large"), [(1, 0.0, 2000, 3), (2, 0.3, 2000, 3), (3, 0.5, 5, 10**6)])
def test_clusters_are_those_of_one_fold(spark, seed, gaps, most, large):
    df = spark.createDataFrame(made(seed, 60, gaps), RECORD)
    plain = fold_by_rule([r.asDict() for r in D.keyed(df).orderBy("ord").collect()])
    assert [r["cluster"] for r in D.clusters(df.repartition(3), large=large, most=most).orderBy("ord").collect()] == plain
    assert D.fold([r.asDict() for r in D.keyed(df).orderBy("ord").collect()]) == plain


def test_a_shared_word_makes_few_candidates(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10))
    rows = [(f"{word()} house", True) for _ in range(1500)]
    texts = spark.createDataFrame(rows, "text string, need boolean")
    grams = D._rarest(texts.select("text"))
    places = texts.join(grams, "text").select(F.explode(D._meeting_places(F.col("grams"), F.col("text"), 0.872)).alias("place")).groupBy("place").count()
    assert places.agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] < 30 * 1500  # of 1,124,250 pairs


def test_an_equal_name_alone_links_nothing(spark):
    rng = random.Random(6)
    rows = [(i, "Blue Fox Bakery", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(14)), "", "") for i in range(300)]
    df = spark.createDataFrame(rows, RECORD)
    assert D.superset_edges(df).count() < 30
    assert D.clusters(df, large=100).where(F.col("ord") != F.col("cluster")).isEmpty()
