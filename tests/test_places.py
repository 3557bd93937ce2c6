"""Place tables against the maps they replace, and at a hundred thousand places."""

import random

from pyspark.sql import functions as F

from sieveline.operators import filters as L
from sieveline.plans import places as T
from sieveline.plans import search as S
from sieveline.plans.dims import Gazetteer

G = Gazetteer()


def test_tables_say_what_the_maps_say(spark, tmp_path):
    rng = random.Random(3)
    words = ["austin", "texas", "Dallas", "parisian", "Paris", "in", "chennai", "Tamil", "Nadu", "leeds", "cafes", "usa", "united", "kingdom", "London,", "england", "gujarat", "houston", "madras", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(120)]
    asked = ["austin", "Texas", "chennai", "tamilnadu", "UK", "nowhere", "london", "dallas", "", "Trichy"]
    rows = [(t, rng.choice(asked), i) for i, t in enumerate(texts)] + [("Paris", "austin", 7)] * 2 + [("", "austin", 1)]
    df = spark.createDataFrame(rows, "text string, location string, phrase int")
    T.Places.of(spark, G).write(str(tmp_path / "places"))
    places = T.Places.read(spark, str(tmp_path / "places"))
    got = sorted((r["text"], r["location"], r["phrase"], r["has_location"], r["wrong_location"]) for r in T.signals(df, places).collect())
    want = df.select("text", "location", "phrase", L.has_location(F.col("text"), F.col("location"), G).alias("h"), L.has_wrong_location(F.col("text"), F.col("location"), G).alias("w"))
    assert got == sorted(map(tuple, want.collect())) and {(r[3], r[4]) for r in got} == {(a, b) for a in (True, False) for b in (True, False)}
    place = df.select("location").distinct().select("location", S.aliases(F.col("location"), G).alias("a"), S.search_places(F.col("location"), G).alias("s"))
    assert {r["location"]: (r["aliases"], r["search_places"]) for r in T.search_places_of(df, places).collect()} == {r["location"]: (r["a"], r["s"]) for r in place.collect()}
    codes = {r["text"]: r["code"] for r in T.countries_of(df, places).collect()}
    assert {t: codes.get(t, "") for t in texts} == {r["text"]: r["c"] for r in df.where(F.col("text").isin(texts)).select("text", S.country_of(F.col("text"), G).alias("c")).collect()}
    odd = spark.createDataFrame([(None, "austin"), ("Paris", None)], "text string, location string")
    assert {(r["has_location"], r["wrong_location"]) for r in T.signals(odd, places).collect()} == {(False, False)}
    assert T.signals(df.limit(0), places).count() == 0


def test_a_hundred_thousand_places(spark):
    base = T.Places.of(spark, G)
    many = spark.range(100_000).select(F.format_string("region %d", F.expr("id div 100")).alias("region"), F.col("id").cast("int").alias("ord"), F.format_string("town number %d", "id").alias("town"))
    wide = T.Places(base.corrections, base.aliases, base.regions.unionByName(many), base.others, base.countries)
    df = spark.createDataFrame([("cafe at Town Number 5", "region 0"), ("cafe at town number 55555", "region 0"), ("town number 5555", "austin"), ("town numbers", "austin")], "text string, location string")
    got = {(r["text"], r["has_location"], r["wrong_location"]) for r in T.signals(df, wide).collect()}
    assert got == {("cafe at Town Number 5", True, False), ("cafe at town number 55555", True, True), ("town number 5555", False, True), ("town numbers", False, False)}
    size = lambda p: len(T.signals(df, p)._jdf.queryExecution().analyzed().toString())
    assert size(wide) < size(base) * 1.5
