"""The store against whole upserts, and the geographic join against all pairs."""

import math
import random

from pyspark.sql import functions as F

from sieveline.sources import feeds as P
from sieveline.sources.store import SCHEMA, Store

BATCH = "business_key string, payload string, at int"


def test_a_store_is_the_upsert_of_its_batches(spark, tmp_path):
    rng = random.Random(1)
    store = Store(spark, f"file://{tmp_path}/store", buckets=8)
    whole = spark.createDataFrame([], SCHEMA.format(key="business_key"))
    for n, size in enumerate([40, 3, 0, 2, 60]):
        rows = [(rng.choice([None, *(f"k{i}" for i in range(30))]), rng.choice([None, f"p{rng.random()}"]), i) for i in range(size)]
        batch = spark.createDataFrame(rows, BATCH)
        before = store.newest()
        busy = store.merge(batch, f"r{n}", n, order="at")
        after = store.newest()
        assert {b for b in after if after[b] != before.get(b)} == set(busy) and (size > 3 or len(busy) <= size)
        assert all(f"bucket={b}" in f for b, f in zip(sorted(busy), sorted(store.folders(busy), key=lambda f: int(f.rsplit("=", 1)[1])), strict=True))
        filled = batch.fillna("", ["business_key"])
        whole = spark.createDataFrame(P.upsert(whole, filled, F.lit(f"r{n}"), F.lit(n).cast("long"), order="at").collect(), SCHEMA.format(key="business_key"))
        assert sorted(map(str, store.read().collect())) == sorted(map(str, whole.collect()))
    # a merge that did not end leaves no trace for readers
    seen = sorted(map(str, store.read().collect()))
    spark.createDataFrame([("k1", "x", ["r"], 1, 1, 3)], SCHEMA.format(key="business_key") + ", bucket int").write.partitionBy("bucket").parquet(f"{store.path}/version=99")
    fs, p = store._fs()
    fs.delete(p(f"{store.path}/version=99/_SUCCESS"), False)
    assert sorted(map(str, store.read().collect())) == seen
    assert store.vacuum() > 0 and sorted(map(str, store.read().collect())) == seen and store.vacuum() == 0


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_many_centres_against_all_pairs(spark):
    rng = random.Random(2)
    centres = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(25)] + [(90, 89.99, 10.0), (91, -90.0, 0.0), (92, 10.0, 179.99), (93, 10.0, -180.0), (94, 0.0, 0.0), (95, None, 1.0), (96, 60.0, 359.9)]
    at = [c for c in centres if c[1] is not None]
    points = [(i, max(-90.0, min(90.0, c[1] + rng.gauss(0, 0.15))), c[2] + rng.gauss(0, 0.2) / max(0.01, math.cos(math.radians(c[1])))) for i, c in enumerate(rng.choice(at) for _ in range(600))]
    points = [(i, a, ((b + 180) % 360) - 180) for i, a, b in points] + [(900, 90.0, -77.0), (901, None, None), (902, 10.0, 180.0), (903, 10.0, -179.999), (904, float("nan"), 1.0)]
    df, own = spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(centres, "centre int, lat double, lon double")
    for far in (18_000, 250_000, 900):
        got = {(r["id"], r["centre"]) for r in P.near_centres(df, own, far).collect()}
        assert got == {(i, c) for i, a, b in points if a is not None and a == a for c, x, y in at if metres(x, y, a, b) <= far} and got
    assert P.near_centres(df.limit(0), own).count() == 0
