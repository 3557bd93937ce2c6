"""Votes as state against the batch vote, under any split of the input."""

import glob
import random
import time

from pyspark.sql import functions as F

from sieveline.functions import normalize as N
from sieveline.operators import evidence as E
from sieveline.streaming import votes as T

COLUMNS = ["entity_id", "field", "value", "confidence", "verified_level", "evidence_count", "n_urls"]


def made(n: int) -> list[tuple]:
    r = random.Random(5)
    kinds = ["official_website", "business_directory", "content_lead", "unknown"]
    rows = []
    for i in range(n):
        who = "hot" if i % 3 == 0 else f"e{r.randrange(12)}"
        field = r.choice(["email", "business_name", "phone"])
        value = {"email": f"{r.randrange(5)}@x.org", "business_name": f"Name {r.randrange(4)}", "phone": f"+1 512 555 01{r.randrange(6):02d}"}[field]
        rows.append((who, i, field, r.choice([value, value.upper(), value, ""]), f"http://s{r.randrange(9)}.org", r.choice(kinds), r.choice([0.36, 0.4, 0.75, 0.95])))
    return rows


def batch(rows):
    canon = N.canonical(F.col("field"), F.col("value"))
    groups = E.verified(E.append(rows), canon)
    urls = groups.where("rn = 1").select("entity_id", "field", "n_urls")
    won = E.winners(groups)
    return sorted(map(tuple, won.join(urls, ["entity_id", "field"]).select(COLUMNS).collect()))


def run(spark, source, out, **how):
    rows = spark.readStream.schema(E.SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = T.start(T.vote_changes(rows, **how), out)
    q.awaitTermination()
    return q


def test_any_split_ends_where_the_batch_does(spark, tmp_path):
    rows = spark.createDataFrame(made(600), E.SCHEMA)
    want = batch(rows)
    for n in (1, 3):
        source, out = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        rows.repartition(n).write.parquet(source)
        q = run(spark, source, out)
        changes = spark.read.schema(T.CHANGES).parquet(f"{out}/changes")
        assert sorted(map(tuple, T.current(changes).select(COLUMNS).collect())) == want
        # each removal takes back the row said just before it
        for key in {(r["entity_id"], r["field"]) for r in changes.collect()}:
            told = sorted((r for r in changes.collect() if (r["entity_id"], r["field"]) == key), key=lambda r: r["seq"])
            assert [r["op"] for r in told] == ["add"] + ["remove", "add"] * (len(told) // 2)
            assert all(a["value"] == b["value"] and a["evidence_count"] == b["evidence_count"] for a, b in zip(told[::2], told[1::2], strict=False))
    fields = len({(r[0], r[2]) for r in made(600)})
    state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert fields * 3 < state < 600 * 3  # groups, URLs and two rows a field; not the evidence itself


def test_a_restart_goes_on_and_rereads_nothing(spark, tmp_path):
    rows = made(90)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows[:60], E.SCHEMA).coalesce(1).write.parquet(source)
    run(spark, source, out)
    for f in glob.glob(f"{source}/*.parquet"):
        open(f, "w").close()  # what was read before is not read again
    spark.createDataFrame(rows[60:], E.SCHEMA).coalesce(1).write.mode("append").parquet(source)
    q = run(spark, source, out)
    assert sum(p["numInputRows"] for p in q.recentProgress) == 30
    assert sorted(map(tuple, T.current(spark.read.schema(T.CHANGES).parquet(f"{out}/changes")).select(COLUMNS).collect())) == batch(spark.createDataFrame(rows, E.SCHEMA))


def test_a_leader_that_falls(spark, tmp_path):
    """The leading value's mean falls with a later row, so that another leads, which that batch does not name."""
    rows = [("a", 1, "email", "x@y.z", "u1", "k", 0.95), ("a", 2, "email", "p@q.r", "u2", "k", 0.9), ("a", 3, "email", "x@y.z", "u1", "k", 0.1)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for r in rows:
        spark.createDataFrame([r], E.SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, out)
    changes = spark.read.schema(T.CHANGES).parquet(f"{out}/changes")
    assert [(r["op"], r["value"]) for r in changes.orderBy("seq").collect()] == [("add", "x@y.z"), ("remove", "x@y.z"), ("add", "p@q.r")]


def test_quiet_fields_are_taken_back(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda who: spark.createDataFrame([(who, 1, "email", f"{who}@y.z", "u", "k", 0.5)], E.SCHEMA).coalesce(1)
    row("a").write.parquet(source)
    q = T.start(T.vote_changes(spark.readStream.schema(E.SCHEMA).parquet(source), quiet_ms=100), out, "0 seconds")
    told = lambda: [(r["entity_id"], r["op"]) for r in spark.read.schema(T.CHANGES).parquet(f"{out}/changes").orderBy("seq").collect()]

    def wait(n: int) -> None:
        end = time.monotonic() + 40
        while time.monotonic() < end and (not glob.glob(f"{out}/changes/*.parquet") or len(told()) < n):
            time.sleep(0.5)

    try:
        wait(2)
        row("a").write.mode("append").parquet(source)  # forgotten, then said again: its numbers still rise
        wait(4)
        assert told() == [("a", "add"), ("a", "remove")] * 2
    finally:
        q.stop()


def test_odd_rows(spark, tmp_path):
    rows = [(None, 1, "email", "x@y.z", None, None, None), (None, None, "email", "X@y.z", None, "k", 0.4), ("a", 1, "email", None, "u", "k", 0.4), ("a", 2, "email", " ", "u", "k", 0.4), ("b", 3, "email", "x@y.z", "u", "k", 0.4), ("b", 3, "email", "x@y.z", "u", "k", 0.4)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, E.SCHEMA).coalesce(1).write.parquet(source)
    run(spark, source, out)
    got = {(r["entity_id"], r["field"]): (r["value"], r["evidence_count"], r["n_urls"]) for r in T.current(spark.read.schema(T.CHANGES).parquet(f"{out}/changes")).collect()}
    assert got == {(None, "email"): ("x@y.z", 2, 1), ("b", "email"): ("x@y.z", 2, 1)}


def test_no_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], E.SCHEMA).write.parquet(source)
    run(spark, source, out)
    assert T.current(spark.createDataFrame([], T.CHANGES)).count() == 0


def test_state_partitions_are_fixed_by_the_first_start(spark, tmp_path):
    source, out, usual = str(tmp_path / "in"), str(tmp_path / "out"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.createDataFrame(made(9), E.SCHEMA).coalesce(1).write.parquet(source)
    q = T.start(T.vote_changes(spark.readStream.schema(E.SCHEMA).parquet(source)), out, partitions=2)
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numShufflePartitions"] == 2 and spark.conf.get("spark.sql.shuffle.partitions") == usual
    assert T.partitions_for(0, 8) == 8 and T.partitions_for(64 << 30, 8) == 1024
