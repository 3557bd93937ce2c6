"""Streams, data sources, the engine, and the driver's contract."""

import json

import duckdb
import pytest

import __spark_entry__ as entry
from sieveline.engine import Engine, Settings, readiness
from sieveline.operators import evidence as E
from sieveline.sources import replay
from sieveline.streaming import incremental as I

SMALL = "/root/testdata/sf0.001"


def own_queries():
    return [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", own_queries())
def test_query_matches_its_sql(spark, name, tmp_path):
    got = entry.queries()[name](spark, SMALL)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.count() >= 0
        return
    got.write.parquet(str(tmp_path / "got"))
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    con.execute(f"CREATE TABLE want AS {sql}")
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    cols = ", ".join(f'"{c}"' for c in sorted(got.columns))
    for a, b in (("want", "got"), ("got", "want")):
        assert con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


def test_batches_end_where_one_batch_does(spark, tmp_path):
    ev = E.page_evidence(spark.read.parquet(f"{SMALL}/pages.parquet")).select("entity_id", "ord", "field", "value", "source_url", "source_type", "reliability")
    ends = []
    for n in (1, 4):
        source, out = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        ev.repartition(n).write.parquet(source)
        I.start(spark, source, out).awaitTermination()
        ends.append(sorted(map(str, I.current_winners(spark, out).collect())))
    assert ends[0] == ends[1] and ends[0]


def test_replayed_pages(spark, tmp_path):
    path = tmp_path / "pages.jsonl"
    path.write_text("\n".join(json.dumps({"query": q, "page": p, "body": f"{q}{p}"}) for q in ("a", "b") for p in (1, 2)))
    replay.register(spark)
    read = spark.read.format("sieveline_replay").option("path", f"file://{path}").option("queries", '["a", "c"]').option("pages", "2")
    assert sorted((r["query"], r["body"]) for r in read.load().collect()) == [("a", "a1"), ("a", "a2")]
    late = read.option("deadline_seconds", "0").load().collect()
    assert {r["error"] for r in late} == {"deadline"} and len(late) == 4
    assert read.option("enabled", "false").load().count() == 0
    bad = spark.read.format("sieveline_replay").option("path", "file:///none").option("queries", '["a"]').load().collect()
    assert [r["error"] for r in bad] == ["FileNotFoundError"]


def test_settings_and_engine(spark):
    s = Settings.of({"SERPER_API_KEY": "k", "RAG_ENABLED": "Yes"}, "CONCURRENCY=8\n# x=1\nTOP_K='3'")
    assert (s.concurrency, s.top_k, s.rag_enabled) == (8, 3, True)
    assert readiness(s)["ready"] and not readiness(Settings())["ready"]
    e = Engine(spark)
    assert 0 < e.plan("plumbers in austin").count() <= 36
    out = e.run(E.page_evidence(spark.read.parquet(f"{SMALL}/pages.parquet")), 5)
    assert out["entities"].count() == 5 and out["verified"].count() > 5
    report = out["report"].first()
    assert report["businesses_found"] == 5 and report["records_with_phone_number"] == "0%" and len(report["limitations"]) == 3
    assert out["index"].select("entity_id").distinct().count() == 5


def test_batches_read_only_their_buckets(spark, tmp_path):
    sink = I.verify_into(str(tmp_path), buckets=8)
    rows = lambda who, value: spark.createDataFrame([(who, 1, "email", value, f"http://{value}", "unknown", 0.4)], E.SCHEMA)
    sink(rows("a", "x@y.z"), 0)
    (next((tmp_path / "evidence" / "batch=0").glob("bucket=*")) / "broken.parquet").write_text("no parquet")
    other = next(c for c in "bcdefgh" if not list((tmp_path / "evidence" / "batch=0").glob(f"bucket={spark.range(1).selectExpr(f'pmod(xxhash64(\'{c}\'), 8) b').first()['b']}")))
    sink(rows(other, "p@q.r"), 1)
    out = spark.read.parquet(f"{tmp_path}/winners").collect()
    assert {r["entity_id"] for r in out} == {"a", other}
