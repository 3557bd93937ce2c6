"""The engine's surface: settings, readiness, and a research run over tables."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import normalize as N
from sieveline.operators import dedupe as D
from sieveline.operators import evidence as E
from sieveline.operators import filters as L
from sieveline.operators import retrieval as R
from sieveline.plans import search as S
from sieveline.plans.dims import LIST_FIELDS, SCALAR_FIELDS, Gazetteer


def flag(value: str | None, default: bool = False) -> bool:
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    """Limits and keys of a deployment; `of` reads them from an environment that wins over a file's lines."""

    keys: dict[str, str] = field(default_factory=dict)
    concurrency: int = 12
    request_timeout: int = 15
    query_budget: int = 36
    pages: int = 2
    max_urls: int = 1000
    max_leads: int = 100
    rag_enabled: bool = False
    chunk: int = 800
    overlap: int = 120
    top_k: int = 6

    @classmethod
    def of(cls, env: dict[str, str] | None = None, lines: str = "") -> Settings:
        pairs = dict(x.split("=", 1) for x in lines.splitlines() if "=" in x and not x.lstrip().startswith("#"))
        e = {k.strip(): v.strip().strip("\"'") for k, v in pairs.items()} | dict(os.environ if env is None else env)
        keys = {k: e[k] for k in ("GEOAPIFY_API_KEY", "GOOGLE_MAPS_API_KEY", "SERPER_API_KEY", "TAVILY_API_KEY") if e.get(k)}
        return cls(keys, int(e.get("CONCURRENCY", 12)), int(e.get("REQUEST_TIMEOUT", 15)), int(e.get("QUERY_BUDGET", 36)), int(e.get("PAGES", 2)), int(e.get("MAX_URLS", 1000)), int(e.get("MAX_LEADS", 100)), flag(e.get("RAG_ENABLED")), int(e.get("CHUNK_SIZE", 800)), int(e.get("CHUNK_OVERLAP", 120)), int(e.get("TOP_K", 6)))


def readiness(s: Settings) -> dict[str, bool]:
    """Which sources have their keys; ready with one map and one search source."""
    on = {"geoapify": "GEOAPIFY_API_KEY" in s.keys, "google_places": "GOOGLE_MAPS_API_KEY" in s.keys, "serper": "SERPER_API_KEY" in s.keys, "tavily": "TAVILY_API_KEY" in s.keys}
    maps, search = on["geoapify"] or on["google_places"] or on["serper"], on["serper"] or on["tavily"]
    return on | {"ready": maps and search}


class Engine:
    """Research over tables: evidence in, ranked entities and their quality out."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, gazetteer: Gazetteer | None = None):
        self.spark, self.settings, self.gazetteer = spark, settings or Settings(), gazetteer or Gazetteer()

    def plan(self, raw: str) -> DataFrame:
        questions = self.spark.createDataFrame([(0, raw)], "qid int, raw string")
        return S.balanced(S.one_each(S.plan_rows(S.parse(questions, self.gazetteer), self.gazetteer)), self.settings.query_budget)

    def run(self, evidence: DataFrame, limit: int = 200, category: str = "", location: str = "", errors: int = 0) -> dict[str, DataFrame]:
        """The whole run over evidence, whose `ord` numbers rows across entities: entities are voted on, gated where a category
        or place is given, matched and merged; the evidence of merged ones is voted on again as that of their first.

        verified, conflicts: of all merged entities; same: (entity_id, head); entities: at most `limit`, by reliability;
        report: one row of counts, coverage and limitations; index: chunks of the entities' texts; chunks: the top evidence."""
        scalars = (*(c for _, c in E.COVERAGE), "business_name", "review_count")
        limit = min(max(limit or 200, 1), 5000)
        rows = E.append(evidence)
        canon = N.canonical(F.col("field"), F.col("value"))
        records = wide(E.winners(E.verified(rows, canon))).join(rows.groupBy("entity_id").agg(F.min("ord").alias("ord"), F.array_join(F.sort_array(F.collect_set("source_url")), " ").alias("urls")), "entity_id")
        if category or location:
            e = {c: F.col(c) for c in ("business_name", "website", "urls", *L.STRONG_FIELDS)}
            records = records.where(L.keeps_entity(e, F.lit("web"), F.lit(category), F.lit(location), self.gazetteer))
        cluster = D.clusters(records)
        heads = cluster.join(records.select("ord", "entity_id"), "ord").join(records.select(F.col("ord").alias("cluster"), F.col("entity_id").alias("head")), "cluster")
        same = heads.select("entity_id", "head")
        rows = rows.join(same, "entity_id").drop("entity_id").withColumnRenamed("head", "entity_id")
        groups = E.verified(rows, canon)
        won = E.winners(groups)
        lists = E.list_fields(rows.where(F.col("field").isin(*LIST_FIELDS)).withColumn("values", F.array("value")), won.where("field = 'business_name'").select("entity_id", F.col("value").alias("name")))
        lists = lists.groupBy("entity_id").pivot("field", list(LIST_FIELDS)).agg(F.first("values"))
        entities = wide(won).join(E.entity_reliability(won, scalars), "entity_id").join(lists, "entity_id", "left").orderBy(F.desc("reliability_score"), "entity_id").limit(limit)
        sums = entities.agg(F.count("*").alias("businesses_found")).crossJoin(same.agg(F.count_if(F.col("entity_id") != F.col("head")).alias("duplicate_records_removed"))).crossJoin(E.verified_count(won.join(entities.select("entity_id"), "entity_id")))  # one row each
        report = sums.crossJoin(E.coverage(entities)).withColumn("limitations", E.limitations(F.col("records_with_phone_number"), F.col("records_with_address"), F.col("records_with_rating"), F.lit(errors)))
        text = F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.when(N.filled(F.col(c)) != "", F.col(c)).otherwise("N/A")) for c in SCALAR_FIELDS), F.concat(F.lit("services: "), F.array_join(F.coalesce("services", F.array().cast("array<string>")), ", ")))
        index = R.index(entities.select("entity_id", text.alias("text"), F.col("website").alias("source")), size=self.settings.chunk, overlap=self.settings.overlap)
        return {"verified": won, "conflicts": E.conflicts(groups), "same": same, "entities": entities, "report": report, "index": index, "chunks": R.evidence_top(rows)}


def wide(won: DataFrame) -> DataFrame:
    """Winners as one row an entity with a column for each scalar field."""
    return won.groupBy("entity_id").pivot("field", list(SCALAR_FIELDS)).agg(F.first("value"))


def main(argv: list[str] | None = None) -> None:
    """python -m sieveline.engine QUERY: prints the source plan; with --evidence, writes the entities as JSON."""
    p = argparse.ArgumentParser(prog="sieveline")
    p.add_argument("query")
    p.add_argument("--limit", type=int, default=200)
    p.add_argument("--evidence")
    p.add_argument("--json-out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("sieveline").getOrCreate()
    engine = Engine(spark)
    engine.plan(a.query).orderBy("pos").select("pos", "grp", "query").show(60, False)
    if a.evidence and a.json_out:
        engine.run(spark.read.parquet(a.evidence), a.limit)["entities"].write.json(a.json_out)


if __name__ == "__main__":
    main()
