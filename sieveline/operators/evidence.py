"""Evidence: the fact table entity_id, ord, field, value, source_url, source_type, reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import normalize as N
from sieveline.plans.dims import HOST_HINTS, RELIABILITY

SCHEMA = "entity_id string, ord long, field string, value string, source_url string, source_type string, reliability double"


def source_type(url: Column, website: Column | None = None, hints: tuple[tuple[str, str], ...] = HOST_HINTS) -> Column:
    """official_website on the entity's own site, else the first hint the host holds, else unknown."""
    host = N.authority(url)
    own = N.authority(website) if website is not None else F.lit("")
    out = F.when((own != "") & host.endswith(own), "official_website")
    for hint, kind in hints:
        out = out.when(host.contains(hint), kind)
    return out.otherwise("unknown")


def reliability(kind: Column, table: dict[str, float] = RELIABILITY) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), kind), F.lit(table["unknown"]))


def append(evidence: DataFrame) -> DataFrame:
    """Evidence that says something: empty values are no evidence."""
    return evidence.where(N.filled(F.col("value")) != "")


def field_urls(evidence: DataFrame) -> DataFrame:
    """(entity_id, field, urls): different URLs in order of first appearance."""
    first = evidence.groupBy("entity_id", "field", "source_url").agg(F.min("ord").alias("o"))
    return first.groupBy("entity_id", "field").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "source_url"))), lambda s: s["source_url"]).alias("urls"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Two facts of each page about its site: the language it states and the title it shows."""
    host = N.authority(F.col("url"))
    entity = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    url = F.col("url")
    kind = F.when(url.contains("#"), "official_website").when(url.endswith(".html"), "business_directory").when(url.contains("?"), "content_lead").otherwise("unknown")
    facts = F.array(
        F.struct(F.lit("language").alias("field"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("value")),
        F.struct(F.lit("business_name").alias("field"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("value")),
    )
    rows = pages.select(entity.alias("entity_id"), F.col("page_id").alias("ord"), F.explode(facts).alias("f"), url.alias("source_url"), kind.alias("source_type"))
    return append(rows.select("entity_id", "ord", "f.field", "f.value", "source_url", "source_type", reliability(F.col("source_type")).alias("reliability")))


def verified(evidence: DataFrame, key: Column) -> DataFrame:
    """(entity_id, field, canon, value, score, rn, n, n_urls, n_types): groups of like values, ranked.

    score = 0.65 mean reliability + 0.08 different URLs (4 at most) + 0.04 different kinds of source (3 at most);
    ties go to the group that appeared first."""
    rows = evidence.withColumn("canon", key).where("canon <> ''")
    # first by URL, then by value: both combine before their shuffle, and different URLs need no expanded rows
    by_url = rows.groupBy("entity_id", "field", "canon", "source_url").agg(
        F.sum("reliability").alias("total"), F.count("*").alias("n"), F.min("ord").alias("first"), F.min_by("value", "ord").alias("value"), F.collect_set("source_type").alias("types")
    )
    groups = by_url.groupBy("entity_id", "field", "canon").agg(
        (F.sum("total") / F.sum("n")).alias("rel"), F.count("*").alias("n_urls"), F.sum("n").alias("n"), F.min("first").alias("first"), F.min_by("value", "first").alias("value"),
        F.sort_array(F.collect_list("source_url")).alias("urls"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"),
    ).withColumn("n_types", F.size("types").cast("long"))
    score = F.col("rel") * 0.65 + F.least("n_urls", F.lit(4)) * 0.08 + F.least("n_types", F.lit(3)) * 0.04
    groups = groups.withColumn("score", F.round(score, 9))
    best = Window.partitionBy("entity_id", "field").orderBy(F.desc("score"), "first", "canon")
    return groups.withColumn("rn", F.row_number().over(best)).withColumnRenamed("rel", "mean_reliability").drop("first")


def confidence(score: Column) -> Column:
    return F.least(score, F.lit(0.99))


def level(n_urls: Column, sure: Column) -> Column:
    return F.when((n_urls >= 3) & (sure >= 0.8), "high").when((n_urls >= 2) | (sure >= 0.72), "medium").otherwise("low")


def winners(groups: DataFrame) -> DataFrame:
    """(entity_id, field, value, confidence, verified_level, evidence_count, sources) of each field."""
    sure = confidence(F.col("score"))
    w = groups.where("rn = 1")
    return w.select("entity_id", "field", N.shown(F.col("field"), F.col("value")).alias("value"), F.round(sure, 3).alias("confidence"), level(F.col("n_urls"), sure).alias("verified_level"), F.col("n").alias("evidence_count"), F.col("urls").alias("sources"))


def conflicts(groups: DataFrame) -> DataFrame:
    """The groups that lost, in rank order, with their sources."""
    return groups.where("rn > 1").select("entity_id", "field", (F.col("rn") - 1).alias("place"), N.shown(F.col("field"), F.col("value")).alias("value"), F.col("urls").alias("sources"), F.col("types").alias("source_types"))


def keep_old(won: DataFrame, old: DataFrame) -> DataFrame:
    """(entity_id, field, value): what won, else what was known before."""
    j = won.select("entity_id", "field", F.col("value").alias("_new")).join(old.select("entity_id", "field", F.col("value").alias("_old")), ["entity_id", "field"], "full")
    return j.select("entity_id", "field", F.coalesce(F.when(F.col("_new") != "", F.col("_new")), "_old").alias("value"))


# fixed values: entries of menus that are no services
MENU_WORDS = ("menu", "see menu", "view menu", "book now", "contact us")


def clean_list(field: Column, values: Column, name: Column) -> Column:
    """List values split, trimmed and told apart; services without links, menu words, the name or scraps."""
    split = F.flatten(F.transform(values, lambda v: F.split(v, r"\s*(?:,|;|\|)\s*")))
    pieces = F.transform(F.when(field.isin("services", "specialties"), split).otherwise(values), lambda v: N.spaced(N.edges(v, " -.,")))
    bad = lambda v: v.startswith("http://") | v.startswith("https://") | N.name_key(v).isin(*MENU_WORDS) | ((N.name_key(name) != "") & (N.name_key(v) == N.name_key(name))) | (F.length(v) < 3)
    return F.array_distinct(F.filter(pieces, lambda v: (v != "") & ~(field.isin("services", "specialties") & bad(v))))


def list_fields(evidence: DataFrame, names: DataFrame) -> DataFrame:
    """evidence(entity_id, ord, field, values, source_url) of list fields -> values, confidence, level, evidence_count."""
    g = evidence.groupBy("entity_id", "field").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "values"))), lambda s: s["values"])).alias("raw"), F.count_distinct("source_url").alias("n_urls"))
    g = g.join(names, "entity_id", "left").withColumn("raw", F.filter("raw", lambda v: N.filled(v) != ""))
    out = g.withColumn("values", clean_list(F.col("field"), F.col("raw"), F.col("name"))).where(F.size("values") > 0)
    return out.select("entity_id", "field", "values", F.round(F.least(0.55 + F.col("n_urls") * 0.1, F.lit(0.9)), 3).alias("confidence"), F.when(F.col("n_urls") > 1, "medium").otherwise("low").alias("verified_level"), F.size("raw").alias("evidence_count"))


def entity_reliability(won: DataFrame, scalars: tuple[str, ...]) -> DataFrame:
    """(entity_id, reliability_score): 0.35 share of filled scalar fields + 0.65 mean confidence, 1 at most."""
    filled = F.count_if(F.col("field").isin(*scalars) & (F.col("value") != ""))
    score = F.least(0.35 * filled / len(scalars) + 0.65 * F.avg("confidence"), F.lit(1.0))
    return won.groupBy("entity_id").agg(F.round(score, 3).alias("reliability_score"))


COVERAGE = (("website", "website"), ("phone_number", "phone"), ("working_hours", "working_hours"), ("license_information", "license_information"), ("email", "email"), ("address", "address"), ("rating", "rating"))


def coverage(entities: DataFrame) -> DataFrame:
    """One row of whole percentages: entities with each field, and with services or specialties."""
    total = F.count("*")
    cols = [N.percent_text(F.count_if(N.filled(F.col(c)) != ""), total).alias(f"records_with_{k}") for k, c in COVERAGE]
    return entities.agg(*cols, N.percent_text(F.count_if((F.size("services") > 0) | (F.size("specialties") > 0)), total).alias("records_with_services"))


def verified_count(won: DataFrame) -> DataFrame:
    return won.where(F.col("verified_level").isin("medium", "high")).agg(F.count_distinct("entity_id").alias("businesses_verified"))


def limitations(phone: Column, address: Column, rating: Column, n_errors: Column) -> Column:
    """What a report must admit, by coverage percentages and errors."""
    rules = (
        (N.percent_number(phone) < 60, "Few phones are known; official sites or paid map data may add some."),
        (N.percent_number(address) < 70, "Few addresses are known; map sources should come first for this question."),
        (N.percent_number(rating) < 50, "Few ratings are known, since many public sources do not show them."),
        (n_errors > 0, "Some sources failed or were late; the report rests on partial evidence."),
    )
    return F.array_compact(F.array(*(F.when(test, text) for test, text in rules)))


def field_reports(won: DataFrame) -> DataFrame:
    """(entity_id, field, report): a field's level and evidence count as a JSON object."""
    return won.select("entity_id", "field", F.to_json(F.struct(F.col("verified_level").alias("value"), F.col("evidence_count").alias("n"))).alias("report"))


def flat_json(won: DataFrame, value: str = "value") -> DataFrame:
    """(entity_id, flat): an entity's fields as one JSON object, keys in order; an entity has a few fields only."""
    pairs = F.sort_array(F.collect_list(F.struct("field", value)))
    return won.groupBy("entity_id").agg(F.to_json(F.map_from_entries(pairs)).alias("flat"))
