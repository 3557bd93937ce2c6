"""Queries of the engine's operators over the driver tables, each with its SQL where SQL can say it.

Scalar operators are one table: name, table, key, Column, SQL. The SQL is written on its own, from the rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import normalize as N
from sieveline.functions.workers import reach
from sieveline.operators import dedupe as D
from sieveline.operators import evidence as E
from sieveline.operators import extract as X
from sieveline.operators import filters as L
from sieveline.plans import search as S
from sieveline.plans.dims import HOST_HINTS, INDUSTRIES, RELIABILITY, Gazetteer
from sieveline.sources import feeds as P

Query = Callable[[SparkSession, str], DataFrame]
G = Gazetteer()
QUESTION = "what is the erly oning thand that with"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL pieces, each the rule in DuckDB's words


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def q_list(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def q_plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def q_name(x: str) -> str:
    return q_plain(f"regexp_replace({x}, '(?i)\\b({N.SUFFIX_WORDS})\\b', ' ', 'g')")


def q_digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def q_phone(x: str) -> str:
    d = q_digits(x)
    d = f"(CASE WHEN length({d}) = 11 AND {d} LIKE '1%' THEN substr({d}, 2) ELSE {d} END)"
    return f"(CASE WHEN length({d}) < 8 THEN '' ELSE {d} END)"


def q_host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def q_path(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"


def q_site(x: str) -> str:
    full = f"(CASE WHEN contains({x}, '://') THEN {x} ELSE 'https://' || {x} END)"
    return f"(CASE WHEN {x} = '' THEN '' ELSE regexp_replace({q_host(full)}, '^www\\.', '') END)"


def q_address(x: str) -> str:
    out = f"lower({x})"
    for a, b in N.ADDRESS_SHORT:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return q_plain(out)


def q_terms(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}')), lambda t: NOT list_contains({q_list(N.STOP_WORDS)}, t))"


def q_any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def q_tokens(x: str, ignored) -> str:
    return f"list_filter(string_split({q_name(x)}, ' '), lambda t: length(t) > 2 AND NOT list_contains({q_list(ignored)}, t))"


def q_first(pairs, test: Callable[[str], str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test(a)} THEN {q(b)}" for a, b in pairs) + f" ELSE {q(default)} END"


STREET = "concat(c_custkey, ' North Street, Suite ', c_nationkey, '; Lake Road')"
PHONE = "concat('+1 (', lpad(CAST(c_custkey % 900 + 100 AS STRING), 3, '0'), ') 555-', lpad(CAST(c_custkey * 37 % 10000 AS STRING), 4, '0'), ' / n.a.')"
COMPANY = "concat('The ', c_mktsegment, ' Co ', c_name, ' LLC - Clinic of record')"
CARD = "concat('[', c_name, '], - , ', c_mktsegment, ' , , North')"


def in_duck(spark_sql: str) -> str:
    return spark_sql.replace("AS STRING", "AS VARCHAR")


def col(sql: str) -> Column:
    return F.expr(sql)


def industry_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {q_any(f'lower({x})', words)} THEN {q(name)}" for name, words in INDUSTRIES) + " ELSE 'general' END"


d_phone, d_company, d_street, d_card = map(in_duck, (PHONE, COMPANY, STREET, CARD))
TARGET = "CAST(o_orderkey % 1200 AS BIGINT)"

#: name, table, key, Column, SQL
SCALARS: tuple[tuple[str, str, str, Callable[[], Column], str], ...] = (
    ("str01_flat_text", "customer", "c_custkey", lambda: N.flat_text(F.col("c_name"), F.when(F.col("c_nationkey") > 12, ""), F.col("c_mktsegment")), "c_name || ' ' || c_mktsegment"),
    ("str02_name_key", "customer", "c_custkey", lambda: N.name_key(col(COMPANY)), q_name(d_company)),
    ("str03_phone_key", "customer", "c_custkey", lambda: N.phone_key(col(PHONE)), q_phone(d_phone)),
    ("str04_site_key", "pages", "page_id", lambda: N.site_key(F.col("url")), q_site("url")),
    ("str05_address_key", "customer", "c_custkey", lambda: N.address_key(col(STREET)), q_address(d_street)),
    ("str06_canonical", "customer", "c_custkey", lambda: N.canonical(F.when(F.col("c_nationkey") % 2 == 0, "phone").otherwise("business_name"), F.when(F.col("c_nationkey") % 2 == 0, col(PHONE)).otherwise(col(COMPANY))), f"CASE WHEN c_nationkey % 2 = 0 THEN {q_phone(d_phone)} ELSE {q_name(d_company)} END"),
    ("str06_canonical_list", "customer", "c_custkey", lambda: N.canonical_list(F.array("c_name", "c_mktsegment", F.lit(""))), f"list_aggregate(list_sort([{q_name('c_name')}, {q_name('c_mktsegment')}]), 'string_agg', '|')"),
    ("str07_shown_phone", "customer", "c_custkey", lambda: N.shown(F.lit("phone"), col(PHONE)), f"trim(string_split({d_phone}, '/')[1], ' -.,')"),
    ("str07_shown_address", "customer", "c_custkey", lambda: N.shown(F.lit("address"), col(CARD)), "c_name || ', ' || c_mktsegment || ', North'"),
    ("str08_clean_title", "customer", "c_custkey", lambda: N.clean_title(col(COMPANY)), "substr(trim(regexp_replace(" + d_company + ", '\\s+[-|]\\s+.*$', '')), 1, 180)"),
    ("str09_lead_parts", "customer", "c_custkey", lambda: F.array_join(N.lead_parts(F.concat_ws(" | ", "c_name", "c_mktsegment", F.lit(" : Best, "))), "~"), "c_name || '~' || c_mktsegment || '~Best'"),
    ("str10_clean_lead", "customer", "c_custkey", lambda: N.clean_lead(F.concat(F.col("c_nationkey").cast("string"), F.lit(") "), F.col("c_name"), F.lit(" is a good one"))), "c_name"),
    ("str11_clean_phone", "customer", "c_custkey", lambda: N.clean_phone(F.concat(F.lit(" -"), F.col("c_custkey").cast("string"), F.lit("  55., "))), "CAST(c_custkey AS VARCHAR) || ' 55'"),
    ("str12_address_line", "customer", "c_custkey", lambda: N.address_line(F.col("c_name"), F.lit(None).cast("string"), F.lit(""), F.col("c_nationkey").cast("string"), F.lit("X")), "c_name || ', ' || CAST(c_nationkey AS VARCHAR) || ', X'"),
    ("str13_strip_tags", "pages", "page_id", lambda: N.strip_tags(F.regexp_extract("html", "(<title>[^<]*</title>)", 1)), "trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"),
    ("str14_slug", "customer", "c_custkey", lambda: N.slug(col(COMPANY)), f"substr(trim(regexp_replace(lower({d_company}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80)"),
    ("str15_terms", "documents", "doc_id", lambda: F.array_join(F.array_sort(N.terms(F.col("text"))), " "), f"coalesce(list_aggregate(list_sort({q_terms('text')}), 'string_agg', ' '), '')"),
    ("str16_name_tokens", "customer", "c_custkey", lambda: F.array_join(N.name_tokens(col(COMPANY), N.HIT_IGNORED), " "), f"list_aggregate({q_tokens(d_company, N.HIT_IGNORED)}, 'string_agg', ' ')"),
    ("str17_percent", "orders", "o_orderkey", lambda: N.percent_number(F.concat((F.col("o_orderkey") % 101).cast("string"), F.lit("%"))), "CAST(o_orderkey % 101 AS INTEGER)"),
    ("str18_escape", "documents", "doc_id", lambda: N.escape(F.col("text")), "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"),
    ("str20_run_key", "customer", "c_custkey", lambda: N.run_key(F.col("c_name"), F.col("c_custkey")), "substr(md5(lower(trim(c_name))), 1, 8) || '_' || CAST(c_custkey AS VARCHAR)"),
    ("str21_evidence_card", "customer", "c_custkey", lambda: N.evidence_card(F.col("c_name"), F.lit(""), F.lit(None).cast("string"), F.lit("w"), F.lit("h"), F.lit("r"), F.col("c_mktsegment"), F.lit("e")), "'Name: ' || c_name || chr(10) || 'Address: N/A' || chr(10) || 'Phone: N/A' || chr(10) || 'Website: w' || chr(10) || 'Hours: h' || chr(10) || 'Rating: r' || chr(10) || 'Services: ' || c_mktsegment || chr(10) || 'Email: e'"),
    ("str22_client_key", "customer", "c_custkey", lambda: N.client_key(F.col("c_name"), F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")), F.when(F.col("c_nationkey") > 15, col(PHONE))), f"CASE WHEN c_nationkey > 15 THEN 'p:' || {q_digits(d_phone)} WHEN c_nationkey > 5 THEN 'na:' || {q_plain('c_name')} || '|' || {q_plain('c_mktsegment')} ELSE 'n:' || {q_plain('c_name')} END"),
    ("qry03_industry", "documents", "doc_id", lambda: S.industry(F.col("text")), industry_sql("text")),
    ("qry04_corrected", "customer", "c_custkey", lambda: S.fixed_location(F.element_at(F.array(*map(F.lit, ("USA", "Trichy", "Old  Town", "U.K.", "tamilnadu"))), (F.col("c_custkey") % 5 + 1).cast("int")), G), "['united states', 'tiruchirappalli', 'Old Town', 'U.K.', 'tamil nadu'][c_custkey % 5 + 1]"),
    ("qry05_aliases", "customer", "c_custkey", lambda: F.array_join(S.aliases(F.element_at(F.array(*map(F.lit, ("chennai", "Chennai", "austin", "nowhere"))), (F.col("c_custkey") % 4 + 1).cast("int")), G), "|"), "['chennai|madras|chennai tamil nadu|tamil nadu', 'Chennai', 'austin|austin texas|texas', 'nowhere'][c_custkey % 4 + 1]"),
    ("qry08_country", "customer", "c_custkey", lambda: S.country_of(F.concat(F.lit("cafes in "), F.element_at(F.array(*map(F.lit, ("Leeds", "london ontario", "Madurai India", "UAE", "Mars"))), (F.col("c_custkey") % 5 + 1).cast("int"))), G), "['gb', 'gb', 'in', 'ae', ''][c_custkey % 5 + 1]"),
    ("qry09_search_places", "customer", "c_custkey", lambda: F.array_join(S.search_places(F.element_at(F.array(*map(F.lit, ("Texas", "toronto", "Oslo"))), (F.col("c_custkey") % 3 + 1).cast("int")), G), "|"), "['austin|dallas|houston', 'toronto|toronto ontario|ontario|canada', 'Oslo'][c_custkey % 3 + 1]"),
    ("qry10_expansions", "customer", "c_custkey", lambda: F.array_join(S.expansions(F.element_at(F.array(*map(F.lit, ("plumers", "cafes", "opera"))), (F.col("c_custkey") % 3 + 1).cast("int")), G), "|"), "['plumbers|plumber|plumbing service|pipe repair', 'cafes|cafe|coffee shop|bakery cafe', 'opera'][c_custkey % 3 + 1]"),
    ("qry16_taxonomy", "customer", "c_custkey", lambda: F.array_join(S.taxonomy(F.element_at(F.array(*map(F.lit, ("gyms", "plumbers", "opera"))), (F.col("c_custkey") % 3 + 1).cast("int")), G), "|"), "['sport.fitness', 'service|commercial', 'commercial|healthcare|service'][c_custkey % 3 + 1]"),
    ("qry17_candidate_goal", "orders", "o_orderkey", lambda: S.candidate_goal(col(TARGET)), f"CASE WHEN {TARGET} <= 10 THEN greatest(60, {TARGET} * 12) WHEN {TARGET} <= 100 THEN greatest(300, {TARGET} * 6) WHEN {TARGET} <= 500 THEN greatest(1000, {TARGET} * 5) ELSE least(5000, greatest({TARGET} * 3, {TARGET} + 500)) END"),
    ("qry17_enrichment_goal", "orders", "o_orderkey", lambda: S.enrichment_goal(col(TARGET)), f"CASE WHEN {TARGET} <= 10 THEN {TARGET} WHEN {TARGET} <= 100 THEN least(40, {TARGET}) ELSE least(80, {TARGET}) END"),
    ("src12_detail_goal", "orders", "o_orderkey", lambda: S.detail_goal(col(TARGET)), f"CASE WHEN {TARGET} <= 25 THEN {TARGET} WHEN {TARGET} <= 100 THEN 40 ELSE 50 END"),
    ("srt04_clamp", "orders", "o_orderkey", lambda: S.clamp_limit(F.col("o_orderkey") * 3 - 50), "CASE WHEN o_orderkey * 3 - 50 = 0 THEN 200 ELSE least(greatest(o_orderkey * 3 - 50, 1), 5000) END"),
    ("flt01_has_location", "pages", "page_id", lambda: L.has_location(F.concat_ws(" ", F.col("url"), F.when(F.col("page_id") % 3 == 0, "Austin, Texas")), F.lit("austin"), G), "page_id % 3 = 0"),
    ("flt02_wrong_location", "pages", "page_id", lambda: L.has_wrong_location(F.concat_ws(" ", F.col("url"), F.element_at(F.array(*map(F.lit, ("Austin", "in Paris", "Parisian", "Dallas"))), (F.col("page_id") % 4 + 1).cast("int"))), F.lit("austin"), G), "page_id % 4 = 1"),
    ("flt03_relevance", "pages", "page_id", lambda: L.relevance(F.when(F.col("page_id") % 2 == 0, "Top 10 cafes").otherwise("Cafe Austin"), F.lit(""), F.col("url"), F.lit("cafes"), F.lit("austin"), G), "CAST(CASE WHEN page_id % 2 = 0 THEN 0.15 ELSE 0.95 END AS DOUBLE)"),
    ("flt04_keeps_hit", "pages", "page_id", lambda: L.keeps_hit(F.when(F.col("page_id") % 2 == 0, "Cafe Austin").otherwise("Cafe"), F.lit(""), F.col("url"), F.lit("cafes"), F.lit("austin"), G), "page_id % 2 = 0"),
    ("flt09_host_class", "pages", "page_id", lambda: L.host_class(F.when(F.col("page_id") % 3 == 0, "https://www.yelp.com/x").when(F.col("page_id") % 3 == 1, "http://quora.com/y").otherwise(F.col("url"))), "['directory', 'content', 'own'][page_id % 3 + 1]"),
    ("flt10_listicle", "part", "p_partkey", lambda: L.listicle(F.concat(F.lit("best "), N.plain(F.col("p_name"))), F.array(F.lit("part"))), f"contains({q_plain('p_name')}, 'part')"),
    ("flt10_directory_title", "pages", "page_id", lambda: L.directory_title(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))), q_any("lower(regexp_extract(html, '<title>([^<]*)</title>', 1))", L.DIRECTORY_TITLES)),
    ("flt12_lead_name", "customer", "c_custkey", lambda: L.lead_name(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).otherwise("list of everything Good"), F.lit("cafes"), F.lit("austin")), "c_nationkey % 2 = 0"),
    ("flt13_place_matches", "customer", "c_custkey", lambda: L.place_matches(F.concat(F.col("c_name"), F.when(F.col("c_nationkey") % 2 == 0, " cafe, Austin").otherwise(" cafe, Oslo")), F.lit("cafes"), F.lit("austin"), G), "c_nationkey % 2 = 0"),
    ("flt14_hit_score", "customer", "c_custkey", lambda: L.hit_score(F.col("c_name"), F.lit("in austin"), F.lit("https://justdial.com/x"), F.col("c_name"), F.lit("https://justdial.com"), F.lit("cafes"), F.lit("austin")), f"CAST(round(len({q_tokens('c_name', N.HIT_IGNORED)}) * 0.22 + 0.7, 6) AS DOUBLE)"),
    ("flt15_page_is_about", "customer", "c_custkey", lambda: L.page_is_about(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).otherwise("other"), F.lit("http://a.b"), F.col("c_name"), F.lit(""), F.lit("cafes"), F.lit("austin")), "c_nationkey % 2 = 0"),
    ("flt16_generic_profile", "customer", "c_custkey", lambda: L.generic_profile(F.when(F.col("c_nationkey") % 2 == 0, "https://www.practo.com/austin/cafes").otherwise("https://x.com/austin/cafes"), F.lit("cafes"), F.lit("austin")), "c_nationkey % 2 = 0"),
    ("flt17_source_type", "pages", "page_id", lambda: E.source_type(F.concat(F.lit("https://"), F.element_at(F.array(*(F.lit(h.strip(".")) for h, _ in HOST_HINTS)), (F.col("page_id") % len(HOST_HINTS) + 1).cast("int")), F.lit(".x/"))), f"{'[' + ', '.join(q(next((k for h, k in HOST_HINTS if h in own.strip('.') + '.x'), 'unknown')) for own, _ in HOST_HINTS) + ']'}[page_id % {len(HOST_HINTS)} + 1]"),
    ("flt17_reliability", "pages", "page_id", lambda: E.reliability(F.element_at(F.array(*map(F.lit, [*RELIABILITY, "other"])), (F.col("page_id") % (len(RELIABILITY) + 1) + 1).cast("int"))), f"[{', '.join(f'CAST({v} AS DOUBLE)' for v in [*RELIABILITY.values(), 0.4])}][page_id % {len(RELIABILITY) + 1} + 1]"),
    ("join03_identity_site", "pages", "page_id", lambda: D.identity_site(F.when(F.col("page_id") % 2 == 0, "https://maps.google.com/x").otherwise(F.col("url"))), f"CASE WHEN page_id % 2 = 0 THEN '' ELSE {q_site('url')} END"),
    ("join10_lead_score", "customer", "c_custkey", lambda: D.lead_score(F.col("c_mktsegment"), F.concat(F.col("c_mktsegment"), F.lit(" House "), F.col("c_name"))), "CAST(0.82 AS DOUBLE)"),
    ("ext07_emails", "documents", "doc_id", lambda: F.array_join(X.emails(F.col("text")), ","), "coalesce(list_aggregate(list_sort(list_distinct(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}'))), 'string_agg', ','), '')"),
    ("ext07_phones", "documents", "doc_id", lambda: F.array_join(X.phones(F.col("text")), ","), f"coalesce(list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(text, {q(X.PHONE)}), lambda p: regexp_replace(trim(p, ' .,-'), '\\s+', ' ', 'g')))), 'string_agg', ','), '')"),
    ("ext10_canonical", "pages", "page_id", lambda: F.concat(F.regexp_extract("url", "^([a-z]+)://", 1), F.lit("://"), N.authority(F.col("url"))), f"regexp_extract(url, '^([a-z]+)://', 1) || '://' || {q_host('url')}"),
    ("ext12_host_path", "pages", "page_id", lambda: F.concat_ws(" ", N.authority(F.col("url")), N.url_path(F.col("url"))), f"{q_host('url')} || ' ' || {q_path('url')}"),
    ("src04_page_offset", "orders", "o_orderkey", lambda: P.page_offset(F.col("o_orderkey"), "a") * 1000 + P.page_offset(F.col("o_orderkey"), "b"), "(o_orderkey - 1) * 30 * 1000 + (o_orderkey - 1) * 10 + 1"),
    ("src16_place_id", "customer", "c_custkey", lambda: P.place_id(F.when(F.col("c_nationkey") % 2 == 0, "id7"), F.concat(F.lit("places/"), F.col("c_name"))), "CASE WHEN c_nationkey % 2 = 0 THEN 'id7' ELSE c_name END"),
    ("src19_cache_key", "customer", "c_custkey", lambda: P.cache_key(F.lit("b"), F.col("c_name"), F.col("c_custkey")), "sha256('b|' || c_name || '|' || CAST(c_custkey AS VARCHAR))"),
    ("src21_map_url", "customer", "c_custkey", lambda: P.map_url(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name"))), "CASE WHEN c_nationkey % 2 = 0 THEN 'https://www.google.com/maps/place/?q=place_id:' || c_name ELSE 'https://www.google.com/maps' END"),
    ("src22_json", "events", "event_id", lambda: F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1)), "coalesce(CAST(json_extract(props, '$.k') AS INTEGER), -1)"),
    ("src23_country_name", "customer", "c_custkey", lambda: S.country_name(S.country_of(F.when(F.col("c_nationkey") % 2 == 0, "gyms in dallas").otherwise("gyms in oslo"), G)), "CASE WHEN c_nationkey % 2 = 0 THEN 'United States' ELSE '' END"),
    ("snk05_business_key", "customer", "c_custkey", lambda: P.business_key(col(PHONE), F.lit(""), F.col("c_name"), col(STREET)), f"sha256({q_phone(d_phone)} || '||' || {q_name('c_name')} || '|' || {q_address(d_street)})"),
    ("snk05_run_id", "customer", "c_custkey", lambda: P.run_id(F.col("c_name"), F.col("c_custkey").cast("string")), "substr(sha256(c_name || '|' || CAST(c_custkey AS VARCHAR)), 1, 24)"),
)


def _scalar(name: str, source: str, key: str, make: Callable[[], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, make().alias("value"))

    run.__name__ = name
    return run


QUERIES: dict[str, Query] = {name: _scalar(name, source, key, make) for name, source, key, make, _ in SCALARS}
ORACLES: dict[str, str] = {name: f"SELECT {key}, {sql} AS value FROM {source}" for name, source, key, _, sql in SCALARS}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep
