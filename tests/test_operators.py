"""Operators against plain Python on small fixtures of our own."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import html as H
from sieveline.functions import normalize as N
from sieveline.operators import dedupe as D
from sieveline.operators import evidence as E
from sieveline.operators import extract as X
from sieveline.operators import filters as L
from sieveline.operators import retrieval as R
from sieveline.plans import search as S
from sieveline.plans.dims import Gazetteer
from sieveline.sources import feeds as P

G = Gazetteer()


def values(spark, inputs, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in df.select("i", fn(F.col("x")).alias("v")).orderBy("i").collect()]


def test_names_phones_sites_and_addresses(spark):
    assert values(spark, ["The Blue Fox, LLC", "Éco Clinic of X", None, "Co-op Center"], N.name_key) == ["blue fox", "co of x", "", "op"]
    assert values(spark, ["+1 (555) 123-4567", "555-1234", "1-555-123-4567 ext", None, "020 7946 0958"], N.phone_key) == ["5551234567", "", "5551234567", "", "02079460958"]
    assert values(spark, ["https://www.A.com/x", "a.com", "http://u@B.org:80/?q", "", None], N.site_key) == ["a.com", "a.com", "u@b.org:80", "", ""]
    assert values(spark, ["12 Main Street, Suite 4", None], N.address_key) == ["12 main st ste 4", ""]


def test_shown_values(spark):
    assert values(spark, ["12; 555-123-4567, x", "none"], lambda c: N.shown(F.lit("phone"), c)) == ["555-123-4567", "none"]
    assert values(spark, ["['1 Main', - , Town]"], lambda c: N.shown(F.lit("address"), c)) == ["1 Main, Town"]
    assert values(spark, ["1) Blue Fox is a bakery - best", "x" * 90], N.clean_lead) == ["Blue Fox", ""]
    assert values(spark, ["12%", " 7 % ", "n/a", None], N.percent_number) == [12, 7, 0, 0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=40), min_size=1, max_size=5), st.integers(1, 9), st.integers(0, 8))
def test_chunks_against_a_loop(spark, texts, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            N.chunks(F.lit("x"), size, overlap)
        return
    want = []
    for t in texts:
        t, out, at = t.strip(), [], 0
        while at < len(t):
            out.append(t[at : at + size])
            at += size - overlap
        want.append(out)
    assert values(spark, texts, lambda c: N.chunks(c, size, overlap)) == want


EVIDENCE = [
    ("e", 1, "phone", "555-123-4567", "u1", "unknown", 0.4), ("e", 2, "phone", "+1 555 123 4567", "u2", "geoapify", 0.78), ("e", 3, "phone", "999 888 7777", "u3", "unknown", 0.4),
    ("e", 4, "business_name", "B", "u1", "unknown", 0.4), ("e", 5, "business_name", "A", "u2", "unknown", 0.4), ("e", 6, "email", "", "u", "unknown", 0.4),
]


def test_votes_conflicts_and_ties(spark):
    ev = E.append(spark.createDataFrame(EVIDENCE, E.SCHEMA))
    for n in (1, 5):
        groups = E.verified(ev.repartition(n), N.canonical(F.col("field"), F.col("value")))
        won = {r["field"]: r for r in E.winners(groups).collect()}
        assert won["phone"]["value"] == "555-123-4567" and won["phone"]["evidence_count"] == 2 and won["phone"]["verified_level"] == "medium"
        assert abs(won["phone"]["confidence"] - (0.59 * 0.65 + 0.16 + 0.08)) <= 0.001 and won["phone"]["sources"] == ["u1", "u2"]
        assert won["business_name"]["value"] == "B"  # equal scores: first seen
        lost = sorted((r["field"], r["value"], r["sources"]) for r in E.conflicts(groups).collect())
        assert lost == [("business_name", "A", ["u2"]), ("phone", "999 888 7777", ["u3"])]
    assert "email" not in won


def test_coverage_rounds_halves_to_even(spark):
    rows = [("x" if i < 1 else "", "x" if i < 3 else "") for i in range(8)]
    df = spark.createDataFrame(rows, "website string, phone string")
    for c in ("working_hours", "license_information", "email", "address", "rating"):
        df = df.withColumn(c, F.lit(""))
    df = df.withColumn("services", F.array().cast("array<string>")).withColumn("specialties", F.array().cast("array<string>"))
    r = E.coverage(df).first()
    assert (r["records_with_website"], r["records_with_phone_number"]) == ("12%", "38%")
    assert E.coverage(df.limit(0)).first()["records_with_website"] == "0%"


def records(seed, n):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(3, 16))) for _ in range(6)]
    out = []
    for i in range(n):
        name = list(rng.choice(names))
        for _ in range(rng.randrange(3)):
            name[rng.randrange(len(name))] = rng.choice("abcdxy")
        out.append((i, "" if rng.random() < 0.1 else "".join(name), rng.choice(["", "1 main street", "1 main st", "9 oak road"]), rng.choice(["", "", "555 123 4567", "555 999 0000"]), rng.choice(["", "", "", "a.com", "https://maps.google.com/q"])))
    return out


def fold_by_rule(rows):
    """Each record against every representative in turn."""
    heads, out = [], []
    for r in rows:
        same = lambda h, k: r[k] and r[k] == h[k]  # noqa: E731, B023
        alike = lambda h, k: SequenceMatcher(None, r[k], h[k]).ratio() if r[k] and h[k] else 0.0  # noqa: E731, B023
        for h in heads:
            name, address = alike(h, "k_name"), alike(h, "k_address")
            score = max(name * 0.55 + address * 0.45, name * 0.75, 0.96 if same(h, "k_phone") else 0, 0.94 if same(h, "k_site") else 0)
            if score >= 0.86 or same(h, "k_phone") and name > 0.45:
                h.update({k: h[k] or r[k] for k in ("k_name", "k_address", "k_phone", "k_site")})
                out.append(h["ord"])
                break
        else:
            heads.append(dict(r))
            out.append(r["ord"])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_component_folds_equal_one_global_fold(spark, seed):
    rows = records(seed, 30)
    df = spark.createDataFrame(rows, "ord long, business_name string, address string, phone string, website string")
    plain = fold_by_rule([r.asDict() for r in D.keyed(df).orderBy("ord").collect()])
    got = [r["cluster"] for r in D.clusters(df.repartition(3)).orderBy("ord").collect()]
    assert got == plain


def test_merge_fills_gaps_in_order(spark):
    df = spark.createDataFrame([(2, "", "9", ["b", "a"]), (1, "A", "", ["a"]), (3, "C", "8", None)], "ord long, business_name string, phone string, services array<string>")
    r = D.merged(df, df.select("ord", F.lit(1).cast("long").alias("cluster"))).first()
    assert (r["business_name"], r["phone"], r["services"], r["records"]) == ("A", "9", ["a", "b"], 3)


def test_lead_and_place_names(spark):
    leads = spark.createDataFrame([(1, "Blue Fox"), (2, "Zed")], "lead_id int, name string")
    places = spark.createDataFrame([(1, "Blue Fox Bakery"), (2, "Blue Hen"), (3, "Blue Fox"), (4, "The Fox Blue Inn")], "place_id int, name string")
    got = [(r["lead_id"], r["place_id"], r["score"]) for r in D.leads_with_places(leads, places).orderBy("rn").collect()]
    assert got[0] == (1, 3, 1.0) and got[1][:2] == (1, 4) or got[1][2] >= 0.82


def test_leads_against_all_pairs(spark):
    rng = random.Random(11)
    words = ["hot", "hot", "hot", "star", "starbucks", "smith", "smithson", "dental", "blue", "fox", "the", "inn"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
    leads = spark.createDataFrame([(i, name()) for i in range(60)] + [(90, "Star"), (91, "Smith"), (92, "ar"), (93, None)], "lead_id int, name string")
    places = spark.createDataFrame([(i, name()) for i in range(80)] + [(90, "Starbucks Coffee"), (91, "Smithson Dental"), (92, "")], "place_id int, name string")
    every = leads.withColumnRenamed("name", "lead").crossJoin(places.withColumnRenamed("name", "place")).withColumn("score", D.lead_score(F.col("lead"), F.col("place"))).where("score >= 0.62").collect()
    want = {}
    for r in sorted(every, key=lambda r: (r["lead_id"], -r["score"], r["place_id"])):
        want.setdefault(r["lead_id"], []).append((r["place_id"], r["score"]))
    got = {}
    for r in D.leads_with_places(leads, places).orderBy("lead_id", "rn").collect():
        got.setdefault(r["lead_id"], []).append((r["place_id"], r["score"]))
    assert got == {k: v[:2] for k, v in want.items()} and got[90] and got[91]


def test_common_words_make_few_candidates(spark):
    leads = spark.createDataFrame([(f"hot w{i} v{i}",) for i in range(100, 400)], "lead string")
    assert D.lead_candidates(leads, leads.withColumnRenamed("lead", "place")).count() < 1500  # of 90,000 pairs that share a word


def test_upsert_takes_the_last_of_a_key(spark):
    old = spark.createDataFrame([("a", "1", ["r0"], 1, 1), ("b", "2", ["r0"], 1, 1)], "business_key string, payload string, seen_in_run_ids array<string>, created_at int, updated_at int")
    new = spark.createDataFrame([("a", "z", 1), ("a", "y", 2), ("c", None, 1)], "business_key string, payload string, at int")
    got = {r["business_key"]: (r["payload"], r["seen_in_run_ids"], r["updated_at"]) for r in P.upsert(old, new, F.lit("r1"), F.lit(5), order="at").collect()}
    assert got == {"a": ("y", ["r0", "r1"], 5), "b": ("2", ["r0"], 1), "c": (None, ["r1"], 5)}


def test_questions(spark):
    rows = [(1, "best  dentists near Chennai"), (2, "austin texas gyms"), (3, "opera"), (4, "in"), (5, "top resturants around trichy")]
    got = {r["qid"]: (r["category"], r["location"]) for r in S.parse(spark.createDataFrame(rows, "qid int, raw string"), G).collect()}
    assert got == {1: ("dentists", "Chennai"), 2: ("gyms", "austin texas"), 3: ("opera", ""), 4: ("in", ""), 5: ("restaurants", "tiruchirappalli")}


def test_plans_name_the_sites_of_an_industry(spark):
    rows = [(1, "best dentists near Chennai"), (2, "hotels"), (3, "cafes in austin")]
    plan = S.plan_rows(S.parse(spark.createDataFrame(rows, "qid int, raw string"), G), G).collect()
    own = lambda q, grp: [r["query"] for r in sorted(plan, key=lambda r: r["ord"]) if r["qid"] == q and r["grp"] == grp]
    assert own(1, "industry_directory")[:2] == ['"dentists" "Chennai" site:healthgrades.com', '"dentists" "Chennai" site:zocdoc.com']
    assert len(own(1, "industry_directory")) == 6 and len(own(1, "directory")) == 11 + 1 and not own(2, "industry_directory")
    assert own(2, "contact") == ["hotels phone address website"] and "cafes in austin delivery contact number" in own(3, "services")


def test_budget_takes_groups_in_turn(spark):
    rows = [(0, f"q{i}", ("places", "social", "odd")[i % 3], i, i) for i in range(12)]
    plan = spark.createDataFrame(rows, "qid int, query string, grp string, priority int, ord int")
    got = [r["query"] for r in S.balanced(plan, 5).orderBy("pos").collect()]
    assert got == ["q0", "q1", "q3", "q4", "q6"]
    assert S.balanced(plan, 12).count() == 12


def test_gates(spark):
    test = lambda c, *a: L.generic_listing(c, F.lit("https://own.example"), F.lit("dentists"), F.lit("Chennai"))
    names = ["Best Dentists in Chennai", "Top 10 Dentists", "Smile House", "what to do when it hurts", "#1", "a@b", "Dentist in Chennai updated list"]
    assert values(spark, names, test) == [True, True, False, True, True, True, True]
    assert values(spark, ["Blue Fox Bakery", "read more", "lower case only", "One two three four five six seven eight Nine"], lambda c: L.lead_name(c, F.lit("x"), F.lit("y"))) == [True, False, False, False]
    assert values(spark, ["https://www.usbank.com/x", "https://a.gov", "https://yelp.com"], E.source_type) == ["government", "government", "review_platform"]


PAGE = """<html><head><title>Blue Fox - Home</title><meta name="description" content="Call 555-123-4567"><link rel="canonical" href="/home">
<script type="application/ld+json">{"@graph":[{"@type":"LocalBusiness","name":"Blue Fox","telephone":"555","address":{"streetAddress":"1 Main","addressCountry":"X"},"aggregateRating":{"ratingValue":4.5}}]}</script>
<script type="application/ld+json">{broken</script><script>var t="</p>";</script></head>
<body><p><b>Open<p>Mon: 9-5<!-- note --><ul><li>Repair services</li><li>R&amp;D</li></ul><a href="https://facebook.com/x?y">f</a><img src="i.png"></body></html>"""


def test_page_facts():
    facts = dict(X.page_facts("http://a.com/p", PAGE))
    assert facts["business_name"] == ["Blue Fox"] and facts["address"] == ["1 Main, X"] and facts["rating"] == ["4.5"]
    assert facts["website"] == ["http://a.com/home"] and facts["social_profiles"] == ["https://facebook.com/x"] and facts["images_urls"] == ["http://a.com/i.png"]
    assert facts["services"] == ["Repair services"] and "R&D" in facts["body"][0] and "var t" not in facts["body"][0]
    assert H.result_list('<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=http%3A%2F%2Fx.y">T</a><a class="result__snippet">S</a></div>', "a") == [{"title": "T", "url": "http://x.y", "snippet": "S", "rank": 1}]
    assert H.result_list('<li class="b_algo"><h2><a href="http://z">Z</a></h2><p>n</p></li>', "b") == [{"title": "Z", "url": "http://z", "snippet": "n", "rank": 1}]
    assert H.parse("<div>" * 5000).text() == ""


def test_text_facts_and_leads(spark):
    text = "Mail a@b.com or A@B.COM, call (555) 123-4567. Mon: 9 to 5\nrated 4.5 out of 5, 1,204 reviews. License: AB 1234"
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(X.text_facts(F.col("t"))).alias("f")).select("f.*")
    got = {}
    for r in df.collect():
        got.setdefault(r["field"], []).append(r["value"])
    assert got["email"] == ["A@B.COM", "a@b.com"] and got["phone"] == ["(555) 123-4567"] and got["rating"] == ["4.5"] and got["review_count"] == ["1,204"]
    page = "<h2>Blue Fox Bakery | Red Hen</h2><h3>read more</h3><li>lower words</li><div class='store-name'>Zed House is nice</div>"
    rows = X.leads(spark.createDataFrame([(1, page)], "page_id long, html string"), F.lit("cafes"), F.lit("austin")).orderBy("ord").collect()
    assert [r["name"] for r in rows] == ["Zed House", "Blue Fox Bakery", "Red Hen"]


def test_retrieval_edges(spark):
    docs = spark.createDataFrame([(0, "red fox", "s0"), (1, "blue fox", "s1"), (2, "none", "s2")], "chunk_id int, chunk string, source string")
    assert [r["chunk_id"] for r in R.lexical_top(docs, "the red fox", 2).collect()] == [0, 1]
    assert [r["score"] for r in R.lexical_top(docs, "zzz", 2).collect()] == [0.0, 0.0]
    a = R.answer(None, R.lexical_top(docs, "red fox", 2)).first()
    assert a["retrieval_mode"] == "lexical" and a["answer"].splitlines()[0] == "red fox" and a["sources"] == ["s0", "s1"]
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0])], "vec_id int, embedding array<double>")
    assert [r["vec_id"] for r in R.dense_top(vec, [1.0, 0.1], 2).collect()] == [0, 2]

    def broken(context, question):
        raise OSError

    assert R.generate("c", "q", broken, lambda c, q: "") == "c" and R.generate("c", "q", lambda c, q: "x") == "x"


def test_caches_and_upserts(spark):
    cache = spark.createDataFrame([("a", 10, "1"), ("b", 20, "2")], "url string, fetched_at long, body string")
    assert [r["url"] for r in P.fresh(cache, F.lit(25), 5).collect()] == ["b"]
    put = spark.createDataFrame([("a", 30, "3")], "url string, fetched_at long, body string")
    assert {r["url"]: r["body"] for r in P.latest(cache, put).collect()} == {"a": "3", "b": "2"}
    assert "<th>name</th><td>A &amp; B</td>" in P.report_html([{"name": "A & B"}], "q")


def test_titles_keep_references_without_a_semicolon(spark):
    html = "<!-- a & b --><script>x && y</script><title>{}</title><a href='/?a=1&b=2&amp;c=3'>Q &lt R</a>"
    titles = ["and&amp", "a &amp; b &lt;i&gt; &quot;c&quot;", "a && b & c", "&lt", "&amp;lt;", "R&D &copy 9"]
    pages = spark.createDataFrame([(i, "http://a.b/", html.format(t)) for i, t in enumerate(titles)], "page_id long, url string, html string")
    got = {r["page_id"]: r["values"][0] for r in X.html_facts(pages, closed=True).where("field = 'title'").collect()}
    assert got == dict(enumerate(["and&amp", 'a & b <i> "c"', "a && b & c", "&lt", "&lt;", "R&D &copy 9"]))
    assert [got[i] for i in range(len(titles))] == values(spark, titles, N.strip_tags)
    root = H.parse(html.format("x"), closed=True)
    assert H.find(root, "a")[0].attrs["href"] == "/?a=1&b=2&c=3" and H.find(root, "script")[0].text(hidden=True) == "x && y"
    assert H.title(H.parse("<title>and&amp</title>")) == "and&"  # HTML's own rule stays the operator's


def test_pages_are_read_few_at_a_time_and_for_wanted_fields_alone(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * X.PAGES + 7))], names=["page_id"])
    parts = list(X.few_rows(iter([batch, batch.slice(0, 3)])))
    assert [b.num_rows for b in parts] == [X.PAGES, X.PAGES, 7, 3] and sum((b.column(0).to_pylist() for b in parts), []) == [*range(batch.num_rows), 0, 1, 2]
    pages = spark.createDataFrame([(i, "http://a.com/p", PAGE) for i in range(3)], "page_id long, url string, html string")
    for fields in (("phone", "address"), ("title", "phone"), ("services",), ()):
        want = [(r["page_id"], r["field"], r["values"]) for r in X.html_facts(pages).orderBy("page_id", "ord").collect() if r["field"] in fields]
        assert [(r["page_id"], r["field"], r["values"]) for r in X.html_facts(pages, fields=fields).orderBy("page_id", "ord").collect()] == want
    monkeypatch.setattr(X.H, "links", lambda *_: pytest.fail("page texts were built"))
    assert X.page_facts("http://a.com/p", PAGE, fields=("phone",))


def test_grid_and_discovery_rows_are_dealt_over_all_tasks_and_meet_no_others(spark):
    from sieveline.functions.workers import tasks

    g = Gazetteer(expansions={"a": ("b", "a in b", "b"), "z": ()}, regions={"c": ("d", "b in d", "d")}, category_corrections={"q": "q"}, corrections={"q": "q"}, aliases={"q": ("q",)})
    asked = spark.createDataFrame([(1, "a", "c"), (1, "a", "c"), (2, "z", "y"), (3, "z", ""), (None, "a", "y")], "qid int, category string, location string").coalesce(1)

    def grid(category, location):
        out = {}
        for i, c in enumerate(dict.fromkeys([category, *g.expansions[category]])):
            for k, l in enumerate(g.regions.get(location) or [location] * (location != "")):
                out.setdefault(f"{c} in {l}", i * 1000 + k)
        return out

    order = lambda rows: sorted(rows, key=str)
    got = S.query_grid(asked, g)
    assert order(tuple(r) for r in got.select("qid", "query", "ord").collect()) == order((r["qid"], t, o) for r in asked.collect() for t, o in grid(r["category"], r["location"]).items())
    assert "Aggregate" not in got._jdf.queryExecution().toString()
    one = S.discovery_rows(asked.limit(1), g).collect()
    assert sorted(map(tuple, S.discovery_rows(asked.where("qid = 1"), g).collect())) == sorted(map(tuple, one * 2))
    many = asked.select(F.explode(F.sequence(F.lit(1), F.lit(100))).alias("qid"), "category", "location").coalesce(1)
    for made in (S.query_grid(many, g), S.discovery_rows(many, g)):
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() == tasks(spark)


def test_entity_hits_read_each_text_once(spark):
    entities = spark.createDataFrame([(1, "Blue Fox", "https://fox.example"), (2, None, None), (None, "No One", "")], "entity_id int, name string, website string")
    rows = [(1, "Blue Fox", "in Austin", "https://fox.example/a", 1), (1, "blue", None, "https://yelp.com/b", 0), (1, "other", "", "https://z.example", 2), (1, "Fox Blue", "austin", "u", 3), (2, "x", "austin", "v", 0), (None, "No One", "austin", "w", 0)]
    hits = spark.createDataFrame(rows, "entity_id int, title string, snippet string, url string, rank int")
    got = D.entity_hits(entities, hits, F.lit("cafes"), F.lit("austin"), 2, 0.2)
    score = L.hit_score(*map(F.col, ("title", "snippet", "url", "name", "website")), F.lit("cafes"), F.lit("austin"))
    want = D.top_hits(hits.join(entities, "entity_id").withColumn("score", score).where("score >= 0.2"), 2)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    assert got._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 1
