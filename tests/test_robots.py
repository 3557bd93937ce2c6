"""Robots files by tables against the standard library's reader."""

import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from sieveline.operators import robots as R

FILES = {
    "http://a.org": "User-agent: *\nDisallow: /private/\nAllow: /private/open\n",
    "http://b.org": "# all\nUser-Agent: other\nUser-agent: Sieve\nAllow: /a/b\nDisallow: /a\n\nUser-agent: *\nDisallow: /\n",
    "http://c.org": "User-agent: *\n\nDisallow: /x\n",
    "http://d.org": "Disallow: /x\nUser-agent: *\nDisallow:\nDisallow: /y # not here\nsitemap: http://d.org/s\nUser-agent: sieve\nCrawl-delay: 3\n",
    "https://e.org:8080": "User-agent:sieve\r\nDisallow: /%7Ejoe/\r\nDisallow: /q?a=1\r\nDisallow: /é/%zz\r\nnonsense\r\n: x\r\nAllow : /~joe/me",
    "http://f.org": "User-agent: *\nDisallow: *\nDisallow: /*.gif\nUser-agent: *\nDisallow: /second\n",
    "http://g.org": "",
    "http://h.org": "User-agent: siev\nUser-agent: *\nDisallow: /both\n \nDisallow: /more\n\t\nUser-agent: sieve\nDisallow: /own",
    "http://i.org": "User-agent: *\nRequest-rate: 1/5\n\nUser-agent: sieve\nDisallow: /;p\nDisallow: /a;\nDisallow: /b?\nDisallow: /c#\nDisallow: /d%23x\n",
}
PATHS = ["", "/", "/private/", "/private/open", "/private/open/x", "/a", "/a/b", "/a/bc", "/ab", "/x", "/x/y", "/y", "/~joe/", "/%7ejoe/x", "/%7Ejoe/me", "/q", "/q?a=1&b", "/q?a=2", "/é/%25zz", "/%C3%A9/%zz", "/*", "/z.gif", "/second", "/both", "/more", "/own", "/a;", "/a;b", "/;p", "/b", "/b?", "/b?q", "/c", "/c#f", "/d#x", "/d%23x", "//x", "?q", "#f", "/a+b", "/%2Fx"]


def by_reader(text, agent, url):
    reader = RobotFileParser()
    reader.parse(text.splitlines())
    return reader.can_fetch(agent, url)


@pytest.mark.parametrize("agent", ["sieve/1.0", "*", "Other", "nobody"])
def test_files_are_read_as_the_reader_does(spark, agent):
    files = spark.createDataFrame([(o, 200, t) for o, t in FILES.items()], "origin string, status int, body string")
    urls = [o + p for o in [*FILES, "http://none.org"] for p in PATHS]
    got = {r["url"] for r in R.allowed(spark.createDataFrame([(u, "k") for u in urls], "url string, origin string"), files, agent).collect()}
    assert got == {u for u in urls if by_reader(FILES.get("/".join(u.split("/")[:3]).split("?")[0].split("#")[0], ""), agent, u)}


def test_made_files(spark):
    rng = random.Random(8)
    lines = ["User-agent: *", "User-agent: sieve", "User-agent: x", "", "", " ", "Disallow: /a", "Allow: /a/b", "Disallow: /", "Allow: /c", "Disallow: /a/b/c", "Disallow:", "Crawl-delay: 1", "# note", "Sitemap: s"]
    files = {f"http://h{i}.org": "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14))) for i in range(150)}
    urls = [h + p for h in files for p in ("/", "/a", "/a/b", "/a/b/c/d", "/c/d", "/zz")]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"] for r in R.allowed(df, spark.createDataFrame([(o, 200, t) for o, t in files.items()], "origin string, status int, body string"), "sieve").collect()}
    assert got == {u for u in urls if by_reader(files[u[: u.index(".org") + 4]], "sieve", u)}


def test_unreadable_files_and_odd_rows(spark):
    text = "User-agent: *\nDisallow: /"
    files = spark.createDataFrame([("http://s.org", s, text) for s in ()] + [(f"http://s{s}.org", s, text) for s in (200, 401, 403, 404, 500, None)], "origin string, status int, body string")
    urls = [f"http://s{s}.org/x" for s in (200, 401, 403, 404, 500, None, "no")] + ["nothing", "", None, "HTTP://S404.ORG/x", "HTTP://S401.org", "http://s404.org/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    assert sorted(r["id"] for r in R.allowed(df, files).collect()) == [3, 5, 6, 10, 12]
    assert R.allowed(df.limit(0), files).count() == 0 and R.allowed(df, files.limit(0)).count() == len(urls) - 3


def test_the_longest_rule_may_decide(spark):
    files = spark.createDataFrame([("http://a.org", 200, FILES["http://a.org"] + "Disallow: /e\nAllow: /e\n")], "origin string, status int, body string")
    df = spark.createDataFrame([(f"http://a.org{p}",) for p in ("/private/open/x", "/private/", "/e")], "url string")
    may = lambda longest: {r["url"][12:] for r in R.allowed(df, files, longest=longest).collect()}
    assert may(False) == set() and may(True) == {"/private/open/x", "/e"}


def test_paths_are_cut_to_the_lengths_of_rules(spark):
    files = spark.createDataFrame([("http://a.org", 200, "User-agent: *\n" + "".join(f"Disallow: /{i:04d}\n" for i in range(2000)))], "origin string, status int, body string")
    df = spark.range(3000).select(F.format_string("http://a.org/%04d/some/long/path/of/a/page", "id").alias("url"))
    plan = R.allowed(df, files)
    assert plan.count() == 1000
    rules = R.rules_for(R.parsed(files), "*")
    assert rules.select(F.length("path")).distinct().count() == 1
