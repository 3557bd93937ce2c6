"""Robots files as tables: their groups and rules, and the URLs they allow.

`parsed` turns files into rules by windows over their lines: a group begins at a user-agent line that follows no other one, an
empty line ends it, and rules outside a group count for nothing. `allowed` picks for each origin the first group that names
the agent, else the first one for all agents, and lets the first of its rules that begins a URL's path decide (`longest`: the
longest one, and an allowing one of two equals). URLs are not held against all rules of their origin: a path is cut to the lengths that
its origin's rules have, and the beginnings meet the rules by equality. Different URLs are judged once.

A file's status decides where there is no text to read: 401 and 403 shut an origin, other 4xx open it, anything else that is no
success shuts it, and an origin whose file could not be fetched (no row, or a null status) is open.

Defined results: URLs without scheme or host are never read; a null URL neither; paths and rules are compared with their percent escapes
undone; an empty path is `/`; repeated URLs are all kept; of repeated files of an origin the first by text counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
FORM = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)(.*)$"


def unquoted(text: Column) -> Column:
    """Percent escapes undone; a percent sign that begins none stays."""
    plain = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.url_decode(plain)).otherwise(text)


def _trimmed(path: Column) -> Column:
    """Without empty parameters, queries and fragments."""
    path = F.regexp_replace(path, "#$", "")
    path = F.regexp_replace(path, r"\?(?=#|$)", "")
    return F.regexp_replace(path, r"^([^?#]*);(?=[?#]|$)", "$1")


def origin_of(url: Column) -> Column:
    """scheme://host in lower case, empty for what is no URL."""
    return F.lower(F.concat(F.regexp_extract(url, FORM, 1), F.when(url.rlike(FORM), "://").otherwise(""), F.regexp_extract(url, FORM, 2)))


def path_of(url: Column) -> Column:
    path = _trimmed(F.regexp_extract(unquoted(url), FORM, 3))
    path = F.when(path.startswith("//"), F.concat(F.lit("//"), path)).otherwise(path)
    return F.when(path == "", "/").otherwise(path)


def parsed(files: DataFrame) -> DataFrame:
    """files(origin, body) -> (origin, grp, agents, ord, allow, path): a row for each rule of each group, and one with null ord for a group without rules."""
    one = files.groupBy(F.lower("origin").alias("origin")).agg(F.min("body").alias("body"))
    lines = one.select("origin", F.posexplode(F.split(F.coalesce("body", F.lit("")), LINE, -1)).alias("ord", "line"))
    said = F.trim(F.regexp_replace(F.regexp_replace("line", "#.*$", ""), r"(?U)^\s+|\s+$", ""))
    key = F.lower(F.regexp_replace(F.regexp_extract(said, r"(?s)^([^:]*):", 1), r"(?U)^\s+|\s+$", ""))
    value = unquoted(F.regexp_replace(F.regexp_extract(said, r"(?s)^[^:]*:(.*)$", 1), r"(?U)^\s+|\s+$", ""))
    kind = F.when(F.col("line") == "", "end").when(key == "user-agent", "agent").when(key.isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    own = lines.select("origin", "ord", kind.alias("kind"), key.alias("key"), value.alias("value")).where("kind is not null")
    w = Window.partitionBy("origin").orderBy("ord")
    own = own.withColumn("begins", (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(w), F.lit("end")) != "agent"))
    own = own.withColumn("begun", F.max(F.when(F.col("begins"), F.col("ord"))).over(w)).withColumn("ended", F.max(F.when(F.col("kind") == "end", F.col("ord"))).over(w))
    live = own.where("begun is not null and kind <> 'end' and coalesce(ended < begun, true)")
    # a group whose agents are followed by no rule before it ends is none
    groups = live.groupBy("origin", F.col("begun").alias("grp")).agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "agent", F.struct("ord", F.lower("value").alias("agent"))))).alias("agents"), F.count_if(F.col("kind") == "rule").alias("n")).where("n > 0")
    rules = live.where(F.col("key").isin("allow", "disallow")).select("origin", F.col("begun").alias("grp"), "ord", ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"), _trimmed(F.col("value")).alias("path"))
    return groups.select("origin", "grp", F.transform("agents", lambda a: a["agent"]).alias("agents")).join(rules, ["origin", "grp"], "left").select("origin", "grp", "agents", "ord", "allow", "path")


def rules_for(rules: DataFrame, agent: str) -> DataFrame:
    """(origin, ord, allow, path): the rules that bind an agent, those of one group for each origin."""
    name = F.lit(agent.split("/")[0].lower())
    every = F.array_contains("agents", "*")
    named = ~every & F.exists("agents", lambda a: name.contains(a))
    rank = F.when(named, F.struct(F.lit(0).alias("k"), "grp")).when(every, F.struct(F.lit(1).alias("k"), "grp"))
    ranked = rules.withColumn("rank", rank)
    first = ranked.withColumn("first", F.min("rank").over(Window.partitionBy("origin")))
    return first.where("rank = first and ord is not null").select("origin", "ord", "allow", "path")


def closed_origins(files: DataFrame) -> DataFrame:
    """(origin, shut) of the origins that a status alone decides; files(origin, status, body)."""
    status = F.min("status")
    shut = F.when(status.isNull(), F.lit(False)).when(status.isin(401, 403), True).when(status.between(400, 499), False).when(status.between(200, 299), F.lit(None).cast("boolean")).otherwise(True)
    return files.groupBy(F.lower("origin").alias("origin")).agg(shut.alias("shut")).where("shut is not null")


def allowed(urls: DataFrame, files: DataFrame, agent: str = "*", longest: bool = False) -> DataFrame:
    """urls(url, ...) that files(origin, status, body) let the agent read; all other columns are kept."""
    rules = rules_for(parsed(files.where("status between 200 and 299")), agent)
    different = urls.where("url is not null").select("url").distinct().select("url", origin_of(F.col("url")).alias("origin")).where("origin <> ''")
    known = different.join(closed_origins(files), "origin", "left").where("not coalesce(shut, false)").select("url", "origin")
    lengths = rules.groupBy("origin").agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths"))
    path = known.join(lengths, "origin").withColumn("path", path_of(F.col("url")))
    starts = path.select("url", "origin", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("path"))
    met = starts.join(rules, ["origin", "path"])
    wins = F.max_by("allow", F.struct(F.length("path"), "allow")) if longest else F.min_by("allow", "ord")
    shut = met.groupBy("url").agg(wins.alias("allow")).where("not allow").select("url")
    may = known.select("url").join(shut, "url", "left_anti")
    return urls.join(may, "url", "left_semi")


