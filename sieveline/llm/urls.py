"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression of Python's `re` (ASCII classes), searched in the lower-cased URL, or in host and path for host
rules. From the expression follow the literal tokens ([a-z0-9]+ runs between separators) that every
URL it fits must hold: `literal_tokens` reads them off the parsed pattern. Token frequencies are counted over
all URLs; each rule is filed under its rarest one. A URL's tokens fetch its candidate rules and only those
run their expressions; rules from which no token follows run on every URL.

Rules come from a list or from a table (`rules_of`). Up to MAX_RULES go to the workers; a longer table takes the
other way, a join of URL tokens with rule tokens whose pairs run the same expressions in the same `re`.

Host rules (host, path prefix) fit the host and its subdomains; the longest that fits decides. Where
none fits, the pattern rules decide, in their order, else the default verdict.

Defined results: null URLs are judged as empty ones; URLs without `://` have empty host and path; both get the default
verdict unless a pattern fits; equal rows are judged each; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm._shared import ensure_workers, materialize

MAX_RULES = 100_000
TOKEN = "[a-z0-9]+"
_TOKEN_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_EDGE, _BREAK = object(), object()  # between tokens; anything


def _class_of(items: list) -> set[str] | None:
    """The token signs that a character class holds; None if that cannot be told."""
    out, inverted = set(), False
    for op, arg in items:
        kind = str(op)
        if kind == "NEGATE":
            inverted = True
        elif kind == "LITERAL":
            out |= {chr(arg).lower()} & _TOKEN_SIGNS
        elif kind == "RANGE":
            out |= {c for c in _TOKEN_SIGNS if arg[0] <= ord(c) <= arg[1] or arg[0] <= ord(c.upper()) <= arg[1]}
        elif kind == "CATEGORY" and str(arg) in ("CATEGORY_DIGIT", "CATEGORY_WORD", "CATEGORY_SPACE"):
            out |= {"CATEGORY_DIGIT": set("0123456789"), "CATEGORY_WORD": set(_TOKEN_SIGNS), "CATEGORY_SPACE": set()}[str(arg)]
        else:
            return None
    return set(_TOKEN_SIGNS) - out if inverted else out


def _symbols(items, out: list) -> None:
    """Required literals of a parsed pattern, with what is known about the places between them."""
    for op, arg in items:
        kind = str(op)
        if kind == "LITERAL":
            out.append(chr(arg).lower())
        elif kind == "SUBPATTERN":
            _symbols(arg[-1], out)
        elif kind == "AT":
            out.append(_BREAK if str(arg) == "AT_NON_BOUNDARY" else _EDGE)
        elif kind == "IN":
            out.append(_EDGE if _class_of(arg) == set() else _BREAK)
        elif kind == "ASSERT_NOT" and len(arg[1]) == 1 and str(arg[1][0][0]) == "IN":
            if _class_of(arg[1][0][1]) == _TOKEN_SIGNS:
                out.append(_EDGE)
        elif kind in ("ASSERT", "ASSERT_NOT"):
            continue  # takes no place, and what it asks beyond that is not used
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            own: list = []
            _symbols(inner, own)
            ends = bool(own) and (own[-1] is _EDGE or own[-1] is not _BREAK and own[-1] not in _TOKEN_SIGNS)
            if least:
                out += own if most == 1 else [*own, _BREAK, *own[-1:]] if ends else [*own, _BREAK]
            else:  # after a part that may be missing there is an edge if one is before it and one ends it
                before = bool(out) and (out[-1] is _EDGE or out[-1] is not _BREAK and out[-1] not in _TOKEN_SIGNS)
                out.append(_BREAK)
                if before and ends:
                    out.append(_EDGE)
        else:
            out.append(_BREAK)


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that every text which the pattern fits must hold, in order; none where none is certain."""
    symbols: list = [_BREAK]
    _symbols(parser.parse(pattern, re.ASCII), symbols)
    tokens, run, whole = [], "", False
    for s in [*symbols, _BREAK]:
        if s is not _EDGE and s is not _BREAK and s in _TOKEN_SIGNS:
            run += s
            continue
        if run and whole and s is not _BREAK:
            tokens.append(run)
        run, whole = "", s is not _BREAK
    return tuple(dict.fromkeys(tokens))


@dataclass(frozen=True)
class UrlRule:
    """name: shown in results; pattern: over host + path for host rules, else over the lower-cased URL."""

    name: str
    verdict: str
    pattern: str
    length: int = 0
    on_host: bool = False

    @property
    def tokens(self) -> tuple[str, ...]:
        return literal_tokens(self.pattern)


def host_rule(verdict: str, host: str, path: str) -> UrlRule:
    return UrlRule(f"{host}{path}", verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", len(host) + len(path), True)


def word_rule(verdict: str, word: str) -> UrlRule:
    """The word as a whole token anywhere in the URL."""
    return UrlRule(word, verdict, rf"(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])")


HOST_RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
PATTERN_RULES = tuple(word_rule("block", w) for w in ("casino", "bets", "betting", "poker", "porn", "xxx", "pills", "viagra", "warez", "torrent"))
RULES_TABLE = "number long, name string, verdict string, pattern string, length int, on_host boolean"


def rules_of(table: DataFrame, most: int = MAX_RULES) -> tuple[UrlRule, ...] | DataFrame:
    """Rules of a table (number, name, verdict, pattern, length, on_host), numbers telling their order: a list of at most `most`, else the table."""
    cols = [x.split()[0] for x in RULES_TABLE.split(", ")]
    rows = table.select(*cols).orderBy("number").limit(most + 1).collect()
    return tuple(UrlRule(*r[1:]) for r in rows) if len(rows) <= most else table.select(*cols)


_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(df: DataFrame) -> DataFrame:
    """df(id, url) with host and path."""
    after = F.expr("substr(url, char_length(substring_index(url, '://', 1)) + 4)")
    there = F.coalesce(F.col("url").contains("://"), F.lit(False))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), _ABC, _ABC.lower())
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.when(there, host).otherwise("")).withColumn("path", F.when(there, path).otherwise(""))


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """URLs that hold each of the rules' tokens: tasks count before rows meet, at most as many rows as the rules have tokens."""
    ensure_workers(urls.sparkSession)
    shared = urls.sparkSession.sparkContext.broadcast(frozenset(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, split, out = shared.value, re.compile(TOKEN).findall, Counter()
        for b in batches:
            for url in b.column(0).to_pylist():
                out.update(wanted.intersection(split(url.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["token", "n"])

    held = urls.select("url").mapInArrow(count, "token string, n long")
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def rarest(rules: tuple[UrlRule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """token -> numbers of the rules filed under it; under "" those that name no token."""
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        tokens = r.tokens
        key = min(tokens, key=lambda t: (counts.get(t, 0), t)) if tokens else ""
        index.setdefault(key, []).append(i)
    return index


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] | DataFrame = HOST_RULES + PATTERN_RULES, default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern): rule is the host rule that decided, pattern the pattern rule."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    urls = split_url(pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url")))
    if isinstance(rules, tuple) and len(rules) <= max_rules:
        return _by_index(urls, rules, rarest(rules, token_counts(urls, {t for r in rules for t in r.tokens})), default)
    if isinstance(rules, tuple):
        rules = urls.sparkSession.createDataFrame([(i, r.name, r.verdict, r.pattern, r.length, r.on_host) for i, r in enumerate(rules)], RULES_TABLE)
    return _by_join(urls, rules, default)


def _by_index(urls: DataFrame, rules: tuple[UrlRule, ...], index: dict[str, list[int]], default: str) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast((rules, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, filed = shared.value
        compiled: dict[int, re.Pattern] = {}
        split = re.compile(TOKEN).findall
        always = filed.get("", [])
        for b in batches:
            _, url, host, path = (c.to_pylist() for c in b.columns)
            out: list[tuple] = []
            for u, h, p in zip(url, host, path, strict=True):
                low = u.lower()
                best, pattern = None, None
                for i in sorted({i for t in set(split(low)) for i in filed.get(t, ())}.union(always)):
                    r = own[i]
                    fits = compiled.get(i) or compiled.setdefault(i, re.compile(r.pattern, re.ASCII))
                    if r.on_host:
                        if (best is None or r.length > best.length) and fits.search(h + p):
                            best = r
                    elif pattern is None and fits.search(low):
                        pattern = r
                verdict = best.verdict if best else pattern.verdict if pattern else default
                out.append((best.name if best else None, verdict, pattern.name if pattern and not best else None))
            rule, verdict, why = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *(pa.array(x, pa.string()) for x in (rule, verdict, why))], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string")


def _tokens_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For rule tables too long to send to workers: tokens of different URLs meet rules by a join."""
    spark = urls.sparkSession
    ensure_workers(spark)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [literal_tokens(p) for p in b.column("pattern").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.list_(pa.string()))], names=[*b.schema.names, "tokens"])

    known = materialize(rules.mapInArrow(name, f"{RULES_TABLE}, tokens array<string>"), "rules")
    one = materialize(urls.select("url", "host", "path").distinct(), "different-urls")
    token = F.explode("tokens").alias("token")
    held = one.select(F.explode(_tokens_of(F.col("url"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))  # counted before rules meet it
    rare = known.select("number", token).join(held, "token", "left").groupBy("number").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    filed = known.drop("tokens").join(rare, "number")
    always = known.where(F.size("tokens") == 0).drop("tokens").limit(MAX_RULES + 1).collect()
    if len(always) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules name no token; each of them would run on every URL")
    everywhere = spark.sparkContext.broadcast([tuple(r) for r in always])
    fits = f"url string, {RULES_TABLE}"
    names = [x.split()[0] for x in fits.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, re.Pattern] = {}
        for b in batches:
            keep = []
            for u, h, p, e, on_host in zip(*(b.column(c).to_pylist() for c in ("url", "host", "path", "pattern", "on_host")), strict=True):
                if len(compiled) > 10_000:
                    compiled.clear()
                fit = compiled.get(e) or compiled.setdefault(e, re.compile(e, re.ASCII))
                keep.append(bool(fit.search(h + p if on_host else u.lower())))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names], names=names).filter(pa.array(keep, pa.bool_()))

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(re.compile(r[3], re.ASCII), r) for r in everywhere.value]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_())
        for b in batches if own else ():
            rows = [(u, *r) for u, h, p in zip(*(c.to_pylist() for c in b.columns), strict=True) for e, r in own if e.search(h + p if r[5] else u.lower())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names=names)

    tokens = one.withColumn("token", F.explode(_tokens_of(F.col("url"))))
    fit = tokens.join(filed, "token").mapInArrow(search, fits).unionByName(one.mapInArrow(run_all, fits))
    first = (-F.col("number")).alias("n")
    best = fit.groupBy("url").agg(
        F.max(F.when(F.col("on_host"), F.struct("length", first, "name", "verdict"))).alias("h"),
        F.max(F.when(~F.col("on_host"), F.struct(first, "name", "verdict"))).alias("p"),
    )
    j = urls.join(best, "url", "left")
    return j.select("page_id", "host", "path", F.col("h.name").alias("rule"), F.coalesce("h.verdict", "p.verdict", F.lit(default)).alias("verdict"), F.when(F.col("h").isNull(), F.col("p.name")).alias("pattern"))


ORACLE_SQL = """
WITH u AS (
  SELECT page_id, url, coalesce(contains(url, '://'), false) AS there,
         substr(url, strpos(url, '://') + 3) AS rest FROM pages),
s AS (
  SELECT page_id, url,
         CASE WHEN there THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN there THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM s),
p AS (
  SELECT *, CASE WHEN rule IS NULL THEN nullif(regexp_extract(lower(url), '(^|[^a-z0-9])(casino|bets|betting|poker|porn|xxx|pills|viagra|warez|torrent)([^a-z0-9]|$)', 2), '') END AS pattern FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       pattern FROM p
"""
