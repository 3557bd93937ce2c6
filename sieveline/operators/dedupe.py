"""Entity matching and merging.

Records are folded in `ord` order: a record joins the first cluster whose representative it matches by `threshold`, and the
representative fills its gaps from it. The fold is exact within components of any superset of the matches. A first, cheap one links
equal phones, sites and names, by stars around the least record of each, and names alike by 0.745, below which no address helps.
Only components of more than LARGE records, a chain's name for instance, are split by a second one, in which an equal name links nothing:

- an equal phone or site: a star;
- names and addresses both alike, compared once for each pair of different (name, address) combinations;
- for representatives whose name and address come from two records: names alike with a record that lacks an address, where
  its phone and site component has one, and addresses alike with one that lacks a name.

Combinations alike are found from one side's different texts. From 0.55 name + 0.45 address >= 0.86 follows name >= 0.745 and address >= 0.689,
and one of the two sides is surer: name >= 0.872 or address >= 0.844. On that side r, texts of n and m letters match in M of them, 2M >= r(n + m), in
at most n + m - 2M + 1 blocks, so they share 3M - n - m - 1 letter pairs, each counted with its occurrence. So of the letter pairs in order of
rarity over all texts, a beginning of each text holds two shared ones (one where texts are short, a single letter where they are
tiny): texts meet where such a pair is equal. An edit distance over (1 - r)(n + m) rules a pair out before it is scored. A word that
many texts share is in few beginnings, unless it is most of the text. Meeting places of more than MOST texts are dealt in blocks,
each pair of parts a group of its own, so that no task holds a hot one. The combinations of alike texts then meet, and the other side
decides; every pair of different texts is scored once. Records of one name are compared by address, one with the other: no shorter test is exact."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sieveline.functions import normalize as N
from sieveline.functions.stored import stored
from sieveline.functions.workers import reach, tasks
from sieveline.plans.dims import LIST_FIELDS, SCALAR_FIELDS

THRESHOLD = 0.86
MOST = 2000
LARGE = 20_000
# fixed values: hosts of map sites, which identify no entity
MAP_HOSTS = ("openstreetmap.org", "google.com", "maps.google.com", "google.co.in")


@lru_cache(maxsize=1 << 17)
def ratio(a: str, b: str) -> float:
    """Similarity by longest matching blocks; 0 where a side is empty. Not symmetric: a is the newer string."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def identity_site(website: Column) -> Column:
    key = N.site_key(website)
    on_map = key.isin(*MAP_HOSTS) | key.endswith(".google.com") | key.endswith(".openstreetmap.org")
    return F.when(on_map, "").otherwise(key)


def keyed(records: DataFrame) -> DataFrame:
    return records.withColumn("k_name", N.name_key(F.col("business_name"))).withColumn("k_address", N.address_key(F.col("address"))).withColumn("k_phone", N.phone_key(F.col("phone"))).withColumn("k_site", identity_site(F.col("website")))


def match_score(name: Column, address: Column, same_phone: Column, same_site: Column) -> Column:
    score = F.greatest(name * 0.55 + address * 0.45, name * 0.75)
    score = F.when(same_phone, F.greatest(score, F.lit(0.96))).otherwise(score)
    score = F.when(same_site, F.greatest(score, F.lit(0.94))).otherwise(score)
    return F.when(same_phone & (name > 0.45), 0.99).otherwise(score)


def pair_scores(pairs: DataFrame) -> DataFrame:
    """pairs with columns l_ and r_ of k_name, k_address, k_phone, k_site -> with `score`."""
    name, address = seq_ratio("l_k_name", "r_k_name"), seq_ratio("l_k_address", "r_k_address")
    same = lambda k: (F.col(f"l_{k}") != "") & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    scored = pairs.withColumn("name_score", name).withColumn("address_score", address)
    return scored.withColumn("score", match_score(F.col("name_score"), F.col("address_score"), same("k_phone"), same("k_site")))


def key_dedupe(records: DataFrame) -> DataFrame:
    """records with `cluster`, the least ord that an equal phone or site gives, one hop: the cheap pass."""
    k = keyed(records)
    low = lambda c: F.min("ord").over(Window.partitionBy(c))
    own = F.col("ord")
    return k.withColumn("cluster", F.least(F.when(F.col("k_phone") != "", low("k_phone")).otherwise(own), F.when(F.col("k_site") != "", low("k_site")).otherwise(own)))


def _least_matched(n: Column, m: Column, r: float) -> Column:
    return F.ceil((n + m) * (r / 2) - 1e-9)


def _least_shared(n: Column, r: float) -> Column:
    """How many letter pairs a string of n letters shares at least with any other whose ratio to it is r or more."""
    others = F.sequence(F.ceil(n * (r / (2 - r)) - 1e-9), F.floor(n * ((2 - r) / r) + 1e-9))
    return F.array_min(F.transform(others, lambda m: _least_matched(n, m, r) * 3 - n - m - 1))


def _numbered(parts: Column) -> Column:
    """Each part with its occurrence, so that equal ones are told apart."""
    return F.transform(parts, lambda p, i: F.concat(p, F.size(F.filter(F.slice(parts, F.lit(1), i), lambda q: q == p)).cast("string")))


def _letter_pairs(text: Column) -> Column:
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n >= 2, _numbered(pairs)).otherwise(F.array().cast("array<string>"))


def _rarest(strings: DataFrame) -> DataFrame:
    """strings(text) -> (text, grams): the letter pairs of each, rarest over all strings first."""
    each = strings.select("text", F.explode_outer(_letter_pairs(F.col("text"))).alias("gram"))
    seen = each.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = each.join(seen, "gram", "left").groupBy("text").agg(F.array_sort(F.collect_list(F.when(F.col("gram").isNotNull(), F.struct("n", "gram")))).alias("g"))
    return ranked.select("text", F.transform("g", lambda x: x["gram"]).alias("grams"))


def _meeting_places(grams: Column, text: Column, r: float) -> Column:
    """Where a string meets all that are alike by r: pairs of its first letter pairs, single ones if it is short, letters if it is tiny."""
    n, size = F.length(text), F.size(grams)
    least = _least_shared(n, r)
    first = F.slice(grams, F.lit(1), F.least(size, size - least + 2))  # two shared ones are among them
    none = F.array().cast("array<string>")
    pairs = F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, size), lambda b: F.concat(F.least(a, b), F.lit("&"), F.greatest(a, b)))))
    single = F.when(least < 2, F.slice(grams, F.lit(1), F.least(size, F.greatest(size - least + 1, F.lit(0))))).otherwise(none)
    letters = F.when(least < 1, F.transform(_numbered(F.split(text, "")), lambda x: F.concat(F.lit("'"), x))).otherwise(none)
    return F.concat(pairs, single, letters)


def _at_most(x: Column, y: Column) -> Column:
    """What the ratio of two texts is at most, by the edits between them."""
    return 1 - F.levenshtein(x, y) / (F.length(x) + F.length(y))


def alike_texts(texts: DataFrame, r: float, most: int = MOST) -> DataFrame:
    """(x, y, ratio), x < y: different texts(text, need) of a ratio of r or more in either direction, one of the two needed."""
    known = _rarest(texts.select("text")).join(texts, "text").select("text", "need", F.explode(_meeting_places(F.col("grams"), F.col("text"), r)).alias("place"))
    sizes = known.groupBy("place").agg(F.count("*").alias("size"), F.max("need").alias("any")).where("size > 1 and any")
    sized = known.join(sizes, "place").withColumn("parts", F.ceil(F.col("size") / most).cast("int")).withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    dealt = sized.select("text", "need", "place", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    dealt = dealt.withColumn("block", F.concat_ws("/", F.least("part", "with"), F.greatest("part", "with")))
    l, q = dealt.alias("l"), dealt.alias("q")
    once = (F.col("l.part") != F.col("q.part")) | (F.col("l.part") == F.col("l.with"))
    near = once & (F.col("l.text") < F.col("q.text")) & (F.col("l.need") | F.col("q.need")) & (_at_most(F.col("l.text"), F.col("q.text")) >= r - 1e-9)
    pairs = l.join(q, (F.col("l.place") == F.col("q.place")) & (F.col("l.block") == F.col("q.block")) & near).select(F.col("l.text").alias("x"), F.col("q.text").alias("y")).distinct()
    return pairs.withColumn("ratio", F.greatest(seq_ratio("x", "y"), seq_ratio("y", "x"))).where(F.col("ratio") >= r - 1e-9)


def _alike(combos: DataFrame, own: str, r: float, other: str, passes: Callable[[Column, Column], Column], most: int) -> DataFrame:
    """(a, b) of combos(ord, own, other) alike by r in own whose ratios on both sides pass."""
    texts = combos.select(F.col(own).alias("text")).distinct()
    pairs = alike_texts(texts.withColumn("need", F.lit(True)), r, most)
    same = texts.select(F.col("text").alias("x"), F.col("text").alias("y"), F.lit(1.0).alias("ratio"))
    end = lambda i, o: combos.select(F.col("ord").alias(i), F.col(own).alias(o), F.col(other).alias(f"{o}_other"))
    # few rows may meet many: a fixed number of tasks, as small inputs would be joined in one
    dealt = pairs.unionByName(same).join(end("a", "x"), "x").repartition(int(combos.sparkSession.conf.get("spark.sql.shuffle.partitions")), "y")
    met = dealt.join(end("b", "y"), "y").where((F.col("x") != F.col("y")) | (F.col("a") > F.col("b")))
    there = F.array_sort(F.array("x_other", "y_other"))  # one order, so that equal pairs are scored once a worker
    met = met.where(passes(F.col("ratio"), _at_most(F.col("x_other"), F.col("y_other")))).select("a", "b", "ratio", there[0].alias("p"), there[1].alias("q"))
    return met.where(passes(F.col("ratio"), F.greatest(seq_ratio("p", "q"), seq_ratio("q", "p")))).select("a", "b")


def _star(rows: DataFrame, *key: str) -> DataFrame:
    return rows.select(F.col("ord").alias("a"), F.min("ord").over(Window.partitionBy(*key)).alias("b")).where("a <> b")


def name_edges(records: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """(a, b): equal phones, sites and names, and names alike enough for `threshold` under the best address."""
    k = keyed(records).select("ord", "k_name", "k_phone", "k_site")
    named = k.where("k_name <> ''")
    texts = named.groupBy(F.col("k_name").alias("text")).agg(F.min("ord").alias("ord"))
    at = lambda c, o: texts.select(F.col("text").alias(c), F.col("ord").alias(o))
    alike = alike_texts(texts.select("text", F.lit(True).alias("need")), (threshold - 0.45) / 0.55, most).join(at("x", "a"), "x").join(at("y", "b"), "y").select("a", "b")
    return _star(k.where("k_phone <> ''"), "k_phone").unionByName(_star(k.where("k_site <> ''"), "k_site")).unionByName(_star(named, "k_name")).unionByName(alike)


def superset_edges(records: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """(a, b) of records that could ever be folded together at `threshold`, which is over 0.75; see the module's text."""
    k = keyed(records).select("ord", "k_name", "k_address", "k_phone", "k_site")
    keys = _star(k.where("k_phone <> ''"), "k_phone").unionByName(_star(k.where("k_site <> ''"), "k_site"))
    both = k.where("k_name <> '' and k_address <> ''")
    keys = stored(keys.unionByName(_star(both, "k_name", "k_address")), "keys")
    name, address = (threshold - 0.45) / 0.55, (threshold - 0.55) / 0.45
    sure_name, sure_address = 1 - (1 - threshold) / 1.1, 1 - (1 - threshold) / 0.9
    combos = both.groupBy("k_name", "k_address").agg(F.min("ord").alias("ord"))
    out = keys
    for own, r, other, mine in (("k_name", sure_name, "k_address", 0.55), ("k_address", sure_address, "k_name", 0.45)):
        out = out.unionByName(_alike(combos, own, r, other, lambda x, y, w=mine: x * w + y * (1 - w) >= threshold - 1e-9, most))
    lacking = k.where("(k_name = '') <> (k_address = '') and (k_phone <> '' or k_site <> '')")
    if lacking.isEmpty():
        return out
    # records that lack one of the two, in a component of keys whose other records have it
    rooted = k.join(components(keys).withColumnRenamed("node", "ord"), "ord")
    has = rooted.groupBy("root").agg(F.max(F.col("k_name") != "").alias("named"), F.max(F.col("k_address") != "").alias("placed")).where("named and placed")
    gaps = lacking.join(rooted.join(has, "root").select("ord"), "ord", "left_semi").withColumn("need", F.lit(True))
    gaps = stored(gaps, "gaps")
    rows = both.withColumn("need", F.lit(False)).unionByName(gaps)
    for own, r in (("k_name", name), ("k_address", address)):
        texts = stored(rows.where(F.col(own) != "").groupBy(F.col(own).alias("text")).agg(F.min("ord").alias("ord"), F.max("need").alias("need")), "texts")
        ends = alike_texts(texts.select("text", "need"), r, most)
        at = lambda c, o: texts.select(F.col("text").alias(c), F.col("ord").alias(o))
        near = ends.join(at("x", "a"), "x").join(at("y", "b"), "y").select("a", "b")
        met = near.select(F.explode(F.array("a", "b")).alias("ord")).unionByName(texts.where("need").select("ord")).distinct()
        own_rows = rows.join(texts.join(met, "ord").select(F.col("text").alias(own)), own, "left_semi")
        out = out.unionByName(near).unionByName(_star(own_rows, own))
    return out


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, root): least reachable node, by passing the least label on; labels are cut from lineage each round."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    spark = edges.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # elsewhere the warehouse may be a machine's own folder
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    both = both.checkpoint()
    labels = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).checkpoint()
    for _ in range(rounds):
        heard = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("x").alias("root"), F.col("root").alias("far"))
        fresh = labels.join(heard, "x").join(jump, "root", "left").select("x", F.least("root", "near", F.coalesce("far", "root")).alias("root")).checkpoint()
        done = fresh.join(labels.withColumnRenamed("root", "old"), "x").where("root <> old").isEmpty()
        labels = fresh
        if done:
            return labels.withColumnRenamed("x", "node")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


class Heads:
    """The representatives of one component, in order, found by what a match needs: an equal phone or site, or a name and an address alike."""

    def __init__(self, threshold: float):
        self.threshold, self.heads = threshold, []
        self.least = {"k_name": (threshold - 0.45) / 0.55 - 1e-9, "k_address": (threshold - 0.55) / 0.45 - 1e-9}
        self.by_key: dict[tuple[str, str], list[int]] = {}
        self.by_name: dict[str, dict[str, list[int]]] = {}
        self.texts: dict[str, dict[str, None]] = {"k_name": {}, "k_address": {}}
        self.known: dict[tuple[str, str], tuple[int, list[str]]] = {}

    def _file(self, i: int) -> None:
        h = self.heads[i]
        for k in ("k_phone", "k_site"):
            if h[k] and i not in (at := self.by_key.setdefault((k, h[k]), [])):
                at.append(i)
        if h["k_name"] and h["k_address"]:
            at = self.by_name.setdefault(h["k_name"], {}).setdefault(h["k_address"], [])
            if i not in at:
                at.append(i)
            for k in self.texts:
                self.texts[k].setdefault(h[k])

    def _alike(self, k: str, text: str) -> list[str]:
        """The heads' texts that are alike; those that came since the last call are looked at."""
        seen, found = self.known.get((k, text), (0, []))
        if seen < len(self.texts[k]):
            found = found + [t for t in islice(self.texts[k], seen, None) if bound(text, t) >= self.least[k] and ratio(text, t) >= self.least[k]]
            self.known[k, text] = (len(self.texts[k]), found)
        return found

    def home(self, r: dict) -> int | None:
        """The first head that r matches."""
        near = {i for k in ("k_phone", "k_site") if r[k] for i in self.by_key.get((k, r[k]), ())}
        if r["k_name"] and r["k_address"] and (names := self._alike("k_name", r["k_name"])):
            streets = dict.fromkeys(self._alike("k_address", r["k_address"]))
            for n in names:
                there = self.by_name[n]
                near.update(i for a in (there if len(there) < len(streets) else streets) if a in there and a in streets for i in there[a])
        return next((i for i in sorted(near) if _score(r, self.heads[i]) >= self.threshold), None)

    def add(self, r: dict) -> int:
        """The cluster of the next record."""
        i = self.home(r)
        if i is None:
            self.heads.append(dict(r))
            self._file(len(self.heads) - 1)
            return r["ord"]
        h = self.heads[i]
        if any(not h[k] and r[k] for k in ("k_name", "k_address", "k_phone", "k_site")):
            for k in ("k_name", "k_address", "k_phone", "k_site"):
                h[k] = h[k] or r[k]
            self._file(i)
        return h["ord"]


def bound(a: str, b: str) -> float:
    """What the ratio is at most, by lengths."""
    return 2 * min(len(a), len(b)) / max(len(a) + len(b), 1)


def fold(rows: Iterable[dict], threshold: float = THRESHOLD) -> list[int]:
    """The cluster (its first record's ord) of each row, rows in ord order with k_ keys."""
    heads = Heads(threshold)
    return [heads.add(r) for r in rows]


def _score(new: dict, old: dict) -> float:
    phone = bool(new["k_phone"]) and new["k_phone"] == old["k_phone"]
    site = bool(new["k_site"]) and new["k_site"] == old["k_site"]
    name, address = ratio(new["k_name"], old["k_name"]), ratio(new["k_address"], old["k_address"])
    score = max(name * 0.55 + address * 0.45, name * 0.75, 0.96 if phone else 0, 0.94 if site else 0)
    return 0.99 if phone and name > 0.45 else score


def clusters(records: DataFrame, threshold: float = THRESHOLD, large: int = LARGE, most: int = MOST) -> DataFrame:
    """(ord, cluster) of every record by the ordered fold, component by component: a task reads its components' records in turn and holds only the heads of one."""
    reach(records.sparkSession)
    k = keyed(records).select("ord", "k_name", "k_address", "k_phone", "k_site")
    roots = components(name_edges(records, threshold, most)).withColumnRenamed("node", "ord")
    wide = roots.groupBy("root").count().where(F.col("count") > large).select("root")
    if not wide.isEmpty():
        hot = roots.join(wide, "root")
        split = components(superset_edges(records.join(hot.select("ord"), "ord", "left_semi"), threshold, most)).withColumnRenamed("node", "ord")
        roots = roots.join(wide, "root", "left_anti").select("ord", "root").unionByName(split.select("ord", "root"))
    placed = k.join(roots, "ord", "left")
    alone = placed.where("root is null").select("ord", F.col("ord").alias("cluster"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, Heads(threshold)
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["root"] != now:
                    now, heads = r["root"], Heads(threshold)
                out.append(heads.add(r))
            yield pa.record_batch([b.column("ord"), pa.array(out, pa.int64())], ["ord", "cluster"])

    grouped = placed.where("root is not null").repartition("root").sortWithinPartitions("root", "ord")
    return grouped.mapInArrow(run, "ord long, cluster long").unionByName(alone)


def merged(records: DataFrame, cluster: DataFrame, scalars: tuple[str, ...] = SCALAR_FIELDS, lists: tuple[str, ...] = LIST_FIELDS) -> DataFrame:
    """One row a cluster: first non-empty scalar in ord order, lists joined in order without repeats, records counted."""
    cols = set(records.columns)
    j = records.join(cluster, "ord")
    aggs = [F.min_by(F.col(c), F.when(N.filled(F.col(c)) != "", F.col("ord"))).alias(c) for c in scalars if c in cols]
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v")))), lambda s: s["v"])))
    aggs += [flat(c).alias(c) for c in lists if c in cols]
    return j.groupBy("cluster").agg(*aggs, F.count("*").alias("records"))


def first_of(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """rows with the first of each key, which may be of several columns."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def ordered_distinct(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, ord): different values with the place of the first; combined before the shuffle."""
    return rows.groupBy(F.col(value).alias("value")).agg(F.min(order).alias("ord"))


def lead_score(lead: Column, place: Column) -> Column:
    """Shared name words, 0.7 by the lead's and 0.3 by the place's; a contained name gives 0.82, an equal one 1."""
    a, b = N.name_tokens(lead, N.LEAD_IGNORED, True), N.name_tokens(place, N.LEAD_IGNORED, True)
    both = F.size(F.array_intersect(a, b))
    base = both / F.greatest(F.size(a), F.lit(1)) * 0.7 + both / F.greatest(F.size(b), F.lit(1)) * 0.3
    la, lb = N.name_key(lead), N.name_key(place)
    score = F.when(la == lb, 1.0).when(lb.contains(la), F.greatest(base, F.lit(0.82))).otherwise(base)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.round(score, 6))


def lead_candidates(leads: DataFrame, places: DataFrame, least: float = 0.62) -> DataFrame:
    """(lead, place) of the different names in `lead` and `place` that could score `least`.

    By words: of a lead's n words a match shares m >= n (least - 0.3) / 0.7, as the place's side gives 0.3 at most; so it shares one
    of the n - m + 1 words that are rarest among the places. By containment, in which words need not be equal: the place
    holds the lead's rarest three letters."""
    words = lambda c: N.name_tokens(F.col(c), N.LEAD_IGNORED, True)
    three = lambda c: (lambda k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(k) - 2, F.lit(1))), lambda i: F.substring(k, i, F.lit(3)))))(N.name_key(F.col(c)))
    l, p = leads.select("lead").distinct().where(F.size(words("lead")) > 0), places.select("place").distinct().where(F.size(words("place")) > 0)
    pairs = None
    for kind, parts in (("word", words), ("three", three)):
        held = p.select("place", F.explode(parts("place")).alias("part"))
        seen = held.groupBy("part").agg(F.count("*").alias("n"))
        own = l.select("lead", F.size(parts("lead")).alias("of"), F.explode(parts("lead")).alias("part")).join(seen, "part", "left")
        rank = F.row_number().over(Window.partitionBy("lead").orderBy(F.coalesce("n", F.lit(0)), "part"))
        needed = F.ceil(F.col("of") * ((least - 0.3) / 0.7) - 1e-9) if kind == "word" else F.col("of")
        found = own.withColumn("rank", rank).where(F.col("rank") <= F.col("of") - F.greatest(needed, F.lit(1)) + 1).join(held, "part")
        if kind == "three":
            found = found.where(N.name_key(F.col("place")).contains(N.name_key(F.col("lead"))))
        found = found.select("lead", "place")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.distinct()


def leads_with_places(leads: DataFrame, places: DataFrame, least: float = 0.62, keep: int = 2) -> DataFrame:
    """(lead_id, place_id, score, rn): the best `keep` places of each lead. Different names are scored once; of a name's places the first `keep` count."""
    l, p = leads.select("lead_id", F.col("name").alias("lead")), places.select("place_id", F.col("name").alias("place"))
    pairs = lead_candidates(l, p, least).withColumn("score", lead_score(F.col("lead"), F.col("place"))).where(F.col("score") >= least)
    same = Window.partitionBy("place").orderBy("place_id")
    first = p.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= keep).drop("_r")
    best = Window.partitionBy("lead").orderBy(F.desc("score"), "place_id")
    top = pairs.join(first, "place").withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= keep)
    return l.join(top, "lead").select("lead_id", "place_id", "score", "rn")


def top_hits(scored: DataFrame, keep: int, key: str = "entity_id") -> DataFrame:
    """The `keep` best-scored hits of each entity, ties by rank then url."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "rank", "url")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)


def entity_hits(entities: DataFrame, hits: DataFrame, category: Column, location: Column, keep: int, least: float = 0.45) -> DataFrame:
    """entities(entity_id, name, website) with the `keep` hits(entity_id, title, snippet, url, rank) that are surest about each."""
    from sieveline.operators.filters import hit_text, name_words, score_of

    # each text, name and host is read once, in the tasks of the join and the ranking
    parts = tasks(hits.sparkSession)
    h = hits.repartition(parts, "entity_id").withColumns({"_text": hit_text(F.col("title"), F.col("snippet"), F.col("url")), "_host": N.authority(F.col("url"))})
    e = entities.repartition(parts, "entity_id").withColumns({"_words": name_words(F.col("name")), "_site": N.authority(F.col("website"))})
    score = score_of(*map(F.col, ("_text", "_words", "_host", "_site", "url")), category, location)
    return top_hits(h.join(e, "entity_id").withColumn("score", score).where(F.col("score") >= least).drop("_text", "_host", "_words", "_site"), keep)
