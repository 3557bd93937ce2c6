"""Places as tables: gazetteers of any length, read from Parquet.

The tables hold what `Gazetteer` holds in maps, for lists that would not fit a plan. Names meet texts by equality: a text is cut into the
runs of words whose lengths any name has, and the runs join the names; Spark broadcasts the names where it knows them to be small.
Locations are looked up once each. Verdicts are those of the maps (tested), and a plan is as long for a million places as for ten.

Defined results: null texts and locations are empty and tell nothing; repeated rows share their verdicts; empty tables know no place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import normalize as N
from sieveline.plans.dims import Gazetteer

TABLES = {"corrections": "wrong string, place string", "aliases": "place string, ord int, alias string", "regions": "region string, ord int, town string", "others": "place string", "countries": "code string, rank int, kind string, name string"}


@dataclass(frozen=True)
class Places:
    """corrections(wrong, place), aliases(place, ord, alias), regions(region, ord, town), others(place), countries(code, rank, kind, name) with kind name or region."""

    corrections: DataFrame
    aliases: DataFrame
    regions: DataFrame
    others: DataFrame
    countries: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, g: Gazetteer) -> Places:
        rows = {
            "corrections": list(g.corrections.items()), "aliases": [(p, i, a) for p, names in g.aliases.items() for i, a in enumerate(names)],
            "regions": [(r, i, t) for r, towns in g.regions.items() for i, t in enumerate(towns)], "others": [(p,) for p in g.off_places],
            "countries": [(code, i, kind, n) for i, (code, names, regions) in enumerate(g.countries) for kind, some in (("name", names), ("region", regions)) for n in some],
        }
        return cls(**{name: spark.createDataFrame(rows[name], schema) for name, schema in TABLES.items()})

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Places:
        """A folder with a Parquet table for each of TABLES."""
        return cls(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()})

    def write(self, folder: str) -> None:
        for name in TABLES:
            getattr(self, name).write.parquet(f"{folder}/{name}")

    def hints(self) -> DataFrame:
        """(phrase) of every name known."""
        names = (self.others.select("place"), self.regions.select("region"), self.regions.select("town"), self.aliases.select("alias"))
        out = None
        for one in names:
            keys = one.toDF("name").select(N.name_key(F.col("name")).alias("phrase"))
            out = keys if out is None else out.unionByName(keys)
        return out.where("phrase <> ''").distinct()


def located(rows: DataFrame, places: Places, location: str = "location") -> DataFrame:
    """(location, place, key): each different location, corrected."""
    once = rows.select(F.col(location).alias("location")).where("location is not null").distinct().withColumn("wrong", N.name_key(F.col("location")))
    fixed = places.corrections.groupBy("wrong").agg(F.min("place").alias("fixed"))
    named = once.join(fixed, "wrong", "left").select("location", F.coalesce("fixed", N.spaced(F.col("location"))).alias("place"))
    return named.withColumn("key", N.name_key(F.col("place")))


def aliases_of(rows: DataFrame, places: Places, location: str = "location") -> DataFrame:
    """(location, aliases): names of each different location in order; one without any has its own."""
    named = located(rows, places, location)
    got = named.join(places.aliases, "place").where("alias <> ''").groupBy("location").agg(F.array_sort(F.collect_list(F.struct("ord", "alias"))).alias("a"))
    names = F.coalesce(F.array_distinct(F.transform("a", lambda x: x["alias"])), F.filter(F.array("place"), lambda p: p != ""))
    return named.join(got, "location", "left").select("location", "place", "key", names.alias("aliases"))


def search_places_of(rows: DataFrame, places: Places, limit: int = 20, location: str = "location") -> DataFrame:
    """(location, aliases, towns, search_places): places to search for, a region's towns or else the aliases, at most `limit`."""
    named = aliases_of(rows, places, location)
    towns = named.join(places.regions, named["key"] == N.name_key(F.col("region"))).groupBy("location").agg(F.array_sort(F.collect_list(F.struct("ord", "town"))).alias("t"))
    out = named.join(towns, "location", "left").withColumn("towns", F.transform("t", lambda x: x["town"]))
    return out.select("location", "place", "key", "aliases", F.coalesce("towns", F.array().cast("array<string>")).alias("towns"), F.slice(F.coalesce("towns", "aliases"), 1, limit).alias("search_places"))


def phrases(text: Column, lengths: Column) -> Column:
    """The different runs of words of a normalised text, of each of the lengths."""
    words = F.split(text, " ")
    runs = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(lengths, runs)))


def named_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts(text) with each of names(phrase, ...) that occurs in the normalised text as whole words."""
    long = names.agg(F.coalesce(F.array_sort(F.collect_set(F.size(F.split("phrase", " ")))), F.array().cast("array<int>")).alias("lengths"))  # one row of a few numbers
    cut = texts.select("text").where("text is not null").distinct().crossJoin(F.broadcast(long))
    runs = cut.select("text", F.explode(phrases(N.name_key(F.col("text")), F.col("lengths"))).alias("phrase"))
    return runs.where("phrase <> ''").join(names, "phrase")


def signals(rows: DataFrame, places: Places, text: str = "text", location: str = "location") -> DataFrame:
    """rows with has_location (a town of the location's region or one of its names occurs in the normalised text) and wrong_location
    (a known place occurs as whole words that is neither the location's nor of a region that holds it)."""
    asked = search_places_of(rows, places, location=location)
    own = asked.select("location", F.explode(F.concat("aliases", "search_places")).alias("name")).select("location", N.name_key(F.col("name")).alias("phrase"))
    members = places.regions.select("region", N.name_key(F.col("town")).alias("m")).unionByName(places.regions.select("region", N.name_key(F.col("region")).alias("m"))).distinct()
    held = asked.select("location", "key").join(members, F.col("key") == F.col("m")).select("location", "region").distinct()
    allowed = own.unionByName(held.join(members, "region").select("location", F.col("m").alias("phrase"))).distinct()
    pairs = rows.select(F.col(text).alias("text"), F.col(location).alias("location")).where("text is not null and location is not null").distinct()
    there = asked.select("location", F.transform(F.concat("towns", "aliases"), N.name_key).alias("names"))
    has = pairs.join(there, "location").where(F.exists("names", lambda n: N.name_key(F.col("text")).contains(n))).select("text", "location").withColumn("_has", F.lit(True))
    met = pairs.join(named_in(pairs, places.hints()), "text")
    wrong = met.join(allowed, ["location", "phrase"], "left_anti").select("text", "location").distinct().withColumn("_wrong", F.lit(True))
    verdict = pairs.join(has, ["text", "location"], "left").join(wrong, ["text", "location"], "left").select(F.col("text").alias("_t"), F.col("location").alias("_l"), "_has", "_wrong")
    out = rows.join(verdict, (F.col(text) == F.col("_t")) & (F.col(location) == F.col("_l")), "left").drop("_t", "_l")
    return out.withColumns({"has_location": F.coalesce("_has", F.lit(False)), "wrong_location": F.coalesce("_wrong", F.lit(False))}).drop("_has", "_wrong")


def countries_of(texts: DataFrame, places: Places) -> DataFrame:
    """(text, code): the first country a text names, by its own names before its regions and their towns."""
    names = places.countries.where("kind = 'name'").select(N.name_key(F.col("name")).alias("phrase"), F.lit(0).alias("pass"), "rank", "code")
    regions = places.countries.where("kind = 'region'").select(N.name_key(F.col("name")).alias("key"), "rank", "code")
    towns = places.regions.select(N.name_key(F.col("region")).alias("key"), F.explode(F.array(N.name_key(F.col("region")), N.name_key(F.col("town")))).alias("phrase")).unionByName(regions.select("key", F.col("key").alias("phrase"))).distinct()
    every = names.unionByName(regions.join(towns, "key").select("phrase", F.lit(1).alias("pass"), "rank", "code")).where("phrase <> ''")
    best = every.groupBy("phrase").agg(F.min(F.struct("pass", "rank", "code")).alias("best"))
    return named_in(texts, best).groupBy("text").agg(F.min("best").alias("best")).select("text", "best.code")
