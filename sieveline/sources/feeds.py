"""Scans of search and place payloads, their caches, and sinks, all as tables.

Network sources are Python Data Sources elsewhere in this package; what they fetch lands in a cache
table, and everything here reads payloads from such a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import normalize as N

BODY_MOST = 2_000_000
HIT = "title string, url string, snippet string, provider string, rank int"
ORGANIC = "struct<organic:array<struct<title:string,link:string,snippet:string,date:string>>,places:array<struct<title:string,link:string,website:string,address:string,phoneNumber:string>>>"
RESULTS = "struct<results:array<struct<title:string,url:string,content:string>>>"
PLACE = "struct<id:string,name:string,displayName:struct<text:string>,formattedAddress:string,nationalPhoneNumber:string,internationalPhoneNumber:string,websiteUri:string,googleMapsUri:string,rating:double,userRatingCount:int,types:array<string>,regularOpeningHours:struct<weekdayDescriptions:array<string>>>"
FEATURE = "struct<properties:struct<name:string,formatted:string,phone:string,email:string,website:string,opening_hours:string,categories:array<string>,lat:double,lon:double,place_id:string,datasource:struct<raw:map<string,string>>>>"
SHOP = "struct<title:string,address:string,phoneNumber:string,website:string,link:string,rating:double,ratingCount:int,category:string,thumbnailUrl:string,placeId:string,cid:string>"
# fixed values: reliability of each place feed
RELIABILITY = {"osm": 0.78, "osm_details": 0.82, "map": 0.92, "map_details": 0.94, "map_legacy": 0.88, "shop": 0.86}
DAY = 86_400


def documents(pages: DataFrame) -> DataFrame:
    """pages as fetched documents: bodies up to BODY_MOST characters, the longest a reader takes."""
    return pages.select("page_id", "url", F.substring(N.filled(F.col("html")), 1, BODY_MOST).alias("body"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls that no rule(origin, prefix) disallows; URLs without scheme and host are never read."""
    u = urls.withColumn("_origin", F.lower(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]+)", 1))).withColumn("_path", F.regexp_extract("url", "^[A-Za-z]+://[^/?#]+([^?#]*)", 1)).where("_origin <> ''")
    shut = u.join(rules, (F.col("_origin") == F.col("origin")) & F.col("_path").startswith(F.col("prefix")), "left_anti")
    return shut.drop("_origin", "_path")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"), 256)


def fresh(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Rows no older than the time to live, its last second included."""
    return cache.where(now - F.col("fetched_at") <= ttl_seconds)


def latest(cache: DataFrame, put: DataFrame, key: str = "url") -> DataFrame:
    """The cache after writes: the row fetched last of each key."""
    every = cache.unionByName(put)
    cols = [c for c in every.columns if c != key]
    return every.groupBy(key).agg(F.max(F.struct("fetched_at", *[c for c in cols if c != "fetched_at"])).alias("r")).select(key, *[f"r.{c}" for c in cols])


def read_through(wanted: DataFrame, cache: DataFrame, key: str = "key", now: Column | None = None, ttl_seconds: int = 14 * DAY) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): misses are what a source still has to scan; empty results are not kept, nor, with `now`, stale ones."""
    kept = cache.where(F.size("results") > 0)
    if now is not None:
        kept = fresh(kept, now, ttl_seconds)
    return wanted.join(kept, key), wanted.join(kept, key, "left_anti")


def search_hits(payloads: DataFrame, provider: str = "serper_search") -> DataFrame:
    """payloads(pid, page, body) -> hits: organic results ranked over pages, then places ranked after them."""
    p = payloads.withColumn("j", F.from_json("body", ORGANIC))
    organic = F.filter(F.transform(F.coalesce("j.organic", F.array().cast("array<struct<title:string,link:string,snippet:string,date:string>>")), lambda x, i: F.struct(N.filled(x["title"]).alias("title"), x["link"].alias("url"), F.when(N.filled(x["snippet"]) != "", x["snippet"]).otherwise(N.filled(x["date"])).alias("snippet"), (i + 1 + (F.col("page") - 1) * 10).cast("int").alias("rank"))), lambda x: N.filled(x["url"]) != "")
    place = F.filter(F.transform(F.coalesce("j.places", F.array().cast("array<struct<title:string,link:string,website:string,address:string,phoneNumber:string>>")), lambda x: F.struct(N.filled(x["title"]).alias("title"), F.when(N.filled(x["website"]) != "", x["website"]).otherwise(x["link"]).alias("url"), N.flat_text(x["address"], x["phoneNumber"]).alias("snippet"))), lambda x: N.filled(x["url"]) != "")
    place = F.transform(place, lambda x, i: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["snippet"].alias("snippet"), (F.size(organic) + i + 1).cast("int").alias("rank")))
    return p.select("pid", F.explode(F.concat(organic, place)).alias("h")).select("pid", "h.*", F.lit(provider).alias("provider"))


def content_hits(payloads: DataFrame, provider: str = "tavily_search") -> DataFrame:
    """payloads(pid, page, body) of a feed with one page of results."""
    rows = payloads.where("page = 1").select("pid", F.posexplode(F.from_json("body", RESULTS)["results"]).alias("i", "x"))
    return rows.where("x.url <> ''").select("pid", N.filled(F.col("x.title")).alias("title"), F.col("x.url").alias("url"), N.filled(F.col("x.content")).alias("snippet"), (F.col("i") + 1).cast("int").alias("rank"), F.lit(provider).alias("provider"))


def page_offset(page: Column, kind: str) -> Column:
    """Where a page of results begins: kind "a" counts 30 from 0, kind "b" 10 from 1."""
    return (page - 1) * 30 if kind == "a" else (page - 1) * 10 + 1


def map_url(place_id: Column) -> Column:
    return F.when(N.filled(place_id) == "", "https://www.google.com/maps").otherwise(F.concat(F.lit("https://www.google.com/maps/place/?q=place_id:"), place_id))


def pin_url(lat: Column, lon: Column) -> Column:
    at = F.concat(lat.cast("string"), F.lit("/"), lon.cast("string"))
    return F.when(lat.isNull() | lon.isNull(), "https://www.openstreetmap.org/").otherwise(F.concat(F.lit("https://www.openstreetmap.org/?mlat="), lat.cast("string"), F.lit("&mlon="), lon.cast("string"), F.lit("#map=18/"), at))


def place_id(item_id: Column, name: Column) -> Column:
    return F.when(N.filled(item_id) != "", item_id).when(N.filled(name).startswith("places/"), F.substring_index(name, "/", -1)).otherwise("")


def first_contact(raw: Column, *values: Column, keys: tuple[str, ...] = ()) -> Column:
    """The first non-empty of the outer values, then of the raw map's keys."""
    every = [*values, *(F.try_element_at(raw, F.lit(k)) for k in keys)]
    return F.coalesce(*(F.when(N.filled(v) != "", v) for v in every), F.lit(""))


def _unpivot(rows: DataFrame, key: str, url: Column, kind: str, rel: float, **fields: Column) -> DataFrame:
    facts = F.array(*(F.struct(F.lit(k).alias("field"), F.filter(F.coalesce(v if k in ("services", "specialties", "images_urls") else F.array(v.cast("string")), F.array().cast("array<string>")), lambda x: N.filled(x) != "").alias("values")) for k, v in fields.items()))
    out = rows.select(key, url.alias("source_url"), F.explode(F.filter(facts, lambda f: F.size(f["values"]) > 0)).alias("f"))
    return out.select(key, "f.field", "f.values", "source_url", F.lit(kind).alias("source_type"), F.lit(rel).alias("reliability"))


def map_facts(payloads: DataFrame, rel: float = RELIABILITY["map"]) -> DataFrame:
    """payloads(pid, body) of map places -> evidence (pid, field, values, source_url, source_type, reliability)."""
    p = payloads.withColumn("j", F.from_json("body", PLACE))
    j = lambda c: F.col(f"j.{c}")
    url = F.coalesce(F.when(N.filled(j("googleMapsUri")) != "", j("googleMapsUri")), map_url(place_id(j("id"), j("name"))))
    return _unpivot(p, "pid", url, "google_places_new", rel, business_name=j("displayName.text"), address=j("formattedAddress"), phone=first_contact(F.create_map().cast("map<string,string>"), j("nationalPhoneNumber"), j("internationalPhoneNumber")), website=F.coalesce(j("websiteUri"), url), rating=j("rating"), review_count=j("userRatingCount"), services=j("types"), working_hours=F.array_join(j("regularOpeningHours.weekdayDescriptions"), "; "))


def osm_facts(payloads: DataFrame, rel: float = RELIABILITY["osm"]) -> DataFrame:
    p = payloads.withColumn("j", F.from_json("body", FEATURE)["properties"]).withColumn("raw", F.coalesce("j.datasource.raw", F.create_map().cast("map<string,string>")))
    j, raw = (lambda c: F.col(f"j.{c}")), F.col("raw")
    return _unpivot(p, "pid", pin_url(j("lat"), j("lon")), "geoapify", rel, business_name=j("name"), address=j("formatted"), phone=first_contact(raw, j("phone"), keys=("phone", "contact:phone", "contact:mobile", "mobile")), email=first_contact(raw, j("email"), keys=("email", "contact:email")), working_hours=first_contact(raw, j("opening_hours"), keys=("opening_hours",)), website=first_contact(raw, j("website"), keys=("website", "contact:website", "url")), services=j("categories"), specialties=j("categories"))


def shop_facts(payloads: DataFrame, rel: float = RELIABILITY["shop"]) -> DataFrame:
    p = payloads.withColumn("j", F.from_json("body", SHOP))
    j = lambda c: F.col(f"j.{c}")
    p = p.withColumn("pid_key", F.coalesce("j.placeId", "j.cid", "j.title")).dropDuplicates(["pid_key"])
    url = first_contact(F.create_map().cast("map<string,string>"), j("link"), j("website"), F.lit("https://google.com/maps"))
    return _unpivot(p, "pid", url, "serper_places", rel, business_name=j("title"), address=j("address"), phone=j("phoneNumber"), website=F.coalesce(j("website"), url), rating=j("rating"), review_count=j("ratingCount"), services=F.array(j("category")), images_urls=F.array(j("thumbnailUrl")))


def first_feed(main: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """Rows of main, and of backup for keys that main lacks."""
    return main.unionByName(backup.join(main.select(key).distinct(), key, "left_anti"))


def all_feeds(**feeds: DataFrame) -> DataFrame:
    """Rows of all feeds with `kind`, the name of theirs; none is lost."""
    return reduce(DataFrame.unionByName, (d.withColumn("kind", F.lit(k)) for k, d in feeds.items()))


def fetch_grid(providers: DataFrame, wanted: DataFrame, pages: int) -> DataFrame:
    """Each provider with each wanted query and page. Providers are a list of a deployment and the queries a run's budget."""
    return wanted.crossJoin(providers).withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """rows whose key is not among those seen; a null key was never seen."""
    return rows.join(seen.select(key), key, "left_anti")


def place_pages(searches: DataFrame, limit: int, size: int = 20, most: int = 100) -> DataFrame:
    """searches with `offset`, a row for each page of results below the limit."""
    return searches.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(max(min(limit, most), 1) - 1), F.lit(size))))


def first_places(found: DataFrame, limit: int, search: str = "search", place: str = "place_id", order: tuple[str, ...] = ("category", "offset", "pos")) -> DataFrame:
    """Different places of a search in the order of its pages, `limit` at most, with `place_no` from 1."""
    order = (*order, place)
    once = found.withColumn("_r", F.row_number().over(Window.partitionBy(search, place).orderBy(*order))).where("_r = 1").drop("_r")
    return once.withColumn("place_no", F.row_number().over(Window.partitionBy(search).orderBy(*order))).where(F.col("place_no") <= limit)


def until_goal(records: DataFrame, passes: Column, goal: int, order: str) -> DataFrame:
    """The first `goal` records in order that pass: a top-k in each task, so no record behind them is moved."""
    return records.where(passes).orderBy(order).limit(goal)


def within_circle(points: DataFrame, lat: float, lon: float, metres: float = 18_000) -> DataFrame:
    """points(lat, lon) within a great-circle distance; a box on the columns prunes first."""
    deg = metres / 111_000
    box = F.col("lat").between(lat - deg, lat + deg)
    a = F.pow(F.sin(F.radians(F.col("lat") - lat) / 2), 2) + F.cos(F.radians(F.lit(lat))) * F.cos(F.radians("lat")) * F.pow(F.sin(F.radians(F.col("lon") - lon) / 2), 2)
    return points.where(box & (2 * 6_371_000 * F.asin(F.sqrt(a)) <= metres))


def near_centres(points: DataFrame, centres: DataFrame, metres: float = 18_000) -> DataFrame:
    """points(lat, lon, ...) with each of centres(centre, lat, lon) within a great-circle distance, and `metres`.

    Both lie in cells: bands of latitude as high as the distance, cut into about square cells. A centre goes to the cells of three
    bands that its circle can touch, across the date line and round a pole, a point to its own; equal cells meet and the distance decides.
    Rows without a place meet none; longitudes count modulo 360."""
    high = max(metres / 110_000, 1e-6)
    cells_in = lambda band: F.greatest(F.lit(1), F.floor(F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(band * high - 90), F.abs((band + 1) * high - 90))))) * (360 / high)))
    cell = lambda lon, band: F.floor((lon + 180) / 360 * cells_in(band))
    turned = lambda lon: F.pmod(lon + 180, F.lit(360.0)) - 180
    known = lambda df: df.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    p = known(points).withColumn("_band", F.floor((F.col("lat") + 90) / high)).withColumn("_cell", cell(turned(F.col("lon")), F.col("_band")))
    c = known(centres).select("centre", F.col("lat").alias("_lat"), turned(F.col("lon")).alias("_lon"))
    angle, flat = metres / 6_371_000, F.cos(F.radians("_lat"))
    wide = F.when(F.sin(F.lit(min(angle, 1.57))) >= flat, 180.0).otherwise(F.degrees(F.asin(F.sin(F.lit(min(angle, 1.57))) / flat)) + 1e-6)
    own = F.floor((F.col("_lat") + 90) / high)
    c = c.withColumn("_wide", wide).withColumn("_band", F.explode(F.sequence(own - 1, own + 1)))
    reach = F.sequence(cell(F.col("_lon") - F.col("_wide"), F.col("_band")), cell(F.col("_lon") + F.col("_wide"), F.col("_band")))
    c = c.withColumn("_cell", F.explode(F.array_distinct(F.transform(reach, lambda x: F.pmod(x, cells_in(F.col("_band"))))))).drop("_wide")
    a = F.pow(F.sin(F.radians(F.col("lat") - F.col("_lat")) / 2), 2) + F.cos(F.radians("_lat")) * F.cos(F.radians("lat")) * F.pow(F.sin(F.radians(F.col("lon") - F.col("_lon")) / 2), 2)
    met = p.join(c, ["_band", "_cell"]).withColumn("metres", 2 * 6_371_000 * F.asin(F.least(F.sqrt(a), F.lit(1.0))))
    return met.where(F.col("metres") <= metres).drop("_band", "_cell", "_lat", "_lon")


def geocode_names(location: Column, parent: Column, country: Column, aliases: Column) -> Column:
    """Names to try for a place: inside its parent, with the country, then its aliases."""
    inside = (N.filled(parent) != "") & (F.lower(F.trim(parent)) != F.lower(F.trim(location)))
    tries = F.concat(F.array_compact(F.array(F.when(inside, F.concat_ws(", ", location, parent)), F.when(inside & (country != ""), F.concat_ws(", ", location, parent, country)), F.when(country != "", F.concat_ws(", ", location, country)))), aliases)
    return F.array_distinct(F.filter(tries, lambda a: a != ""))


# sinks


def to_events(rows: DataFrame, event: str | Column) -> DataFrame:
    """One JSON line a row: the event's name and the row."""
    return rows.select(F.to_json(F.struct((event if isinstance(event, Column) else F.lit(event)).alias("event"), F.struct(*rows.columns).alias("payload"))).alias("value"))


def business_key(phone: Column, website: Column, name: Column, address: Column) -> Column:
    return cache_key(N.phone_key(phone), N.site_key(website), N.name_key(name), N.address_key(address))


def run_id(query: Column, started: Column) -> Column:
    return F.substring(cache_key(query, started), 1, 24)


def upsert(old: DataFrame, new: DataFrame, run: Column, now: Column, key: str = "business_key", order: str | None = None) -> DataFrame:
    """old after new rows: new values win, runs are added to those seen, creation times stay.

    old: key, payload, seen_in_run_ids, created_at, updated_at; new: key, payload. Of a repeated new key the last by
    `order` wins, then the greatest payload; a null payload is new too and leaves the old one."""
    n = new.groupBy(key).agg(F.max(F.struct(F.col(order) if order else F.lit(0), F.col("payload")))["payload"].alias("_p"), F.lit(True).alias("_new"))
    j = old.join(n, key, "full")
    hit = F.coalesce("_new", F.lit(False))
    seen = F.coalesce("seen_in_run_ids", F.array().cast("array<string>"))
    return j.select(key, F.coalesce("_p", "payload").alias("payload"), F.when(hit, F.array_union(seen, F.array(run))).otherwise(seen).alias("seen_in_run_ids"), F.coalesce("created_at", now).alias("created_at"), F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"))


def report_html(rows: list[dict], query: str) -> str:
    """A report of at most a few thousand entities, rendered on the driver: a table, a page break after every third."""
    from html import escape

    cell = lambda v: escape(str(v if v not in (None, "", []) else "Not found"))
    body = []
    for i, r in enumerate(rows):
        lines = "".join(f"<tr><th>{escape(k)}</th><td>{cell(v)}</td></tr>" for k, v in r.items())
        body.append(f"<table>{lines}</table>" + ('<div class="break"></div>' if i % 3 == 2 else ""))
    return f"<!doctype html><title>{escape(query)}</title><h1>{escape(query)}</h1><p>{len(rows)} entities</p>" + "".join(body)


def ranked_hits(hits: DataFrame, most: int) -> DataFrame:
    """Different URLs, best score first, at most `most`."""
    w = Window.partitionBy("url").orderBy("rank", "provider")
    one = hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return one.orderBy(F.desc("score"), "rank", "url").limit(most)
