"""Predicates and scores on search hits, entities and titles, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import normalize as N
from sieveline.plans import search as S
from sieveline.plans.dims import Gazetteer

# fixed values: hosts and phrases the rules test
SEARCH_HOSTS = ("google.com", "bing.com", "duckduckgo.com")
BLOCKED_URLS = ("google.com/search", "bing.com/search", "duckduckgo.com")
LIST_PHRASES = ("in india", "near me in india", "top 10")
DIRECTORY_HOSTS = ("justdial.", "sulekha.", "yellowpages.", "yelp.", "indiamart.", "tradeindia.")
REVIEW_HOSTS = ("tripadvisor.", "zomato.", "restaurant-guru.", "magicpin.")
CONTENT_HOSTS = ("quora.", "reddit.", "medium.", "blogspot.", "wordpress.", "youtube.")
PROFILE_HOSTS = ("practo.", "dentee.", "justdial.", "sulekha.")
DIRECTORY_TITLES = ("restaurants", "yellow pages", "companies", "directory", "near me", "order online", "check prices", "reviews", "all you must know")
LISTICLE_STARTS = ("best ", "top ", "famous ", "popular ")
LISTICLE_PARTS = (" updated ", " food lovers", " culinary ", " district")
QUESTION_STARTS = ("if ", "when ", "where ", "how ", "why ", "what ")
LEAD_REJECTS = ("what are", "best places", "must try", "food guide", "restaurants in", "places to eat", "business directory", "list of", "map of", "exploring", "guide", "read more", "view all", "near me", "reviews", "comments")
GENERIC_NAMES = ("dining", "tripadvisor", "restaurant", "restaurants")
STRONG_FIELDS = ("address", "phone", "email", "working_hours", "rating", "review_count", "license_information")
MAP_SOURCES = ("geoapify", "google_places", "serper_places")
BROAD_CATEGORIES = ("shop", "store", "shopping", "service", "business")


def any_in(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in parts), F.lit(False))


def any_start(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(p) for p in parts), F.lit(False))


def some_of(text: Column, words: Column) -> Column:
    """Whether the text holds one of the words of an array."""
    return F.exists(words, lambda w: text.contains(w))


def has_location(text: Column, location: Column, g: Gazetteer) -> Column:
    """A town of the region or an alias of the place occurs in the normalised text."""
    hay = N.name_key(text)
    towns = F.coalesce(F.try_element_at(S.array_map(g.regions), N.name_key(S.fixed_location(location, g))), F.array().cast("array<string>"))
    names = F.transform(F.concat(towns, S.aliases(location, g)), N.name_key)
    return some_of(hay, names)


def has_wrong_location(text: Column, location: Column, g: Gazetteer) -> Column:
    """A known place that is not this one, nor of its regions, occurs as a whole phrase."""
    every = sorted({*g.off_places, *g.regions, *(t for x in g.regions.values() for t in x), *(a for x in g.aliases.values() for a in x)})
    own = F.transform(F.concat(S.aliases(location, g), S.search_places(location, g)), N.name_key)
    key = N.name_key(S.fixed_location(location, g))
    by_region = [F.when(key.isin(r, *towns), F.array(*map(F.lit, (r, *towns)))).otherwise(F.array().cast("array<string>")) for r, towns in g.regions.items()]
    allowed = F.concat(own, *by_region)
    hay = F.concat(F.lit(" "), N.name_key(text), F.lit(" "))
    hints = F.array_except(F.array(*map(F.lit, every)), allowed)
    return F.exists(hints, lambda h: hay.contains(F.concat(F.lit(" "), h, F.lit(" "))))


def category_terms(category: Column, g: Gazetteer) -> Column:
    return F.filter(F.transform(S.expansions(category, g), lambda c: F.regexp_replace(F.lower(c), "s+$", "")), lambda c: c != "")


def relevance(title: Column, snippet: Column, url: Column, category: Column, location: Column, g: Gazetteer) -> Column:
    """0.15, raised by place and category, lowered by other places, search hosts and lists; never below 0."""
    text = F.concat_ws(" ", N.filled(title), N.filled(snippet), N.filled(url))
    there = N.filled(location) != ""
    score = (
        F.lit(0.15)
        + F.when(there & has_location(text, location, g), 0.65).otherwise(0.0)
        + F.when(some_of(F.lower(text), category_terms(category, g)), 0.15).otherwise(0.0)
        - F.when(there & has_wrong_location(text, location, g), 0.7).otherwise(0.0)
        - F.when(any_in(N.authority(url), SEARCH_HOSTS), 0.4).otherwise(0.0)
        - F.when(any_in(F.lower(N.filled(title)), LIST_PHRASES), 0.15).otherwise(0.0)
    )
    return F.greatest(F.round(score, 6), F.lit(0.0))


def keeps_hit(title: Column, snippet: Column, url: Column, category: Column, location: Column, g: Gazetteer) -> Column:
    host = N.authority(url)
    shut = (host == "") | any_in(F.lower(N.filled(url)), BLOCKED_URLS) | (host.contains("google.") & N.url_path(url).startswith("/maps/search"))
    return ~shut & ((N.filled(location) == "") | (relevance(title, snippet, url, category, location, g) >= 0.35))


def host_class(url: Column) -> Column:
    host = N.authority(url)
    return F.when(any_in(host, DIRECTORY_HOSTS), "directory").when(any_in(host, REVIEW_HOSTS), "review").when(any_in(host, CONTENT_HOSTS), "content").otherwise("own")


def variants(category: Column) -> Column:
    """Forms a listing title may give a category: itself and its singulars."""
    c = N.name_key(category)
    y = F.when(c.endswith("ies"), F.regexp_replace(c, "ies$", "y"))
    return F.array_distinct(F.filter(F.array(c, y, F.when(c.endswith("s"), F.regexp_replace(c, "s$", ""))), lambda v: N.filled(v) != ""))


def directory_title(name: Column) -> Column:
    return any_in(name, DIRECTORY_TITLES)


def listicle(name: Column, forms: Column) -> Column:
    """A list of a category rather than one of it: superlatives, counts, or phrases of such pages."""
    best = any_in(name, ("best", "top", "famous", "updated"))
    signs = any_in(name, LISTICLE_PARTS) | any_start(name, LISTICLE_STARTS) | (name.startswith("the ") & name.contains(" best ")) | (name.rlike("[0-9]") & best)
    return some_of(name, forms) & signs


def sentence_title(raw: Column) -> Column:
    key = N.name_key(raw)
    long = F.size(F.split(key, " ")) > 10
    return long | raw.contains("...") | raw.contains("…") | (F.regexp_count(raw, F.lit(",")) >= 3) | (F.regexp_count(raw, F.lit(" - ")) >= 2) | any_start(key, QUESTION_STARTS)


def listing_start(name: Column, category: Column, location: Column) -> Column:
    """The name is, or starts with, a category at a place, with or without best, top or near me."""
    place = N.name_key(location)
    shapes = lambda v: F.array(*(F.concat(F.lit(a), v, F.lit(b), place) for a, b in (("", " in "), ("", " "), ("best ", " in "), ("top ", " in "), ("", " near me in "), ("best ", " near me in "))))
    every = F.flatten(F.transform(variants(category), shapes))
    hit = F.exists(every, lambda s: (name == s) | name.startswith(F.concat(s, F.lit(" "))))
    return (N.name_key(category) != "") & (place != "") & hit


def generic_listing(raw: Column, website: Column, category: Column, location: Column) -> Column:
    """Names that stand for a page about many entities."""
    name, kind, forms = N.name_key(raw), host_class(website), variants(category)
    trimmed = F.trim(N.filled(raw))
    return (
        (name == "") | trimmed.startswith("#") | trimmed.contains("@") | sentence_title(trimmed) | listing_start(name, category, location) | name.isin(*GENERIC_NAMES)
        | listicle(name, forms) | (kind == "content") | ((kind == "directory") & some_of(name, forms) & name.contains(N.name_key(location))) | (kind.isin("directory", "review") & directory_title(name))
    )


def keeps_entity(e: dict[str, Column], source: Column, category: Column, location: Column, g: Gazetteer) -> Column:
    """e: columns business_name, website, urls (text) and the STRONG_FIELDS."""
    text = F.concat_ws(" ", *(N.filled(e[k]) for k in ("business_name", "address", "website", "urls")))
    named = N.filled(e["business_name"]) != ""
    placed = (N.filled(location) == "") | has_location(text, location, g)
    strong = reduce(lambda a, b: a | b, (F.trim(N.filled(e[f])) != "" for f in STRONG_FIELDS))
    on_map = (N.filled(e["address"]) != "") | (N.filled(e["phone"]) != "")
    own_site = (N.filled(e["website"]) != "") & (host_class(e["website"]) == "own")
    return named & placed & ~generic_listing(e["business_name"], e["website"], category, location) & F.when(source.isin(*MAP_SOURCES), on_map).otherwise(strong | own_site)


# fixed values: phrases of page titles that name no business
PAGE_PHRASES = (
    "what are", "all you must know", "yellow pages", "best restaurants", "top restaurants", "famous restaurants", "the 10 best", "must try", "places to eat",
    "food guide", "culinary delights", "business directory", "list of companies", "best attractions", "popular restaurants", "restaurants near",
)


def non_business_title(title: Column, url: Column) -> Column:
    key, host = N.plain(title), N.authority(url)
    forms = F.array(*map(F.lit, ("restaurant", "dentist", "doctor", "electrician", "plumber", "shop", "salon")))
    return ((key == "google") & host.contains("google.")) | (host.contains("google.") & N.url_path(url).startswith("/maps/search")) | any_in(host, ("quora.", "reddit.", "youtube.", "youtu.be")) | key.isin(*GENERIC_NAMES) | listicle(key, forms) | any_in(key, PAGE_PHRASES)


def lead_name(value: Column, category: Column, location: Column) -> Column:
    clean = N.clean_lead(value)
    key = N.plain(clean)
    bad = (F.length(clean) < 3) | ~clean.rlike("[A-Za-z]") | any_in(key, LEAD_REJECTS) | key.isin(*GENERIC_NAMES) | (key == F.lower(category)) | (key == F.lower(location)) | (F.size(F.split(key, " ")) > 8)
    return ~bad & clean.rlike(r"(?U)(^|\s)\p{Lu}")


def place_matches(text: Column, category: Column, location: Column, g: Gazetteer) -> Column:
    broad = any_in(F.lower(category), BROAD_CATEGORIES)
    return has_location(text, location, g) & (broad | some_of(F.lower(text), category_terms(category, g)))


def generic_profile(url: Column, category: Column, location: Column) -> Column:
    """A directory's page about a category at a place."""
    path = F.regexp_replace(N.url_path(url), "/+$", "")
    key = N.name_key(F.replace(path, F.lit("/"), F.lit(" ")))
    loc, cat = N.name_key(location), F.regexp_replace(N.name_key(category), "s+$", "")
    both = (loc != "") & (cat != "") & key.contains(loc) & key.contains(cat)
    return any_in(N.authority(url), PROFILE_HOSTS) & (both | path.rlike("/(doctors|dentists|clinics|search|list)$"))


def hit_score(title: Column, snippet: Column, url: Column, name: Column, website: Column, category: Column, location: Column) -> Column:
    """How surely a hit is about a named entity: 0.22 a name word, 0.25 the place, 0.35 its host, 0.10 a profile host."""
    return score_of(hit_text(title, snippet, url), name_words(name), N.authority(url), N.authority(website), url, category, location)


def hit_text(title: Column, snippet: Column, url: Column) -> Column:
    return N.name_key(F.concat_ws(" ", N.filled(title), N.filled(snippet), N.filled(url)))


def name_words(name: Column) -> Column:
    return N.name_tokens(name, N.HIT_IGNORED)


def score_of(text: Column, words: Column, host: Column, site: Column, url: Column, category: Column, location: Column) -> Column:
    """hit_score() of hit_text(), name_words() and the hosts of hit and website; where these are columns of a table, no word makes the text anew."""
    loc = N.name_key(location)
    score = F.size(F.filter(words, lambda t: text.contains(t))) * 0.22 + F.when((loc != "") & text.contains(loc), 0.25).otherwise(0.0) + F.when((site != "") & host.contains(site), 0.35).otherwise(0.0) + F.when(any_in(host, PROFILE_HOSTS), 0.1).otherwise(0.0)
    return F.when(generic_profile(url, category, location), 0.0).otherwise(F.round(score, 6))


def page_is_about(text: Column, website: Column, name: Column, address: Column, category: Column, location: Column) -> Column:
    hay, words, loc = N.name_key(text), N.name_tokens(name, N.HIT_IGNORED), N.name_key(location)
    hits = F.size(F.filter(words, lambda t: hay.contains(t)))
    near = (N.filled(address) != "") & (loc != "") & hay.contains(loc) & (hits >= 1)
    return ~generic_profile(website, category, location) & (F.size(words) > 0) & ((hits >= F.greatest(F.lit(1), F.size(words) - 1)) | near)
