"""Evidence from pages: native expressions where a regular expression does, one HTML pass where a tree is needed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import html as H
from sieveline.functions import normalize as N

# fixed values: the forms of contact facts in running text
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+?1[\s.-]?)?(?:\(?[0-9]{3}\)?[\s.-]?)[0-9]{3}[\s.-]?[0-9]{4}(?:\s*(?:x|ext\.?)\s*[0-9]+)?|(?:\+?91[\s.-]?)?[6-9][0-9]{4}[\s.-]?[0-9]{5}|0[0-9]{2,5}[\s.-]?[0-9]{5,8}"
HOURS = r"(?i)\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\s*[-:]\s*[^<\n]{3,80}"
RATING = r"(?i)\b([1-5](?:\.[0-9])?)\s*(?:out of|/)\s*5\b"
REVIEWS = r"(?i)\b([0-9][0-9,]*)\s+reviews?\b"
LICENSE = r"(?i)\b(?:license|lic\.?|npi|bar no\.?|bar number)\s*[:#]?\s*([A-Z0-9 -]{4,30})"
SOCIAL_HOSTS = ("linkedin.com", "facebook.com", "instagram.com", "x.com", "twitter.com", "youtube.com")
SERVICE_WORDS = ("services", "practice areas", "specialties", "treatments", "procedures", "emergency", "consultation", "menu", "delivery", "repair", "installation", "maintenance", "cuisine", "products", "solutions")
# fixed values: linked-data keys and the evidence fields they fill
LD_FIELDS = (("name", "business_name"), ("telephone", "phone"), ("email", "email"), ("url", "website"), ("openingHours", "working_hours"), ("description", "services"), ("servesCuisine", "services"), ("menu", "services"), ("keywords", "services"), ("medicalSpecialty", "specialties"), ("knowsAbout", "specialties"))
LD_TYPES = ("localbusiness", "organization", "physician", "dentist", "legalservice")
LEAD_TYPES = ("LocalBusiness", "Restaurant", "Store", "MedicalBusiness", "LegalService")
LEAD_CLASSES = ("business-name", "store-name", "listing-name", "result-title", "vendor-name", "company-name", "merchant-name", "jcn")
# fixed values: fields that page_facts takes from a page's elements
PAGE_FIELDS = ("title", "description", "body", "website", "social_profiles", "images_urls", "services", "specialties")
MOST_TEXT = 50_000
PAGES = 50


def all_of(text: Column, form: str) -> Column:
    """Different matches, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(N.filled(text), F.lit(form), F.lit(0))))


def emails(text: Column) -> Column:
    return all_of(text, EMAIL)


def phones(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(N.filled(text), F.lit(f"(?=[+(0-9])(?:{PHONE})"), F.lit(0)), N.clean_phone)))


def hours(text: Column) -> Column:
    return F.array_join(F.slice(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(N.filled(text), F.lit(HOURS), F.lit(0)), F.trim))), 1, 14), "; ")


def text_facts(text: Column) -> Column:
    """array of (field, value): what running text says about an entity."""
    one = lambda name, v: F.array(F.struct(F.lit(name).alias("field"), v.alias("value")))
    many = lambda name, vs: F.transform(vs, lambda v: F.struct(F.lit(name).alias("field"), v.alias("value")))
    t = N.filled(text)
    facts = F.concat(many("email", emails(t)), many("phone", phones(t)), one("working_hours", hours(t)), one("rating", F.regexp_extract(t, RATING, 1)), one("review_count", F.regexp_extract(t, REVIEWS, 1)), one("license_information", F.regexp_extract(t, LICENSE, 0)))
    return F.filter(facts, lambda f: f["value"] != "")


def hit_facts(hits: DataFrame) -> DataFrame:
    """hits(hit_id, title, url, snippet, source_type, reliability) -> seed evidence (hit_id, field, value, source_type, reliability)."""
    from sieveline.operators.filters import non_business_title

    name = N.clean_title(F.col("title"))
    fact = lambda f, v, kind, rel: F.struct(F.lit(f).alias("field"), v.alias("value"), kind.alias("source_type"), rel.cast("double").alias("reliability"))
    seed = F.array(
        F.when(~non_business_title(name, F.col("url")), fact("business_name", name, F.lit("search_result"), F.lit(0.45))),
        fact("website", F.col("url"), F.col("source_type"), F.col("reliability")),
    )
    text = F.transform(text_facts(F.concat_ws(" ", "title", "snippet")), lambda f: F.struct(f["field"].alias("field"), f["value"].alias("value"), F.lit("search_result").alias("source_type"), F.lit(0.45).alias("reliability")))
    rows = hits.select("hit_id", F.explode(F.array_compact(F.concat(seed, text))).alias("f")).select("hit_id", "f.*")
    return rows.where("value <> ''")


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in parts of PAGES: a Python worker holds the trees, texts and facts of these pages alone."""
    for b in batches:
        for lo in range(0, b.num_rows, PAGES):
            yield b.slice(lo, PAGES)


def _texts(value) -> list[str]:
    if isinstance(value, list):
        return [str(x) for x in value if x]
    return [str(value)] if value else []


def _address(value) -> str:
    if isinstance(value, dict):
        return ", ".join(str(value[k]) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry") if value.get(k))
    return value if isinstance(value, str) else ""


def ld_facts(item: dict) -> list[tuple[str, list[str]]]:
    """(field, values) of a linked-data object that describes an entity."""
    kind = item.get("@type", "")
    kind = " ".join(map(str, kind)) if isinstance(kind, list) else str(kind)
    if not any(t in kind.lower() for t in LD_TYPES) and not any(k in item for k in ("telephone", "address", "openingHours")):
        return []
    out = [(f, _texts(item.get(k))) for k, f in LD_FIELDS]
    out.append(("address", _texts(_address(item.get("address")))))
    rating = item.get("aggregateRating")
    if isinstance(rating, dict):
        out += [("rating", _texts(rating.get("ratingValue"))), ("review_count", _texts(rating.get("reviewCount")))]
    return [(f, v) for f, v in out if v and v != [""]]


def page_facts(url: str, html: str, closed: bool = False, fields: tuple[str, ...] | None = None) -> list[tuple[str, list[str]]]:
    """(field, values) of a page, but for those of its running text, which `body` holds for text_facts(). `closed` as in html.parse.
    With `fields`, only these, numbered among themselves; the page's texts are not built unless one of PAGE_FIELDS is wanted."""
    root = H.parse(html, closed)
    out = [x for item in H.linked_data(root) for x in ld_facts(item)]
    if fields is not None and not set(fields) & set(PAGE_FIELDS):
        return [(f, [x for x in v if x]) for f, v in out if f in fields and any(v)]
    name = H.meta(root, "og:title") or H.title(root)
    social, images = H.links(root, url, SOCIAL_HOSTS)
    services = list(dict.fromkeys(t for n in H.find(root, "li", "a", "h2", "h3") if 3 <= len(t := n.text()) <= 80 and any(w in t.lower() for w in SERVICE_WORDS)))[:30]
    out += [("title", [name]), ("description", [H.meta(root, "description") or H.meta(root, "og:description")]), ("body", [root.text()[:MOST_TEXT]]), ("website", [H.canonical(root, url)])]
    out += [("social_profiles", social), ("images_urls", images[:20]), ("services", services), ("specialties", services)]
    return [(f, [x for x in v if x]) for f, v in out if any(v) and (fields is None or f in fields)]


def html_facts(pages: DataFrame, closed: bool = False, fields: tuple[str, ...] | None = None) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, ord, field, values): one HTML pass in Arrow batches, then native expressions. `closed` and `fields` as in page_facts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            rows = [(i, k, f, v) for i, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, (f, v) in enumerate(page_facts(u or "", h or "", closed, fields))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string())), strict=True)], names=["page_id", "ord", "field", "values"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(read, "page_id long, ord int, field string, values array<string>")


def lead_texts(html: str, most: int = 12) -> list[str]:
    """Texts that may name entities on a list page: linked data, marked elements, then headings, items and links."""
    root = H.parse(html)
    out = [str(x.get("name")) for item in H.linked_data(root) for x in (item, *H.children(item)) if isinstance(x.get("name"), str)]
    marked = [n for n in root.walk() if any(t in n.attrs.get("itemtype", "") for t in LEAD_TYPES) or any(n.has_class(c) for c in LEAD_CLASSES)]
    out += [n.text() for n in marked[: most * 4]]
    for tag in ("h2", "h3", "h4", "strong", "li", "a"):
        out += [n.text() for n in H.find(root, tag)]
    return [x for x in out if x]


def leads(pages: DataFrame, category: Column, location: Column, most: int = 12) -> DataFrame:
    """pages(page_id, html) -> (page_id, ord, name): at most `most` different entity names a list page gives."""
    from sieveline.operators.filters import lead_name

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            got = [lead_texts(h or "", most) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.string()))], names=["page_id", "texts"])

    rows = pages.select(F.col("page_id").cast("long"), "html").mapInArrow(read, "page_id long, texts array<string>")
    parts = F.flatten(F.transform("texts", N.lead_parts))
    names = F.array_distinct(F.filter(F.transform(F.filter(parts, lambda p: lead_name(p, category, location)), N.clean_lead), lambda n: n != ""))
    return rows.select("page_id", F.posexplode(F.slice(names, 1, most)).alias("ord", "name"))
