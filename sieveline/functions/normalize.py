"""Text, phone, URL and address normalisers and display clean-ups, as Column expressions.

Missing values are empty strings: every function takes null as empty and returns no null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that name a legal form or kind of business and carry no identity
SUFFIX_WORDS = "llc|inc|corp|corporation|company|co|pllc|pc|pa|ltd|the|clinic|center|centre"
# fixed values: address words and their short forms, replaced in this order
ADDRESS_SHORT = ((" street", " st"), (" avenue", " ave"), (" road", " rd"), (" boulevard", " blvd"), (" drive", " dr"), (" suite", " ste"))
# fixed values: words that questions and chunks are not matched by
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "this", "to", "with", "what", "which", "who", "where", "show", "give", "list")
# fixed values: name words too common to tell entities apart, for page hits and for map leads
HIT_IGNORED = ("clinic", "hospital", "care", "dental", "doctor", "dr", "the", "and", "in", "near", "best")
LEAD_IGNORED = ("the", "and", "restaurant", "restaurants", "hotel", "clinic", "shop", "store", "service", "services", "center", "centre", "near", "in")


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def spaced(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(filled(c), r"(?U)\s+", " "))


def flat_text(*parts: Column) -> Column:
    """Non-empty parts joined by a space; arrays and maps contribute their own non-empty parts."""
    return F.array_join(F.filter(F.array(*parts), lambda x: filled(x) != ""), " ")


def flat_array(a: Column) -> Column:
    return F.array_join(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: filled(x) != ""), " ")


def plain(c: Column) -> Column:
    """Lower case, other than a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", " "))


def name_key(c: Column) -> Column:
    """plain() without words of legal form."""
    return plain(F.regexp_replace(filled(c), rf"(?iU)\b({SUFFIX_WORDS})\b", " "))


def phone_key(c: Column) -> Column:
    """Digits, without a leading 1 of eleven; empty if fewer than eight."""
    digits = F.regexp_replace(filled(c), "[^0-9]", "")
    digits = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(F.length(digits) < 8, "").otherwise(digits)


def authority(c: Column) -> Column:
    """What stands between :// and the path, lower-cased; empty without ://."""
    return F.lower(F.regexp_extract(filled(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(c: Column) -> Column:
    return F.lower(F.regexp_extract(filled(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def site_key(c: Column) -> Column:
    """Host of a URL, with or without scheme, without www."""
    url = F.when(filled(c).contains("://"), filled(c)).otherwise(F.concat(F.lit("https://"), filled(c)))
    return F.when(filled(c) == "", "").otherwise(F.regexp_replace(authority(url), r"^www\.", ""))


def address_key(c: Column) -> Column:
    out = F.lower(filled(c))
    for old, new in ADDRESS_SHORT:
        out = F.replace(out, F.lit(old), F.lit(new))
    return plain(out)


def canonical(field: Column, value: Column) -> Column:
    """The key under which values of a field are the same."""
    return F.when(field == "phone", phone_key(value)).when(field == "website", site_key(value)).when(field == "address", address_key(value)).otherwise(name_key(value))


def canonical_list(values: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.filter(values, lambda x: filled(x) != ""), name_key)), "|")


def edges(c: Column, chars: str) -> Column:
    """c without any of chars at its ends."""
    return F.btrim(filled(c), F.lit(chars))


def shown(field: Column, value: Column) -> Column:
    """How a winning value is shown: the first phone of a list, an address without brackets and stray marks."""
    parts = F.filter(F.split(filled(value), "[,;|/]"), lambda p: phone_key(p) != "")
    phone = edges(F.when(F.size(parts) > 0, parts[0]).otherwise(filled(value)), " -.,")
    address = F.regexp_replace(filled(value), r"[\[\]']", "")
    address = F.regexp_replace(address, r"(?:^|,\s*)-\s*(?=,|$)", "")
    address = edges(spaced(F.regexp_replace(address, r"\s*,\s*,+", ", ")), " ,")
    return F.when(field == "phone", phone).when(field == "address", address).otherwise(filled(value))


def clean_title(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(filled(c), r"\s+[-|]\s+.*$", "")), 1, 180)


def lead_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(spaced(c), r"\s*(?:\||•|·|:|–|—)\s*"), lambda p: edges(p, " -:.,")), lambda p: p != "")


def clean_lead(c: Column) -> Column:
    out = F.trim(F.regexp_replace(filled(c), r"^[0-9]+\s*[).:-]\s*", ""))
    out = F.trim(F.split(out, r"\s+(?:is|are|was|were)\s+", 2)[0])
    out = F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+[-|]\s+.*$", "")), r"\s+", " ")
    return F.when(F.length(out) > 80, "").otherwise(out)


def clean_phone(c: Column) -> Column:
    return spaced(edges(c, " .,-"))


def address_line(street: Column, city: Column, region: Column, code: Column, country: Column) -> Column:
    return F.array_join(F.filter(F.array(street, city, region, code, country), lambda x: filled(x) != ""), ", ")


def strip_tags(c: Column) -> Column:
    return spaced(unescape(F.regexp_replace(filled(c), "<[^>]+>", " ")))


def unescape(c: Column) -> Column:
    """The named entities that matter for text, and numeric ones left as they are."""
    out = c
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def escape(c: Column) -> Column:
    out = filled(c)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def slug(c: Column, default: str = "report", most: int = 80) -> Column:
    out = edges(F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", "-"), "-")
    return F.when(out == "", default).otherwise(F.substring(out, 1, most))


def terms(c: Column) -> Column:
    """Different tokens of two or more a-z or 0-9, without stop words."""
    found = F.regexp_extract_all(F.lower(filled(c)), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def name_tokens(c: Column, ignored: tuple[str, ...], distinct: bool = False) -> Column:
    out = F.filter(F.split(name_key(c), " "), lambda t: (F.length(t) > 2) & ~t.isin(*ignored))
    return F.array_distinct(out) if distinct else out


def percent_number(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.trim(filled(c)), "%+$", "").try_cast("int"), F.lit(0))


def percent_text(part: Column, total: Column) -> Column:
    """A whole percentage, halves to even."""
    return F.concat(F.bround(F.lit(100.0) * part / F.greatest(total, F.lit(1)), 0).cast("int").cast("string"), F.lit("%"))


def chunks(c: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters, each `size - overlap` after the one before, while they start inside the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap

    def windows(t: Column) -> Column:
        last = F.ceil(F.length(t) / step).cast("int") - 1
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, i * step + 1, F.lit(size))))

    # as an element of an array, the trimmed text is worked out once and not for every window
    return F.transform(F.array(F.regexp_replace(filled(c), r"(?U)^\s+|\s++$", "")), windows)[0]


def run_key(query: Column, epoch: Column) -> Column:
    return F.concat(F.substring(F.md5(F.lower(F.trim(filled(query)))), 1, 8), F.lit("_"), epoch.cast("string"))


def client_key(name: Column, address: Column, phone: Column) -> Column:
    """Entity key of a viewer: phone, else name and address, else name."""
    digits = F.regexp_replace(filled(phone), "[^0-9]", "")
    return F.when(digits != "", F.concat(F.lit("p:"), digits)).when(filled(address) != "", F.concat(F.lit("na:"), plain(name), F.lit("|"), plain(address))).otherwise(F.concat(F.lit("n:"), plain(name)))


def evidence_card(name: Column, address: Column, phone: Column, website: Column, hours: Column, rating: Column, services: Column, email: Column) -> Column:
    """Eight labelled lines of an entity for retrieval, N/A where nothing is known."""
    lines = (("Name", name), ("Address", address), ("Phone", phone), ("Website", website), ("Hours", hours), ("Rating", rating), ("Services", services), ("Email", email))
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.when(filled(v) == "", "N/A").otherwise(v)) for k, v in lines))
