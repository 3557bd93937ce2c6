"""Personal data by fixed forms and by bootstrapped contexts, in DataFrame and SQL expressions only.

Base spans are the matches of four forms (email, ip, card, phone) that pass their tests. They seed
contextual extraction: the words around an identifier are lexical patterns, patterns and instances
make a graph, and rounds of scoring let instances raise the patterns they stand in and patterns the
instances they hold. An identifier-like token no form took is a span where a pattern of enough
different seeds, nearly all of one kind, surrounds it and its own look suits that kind.

Positions come without Python: the parts between matches and the matches themselves, in turn, have
lengths, and their running sums are code point offsets. Patterns keep linear time on any text: runs
are possessive and start only where an earlier start could not have taken them.

Defined results: null and empty texts have no spans; rows equal in doc_id and text share their result
and are each returned; an empty table gives an empty result; other columns are carried by `redact` and
ignored by `find`."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm._shared import materialize

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
FORMS = {
    # a local part starts where its run does, or where the match before ended
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"  # a token with a digit or an at sign


@dataclass(frozen=True)
class Bootstrap:
    """Rounds of scoring; different seeds a pattern needs; confidence it needs to discover."""

    rounds: int = 3
    support: int = 5
    confidence: float = 0.8


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that texts without any match fail."""
    return text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255
        return F.forall(F.split(m, r"\."), small)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    turned = F.reverse(digits)
    worth = lambda i: (lambda d: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))(F.substring(turned, i + 1, F.lit(1)).cast("int"))
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def _looks(kind: str, m: Column) -> Column:
    """Whether a token could be an identifier of the kind, in a form of its own."""
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    other = F.length(F.regexp_replace(m, r"[0-9 ().+/-]", ""))
    if kind == "email":
        return m.rlike("^[^@]+@[^@]+$")
    if kind == "ip":
        return m.rlike(r"^[0-9]{1,3}([.,:_][0-9]{1,3}){3}$")
    return (digits.between(12, 19) if kind == "card" else digits.between(7, 15)) & (other == 0)


def _pieces(text: Column, form: str, there: Column) -> Column:
    """Of each match: gap (code points since the match before), body, left and right (what stands around it)."""
    none = F.array().cast("array<string>")
    gaps = F.when(there, F.split(text, form, -1)).otherwise(none)
    bodies = F.when(there, F.regexp_extract_all(text, F.lit(form), F.lit(0))).otherwise(none)
    around = F.transform(gaps, lambda g: F.struct(F.char_length(g).alias("gap"), F.right(g, F.lit(64)).alias("left"), F.left(g, F.lit(32)).alias("right")))
    return F.struct(bodies.alias("bodies"), around.alias("around"))


def _scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash and the pieces of each form and of tokens."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    text = F.col("text")
    forms = {k: (FORMS[k], _hint(k, text)) for k in KINDS} | {"token": (TOKEN, text.rlike("[0-9@]"))}
    found = plain.select("doc_id", "text_hash", *(_pieces(text, f, there).alias(k) for k, (f, there) in forms.items()))
    some = reduce(lambda a, b: a | b, (F.size(f"{k}.bodies") > 0 for k in forms))
    return found.select("doc_id", "text_hash", *(F.when(some, F.col(k)).alias(k) for k in forms))


def _occurrences(scan: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, start, end, body, left, right) of each match, before any test."""
    texts = scan.where("email is not null").dropDuplicates(["doc_id", "text_hash"])
    kinds = (*KINDS, "token")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}.bodies").alias("bodies"), F.col(f"{k}.around").alias("around")) for k in kinds)))
    rows = texts.select("doc_id", "text_hash", each.alias("e")).select("doc_id", "text_hash", "e.kind", "e.bodies", "e.around").where(F.size("bodies") > 0)
    zipped = F.arrays_zip(F.col("bodies").alias("body"), F.col("around").alias("here"), F.slice("around", F.lit(2), F.size("bodies")).alias("next"))
    rows = rows.select("doc_id", "text_hash", "kind", F.posexplode(zipped).alias("i", "m")).where("m.body is not null")
    so_far = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.here.gap") + F.char_length("m.body")).over(so_far)
    return rows.select("doc_id", "text_hash", "kind", (end - F.char_length("m.body")).alias("start"), end.alias("end"), F.col("m.body").alias("body"), F.col("m.here.left").alias("left"), F.col("m.next.right").alias("right"))


def _patterns(rows: DataFrame) -> DataFrame:
    """rows with their patterns: the two words before, and the words on both sides; digits are alike."""
    word = lambda c, form: F.regexp_replace(F.lower(F.regexp_extract(c, form, 1)), "[0-9]", "0")
    two = word(F.col("left"), r"(\S++\s++\S++)\s*$")
    one, after = word(F.col("left"), r"(\S++)\s*$"), word(F.col("right"), r"^\s*+(\S++)")
    some = F.array(F.when(two != "", F.concat(F.lit("before "), two)), F.when((one != "") & (after != ""), F.concat(F.lit("between "), one, F.lit(" "), after)))
    return rows.withColumn("pattern", F.explode(F.array_compact(some)))


def _discovered(marked: DataFrame, how: Bootstrap) -> DataFrame:
    """(doc_id, text_hash, kind, start, end) that high-confidence patterns add to the base spans."""
    base = marked.where("is_base")
    core = F.regexp_extract("body", r"""^[\["'(<{]*+(.*?)[\].,;:!?"')>}]*$""", 1)
    lead = F.char_length("body") - F.char_length(F.regexp_replace("body", r"""^[\["'(<{]++""", ""))
    token = marked.where("kind = 'token'").withColumn("core", core).withColumn("start", F.col("start") + lead).withColumn("end", F.col("start") + F.char_length("core"))
    token = token.withColumn("body", F.col("core")).drop("core").where(reduce(lambda a, b: a | b, (_looks(k, F.col("body")) for k in KINDS)))
    # tokens that touch a base span are no candidates
    both = base.unionByName(token)
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    before = F.max(F.when(F.col("is_base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("is_base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = both.withColumn("before", before).withColumn("after", after)
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    both = materialize(_patterns(both.where(F.col("is_base") | free).drop("before", "after").withColumn("instance", F.lower("body"))), "contexts")

    graph = both.select("pattern", "instance").distinct()
    wide = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    graph = materialize(graph.join(wide, "pattern"), "graph")
    seeds = both.where("is_base").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    scores, strong = seeds, None
    for _ in range(how.rounds):
        held = graph.join(scores, "instance").groupBy("pattern", "kind", "n").agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= 0.99).alias("support"))
        strong = held.where(F.col("support") >= how.support).select("pattern", "kind", (F.col("mass") / (F.col("n") + 0.5)).alias("confidence"))
        strong = materialize(strong.where("confidence >= 0.5"), "patterns")
        # an instance is as sure as its patterns together; seeds stay sure
        raised = graph.select("pattern", "instance").join(strong, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"))
        scores = materialize(raised.join(seeds.select("instance", "kind"), ["instance", "kind"], "left_anti").unionByName(seeds), "scores")
    found = both.where("not is_base").drop("kind").join(strong.where(F.col("confidence") >= how.confidence), "pattern")
    fits = reduce(lambda a, b: a | b, ((F.col("kind") == k) & _looks(k, F.col("body")) for k in KINDS))
    best = found.where(fits).groupBy("doc_id", "text_hash", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    return best.select("doc_id", "text_hash", F.col("b.kind").alias("kind"), "start", "end")


def spans_of(docs: DataFrame, how: Bootstrap | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, text_hash) of docs, spans (doc_id, text_hash, kind, start, end, is_base))."""
    how = how or Bootstrap()
    scan = materialize(_scan(docs), "scan")
    rows = _occurrences(scan)
    passes = reduce(lambda a, b: a | b, ((F.col("kind") == k) & _passes(k, F.col("body")) for k in KINDS))
    marked = materialize(rows.withColumn("is_base", passes).where("is_base or kind = 'token'"), "occurrences")
    base = marked.where("is_base").select("doc_id", "text_hash", "kind", "start", "end", "is_base")
    return scan.select("doc_id", "text_hash"), base.unionByName(_discovered(marked, how).withColumn("is_base", F.lit(False)))


def _by_text(spans: DataFrame) -> DataFrame:
    number = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i))), F.col("kind"))
    one = F.struct("start", number.alias("k"), "end", "kind", "is_base")
    return spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(one)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, how: Bootstrap | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_found for each row of docs; counts are of base spans."""
    rows, spans = spans_of(docs, how)
    got = _by_text(spans)
    j = rows.join(got.hint("merge"), [rows["doc_id"].eqNullSafe(got["doc_id"]), rows["text_hash"] == got["text_hash"]], "left")
    found = F.coalesce(F.col("found"), F.array().cast(got.schema["found"].dataType))
    base = F.filter(found, lambda s: s["is_base"])
    of = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return j.select(rows["doc_id"], *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(found).alias("spans"), F.size(F.filter(found, lambda s: ~s["is_base"])).alias("n_found"))


def redact(docs: DataFrame, how: Bootstrap | None = None) -> DataFrame:
    """docs with every span of `text` replaced by its kind in brackets, and n_chars, if there, set anew."""
    _, spans = spans_of(docs, how)
    got = _by_text(spans).select(F.col("doc_id").alias("__sv_id"), F.col("text_hash").alias("__sv_h"), F.col("found").alias("__sv_found"))
    own = docs.columns
    rows = docs.withColumn("__sv_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    j = rows.join(got, [rows["doc_id"].eqNullSafe(got["__sv_id"]), rows["__sv_hash"] == got["__sv_h"]], "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        part = F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(free, F.concat(acc["out"], part, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.char_length("text")))
    text = F.when(F.col("__sv_found").isNull(), F.col("text")).otherwise(F.aggregate("__sv_found", start, step, rest))
    j = j.withColumn("text", text)
    if "n_chars" in own:
        j = j.withColumn("n_chars", F.when(F.col("__sv_found").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return j.select(*own)
