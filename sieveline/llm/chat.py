"""Conversations formatted for training, in DataFrame and SQL expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into a block, whose
texts are joined inside the marks of the role; blocks are joined into one string. Marks that occur inside texts or role
names are escaped by a backslash after their bracket, so the turns can be read back exactly. The loss mask is a list of
spans, one for each assistant turn, in bytes of the UTF-8 string: bytes, as a span of them is cut out in the time of its
length. Spans are sums of the lengths before them, taken in two levels (sums of runs of turns, then inside a run), so that
a conversation of n turns costs n * sqrt(n) additions and everything else is linear in its text.

Defined results: a null text or role is the empty one; turns of equal number are ordered by role, then text; a null turn
number comes first; equal rows are turns each; a row without conv_id belongs to no conversation and is formatted alone; an empty
table gives an empty result; other columns are ignored, whatever their names. A conversation must fit a Spark string (2 GB)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "turns array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Template:
    """Marks of roles as (role, before, after); of any other role, with its name; between merged texts; before a conversation.
    Marks are bracketed words without spaces or brackets inside: `word` after `<` or `[`, with or without a slash."""

    roles: tuple[tuple[str, str, str], ...] = (("system", "[SYS] ", " [/SYS]"), ("user", "[INST] ", " [/INST]"), ("assistant", " ", "</s>"))
    other: tuple[str, str] = ("[ROLE] ", " [/ROLE]")
    between: str = "[SEP]"
    begin: str = "<s>"
    angle: tuple[str, ...] = ("s>",)
    square: tuple[str, ...] = ("INST]", "SYS]", "ROLE]", "SEP]")
    trained: str = "assistant"

    def mark(self, bracket: str, words: tuple[str, ...]) -> str:
        return rf"(?<={bracket})%s(?=\\*+/?(?:{'|'.join(re.escape(w) for w in words)}))"

    def marks(self, escaped: bool) -> str:
        """The place after the bracket of each mark, with the backslash that escapes it or without one."""
        slash = r"\\" if escaped else ""
        return "|".join(self.mark(b, w) % slash for b, w in (("<", self.angle), (r"\[", self.square)))


def escape(text: Column, template: Template = Template()) -> Column:
    return F.regexp_replace(text, template.marks(False), r"\\")


def unescape(text: Column, template: Template = Template()) -> Column:
    return F.regexp_replace(text, template.marks(True), "")


def collected(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order. Rows without conv_id stay where they are, one turn each."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    flat = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    grouped = flat.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.unionByName(flat.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))


def _sums_before(lengths: Column) -> Column:
    """Of each element the sum of those before it."""
    n = F.size(lengths)
    wide = F.ceil(F.sqrt(n)).cast("int")
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    runs = F.transform(F.sequence(F.lit(0), F.ceil(n / wide).cast("int") - 1), lambda r: total(F.slice(lengths, r * wide + 1, wide)))
    before = F.transform(runs, lambda _, r: total(F.slice(runs, F.lit(1), r)))
    return F.flatten(F.transform(before, lambda base, r: F.transform(F.slice(lengths, r * wide + 1, wide), lambda _, i: base + total(F.slice(lengths, r * wide + 1, i)))))


def _marks(role: Column, template: Template, after: bool) -> Column:
    fixed = {r: (before, end) for r, before, end in template.roles}
    head = F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.between))
    out = F.lit(template.other[1]) if after else head
    for r, pair in fixed.items():
        out = F.when(role == r, F.lit(pair[after])).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, loss_spans): rows are (conv_id, turn, role, text). Spans are (start, end) in bytes, end exclusive."""
    turns = F.col("turns")
    role_at = lambda i: F.element_at(turns, i + 1).getField("role")
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    starts = collected(rows).select("conv_id", "turns", F.filter(places, lambda i: F.when(i == 0, True).otherwise(role_at(i) != role_at(F.greatest(i, F.lit(1)) - 1))).alias("starts"))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("turns")))
    run = lambda r: F.struct(role_at(r["s"]).alias("role"), F.transform(F.slice(turns, r["s"] + 1, r["e"] - r["s"]), lambda t: escape(t["text"], template)).alias("texts"))
    merged = starts.select("conv_id", F.transform(F.arrays_zip(F.col("starts").alias("s"), ends.alias("e")), run).alias("runs"))
    block = lambda r: F.struct(r["role"].alias("role"), r["texts"].alias("texts"), _marks(r["role"], template, False).alias("head"), _marks(r["role"], template, True).alias("tail"))
    blocks = merged.select("conv_id", F.transform("runs", block).alias("blocks"))
    # a piece is a text with the marks before and after it
    last = lambda b, i: i == F.size(b["texts"]) - 1
    piece = lambda b: F.transform(b["texts"], lambda t, i: F.struct((b["role"] == template.trained).alias("loss"), F.when(i == 0, b["head"]).otherwise(F.lit(template.between)).alias("head"), t.alias("text"), F.when(last(b, i), b["tail"]).otherwise("").alias("tail")))
    pieces = blocks.select("conv_id", F.flatten(F.transform("blocks", piece)).alias("pieces"))
    long = lambda p: (F.octet_length(p["head"]) + F.octet_length(p["text"]) + F.octet_length(p["tail"])).cast("long")
    sized = pieces.select("conv_id", "pieces", F.transform("pieces", long).alias("lengths"))
    placed = sized.select("conv_id", "pieces", _sums_before(F.col("lengths")).alias("at"))
    start = lambda z: z["at"] + len(template.begin.encode()) + F.octet_length(z["p"]["head"])
    spans = F.transform(F.filter(F.arrays_zip(F.col("pieces").alias("p"), F.col("at").alias("at")), lambda z: z["p"]["loss"]), lambda z: F.struct(start(z).alias("start"), (start(z) + F.octet_length(z["p"]["text"])).alias("end")))
    whole = F.concat(F.lit(template.begin), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), ""))
    return placed.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turns, trained, formatted): the turns (role, text) and the texts under the loss mask, from the string and its spans alone."""
    kinds = [(None, *template.other), *template.roles]
    body = "|".join(f"{re.escape(before)}.*?{re.escape(after)}" for _, before, after in kinds)
    found = formatted.select("*", F.encode("formatted", "UTF-8").alias("raw"), F.regexp_extract_all("formatted", F.lit(f"(?s){body}"), F.lit(0)).alias("found"))

    def parse(b: Column) -> Column:
        inner = lambda before, after: F.split(F.substring(b, F.lit(len(before) + 1), F.char_length(b) - len(before) - len(after)), re.escape(template.between), -1)
        named = inner(*template.other)
        out = F.struct(unescape(named[0], template).alias("role"), F.slice(named, F.lit(2), F.size(named)).alias("texts"))
        for role, before, after in template.roles:
            out = F.when(b.startswith(before), F.struct(F.lit(role).alias("role"), inner(before, after).alias("texts"))).otherwise(out)
        return out

    blocks = found.select("*", F.transform("found", parse).alias("blocks"))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t, template).alias("text")))))
    trained = F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(F.col("raw"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8"), template))
    return blocks.select("conv_id", turns.alias("turns"), trained.alias("trained"), "formatted")


def digests(read: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = read.select("*", F.array_join("trained", "").alias("loss"))
    return loss.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The turns as they lie in the table, and the string's length from the marks of the default template.
ORACLE_SQL = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
                  regexp_replace(regexp_replace(text, '(<)(\\*/?s>)', '\1\\\2', 'g'), '(\[)(\\*/?(INST|SYS|ROLE|SEP)\])', '\1\\\2', 'g') AS kept
           FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sized AS (SELECT *, length(kept) + CASE WHEN NOT opens THEN 5 WHEN role = 'system' THEN 6 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 1 ELSE 12 + length(role) END
                 + CASE WHEN NOT closes THEN 0 WHEN role = 'system' THEN 7 WHEN role = 'user' THEN 8 WHEN role = 'assistant' THEN 4 ELSE 8 END AS long FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(long) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
