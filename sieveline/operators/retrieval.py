"""Evidence retrieval: chunks, dense and lexical top-k, answers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import normalize as N

IMPORTANT = ("business_name", "address", "phone", "email", "website", "working_hours", "rating", "review_count", "license_information", "services", "specialties")


def index(docs: DataFrame, text: str = "text", size: int = 800, overlap: int = 120, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs with `chunk_id` and `chunk` for each window of the text, and `embedding` if a function gives it."""
    rows = docs.select("*", F.posexplode(N.chunks(F.col(text), size, overlap)).alias("chunk_id", "chunk"))
    return rows.withColumn("embedding", embed(F.col("chunk"))) if embed else rows


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; a zero vector has the norm 1e-8."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: (lambda n: F.when(n == 0, 1e-8).otherwise(n))(F.sqrt(dot(x, x)))
    return dot(a, b) / (norm(a) * norm(b))


def dense_top(vectors: DataFrame, query: list[float] | DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """The k nearest vectors to one, given as numbers or as a table of one row with `embedding`; a per-partition top-k precedes the merge, so k rows a task move."""
    q = F.col("_query") if isinstance(query, DataFrame) else F.array(*map(F.lit, map(float, query)))
    if isinstance(query, DataFrame):
        vectors = vectors.crossJoin(F.broadcast(query.select(F.col("embedding").alias("_query"))))
    return vectors.withColumn("score", F.round(cosine(F.col("embedding"), q), 4)).orderBy(F.desc("score"), key).limit(k).drop("_query")


def lexical_score(question: Column, chunk: Column) -> Column:
    a = N.terms(question)
    return _overlap_score(F.size(F.array_intersect(a, N.terms(chunk))), F.size(a))


def _overlap_score(both: Column, asked: Column) -> Column:
    score = both / F.greatest(asked, F.lit(1)) + F.least(both, F.lit(6)) * 0.05
    return F.when(both > 0, F.round(score, 6)).otherwise(0.0)


def lexical_top(chunks: DataFrame, question: str, k: int, order: str = "chunk_id") -> DataFrame:
    """The k best chunks, later ones first among equals; all chunks score 0 where no word is shared."""
    words = [w for w in dict.fromkeys(re.findall("[a-z0-9]{2,}", question.lower())) if w not in N.STOP_WORDS]
    # only the question's words are taken from a chunk
    form = f"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"
    both = F.size(F.array_distinct(F.regexp_extract_all(F.lower(N.filled(F.col("chunk"))), F.lit(form), F.lit(0)))) if words else F.lit(0)
    return chunks.withColumn("score", _overlap_score(both, F.lit(len(words)))).orderBy(F.desc("score"), F.desc(order)).limit(k)


def answer_line(chunk: Column) -> Column:
    return F.substring(N.spaced(chunk), 1, 350)


def answer(dense: DataFrame | None, lexical: DataFrame) -> DataFrame:
    """(text, sources, retrieval_mode): dense hits if there are any, else lexical ones; five chunks of 350 characters."""
    hits = lexical.select("chunk", "source", "score").withColumn("mode", F.lit("lexical"))
    if dense is not None:
        d = dense.select("chunk", "source", "score").withColumn("mode", F.lit("dense"))
        hits = d.unionByName(hits)
    rank = F.row_number().over(Window.orderBy("mode", F.desc("score"), "source", "chunk"))
    best = hits.withColumn("r", rank).where("r <= 5")  # top-k inputs only
    first = F.min_by("mode", "r")
    rows = best.agg(F.sort_array(F.collect_list(F.struct("r", "mode", "chunk", "source"))).alias("h"), first.alias("retrieval_mode"))
    own = F.filter("h", lambda x: x["mode"] == F.col("retrieval_mode"))
    return rows.select(F.array_join(F.transform(own, lambda x: answer_line(x["chunk"])), "\n").alias("answer"), F.array_distinct(F.transform(own, lambda x: x["source"])).alias("sources"), "retrieval_mode")


def generate(context: str, question: str, *backends: Callable[[str, str], str | None]) -> str:
    """The first backend's answer, else the context: hosted, local and plain in turn. A backend that fails gives way."""
    for backend in backends:
        try:
            if text := backend(context, question):
                return text
        except (OSError, ValueError, TimeoutError):
            continue
    return context


def evidence_top(evidence: DataFrame, limit: int = 40, fields: tuple[str, ...] = IMPORTANT) -> DataFrame:
    """The most trusted evidence of important fields, filled values first, ties by order."""
    rows = evidence.where(F.col("field").isin(*fields)).withColumn("reliability", F.round("reliability", 3))
    return rows.orderBy(F.desc("reliability"), F.desc(N.filled(F.col("value")) != ""), "entity_id", "ord", "field").limit(limit)


def summary(query: str, n_entities: Column, n_verified: Column) -> Column:
    return F.format_string("Found %d distinct businesses for %s; %d have a field verified at medium or high level. Only retrieved public evidence is used, and conflicts are shown.", n_entities, F.lit(query), n_verified)
