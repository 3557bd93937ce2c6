"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import align, chat, lattice, lmscore, media, mixing, neardup, packing, pii, quality, resample, toxicity, urls
from sieveline.llm._shared import ensure_workers


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ensure_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, with_ids=False)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = neardup.near_duplicates(_read(spark, sf_dir, "documents"), size=3, numerator=85, denominator=100)
    return got.select("doc_id", "n_shingles", "component_id", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_read(spark, sf_dir, "documents"), parts=7, test=2, held=6)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_read(spark, sf_dir, "embeddings"), least=0.9)


def held_out(parts: int, held: int) -> Column:
    return ~quality.learns(F.col("doc_id"), parts, held)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, _read(spark, sf_dir, "labels"), cut=0.7).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = lambda field: F.size(F.array_distinct(F.transform("segments", lambda s: s[field]))).cast("long")
    got = mixing.takes(_read(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "source", F.when(F.col("taken") > 0, drawn("shard")).otherwise(0).alias("n_shards"), F.when(F.col("taken") > 0, drawn("slot")).otherwise(0).alias("n_slots"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "digest", "shard", "offset", "length"]
    return media.media_columns(_read(spark, sf_dir, "documents")).select(*cols)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), cut=0.3)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted", "evidence")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), resample.Features(1, 10_000), percent=10, least_words=20, seed=2024)
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = align.align(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a")


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    escaped = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.read_back(chat.format_conversations(turns.unionByName(escaped))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_best_fit_packing, op3_minhash_near_dedup, op4_pii, op5_lm_scoring, op6_embedding_near_dedup, op7_quality_classifier, op8_source_mixing, op9_media_columns, op10_toxicity, op11_importance_resampling, op12_tokenizer_alignment, op13_chat_formatting)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": urls.ORACLE_SQL, "op11_importance_resampling": resample.ORACLE_SQL, "op13_chat_formatting": chat.ORACLE_SQL}
