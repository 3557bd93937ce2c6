"""A training corpus from documents: quality, near-duplicates, personal data, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last
return the columns of documents:

- quality: texts the classifier rejects go;
- near_dedup: of each group of near-duplicates (five words, similarity of 0.8) one text stays;
- pii: spans of personal data become their kind in brackets;
- mixing: a row for each text and pass of the mixture, holding the words taken;
- packing: pieces of at most 2048 tokens with their ids, sequence and offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import mixing, neardup, packing, pii, quality
from sieveline.llm._shared import ensure_workers, materialize
from sieveline.llm.registry import tokenizer_path

CUT = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), cut=CUT)
    return docs.where(quality.scorer(spark, model)(F.col("text")) >= CUT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, size=5, numerator=80, denominator=100)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), capacity=2048)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but the redaction can be said in SQL: models, registers, permutations and bins are not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next."""
    ensure_workers(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
