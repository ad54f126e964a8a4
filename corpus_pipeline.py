"""From raw documents to token ids: toxicity, near-duplicates, personal data, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helmline.llm import bpe, mixing, pii, simhash, toxicity
from helmline.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labelled ones of its own input."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, one without an id only if all are."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    redacted = pii.redact(pii.find(docs.select(*COLUMNS), out="spans"))
    return redacted.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic have their target weights."""
    return mixing.sample(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    ids = bpe.encode(docs, keep=("doc_id", "lang", "source"), also_text=True, decoded="decoded")
    return ids.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("toxicity", toxic_out),
    ("simhash", near_copies_out),
    ("pii", personal_data_out),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: Training, fingerprint links and merges have no SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
