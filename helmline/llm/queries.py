"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helmline.llm import (
    bpe, exact, hard_negatives, html_text, mixing, neighbours, phrases, pii, quality, simhash, suffixes, toxicity, whitening)
from helmline.llm.common import sha256_hex, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and the bytes they decode to, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), decoded="decoded").select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        sha256_hex(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"))


def op2_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that recur from documents with smaller ids, removed."""
    return phrases.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", sha256_hex(F.col("kept")).alias("kept_sha256"))


def op3_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that recur from documents with smaller ids, removed."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", sha256_hex(F.col("kept")).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by a model of the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).select(
        "page_id", F.length("text").cast("bigint").alias("n_chars"), sha256_hex(F.col("text")).alias("text_sha256"), "text")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, sampling probability and draw of every document."""
    return mixing.probabilities(table(spark, sf_dir, "documents"))


def op9_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), out="found").select("doc_id", "found")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(count(k.name) for k in pii.KINDS if k.base),
        sha256_hex(pii.listed(F.filter("found", lambda s: s.base))).alias("base_sha256"), pii.listed(F.col("found")).alias("spans"))


def op11_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return exact.deduplicate(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", hard_negatives.relabelled(F.col("label"), F.col("vec_id")))
    return hard_negatives.mine(rows, F.pmod("id", F.lit(50)) == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_repeated_phrases": op2_repeated_phrases,
    "op3_suffix_arrays": op3_suffix_arrays,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_html_text": op7_html_text,
    "op8_source_mixing": op8_source_mixing,
    "op9_vector_duplicates": op9_vector_duplicates,
    "op10_pii": op10_pii,
    "op11_exact_groups": op11_exact_groups,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op11_exact_groups": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op12_hard_negatives": """
        WITH sound AS (
            SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        scored AS (
            SELECT a.no AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, b.label = a.label AS same,
                   list_inner_product(a.v, b.v)::BIGINT AS score
            FROM sound a JOIN sound b ON a.vec_id % 50 = 0 AND a.no <> b.no AND len(a.v) = len(b.v)),
        positives AS (
            SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM scored WHERE same),
        negatives AS (
            SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.id) AS rank
            FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
             AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
            WHERE p.place <= 5)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
        FROM negatives WHERE rank <= 3""",
}
