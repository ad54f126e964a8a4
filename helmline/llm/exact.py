"""Exact dedup by skew-safe combining: locally, then per salt, then over all salts, in built-in functions only.

A text is grouped by its SHA-256 digest and its whole content. The first aggregate runs inside each task before
anything moves (one row per text and task) and meets others of the same salt; a salt is a share of the tasks, so that a
text which fills a third of the table is some rows for each salt and not a row for each copy. The second aggregate
combines the salt winners of a text. Whole contents are the grouping keys of both, so texts that share a digest without
being equal stay apart. What has to find its way back to the single rows is the digest alone wherever one content owns
the digest; rows of a digest with several contents are matched by content again. The way back is salted by row: the
classes are handed to the (digest, salt) pairs that exist, and the pairs to the rows.

Equal means identical bytes after null has become the empty text; nothing else is changed. The largest id of a group
names it and null ids come last: a group of null ids only has a null `keep_id`. Of repeated rows with the winning id one
row stays. Every row comes out once, dropped or not, with `kept`. Very long texts are keys like any other. Other columns
are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from helmline.llm.common import shuffle_partitions, staged


def salts_for(partitions: int) -> int:
    """Salts so that the rows of one salt and the salts of one text both number about the root of the tasks."""
    return max(4, isqrt(partitions) + 1)


def groups(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, text, keep_id, group_size) of each distinct content of rows (id, digest, text)."""
    local = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = local.groupBy("digest", "salt", "text").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    return merged.groupBy("digest", "text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))


def handed_back(keys: DataFrame, classes: DataFrame, by: list[str], salts: int) -> DataFrame:
    """keys (id, row, *by) with keep_id, group_size and kept from their class in classes (*by, keep_id, group_size).

    Rows are counted into the pairs of class and salt that exist before the classes meet them, so a class is spread
    over no more salts than it has rows. The pairs are written: which of several rows with the winning id stays is
    decided once.
    """
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    best = salted.groupBy(*by, "salt").agg(
        F.max("id").alias("top"), F.max_by("row", "id").alias("at"), F.min("row").alias("first"))
    own = Window.partitionBy(*by)
    pairs = best.select(
        *(F.col(c).alias(f"own_{c}") for c in by), F.col("salt").alias("own_salt"),
        F.coalesce(F.max_by("at", "top").over(own), F.min("first").over(own)).alias("winner"))
    named = staged(classes.join(pairs, [classes[c] == pairs[f"own_{c}"] for c in by]).drop(*by))
    met = [salted[c] == named[f"own_{c}"] for c in (*by, "salt")]
    return salted.join(named, met).select(
        "id", *by, "keep_id", "group_size", (F.col("row") == F.col("winner")).alias("kept"))


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of df.

    digest: what texts are grouped by, SHA-256 if not given. Any function of the text is right; a weak one costs time.
    """
    salts = salts_for(shuffle_partitions(df.sparkSession))
    held = df.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    sha = F.unhex(F.sha2("text", 256))
    rows = held.withColumn("digest", digest(F.col("text")) if digest else sha)
    found = groups(rows, salts)
    per_digest = staged(found.groupBy("digest").agg(
        F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))
    sole = per_digest.where("contents = 1").drop("contents")
    keys = staged(rows.select("id", "digest", F.monotonically_increasing_id().alias("row"), *([sha.alias("sha")] if digest else [])))
    names = [F.col("id").alias("doc_id"), "keep_id", "group_size", "kept"]
    by = ["digest", "sha"] if digest else ["digest"]
    if digest:
        # The content's own digest is only carried along here: classes of a sole content have one.
        sole = sole.join(keys.groupBy("digest").agg(F.min("sha").alias("sha")), "digest")
    out = handed_back(keys, sole, by, salts).select(*names, F.lower(F.hex(by[-1])).alias("text_sha256"))
    shared = per_digest.where("contents > 1").select("digest")
    if shared.isEmpty():
        return out
    apart = staged(rows.join(shared, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()))
    several = handed_back(apart, groups(apart, salts), ["digest", "text"], salts)
    return out.unionByName(several.select(*names, F.sha2("text", 256).alias("text_sha256")))
