"""Corpus work: survey of sessions, sealing, sampling and the deterministic split."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmline.functions.ordered import RECORD_BLOCK, Run, block_of, dense_seq, running


def survey(features: DataFrame) -> DataFrame:
    """What each session holds: records, operator turns, actions, write targets, interrupts."""
    return features.groupBy("stream_id").agg(
        F.count("*").alias("records"), F.count_if("is_op").alias("operator_turns"),
        F.sum("action_count").alias("actions"), F.sum(F.size("write_paths")).alias("write_actions"),
        F.count_if("is_interrupt").alias("interrupts"))


def skip_reason(parent: Column, n_bytes: Column, quiet_s: Column, turns: Column, *, max_bytes=0,
                quiet_for=0, min_turns=0) -> Column:
    """First bound a session fails: sub-agent, size, recent write, too few operator turns."""
    out = F.when(parent.isNotNull() & (parent != ""), "subagent")
    if max_bytes > 0:
        out = out.when(n_bytes > max_bytes, "too_large")
    if quiet_for > 0:
        out = out.when(quiet_s < quiet_for, "recent")
    return out.when(turns < min_turns, "too_few_turns").otherwise("")


def roll_up(stats: DataFrame, *by: str) -> DataFrame:
    return stats.groupBy(*by).agg(
        F.count("*").alias("sessions"), F.sum("operator_turns").alias("operator_turns"),
        F.sum("actions").alias("actions"), F.count_distinct("project").alias("projects"))


def sampled(turn_id: Column, per_mille: int) -> Column:
    """Hash sample of turns: the same turns every time, chosen by nothing the rules decided."""
    if per_mille <= 0:
        return F.lit(True)
    n = F.conv(F.substring(F.sha2(turn_id, 256), 1, 8), 16, 10).cast("long")
    return n % 1000 < per_mille


def hash_order(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def assign_split(candidates: DataFrame, prior: DataFrame | None = None, per_project: int = 0) -> DataFrame:
    """Deal sessions alternately to dev and holdout, per project in hash order.

    The hash is uniform, so its leading digits cut a project of any size into equal blocks. Sessions
    of `prior` (id, project, split) keep their side, and unseen prior sessions stay. An id under several
    projects is dealt once, under the first of them by name.
    """
    d = candidates.groupBy("id").agg(F.min("project").alias("project")).withColumn("h", hash_order(F.col("id")))
    block = F.conv(F.substring("h", 1, 3), 16, 10).cast("long")
    d = running(d, ["project"], ["h", "id"], block, {"nth": Run("sum", F.lit(1).cast("long"))})
    if per_project > 0:
        d = d.where(F.col("nth") <= per_project)
    odd = F.conv(F.substring(hash_order(F.col("project")), 16, 1), 16, 10).cast("long") % 2
    d = d.withColumn("dealt", F.when((odd + F.col("nth") - 1) % 2 == 1, "holdout").otherwise("dev"))
    if prior is None:
        return d.select("id", "project", F.col("dealt").alias("split"))
    p = prior.select("id", F.col("split").alias("kept"))
    mine = d.join(p, "id", "left").select(
        "id", "project", F.coalesce("kept", "dealt").alias("split"))
    rest = prior.join(mine.select("id"), "id", "left_anti").select("id", "project", "split")
    return mine.unionByName(rest)


def drop_sealed(candidates: DataFrame, sealed: DataFrame) -> DataFrame:
    """Candidates whose content is not already in the corpus."""
    return candidates.join(sealed.select("sha256").distinct(), "sha256", "left_anti")


def broken_seals(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions whose recomputed hash differs from the sealed one, or whose file is gone."""
    now = files.select("id", F.col("sha256").alias("actual"))
    return manifest.join(now, "id", "left").where(~F.col("sha256").eqNullSafe(F.col("actual"))).select(
        "id", F.col("sha256").alias("sealed"), "actual")


def newest(sessions: DataFrame, per_project: int = 3, limit: int = 15) -> DataFrame:
    """Report: newest per root, then newest overall. Row counts shrink before the last sort."""
    by = [F.col("modified").desc(), F.col("id").asc()]
    salted = sessions.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    local = salted.withColumn("n", F.row_number().over(
        Window.partitionBy("root", "__salt").orderBy(*by))).where(F.col("n") <= per_project)
    top = local.withColumn("n", F.row_number().over(
        Window.partitionBy("root").orderBy(*by))).where(F.col("n") <= per_project)
    return top.drop("n", "__salt").orderBy(*by).limit(limit)


def content_hash(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Content hash per key, of one form at every size: it tells changed, moved, lost and added rows.

    Each row is hashed with its place; the digests are folded lane by lane with exclusive or, which needs no order
    and is combined before the shuffle, so a key may have any number of rows. A null text counts as an empty one.
    """
    h = F.sha2(F.concat(F.col(order).cast("string"), F.lit("\x00"), F.coalesce(F.col(text), F.lit(""))), 256)
    lanes = [f"lane{i}" for i in range(4)]
    d = lines.select(key, h.alias("h")).select(
        key, *[F.conv(F.substring("h", 16 * i + 1, 15), 16, 10).cast("long").alias(n) for i, n in enumerate(lanes)])
    folded = d.groupBy(key).agg(F.count("*").alias("n"), *[F.bit_xor(n).alias(n) for n in lanes])
    return folded.select(key, F.sha2(F.concat_ws(":", "n", *lanes), 256).alias("sha256"))


def _sha256_of_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One key's rows by file and place, batch by batch."""
    h, key, name = hashlib.sha256(), None, None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.name != name:
                h.update(row.name.encode() + b"\x00")
            key, name = row.key, row.name
            h.update(row.bytes)
    yield pd.DataFrame({"key": [key], "sha256": [h.hexdigest()]})


def file_digest(lines: DataFrame, key: str, name: str, order: str, text: str) -> DataFrame:
    """SHA-256 per key of its files by name: each name, a NUL, and the file's bytes.

    lines: one row per line, its ending included; a null text adds no bytes, so such a row stands for an empty
    file. A null name is an empty one; rows without a key are left out. The digest is one chain over all bytes, so
    a key is one task, which holds a batch of its rows at a time; `tree_digest` has no such chain.
    """
    d = lines.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.coalesce(F.col(name), F.lit("")).alias("name"), F.col(order).alias("place"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    ordered = d.repartition("key").sortWithinPartitions("key", "name", "place", "bytes")
    return ordered.groupBy("key").applyInPandas(_sha256_of_files, "key string, sha256 string").withColumnRenamed("key", key)


#: Children of a node of the tree, and its levels: places for 4096 ** 4 rows of a key.
TREE_ROWS, TREE_LEVELS = 4096, 4


def tree_digest(lines: DataFrame, key: str, order: str, text: str, rows: int = TREE_ROWS) -> DataFrame:
    """Ordered digest per key without a chain over its rows: SHA-256 of the SHA-256 of each line, up a tree.

    Lines are ranked by `order`, whole numbers that no two rows of a key share; a null text counts as an empty one.
    Every key has the same levels, so its digest depends on its own rows alone. Rows without a key are left out.
    """
    d = dense_seq(
        lines.where(F.col(key).isNotNull()).select(
            F.col(key).alias("key"), F.col(order).alias("place"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h")),
        ["key"], ["place"], block_of(F.col("place"), RECORD_BLOCK), "at").withColumn("at", F.col("at") - 1)
    for _ in range(TREE_LEVELS):
        d = d.groupBy("key", F.floor(F.col("at") / rows).alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("at", "h"))).alias("below")
        ).select("key", F.col("up").alias("at"), F.sha2(F.array_join(F.transform("below", lambda b: b["h"]), ""), 256).alias("h"))
    return d.select(F.col("key").alias(key), F.col("h").alias("sha256"))
