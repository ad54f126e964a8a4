"""Connected components of a link table by min-parent hooking and pointer jumping, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helmline.llm.common import staged


def _with_parent(edges: DataFrame, key: str) -> DataFrame:
    """edges with `least`: the smallest parent of edges[key], or null for a root.

    The join is on a hash and the id, so that both sides are dealt out for it alone and Spark may split the
    rows of a hub; the smallest parents are aggregated before they move.
    """
    least = edges.groupBy("child").agg(F.min("parent").alias("least")).select(
        F.col("child").alias("node"), F.xxhash64("child").alias("node_hash"), "least")
    keyed = edges.withColumn("key_hash", F.xxhash64(key))
    return keyed.join(least, (keyed.key_hash == least.node_hash) & (keyed[key] == least.node), "left").select(
        "child", "parent", "least")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link to another one.

    links: two bigint columns; direction, repeats, self links and nulls do not matter. Nodes without a link to
    another node are not in the result. Each round joins every child to its smallest parent and that one's
    parents to each other, then replaces parents by grandparents; the number of rounds is logarithmic in the
    longest path. A round is written to the shared folder.
    """
    edges = staged(
        links.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    before = None
    while True:
        hooked = _with_parent(edges, "child").select(F.explode(F.array(
            F.struct("child", F.col("least").alias("parent")),
            F.struct(F.col("parent").alias("child"), F.col("least").alias("parent")),
        )).alias("e")).select("e.child", "e.parent").where("child > parent").distinct()
        edges = staged(
            _with_parent(staged(hooked), "parent")
            .select("child", F.coalesce("least", "parent").alias("parent")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(
        edges.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct())
