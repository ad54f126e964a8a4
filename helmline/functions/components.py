"""Connected groups of a link table, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmline.plans.stage import stage


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group): the smallest node reachable from each node that has a link to another one.

    Two turns a round, each of them an aggregate and a join: first every larger neighbour of a node moves to
    the smallest one, then the smaller ones do. A round is written; rounds grow with the logarithm of the
    longest path, and without links there is none. Null ends and links of a node to itself say nothing.
    """
    big, small = F.greatest(a, b).alias("big"), F.least(a, b).alias("small")
    edges = stage(links.where(F.col(a) != F.col(b)).select(big, small).distinct(), "links")
    before, now = None, _mark(edges)
    while now != before and now[0]:
        both = edges.select(F.col("big").alias("u"), F.col("small").alias("v")).unionByName(
            edges.select(F.col("small").alias("u"), F.col("big").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = stage(both.where("v > u").join(low, "u").select(
            F.col("v").alias("big"), F.col("m").alias("small")).distinct(), "links")
        low = far.groupBy("big").agg(F.min("small").alias("m"))
        near = far.join(low, "big").select(F.explode(F.array(
            F.struct("big", F.col("m").alias("small")),
            F.struct(F.col("small").alias("big"), F.col("m").alias("small")))).alias("e"))
        edges = stage(near.select("e.*").where("big > small").distinct(), "links")
        before, now = now, _mark(edges)
    return edges.select(F.col("big").alias("node"), F.col("small").alias("group")).unionByName(
        edges.select(F.col("small").alias("node"), F.col("small").alias("group")).distinct())


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first())
