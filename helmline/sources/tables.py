"""Parquet tables as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A plain scan; spread over the cores only when the files have fewer splits than there are cores.

    Text expressions cost far more per byte than a scan. One row group is one task, so a small or badly
    written file would leave the cluster idle; a large table has splits enough and is left alone.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
