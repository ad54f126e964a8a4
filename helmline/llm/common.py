"""Helpers that several operators share: input columns, written stages, blocks and small batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helmline.plans.stage import stage

#: Word separators of the operators: space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts the lineage, survives lost executors."""
    return stage(df, "llm")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_count(spark: SparkSession, total_bytes: int, target_bytes: int) -> int:
    """Number of groups so that one holds about target_bytes; two per shuffle partition at least, so that they even out."""
    return max(2 * shuffle_partitions(spark), -(-total_bytes // target_bytes))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one holds about `most` bytes of the given text column (or a single row)."""
    for batch in batches:
        at, held = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)
