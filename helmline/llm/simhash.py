"""SimHash near-duplicates by multi-index hashing.

Fingerprints have 64 bits over the XXH64 hashes of 3-word shingles (ASCII lower case, repeats counted). Two
fingerprints that differ in at most three bits differ in at most one bit in one of their two 32-bit segments.
So each segment has a table; every fingerprint looks up the small Hamming ball around its segment (the value and
the values with one more bit set: of two values one bit apart, one finds the other), and the distance over all 64
bits is verified in the join. Only distinct fingerprints take part: copies are collapsed first and never paired.

Null and empty texts, and texts of separators only, have fingerprint zero and are linked like any other. Texts
of one or two words are one shingle. Repeated rows and repeated ids give one row each; a null id never names a
component, and a component of null ids only has a null one. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, functions as F

from helmline.llm.common import small_batches, staged
from helmline.llm.components import components

SHINGLE = 3
MOST_BITS = 3
SEED = 42


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    of = xxhash.xxh64_intdigest
    last = ends[width - 1:] or ends[-1:]
    hashes = np.array([of(joined[s:e - 1], SEED) for s, e in zip(starts, last)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row. Row by row, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = pa.array([fingerprint(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fp"])

    return df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                     F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): fingerprints of the table (fp, unique) that differ in 1 to 3 bits; a pair may come twice."""
    segments = distinct.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("value")),
        F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("value")),
    )).alias("s")).select("fp", "s.seg", "s.value")
    ball = F.array(F.col("value"), *(F.col("value").bitwiseOR(F.lit(1 << i)) for i in range(32)))
    probes = segments.select("fp", "seg", F.col("value").alias("own"), F.explode(F.array_distinct(ball)).alias("value"))
    other = segments.select(F.col("fp").alias("other"), F.col("seg").alias("other_seg"), F.col("value").alias("held"))
    return probes.join(
        other,
        (probes.seg == other.other_seg) & (probes.value == other.held)
        & ((probes.own != probes.value) | (probes.fp < other.other))
        & (F.bit_count(probes.fp.bitwiseXOR(other.other)) <= MOST_BITS),
    ).select(F.col("fp").alias("a"), F.col("other").alias("b"))


def _classes(docs: DataFrame) -> DataFrame:
    """(class_fp, component, component_id) of each distinct fingerprint of docs (doc_id, fp)."""
    distinct = staged(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct))
    named = distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    named = staged(named)
    least = named.groupBy("component").agg(F.min("first").alias("component_id")).select(
        F.col("component").alias("key"), F.xxhash64("component").alias("key_hash"), "component_id")
    named = named.withColumn("hash", F.xxhash64("component"))
    return named.join(least, (named.hash == least.key_hash) & (named.component == least.key)).select(
        F.col("fp").alias("class_fp"), "component", "component_id")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df for each component of near copies, with all its columns.

    It is the row with the smallest id, nulls last; of several rows with that id, the one with the smallest hash.
    """
    columns = df.columns
    number = next(n for n in (f"row_{k}" for k in range(len(columns) + 1)) if n not in columns)
    own = staged(df.withColumn(number, F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = pa.array([fingerprint(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("doc_id", "row", "mark")] + [found], ["doc_id", "row", "mark", "fp"])

    docs = staged(own.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(number).alias("row"), F.xxhash64(*(F.col(f"`{c}`") for c in columns)).alias("mark"),
        F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, row bigint, mark bigint, fp bigint"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "row")
    # The best row of each fingerprint first, so that a group of copies is one row when components meet.
    best = staged(docs.groupBy("fp").agg(F.min(rank).alias("best")))
    classes = _classes(docs.select("doc_id", "fp"))
    chosen = staged(best.join(classes, best.fp == classes.class_fp).groupBy("component").agg(F.min("best").alias("best")).select(
        F.col("best.row").alias("chosen")))
    # The same plan at every size: rows are dealt by number to a hash table of the numbers that stay, without a sort of texts.
    return own.join(chosen.hint("shuffle_hash"), own[number] == chosen["chosen"], "left_semi").select(*(F.col(f"`{c}`") for c in columns))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id: smallest doc_id reachable by links), one row per row."""
    docs = staged(fingerprints(df, doc_id, text))
    classes = _classes(docs)
    return docs.join(classes, docs.fp == classes.class_fp).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
