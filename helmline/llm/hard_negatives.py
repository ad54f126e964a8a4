"""Hard negatives by a vertical scan of dimensions with bounds (branch and bound on decomposed data).

Components become whole numbers, floor(256 x). An anchor reads the dimensions in descending order of its own magnitude.
After some dimensions every candidate has a partial score, and the least and greatest component of each unread dimension
bound what can still come. A bitmap of candidates shrinks by these bounds: while positives are looked for, a candidate
stays if its upper bound reaches the lowest score that still counts; while negatives are looked for, if its bounds meet a
score window of the anchor and reach the lowest score that counts there. What is left has its exact score in the end.

Both searches are one job each. Anchors are dealt into groups of bounded size and the other rows into shares; a group
meets a share in one task, where the rows of the share come by in Arrow batches and only the best few of each anchor are
held. No pair of rows leaves a task, only the best of each anchor and share; their order is settled by a window.
Positives are looked for among the rows of the anchor's label only, so a frequent label is many shares. Writing to the
shared folder fixes row numbers before anything refers to them.

Rows with a null label, a null vector, or any null or non-finite component take no part. Scores need vectors of equal
length: rows of different length are never compared, an empty vector scores 0. Rows, not ids, are compared: repeated rows
are rows of their own, and an anchor is never its own positive. Null ids are no anchors and come last among equal scores.
Scores are exact whole numbers; one that doesn't fit into 64 bits is an error. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from helmline.llm.common import shuffle_partitions, staged

POSITIVES = 5
NEGATIVES = 3
#: A negative scores between these hundredths of its positive.
LOW, HIGH = 50, 95
SCALE = 256
#: Anchors that a task holds, and the fewest rows that make a share worth a task of its own.
ANCHORS = 8192
LEAST_ROWS = 256
#: Largest number that doubles add up exactly.
EXACT = 1 << 53


def numbers(lists: pa.Array, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of lists of one length: doubles where all scores are exact in them, else Python's numbers."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = flat.reshape(len(lists), len(flat) // max(len(lists), 1))
    x = np.floor(scale * flat)
    most = np.abs(x).max(initial=0)
    if most * most * max(x.shape[1], 1) < EXACT:
        return x
    return np.array([[scale * int(c) if abs(c) >= EXACT else int(np.floor(scale * c)) for c in row] for row in flat.tolist()],
                    object).reshape(x.shape)


def steps(dims: int) -> list[tuple[int, int]]:
    """Runs of dimensions that are read between two looks at the bounds; they grow as less is left to decide."""
    out, at, width = [], 0, 8
    while at < dims:
        out.append((at, min(at + width, dims)))
        at, width = at + width, width * 2
    return out


def scan(anchor: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, bitmap: np.ndarray, still) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of the candidates in the bitmap that `still(lower bounds, upper bounds)` never ruled out.

    columns: one row per dimension; low and high: its least and greatest component.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    weights = anchor[order]
    a, b = weights * low[order], weights * high[order]
    least = np.append(np.cumsum(np.minimum(a, b)[::-1])[::-1], 0)
    most = np.append(np.cumsum(np.maximum(a, b)[::-1])[::-1], 0)
    rows = np.flatnonzero(bitmap)
    scores = np.zeros(len(rows), columns.dtype)
    for start, stop in steps(len(order)):
        scores = scores + weights[start:stop] @ columns[np.ix_(order[start:stop], rows)]
        stay = still(scores + least[stop], scores + most[stop])
        if not stay.all():
            rows, scores = rows[stay], scores[stay]
        if not len(rows):
            break
    return rows, scores


def nth_largest(values: np.ndarray, n: int):
    return -np.inf if len(values) < n else np.partition(values, len(values) - n)[len(values) - n] if values.dtype != object else sorted(values)[-n]


@dataclass
class Best:
    """The best few (score, id or None, row) so far; equal scores by id, null last."""

    room: int
    held: list[tuple] = field(default_factory=list)

    def floor(self):
        return self.held[-1][0] if len(self.held) == self.room else -np.inf

    def add(self, scores, ids, rows) -> None:
        more = [(int(s), i, int(r)) for s, i, r in zip(scores, ids, rows)]
        self.held = sorted([*self.held, *more], key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))[:self.room]


class Positives:
    """The best rows of an anchor's own label, itself left out."""

    def __init__(self, row: dict) -> None:
        self.no, self.label, self.best = row["no"], row["label"], Best(POSITIVES)

    def read(self, anchor: np.ndarray, block: "Block") -> None:
        bitmap = (block.labels == self.label) & (block.numbers != self.no)
        floor = self.best.floor()

        def still(lower, upper):
            return upper >= max(floor, nth_largest(lower, POSITIVES))

        rows, scores = block.scan(anchor, bitmap, still)
        top = np.flatnonzero(scores >= max(floor, nth_largest(scores, POSITIVES)))
        self.best.add(scores[top], block.ids_of(rows[top]), block.numbers[rows[top]])

    def rows(self):
        return [(None, *x) for x in self.best.held]


class Negatives:
    """The best rows of other labels in each score window of an anchor's positives."""

    def __init__(self, row: dict) -> None:
        self.label = row["label"]
        # 50 p <= 100 s <= 95 p in whole numbers; equal positives have one window.
        windows = {p: (-(-LOW * p // 100), HIGH * p // 100) for p in row["positives"]}
        self.windows = {p: (lo, hi, Best(NEGATIVES)) for p, (lo, hi) in windows.items() if lo <= hi}

    def read(self, anchor: np.ndarray, block: "Block") -> None:
        if not self.windows:
            return
        windows = list(self.windows.values())

        def still(lower, upper):
            stay = np.zeros(len(lower), bool)
            for lo, hi, best in windows:
                certain = lower[(lower >= lo) & (upper <= hi)]
                stay |= (lower <= hi) & (upper >= max(lo, best.floor(), nth_largest(certain, NEGATIVES)))
            return stay

        rows, scores = block.scan(anchor, block.labels != self.label, still)
        for lo, hi, best in windows:
            inside = np.flatnonzero((scores >= max(lo, best.floor())) & (scores <= hi))
            inside = inside[scores[inside] >= nth_largest(scores[inside], NEGATIVES)]
            best.add(scores[inside], block.ids_of(rows[inside]), block.numbers[rows[inside]])

    def rows(self):
        return [(p, *x) for p, (_, _, best) in self.windows.items() for x in best.held]


class Block:
    """Candidates of one batch, by dimension."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        x = numbers(batch.column("v"))
        self.columns = np.ascontiguousarray(x.T)
        self.low, self.high = self.columns.min(1), self.columns.max(1)
        self.most = np.abs(self.columns).max(initial=0) * max(len(self.columns), 1)
        self.labels = batch.column("label").to_numpy(zero_copy_only=False)
        self.numbers = batch.column("no").to_numpy(zero_copy_only=False)
        self.ids = batch.column("id")

    def ids_of(self, rows: np.ndarray) -> list[int | None]:
        return self.ids.take(pa.array(rows)).to_pylist()

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, still) -> tuple[np.ndarray, np.ndarray]:
        columns = self.columns
        if anchor.dtype != columns.dtype or np.abs(anchor).max(initial=0) * self.most >= EXACT:
            whole = np.vectorize(int, otypes=[object])
            anchor, columns = (x if x.dtype == object or not x.size else whole(x) for x in (anchor, columns))
        return scan(anchor, columns, self.low, self.high, bitmap, still)


def prepared(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(no, id, v, dims, label) of the rows that take part; no numbers them."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), v.alias("v"), F.col(f"`{label}`").cast("bigint").alias("label"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return staged(rows.where(F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.monotonically_increasing_id().alias("no"), "id", "v", F.size("v").alias("dims"), "label"))


FOUND = "anchor bigint, positive_score bigint, score bigint, id bigint, no bigint"


def search(anchors: DataFrame, rows: DataFrame, kind: type, together: list[str]) -> DataFrame:
    """FOUND: the best rows of each anchor within each share of rows, by a vertical scan.

    together: columns that an anchor and a row need to have in common to meet at all.
    """
    spark = rows.sparkSession
    n, m, parts = rows.count(), anchors.count(), shuffle_partitions(spark)
    groups = max(1, -(-m // ANCHORS))
    shares = max(1, min(-(-2 * parts // groups), -(-n // LEAST_ROWS)))
    names = list(dict.fromkeys(["side", *together, "grp", "share", "no", "id", "label", "v", "positives"]))
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k: F.pmod(F.xxhash64("no"), F.lit(k)).cast("int")
    left = anchors.withColumns({"side": F.lit(0), "grp": dealt(groups), "share": spread(shares)})
    right = rows.withColumns({"side": F.lit(1), "share": dealt(shares), "grp": spread(groups), "positives": F.lit(None).cast("array<bigint>")})
    keys = [*together, "grp", "share"]
    met = left.select(*names).unionByName(right.select(*names)).repartition(max(parts, min(groups * shares, 4 * parts)), *keys)
    ordered = met.sortWithinPartitions(*keys, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, group, vectors = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            made = [(no, *x) for no, one, _ in group for x in one.rows()]
            if made:
                fields = ["anchor", "positive_score", "score", "id", "no"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], fields)

        for batch in batches:
            for part in runs(batch, [*keys, "side"]):
                key = tuple(part.column(k)[0].as_py() for k in keys)
                if key != here:
                    yield from out()
                    here, group = key, []
                if part.column("side")[0].as_py() == 0:
                    vectors = numbers(part.column("v"))
                    group += [(r["no"], kind(r), v) for r, v in zip(part.drop_columns(["v"]).to_pylist(), vectors)]
                elif group:
                    block = Block(part)
                    for _, one, v in group:
                        one.read(v, block)
        yield from out()

    return ordered.mapInArrow(run, FOUND)


def runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The batch, cut where a key changes."""
    change = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        values = batch.column(k).to_numpy(zero_copy_only=False)
        change |= values[1:] != values[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def mine(df: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors' hard negatives.

    anchor: a condition on the id, under the name `id`. Positives are the POSITIVES best other rows of an anchor's label;
    each has up to NEGATIVES rows of other labels that score between LOW and HIGH hundredths of it.
    """
    rows = prepared(df, vec_id, embedding, label)
    anchors = rows.where(anchor)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "no")
    found = search(anchors.withColumn("positives", F.lit(None).cast("array<bigint>")), rows, Positives, ["dims", "label"])
    best = staged(found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= POSITIVES).select(
        "anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = best.groupBy("anchor").agg(F.collect_set("positive_score").alias("positives"))
    asked = anchors.join(windows, F.col("no") == F.col("anchor")).select("no", "id", "label", "v", "dims", "positives")
    within = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "no")
    low = search(staged(asked), rows, Negatives, ["dims"]).withColumn("rank", F.row_number().over(within)).where(
        F.col("rank") <= NEGATIVES).select("anchor", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("no").alias("anchor"), F.col("id").alias("anchor_id"))
    return best.join(low, ["anchor", "positive_score"]).join(named, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(label: Column, vec_id: Column) -> Column:
    """The label, moved on by one where the id is divisible by 7."""
    return F.when(F.pmod(vec_id, F.lit(7)) == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
