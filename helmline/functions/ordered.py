"""Ordered computations that survive one very long stream.

A plain `Window.partitionBy(stream).orderBy(seq)` puts a whole stream into one task. Here a stream is
cut into blocks of its order key. Unbounded frames become a two-level scan: one row of partial state
per block (map-side combined), a window over those few rows, and a local window per block. Bounded
frames are computed per block after copying the last rows of each block into the next one.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmline.plans.stage import stage

RECORD_BLOCK = "record_rows"
TURN_BLOCK = "turn_rows"


@dataclass(frozen=True)
class Layout:
    """Block sizes, and whether streams have to be cut at all.

    `split` is switched off only after a count has shown that no stream is longer than one block;
    the two-level plans then shrink to plain windows.
    """

    record_rows: int = 1 << 16
    turn_rows: int = 1 << 13
    split: bool = True


_layout: ContextVar[Layout] = ContextVar("layout", default=Layout())


@contextmanager
def layout(value: Layout):
    token = _layout.set(value)
    try:
        yield value
    finally:
        _layout.reset(token)


def current() -> Layout:
    return _layout.get()


@dataclass(frozen=True)
class Run:
    """One running value: `op` in sum, last (ignoring nulls), max, min; strict leaves the row out."""

    op: str
    col: Column
    strict: bool = False


def block_of(col: Column, size: str) -> Column:
    return F.floor(col / F.lit(getattr(current(), size))).cast("long")


def running(df: DataFrame, keys, order, block: Column, outs: dict[str, Run],
            descending: bool = False, reread: bool = False) -> DataFrame:
    """Add running values over `keys` in `order`, with one task per (keys, block) at most.

    The two-level form reads its input twice. It is staged first, so that a chain of running values
    stays linear; `reread=True` says that the input is a plain scan that is better read again.
    """
    keys, order = list(keys), list(order)
    if not current().split:
        return _running_whole(df, keys, order, outs, descending)
    d = df.select("*", block.alias("__blk"), *[r.col.alias(f"__in_{n}") for n, r in outs.items()])
    if not reread:
        d = stage(d, "running")

    at = F.struct(*[F.col(o) for o in order])
    partial = []
    for name, r in outs.items():
        v = F.col(f"__in_{name}")
        if r.op == "last":
            pick = F.min_by if descending else F.max_by
            partial.append(pick(v, F.when(v.isNotNull(), at)).alias(f"__p_{name}"))
        else:
            partial.append(getattr(F, r.op)(v).alias(f"__p_{name}"))
    blocks = d.groupBy(*keys, "__blk").agg(*partial)

    by_blk = F.col("__blk").desc() if descending else F.col("__blk").asc()
    wb = Window.partitionBy(*keys).orderBy(by_blk).rowsBetween(Window.unboundedPreceding, -1)

    def over(op, col, w):
        return F.last(col, ignorenulls=True).over(w) if op == "last" else getattr(F, op)(col).over(w)

    carry = blocks.select(
        *keys, "__blk",
        *[over(r.op, F.col(f"__p_{n}"), wb).alias(f"__c_{n}") for n, r in outs.items()],
    )

    by = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    wl = Window.partitionBy(*keys, "__blk").orderBy(*by)
    joined = d.join(carry, [*keys, "__blk"])
    cols = []
    for name, r in outs.items():
        w = wl.rowsBetween(Window.unboundedPreceding, -1 if r.strict else 0)
        local, before = over(r.op, F.col(f"__in_{name}"), w), F.col(f"__c_{name}")
        if r.op == "sum":
            cols.append((F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0))).alias(name))
        elif r.op == "last":
            cols.append(F.coalesce(local, before).alias(name))
        else:
            best = F.greatest if r.op == "max" else F.least
            cols.append(best(local, before).alias(name))
    keep = [c for c in df.columns if c not in outs]
    return joined.select(*keep, *cols)


def _running_whole(df, keys, order, outs, descending):
    by = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    cols = []
    for name, r in outs.items():
        at = w.rowsBetween(Window.unboundedPreceding, -1 if r.strict else 0)
        if r.op == "last":
            made = F.last(r.col, ignorenulls=True).over(at)
        else:
            made = getattr(F, r.op)(r.col).over(at)
        cols.append((F.coalesce(made, F.lit(0)) if r.op == "sum" else made).alias(name))
    return df.select(*[c for c in df.columns if c not in outs], *cols)


def framed(df: DataFrame, keys, index: str, reach: int, outs) -> DataFrame:
    """Add bounded look-back values. `index` is dense per `keys`; frames reach `reach` rows back.

    `outs(window)` maps names to expressions over the given window spec (partitioned and ordered,
    frame still open). Rows within `reach` of a block's end are copied to the next block as context.
    """
    keys = list(keys)
    d, blk = with_context(df, F.col(index), reach)
    w = Window.partitionBy(*keys, "__blk").orderBy(index)
    made = {n: e for n, e in outs(w).items()}
    keep = [c for c in df.columns if c not in made]
    return (
        d.select(*keep, "__blk", *[e.alias(n) for n, e in made.items()])
        .where(F.col("__blk") == blk)
        .drop("__blk")
    )


def with_context(df: DataFrame, index: Column, reach: int) -> tuple[DataFrame, Column]:
    """Rows with their block, and copies of the last `reach` indexes of a block for the next one."""
    if not current().split:
        return df.withColumn("__blk", F.lit(0).cast("long")), F.lit(0).cast("long")
    size = max(current().turn_rows, 2 * reach)
    blk = F.floor(index / F.lit(size)).cast("long")
    near_end = (index % size) >= size - reach
    homes = F.when(near_end, F.array(blk, blk + 1)).otherwise(F.array(blk))
    return df.withColumn("__blk", F.explode(homes)), blk


def dense_seq(df: DataFrame, keys, order, block: Column, name: str = "seq") -> DataFrame:
    """Dense 1-based ordinal over `keys` in `order`."""
    return running(df, keys, order, block, {name: Run("sum", F.lit(1).cast("long"))}, reread=True)
