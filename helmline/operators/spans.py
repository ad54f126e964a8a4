"""Greedy one-to-one matching of spans by overlap, without labels times predictions of a record.

Spans that overlap meet in cells: a span belongs to the level of the least power of two that holds it, and touches at most
two cells of that width or of a wider level. Two spans are compared at the wider level of the two, in the cell where the
later one starts, so a pair comes out once and only spans that share a cell meet.

Pairs are taken best first (overlap, then start of the prediction, then place of the label, then of the prediction). A pair
that is the best of both its sides is taken by that order whatever else is, so all such pairs are taken at once, in rounds.
What a long chain leaves after the last round is folded in order.

Whole records overlap everything in their record by one byte. Where a record has nothing else, its labels and predictions
pair off by rank. Where it has spans too, one walk over the predictions by start keeps the labels not used yet.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmline.plans.stage import stage

ROUNDS = 8
_IDS = ["li", "pi", "overlap"]


def _level(start: str, end: str) -> Column:
    """k of the least 2**k that is no shorter than the span."""
    return F.expr(f"CASE WHEN {end} - {start} = 1 THEN 0 ELSE length(bin({end} - {start} - 1)) END")


def _cells(d: DataFrame, start: str, end: str, wider: list[int]) -> DataFrame:
    """One row per cell of the span's own level and of each wider level in which the other side has spans."""
    d = d.withColumn("own", _level(start, end))
    others = F.array(*[F.lit(k) for k in wider]).cast("array<int>")
    d = d.withColumn("level", F.explode(F.array_union(F.array("own"), F.filter(others, lambda k: k > F.col("own")))))
    return d.withColumn("cell", F.explode(F.expr(
        f"array_distinct(array(shiftright({start}, level), shiftright({end} - 1, level)))")))


def overlapping(l: DataFrame, p: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, li, pi, ps, overlap) of spans l (unit, li, ls, le) and p (unit, pi, ps, pe) that share a byte."""
    level_of = lambda d, s, e: [r[0] for r in d.select(_level(s, e)).distinct().collect()]  # at most 64 numbers
    a = _cells(l, "ls", "le", level_of(p, "ps", "pe")).withColumnRenamed("own", "own_l")
    b = _cells(p, "ps", "pe", level_of(l, "ls", "le")).withColumnRenamed("own", "own_p")
    d = a.join(b, [*unit, "level", "cell"]).where(
        (F.col("level") == F.greatest("own_l", "own_p")) & (F.expr("shiftright(greatest(ls, ps), level)") == F.col("cell")))
    shared = F.least("le", "pe") - F.greatest("ls", "ps")
    return d.where(shared > 0).select(*unit, "li", "pi", "ps", shared.cast("long").alias("overlap"))


def _schema(unit: list[str]) -> tuple[str, pa.Schema]:
    ddl = ", ".join([f"{u} string" for u in unit] + [f"{n} long" for n in _IDS])
    return ddl, pa.schema([(u, pa.string()) for u in unit] + [(n, pa.int64()) for n in _IDS])


def best_first(edges: DataFrame, unit: list[str], rounds: int = ROUNDS) -> DataFrame:
    """The pairs of `edges` (unit, li, pi, ps, overlap) that a walk from best to worst takes."""
    ddl, schema = _schema(unit)
    rank = F.struct((-F.col("overlap")).alias("worse"), "ps", "li", "pi")
    left, taken = stage(edges, "edges"), []
    for _ in range(rounds):
        if left.isEmpty():
            break
        first = lambda side: left.groupBy(*unit, side).agg(F.min(rank).alias("r")).select(  # noqa: E731, B023
            *unit, F.col("r.li").alias("li"), F.col("r.pi").alias("pi"), (-F.col("r.worse")).alias("overlap"))
        won = stage(first("li").join(first("pi").drop("overlap"), [*unit, "li", "pi"]).select(*unit, *_IDS), "won")
        taken.append(won)
        left = stage(left.join(won.select(*unit, "li"), [*unit, "li"], "left_anti").join(
            won.select(*unit, "pi"), [*unit, "pi"], "left_anti"), "edges")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs arrive best first; the sides used so far are all the state."""
        used_l, used_p = set(), set()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["li"] not in used_l and r["pi"] not in used_p:
                    used_l.add(r["li"])
                    used_p.add(r["pi"])
                    rows.append({n: r[n] for n in schema.names})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    if not left.isEmpty():
        chain = left.repartition(*unit).sortWithinPartitions(*unit, F.col("overlap").desc(), "ps", "li", "pi")
        taken.append(chain.groupBy(*unit).applyInArrow(walk, ddl))
    nothing = left.limit(0).select(*unit, *_IDS)
    return reduce(DataFrame.unionByName, taken, nothing)


def _by_start(schema: pa.Schema, unit: list[str]):
    """Walk of one record: labels by place, then predictions and one-byte pairs by start of the prediction."""
    def settle(whole, part, used, preds, edges):
        """Best pairs among the predictions of one start: (li, pi), least first."""
        blunt, sharp = deque(sorted(p for p, w in preds if w)), deque(sorted(p for p, w in preds if not w))
        gone, edges = set(), deque(sorted(edges))
        while True:
            for line in (whole, part):
                while line and line[0] in used:
                    line.popleft()
            for line in (blunt, sharp):
                while line and line[0] in gone:
                    line.popleft()
            while edges and (edges[0][0] in used or edges[0][1] in gone):
                edges.popleft()
            options = [edges[0]] if edges else []
            options += [(whole[0], q[0]) for q in (blunt, sharp) if whole and q]
            options += [(part[0], blunt[0])] if part and blunt else []
            if not options:
                return
            li, pi = min(options)
            used.add(li)
            gone.add(pi)
            yield li, pi

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part, used = deque(), deque(), set()
        at, preds, edges, key = None, [], [], {}

        def out():
            rows = [{**key, "li": li, "pi": pi, "overlap": 1} for li, pi in settle(whole, part, used, preds, edges)]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    (whole if r["whole"] else part).append(r["li"])
                    continue
                if preds and r["ps"] != at:
                    yield out()
                    preds, edges = [], []
                at, key = r["ps"], {u: r[u] for u in unit}
                if r["kind"] == 1:
                    preds.append((r["pi"], r["whole"]))
                else:
                    edges.append((r["li"], r["pi"]))
        if preds:
            yield out()

    return walk


def matches(l: DataFrame, p: DataFrame, unit: list[str], rounds: int = ROUNDS) -> DataFrame:
    """(unit, li, pi, overlap), each li and pi of a unit at most once.

    l: unit, li, ls, le; p: unit, pi, ps, pe. An end that is not behind its start names the whole record. A row with a null
    bound or a null in its unit matches nothing.
    """
    ddl, schema = _schema(unit)
    l = stage(l.withColumn("whole", F.col("le") <= F.col("ls")).where("whole is not null"), "labelled")
    p = stage(p.withColumn("whole", F.col("pe") <= F.col("ps")).where("whole is not null"), "predicted")
    spans = overlapping(l.where("not whole"), p.where("not whole"), unit)
    form = l.select(*unit, "whole").unionByName(p.select(*unit, "whole")).groupBy(*unit).agg(
        F.bool_and("whole").alias("only"), F.bool_or("whole").alias("some"))
    form = stage(form.where("some"), "blunt")
    if form.isEmpty():
        return best_first(spans, unit, rounds)
    spans = stage(spans.join(form.select(*unit, "some"), unit, "left"), "overlaps")
    sharp = stage(best_first(spans.where("overlap > 1 or some is null").drop("some"), unit, rounds), "sharp")

    only = form.where("only").select(*unit)
    n = F.row_number()
    ranked_l = l.join(only, unit).withColumn("n", n.over(Window.partitionBy(*unit).orderBy("li")))
    ranked_p = p.join(only, unit).withColumn("n", n.over(Window.partitionBy(*unit).orderBy("ps", "pi")))
    level = ranked_l.select(*unit, "n", "li").join(ranked_p.select(*unit, "n", "pi"), [*unit, "n"]).select(
        *unit, "li", "pi", F.lit(1).cast("long").alias("overlap"))

    mixed, none = form.where("not only").select(*unit), lambda name: F.lit(None).cast("long").alias(name)
    free = lambda d, side: d.join(mixed, unit).join(sharp.select(*unit, side), [*unit, side], "left_anti")
    rows = free(l, "li").select(*unit, F.lit(0).alias("kind"), none("ps"), F.col("li").cast("long"), none("pi"), "whole")
    rows = rows.unionByName(free(p, "pi").select(
        *unit, F.lit(1).alias("kind"), F.col("ps").cast("long"), none("li"), F.col("pi").cast("long"), "whole"))
    ones = spans.where("overlap = 1 and some").drop("some")
    rows = rows.unionByName(free(free(ones, "li"), "pi").select(
        *unit, F.lit(2).alias("kind"), F.col("ps").cast("long"), F.col("li").cast("long"), F.col("pi").cast("long"),
        F.lit(False).alias("whole")))
    rows = rows.repartition(*unit).sortWithinPartitions(*unit, F.col("kind") > 0, "ps", "kind", "li", "pi")
    return sharp.unionByName(level).unionByName(rows.groupBy(*unit).applyInArrow(_by_start(schema, unit), ddl))
