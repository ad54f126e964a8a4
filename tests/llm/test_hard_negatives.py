"""Hard negatives against all pairs, in Python's own whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helmline.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def expected(rows, every=50):
    """rows: (id, vector, label); the rows of the result, each anchor's in order."""
    held = [(i, [math.floor(256 * c) for c in v], l) for i, v, l in rows
            if l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for k, (i, v, label) in enumerate(held):
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for n, (j, w, other) in enumerate(held) if n != k and len(w) == len(v)]
        order = sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        for p, pid, _ in [x for x in order if x[2] == label][:5]:
            fits = [x for x in order if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p]
            out += [(i, pid, r + 1, x[1], p, x[0]) for r, x in enumerate(fits[:3])]
    return sorted(out, key=str)


def found(df, every=50, **more):
    return sorted((tuple(r) for r in hn.mine(df, F.col("id") % every == 0, **more).collect()), key=str)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((4, 24)) * 0.3
    rows = [(i, [float(c) for c in centres[i % 4] + rng.standard_normal(24) * 0.2], int(rng.integers(4)) if i % 3 else 1) for i in range(1500)]
    rows += [(1500 + i, rows[50][1], 2) for i in range(40)]
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert got == expected(rows) and len(got) > 200


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)], i % 3) for i in range(400)]
    rows += [(None, [0.5] * 4, 1), (None, [0.5, 0.5, 0.5, 0.25], 2), (50, [1.0] * 4, 0), (50, [1.0] * 4, 0), (100, None, 1), (150, [1.0] * 4, None),
             (200, [None] * 4, 1), (250, [float("nan")] * 4, 1), (300, [float("inf")] + [1.0] * 3, 1), (350, [], 1), (351, [], 2), (352, [], 1),
             (500, [1.0, 2.0], 0), (501, [1.0, 1.0], 0), (502, [0.5, 1.5], 1), (550, [-1.0, -1.0], 5), (551, [1.0, 1.0], 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(df)
    # Rows that are equal but for their number may stand for each other; what is shown of them is the same.
    assert got == expected(rows)
    clash = df
    for name in ("no", "id", "side", "share", "grp", "positives", "score", "anchor", "place", "dims", "v"):
        clash = clash.withColumn(name, F.lit(1))
    assert found(clash) == got
    assert hn.mine(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert hn.mine(df.where("vec_id = 7"), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("factor", [2.0 ** 14, 2.0 ** 20])
def test_large_components_are_exact(spark, factor):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in np.abs(rng.standard_normal(3)) * factor], i % 2) for i in range(300)]
    rows += [(1000 + i, [float(c) for c in np.abs(rng.standard_normal(3))], i % 2) for i in range(100)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == expected(rows)


def test_same_rows_at_any_size_of_groups_and_shares(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.standard_normal(6)], int(rng.integers(3))) for i in range(600)]
    df, want = spark.createDataFrame(rows, SCHEMA), expected(rows, 5)
    for anchors, least in ((7, 20), (1000, 10_000)):
        monkeypatch.setattr(hn, "ANCHORS", anchors)
        monkeypatch.setattr(hn, "LEAST_ROWS", least)
        assert found(df, 5) == want


def test_bounds_rule_candidates_out():
    """A scan never loses a row that counts, and most rows are gone before the last dimension is read."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.standard_normal((4000, 64)) * 20 * (0.9 ** np.arange(64)))
    columns, anchor, sizes = np.ascontiguousarray(x.T), x[0], []

    def still(lower, upper):
        sizes.append(len(lower))
        return upper >= hn.nth_largest(lower, 5)

    rows, scores = hn.scan(anchor, columns, columns.min(1), columns.max(1), np.ones(4000, bool), still)
    assert set(np.argsort(-(x @ anchor), kind="stable")[:5]) <= set(rows) and (scores == x[rows] @ anchor).all()
    assert sizes[-1] < 400


def test_relabelled(spark):
    df = spark.createDataFrame([(0, 9), (7, 3), (8, 4), (None, 5), (14, None)], "i bigint, l int")
    got = [r[0] for r in df.select(hn.relabelled(F.col("l"), F.col("i"))).collect()]
    assert got == [0, 4, 4, 5, None]
