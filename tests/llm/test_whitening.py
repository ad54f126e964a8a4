"""Singular values and directions against numpy's own solver; whitened rows against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helmline.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<double>"


def matrices():
    rng = np.random.default_rng(1)
    yield "random", rng.standard_normal((40, 40))
    yield "graded", rng.standard_normal((30, 30)) * 10.0 ** -np.arange(30)
    yield "graded the other way", rng.standard_normal((30, 30)) * 10.0 ** np.arange(-20, 10)
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    p = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    yield "equal values", q @ np.diag([5.0] * 4 + [3.0] * 3 + [1.0] * 13) @ p
    yield "close values", q @ np.diag(5 + np.arange(20) * 1e-10) @ p
    yield "rank three", rng.standard_normal((25, 3)) @ rng.standard_normal((3, 25))
    yield "diagonal", np.diag([3.0, 1.0, 2.0, 2.0, 0.0, 5.0])
    yield "identity", np.eye(9)
    yield "zero columns", np.hstack([rng.standard_normal((12, 6)), np.zeros((12, 6))])
    yield "fewer rows", rng.standard_normal((5, 16))
    yield "one", np.array([[2.5]])
    yield "two", np.array([[1.0, 1e-9], [0.0, 1.0]])
    yield "large", rng.standard_normal((300, 128)) @ np.diag(np.linspace(1, 3, 128))


@pytest.mark.parametrize("name, m", list(matrices()), ids=[n for n, _ in matrices()])
def test_values_and_directions(name, m):
    r = np.linalg.qr(m, mode="r")
    u, s, vt = np.linalg.svd(r)
    if len(r) < r.shape[1]:
        s = np.append(s, np.zeros(r.shape[1] - len(r)))
        r = np.concatenate([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])
    diagonal, above, right = wh.bidiagonalised(r)
    got = wh.squared_singular_values(diagonal, above)
    assert np.allclose(np.sqrt(np.maximum(got, 0)), s, rtol=1e-12, atol=1e-13 * s[0])
    b = np.diag(diagonal) + np.diag(above, 1)
    back = wh.carried_back(np.eye(len(b)), right)
    assert np.allclose(back.T @ (r.T @ r) @ back, b.T @ b, atol=1e-12 * s[0] ** 2)
    values, v = wh.directions(r)
    rank = int((s > 1e-12 * s[0]).sum())
    assert len(values) == min(8, rank)
    assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-9)
    assert np.linalg.norm((r.T @ r) @ v.T - v.T * values, axis=0).max() <= 1e-10 * s[0] ** 2


def test_small_values_keep_their_digits():
    """A bidiagonal matrix fixes its small singular values relatively, and dqds finds them so."""
    diagonal, above = 10.0 ** -np.arange(12), 0.5 * 10.0 ** -np.arange(11)
    got = np.sqrt(wh.squared_singular_values(diagonal, above))
    assert np.isclose(np.prod(got), np.prod(diagonal), rtol=1e-12)


def plain(rows):
    """(x, covariance, eigenvalues, directions) of the rows that take part."""
    held = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in held], np.int64)
    c = x - x.sum(0) / len(x)
    e, v = np.linalg.eigh(c.T @ c / len(x))
    return held, x, c, e[::-1], v[:, ::-1]


def test_whitened_rows(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((900, 20)) @ (rng.standard_normal((20, 20)) * 0.3) + 0.2
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(None, rows[0][1]), (1, rows[1][1]), (1, rows[1][1]), (9000, None), (9001, [None] + rows[0][1][1:]), (9002, [float("nan")] * 20),
             (9003, [float("inf")] * 20)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    held, x, c, e, v = plain(rows)
    got = wh.whitened(df).collect()
    assert len(got) == 8 * len(held) and all(r.identity_error < 1e-9 and r.n == len(held) for r in got)
    assert sorted({r.component for r in got}) == list(range(1, 9))
    want = c @ v[:, :8] / np.sqrt(e[:8])
    of = {i: k for k, (i, _) in enumerate(held)}
    total = x.sum(0)
    for r in got:
        k, j = of[r.vec_id], r.component - 1
        assert r.deviation == sum((len(x) * int(a) - int(b)) ** 2 for a, b in zip(x[k], total))
        assert abs(abs(r.whitened) - abs(want[k, j])) < 1e-9 and abs(r.explained / (e[j] / e.sum()) - 1) < 1e-10


def test_lengths_constants_and_broadcast_bound(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(60)] + [(100 + i, [float(c) for c in rng.standard_normal(5)]) for i in range(40)]
    rows += [(200, []), (201, []), (202, [1.0]), (203, [2.0, 2.0]), (204, [2.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df
    for name in ("id", "v", "dims", "n", "total", "r", "grp", "salt", "axes"):
        clash = clash.withColumn(name, F.lit(1))
    key = lambda r: (r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 6))
    got = sorted(map(key, wh.whitened(clash).collect()))
    assert {(k[0] < 100, k[2]) for k in got} == {(True, 60), (False, 40)} and len(got) == 60 * 3 + 40 * 5
    monkeypatch.setattr(wh, "MODEL_BYTES", 0)
    assert sorted(map(key, wh.whitened(df).collect())) == got
    assert wh.whitened(df.limit(0)).count() == 0


def test_large_numbers():
    x = np.array([[1 << 40, 5], [-(1 << 40), 7]], np.int64)
    assert wh.deviations(x, 1 << 30, [1 << 60, 12]).tolist() == [[(1 << 70) - (1 << 60), (5 << 30) - 12], [-(1 << 70) - (1 << 60), (7 << 30) - 12]]
    assert wh.exact_squares(np.array([[1 << 31, 1], [1 << 32, 1]])) == [(1 << 62) + 1, None]
    with pytest.raises(ValueError):
        wh.numbers(__import__("pyarrow").array([[1e300]]))
