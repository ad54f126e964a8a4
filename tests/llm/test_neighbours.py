"""Links and components against all pairs."""

import numpy as np

from helmline.llm import neighbours


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 16))
    big = rng.standard_normal(16) + rng.standard_normal((230, 16)) * 0.03
    x = np.concatenate([x, x[:60] + rng.standard_normal((60, 16)) * 0.05, x[:9] * 3, x[:5], big])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] + [1.0] * 15), (9004, [1.0]),
           (9005, [float("inf")] + [1.0] * 15), (9006, [])]
    df = spark.createDataFrame([(v, i, i % 3) for i, v in rows + odd], "embedding array<double>, vec_id bigint, cid int")
    got = {r.vec_id: r for r in neighbours.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    n = near.sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.99 * n.sum()
    label = np.arange(len(x))
    while True:
        new = np.where(near, label, len(x)).min(1)
        if (new == label).all():
            break
        label = new
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) >= 0.99
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_window_goes_on_in_a_run():
    x = np.tile([1.0, 0.0], (40, 1))
    assert sum(len(i) for i, _ in neighbours.window_pairs(x, 4, 0.95)) == 40 * 39 // 2


def test_group_around_the_bound_whole(spark):
    """A group far larger than a window with cosines on both sides of the bound loses no link, at any partition count."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    centre /= np.linalg.norm(centre)
    x = np.concatenate([centre + rng.standard_normal((2500, 16)) * 0.056, rng.standard_normal((500, 16))])
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = (y @ y.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    before, cell = spark.conf.get("spark.sql.shuffle.partitions"), neighbours.CELL_BYTES
    try:
        neighbours.CELL_BYTES = 600 * 16 * 8
        for parts in ("2", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(df).collect()}
            assert [got[i] for i in range(2500)] == expected[:2500].tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        neighbours.CELL_BYTES = cell


def test_every_length_and_scale(spark):
    """Vectors of each length link among themselves, whatever their scale; null and repeated ids keep their rows."""
    rng = np.random.default_rng(11)
    rows, vectors = [], []
    for dims, n, tight in ((16, 120, 40), (3, 30, 6), (2, 2, 0), (1, 4, 0)):
        x = rng.standard_normal((n, dims))
        if tight:
            x[:tight] = rng.standard_normal(dims) + rng.standard_normal((tight, dims)) * 0.03
        vectors += list(x)
    vectors += [np.array([1e200, 2e200]), np.array([1e-200, 2.0001e-200]), np.array([3.0, 6.0]), np.array([5e-324, 1e-323])]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    rows += [(None, [float(c) for c in vectors[0]]), (5, [float(c) for c in vectors[5]]), (None, None)]
    got = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    unit = [None if v is None else (lambda w: w / np.linalg.norm(w))(np.array(v) / np.abs(v).max()) for _, v in rows]

    def near(a, b):
        return a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95

    n_links = [sum(near(a, b) for j, b in enumerate(unit) if j != i) for i, a in enumerate(unit)]
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links) for r in got) == sorted(
        (-1 if i is None else i, n) for (i, _), n in zip(rows, n_links))
    at = {i: next(k for k, (j, _) in enumerate(rows) if j == i) for i, _ in rows if i is not None}
    for r in got:
        if r.vec_id is not None and r.component_id != r.vec_id:
            assert len(unit[at[r.vec_id]]) == len(unit[at[r.component_id]])
            assert not r.kept
    by_id = {r.vec_id: r for r in got if r.vec_id is not None}
    first = len(vectors) - 4
    assert len({by_id[first + k].component_id for k in range(4)}) == 1
