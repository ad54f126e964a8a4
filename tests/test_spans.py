"""Matching of spans against the plain walk over all pairs, best first."""

import random

import pytest

from helmline.operators import spans as SP

UNIT = ["session", "record", "family"]


def plain(ls, ps):
    taken = set()
    for unit in {r[:3] for r in ls}:
        edges = []
        for *u, li, a, b in ls:
            for *v, pi, c, d in ps:
                if tuple(u) == unit == tuple(v):
                    n = 1 if b <= a or d <= c else min(b, d) - max(a, c)
                    if n > 0:
                        edges.append((-n, c, li, pi))
        used_l, used_p = set(), set()
        for n, _, li, pi in sorted(edges):
            if li not in used_l and pi not in used_p:
                used_l.add(li)
                used_p.add(pi)
                taken.add((*unit, li, pi, -n))
    return taken


def frames(spark, ls, ps):
    schema = "session string, record string, family string, {0}i long, {0}s long, {0}e long"
    return (spark.createDataFrame(ls, schema.format("l")), spark.createDataFrame(ps, schema.format("p")))


def run(spark, ls, ps, **kw):
    rows = SP.matches(*frames(spark, ls, ps), UNIT, **kw).collect()
    got = [(*[r[u] for u in UNIT], r.li, r.pi, r.overlap) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


def dealt(rng, kind, n):
    """Rows of one unit; kind says which share of them names the whole record."""
    out = []
    for i in range(n):
        a = rng.randrange(-3, 60)
        whole = rng.random() < kind
        out.append((i, a, a - rng.randrange(2) if whole else a + rng.choice((1, 2, 3, 7, 16, 40))))
    return out


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_equals_the_walk_over_all_pairs(spark, rounds):
    rng = random.Random(5)
    ls, ps = [], []
    for k, (a, b) in enumerate([(0, 0), (0, 0), (1, 1), (1, 0), (0, 1), (.3, .3), (.5, .1), (.1, .6), (1, .5), (.5, 1)]):
        for part in range(3):
            unit = (f"s{k}", f"r{part}", "f")
            ls += [(*unit, *r) for r in dealt(rng, a, rng.randrange(1, 14))]
            ps += [(*unit, *r) for r in dealt(rng, b, rng.randrange(1, 14))]
    assert run(spark, ls, ps, rounds=rounds) == plain(ls, ps)


def test_a_chain_longer_than_the_rounds(spark):
    """Each span overlaps the next by one byte more, so that a round settles only the last one."""
    unit, ls, ps, at = ("s", "r", "f"), [], [], 0
    for i in range(40):
        (ls if i % 2 == 0 else ps).append((*unit, i // 2, at, at + 100 + 2 * i))
        at += 100 + 2 * i - (i + 1)
    want = plain(ls, ps)
    assert run(spark, ls, ps, rounds=3) == want


def test_many_spans_on_each_side_of_one_record(spark):
    n, unit = 10_000, ("s", "r", "f")
    ls = [(*unit, i, 10 * i, 10 * i + 8) for i in range(n)] + [(*unit, n, 0, 10 * n)]
    ps = [(*unit, i, 10 * i + 3, 10 * i + 12) for i in range(n)]
    got = run(spark, ls, ps)
    # The long label takes a prediction whole, the first of the equal ones; its own label falls to no other.
    assert (*unit, n, 0, 9) in got
    assert {g for g in got if g[3] not in (n, 0, 1)} == {(*unit, i, i, 5) for i in range(2, n)}
    whole = [(*unit, i, 0, 0) for i in range(n)]
    assert run(spark, whole, whole) == {(*unit, i, i, 1) for i in range(n)}
    mixed = run(spark, whole, ps)
    assert mixed == {(*unit, i, i, 1) for i in range(n)}


def test_nulls_and_empty_tables(spark):
    unit = ("s", "r", "f")
    assert run(spark, [(*unit, 1, None, 4), (None, "r", "f", 2, 0, 4)], [(*unit, 1, 0, 9), (None, "r", "f", 2, 0, 4)]) == set()
    assert run(spark, [], []) == set() == run(spark, [(*unit, 1, 0, 0)], [])
