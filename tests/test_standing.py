"""Claims of release sentences, medians of the standing set, and connected groups, against plain loops."""

import random
import statistics

import pytest

from helmline.functions.components import connected
from helmline.functions.ordered import Layout, layout
from helmline.operators import obligations as O


def test_connected_groups(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(170)]
    links += [(7, 7), (None, 3), (8, None), (101, 100)] + [(5000, n) for n in range(5001, 5040)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    rows = connected(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert len(rows) == len(parent) and {r.node: r.group for r in rows} == {n: root(n) for n in parent}
    assert connected(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b").count() == 0


def standing_table(rng, turns, identities):
    """Ledger rows and introductions of one epoch, requirements stated and released at random."""
    led, intro, state, medians = [], [], {}, {}
    first = {}
    for t in range(1, turns + 1):
        pos, changed = 0, False
        for i in rng.sample(range(identities), rng.randrange(0, min(5, identities + 1))):
            was = state.get(i)
            now = "released" if was is not None and rng.random() < 0.45 else "unresolved"
            if was is None:
                first[i] = t
                intro.append((f"i{i}", t, pos))
                pos += 1
            led.append((f"i{i}", t, was, now, now == "released"))
            changed |= (was == "unresolved") != (now == "unresolved")
            state[i] = now
        if changed:
            stand = [first[i] for i, s in state.items() if s == "unresolved"]
            medians[t] = statistics.median(stand) if stand else None
    return led, intro, medians


@pytest.mark.parametrize("rows", [1 << 13, 16, 3])
def test_medians_in_spans(spark, rows):
    rng = random.Random(5)
    led, intro, want = [], [], {}
    for s, (turns, identities) in enumerate([(150, 40), (90, 400), (40, 3), (1, 5), (60, 60)]):
        a, b, c = standing_table(rng, turns, identities)
        led += [(f"s{s}", s, *r) for r in a]
        intro += [(f"s{s}", s, *r) for r in b]
        want |= {(f"s{s}", t): m for t, m in c.items()}
    key = "stream_id string, epoch_before long, identity string, turn_index long, "
    with layout(Layout(turn_rows=rows)):
        got = O.standing_medians(spark.createDataFrame(led, key + "prev_state string, end_state string, released boolean"),
                                 spark.createDataFrame(intro, key + "pos int")).collect()
        assert O.standing_medians(spark.createDataFrame([], key + "prev_state string, end_state string, released boolean"),
                                  spark.createDataFrame([], key + "pos int")).count() == 0
    assert len(got) == len(want) and {(r.stream_id, r.turn_index): r.median_index for r in got} == want


def claimed_by_hand(pairs, last):
    """One sentence after the other; a requirement is taken once a turn and is gone until it is stated again."""
    out, gone = [], {}
    for turn in sorted({p[0] for p in pairs}):
        taken = set()
        for pos in sorted({p[1] for p in pairs if p[0] == turn}):
            free = [p for p in pairs if p[:2] == (turn, pos) and p[2] not in taken
                    and not gone.get(p[2], -1) > last[p[2], turn]]
            best = [p for p in free if p[3] == max(f[3] for f in free)]
            if len(best) == 1:
                taken.add(best[0][2])
                out.append((turn, pos, best[0][2]))
        gone |= {i: turn for i in taken}
    return out


@pytest.mark.parametrize("crowd", [3, 12])
def test_claims_by_connected_requirements(spark, crowd):
    """crowd: how many requirements a sentence may match, so that there are groups of one and of many."""
    rng = random.Random(crowd)
    stated, pairs, want = [], [], []
    for s in range(6):
        said = {(i, t) for i in range(12) for t in [i % 4, *rng.sample(range(1, 60), 4)]}
        stated += [(f"s{s}", 0, f"i{i:02}", t) for i, t in said]
        mine = []
        for t in range(12, 60):
            for pos in range(rng.randrange(0, 3)):
                width = rng.choice([1, 1, crowd])
                at = rng.randrange(0, 13 - width)
                mine += [(t, pos, f"i{i:02}", rng.choice([0.5, 0.75, 1.0])) for i in range(at, at + width)]
        last = {(f"i{i:02}", t): max(u for j, u in said if j == i and u < t) for i in range(12) for t in range(12, 60)}
        want += [(f"s{s}", *c) for c in claimed_by_hand(mine, last)]
        pairs += [(f"s{s}", 0, i, t, t, f"t{t}", pos, i, "drop", cover) for t, pos, i, cover in mine]
    occ = spark.createDataFrame(stated, "stream_id string, epoch_before long, identity string, turn_index long")
    d = spark.createDataFrame(pairs, "stream_id string, epoch_before long, identity string, turn_index long, seq long, "
                                     "turn_id string, pos int, key string, marker string, cover double")
    got = O.releases(d, occ).collect()
    assert sorted((r.stream_id, r.turn_index, r.pos, r.identity) for r in got) == sorted(want)
    assert {(r.key == r.identity, r.turn_id == f"t{r.turn_index}") for r in got} == {(True, True)}
    assert O.releases(d.limit(0), occ).count() == 0
