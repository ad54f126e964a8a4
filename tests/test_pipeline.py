import math
from collections import defaultdict

import pytest

from helmline.functions.ordered import Layout, layout
from helmline.operators import turns as W
from helmline.plans.pipeline import analyze
from tests import sequential, streams

SKIP = {"repair_no", "lexical_overlap_previous", "lexical_overlap_window"}


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def simulate(feature_rows):
    by = defaultdict(list)
    for r in feature_rows:
        by[r.stream_id].append(r)
    out = {}
    for sid, rows in by.items():
        st = sequential.Stream()
        rows.sort(key=lambda r: r.seq)
        for r in rows:
            st.feed(r)
        st.finish(rows[-1].seq)
        out[sid] = st
    return out


@pytest.mark.parametrize("seed,kw", [
    (1, {}), (2, dict(resets=0.15)), (3, dict(streams=12, length=300, resets=0.0)),
    (4, dict(agents=0.2, resets=0.05)), (5, dict(streams=6, length=260, resets=0.02, blocks=7)),
])
def test_snapshots_equal_brute_force(spark, seed, kw):
    """The last case cuts every stream into tiny blocks, so that the two-level plans run."""
    blocks = kw.pop("blocks", None)
    shape = Layout(record_rows=blocks, turn_rows=blocks) if blocks else Layout()
    with layout(shape):
        a = analyze(streams.frame(spark, seed, **kw))
    sims = simulate(a.records.collect())
    got = defaultdict(dict)
    for r in a.snapshots.collect():
        got[r.stream_id][r.turn_index] = r.asDict()
    overlap = {(r.stream_id, r.turn_index): r for r in W.lexical_overlap(a.sentences).collect()}
    bad = []
    for sid, sim in sims.items():
        assert len(got[sid]) == len(sim.snaps)
        for s in sim.snaps:
            g = got[sid][s["turn_index"]]
            for k, v in s.items():
                if k not in SKIP and not same(g[k], v):
                    bad.append((sid, s["turn_index"], k, g[k], v))
            if (f"rep-{s['repair_no']}" if s["repair_no"] else None) != g["repair_id"]:
                bad.append((sid, s["turn_index"], "repair_id", g["repair_id"], s["repair_no"]))
            o = overlap[sid, s["turn_index"]]
            for k in ("lexical_overlap_previous", "lexical_overlap_window"):
                if not same(o[k], s[k]):
                    bad.append((sid, s["turn_index"], k, o[k], s[k]))
    assert not bad, (len(bad), bad[:10])

    evs = defaultdict(list)
    for r in a.episodes.where("out = 'event'").orderBy("stream_id", "seq", "phase", "stretch", "ord").collect():
        evs[r.stream_id].append((r.seq, r.kind, r.repair_id, r.status, r.depth, r.chars, r.records,
                                 r.pollution_status, r.cycle_records, r.agent_turn, r.target_key,
                                 r.cycle_failed, r.cycle_writes, r.cycle_interrupts, r.last_us))
    for sid, sim in sims.items():
        want = [(e["seq"], e["kind"], f"rep-{e['local_no']}", e["status"], e["depth"], e["chars"],
                 e["records"], e.get("pollution_status"), e.get("cycle_records"), e.get("agent_turn"),
                 e["target_key"], e.get("cycle_failed"), e.get("cycle_writes"),
                 e.get("cycle_interrupts"), e["last_us"]) for e in sim.fold.events]
        assert evs[sid] == want, (sid, [x for x in zip(evs[sid], want) if x[0] != x[1]][:3])

    ptr = defaultdict(set)
    for r in a.pointers.collect():
        ptr[r.stream_id].add((r.seq, r.outcome, r.settled_turn))
    near = defaultdict(list)
    for r in a.near_repeats.collect():
        near[r.stream_id].append((r.seq, r.key, r.prior_key))
    rel = defaultdict(list)
    for r in a.claims.collect():
        rel[r.stream_id].append((r.seq, r.key))
    for sid, sim in sims.items():
        assert ptr[sid] == set(sim.outcomes), sid
        assert sorted(set(near[sid])) == sorted(set(sim.near)), sid
        assert sorted(rel[sid]) == sorted(sim.released), sid
