"""Live snapshots, gaps, trends and the inventory at a stop against the batch run of the same rows."""

import json
import random

import pytest

from helmline.operators import summary
from helmline.plans.pipeline import analyze
from helmline.sources.records import RECORD_SCHEMA
from helmline.streaming import live as LV
from helmline.streaming import snapshots as S
from tests import streams


def close(a, b):
    return abs(a - b) < 1e-9 if isinstance(a, float) and isinstance(b, float) else a == b


def run(query, checkpoint, out):
    q = query.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start(out)
    assert q.awaitTermination(280)
    assert q.exception() is None


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """Shuffled, repeated and partly lost records over three runs; the batch run of those that arrived."""
    tmp = tmp_path_factory.mktemp("live")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    S.configure(spark)
    df = streams.frame(spark, 21, streams=9, length=110, resets=0.05)
    rows = [json.loads(x) for x in df.toJSON().collect()]
    longest = {r["stream_id"]: max(q["seq"] for q in rows if q["stream_id"] == r["stream_id"]) for r in rows}
    rng = random.Random(5)
    gone = {(s, q) for s, n in longest.items() for q in (4, 5, 17) if q < n - 2}
    late = [r for r in rows if (r["stream_id"], r["seq"]) == ("r0", 4)]
    kept = [r for r in rows if (r["stream_id"], r["seq"]) not in gone]
    parts = [kept[k::3] for k in range(3)]
    parts[1] += rng.sample(kept, 15)
    for p in parts:
        rng.shuffle(p)
    tick = dict(kept[0], stream_id="tick", seq=1, turn_id="seq-1", speaker_class="tool", text="", actions=None)
    src = tmp / "in"
    src.mkdir()
    emitted, check = str(tmp / "out"), str(tmp / "chk")
    # Nothing is given up within ten minutes; the record of another stream half an hour later moves the watermark on.
    for i, (minute, part) in enumerate(zip((0, 1, 2, 30, 31), [*parts, [tick], [*late, dict(tick, seq=2, turn_id="seq-2")]])):
        part = [dict(r, arrival=f"2024-05-01T10:{minute:02}:00Z") for r in part]
        (src / f"p{i}.json").write_text("\n".join(map(json.dumps, part)) + "\n", encoding="utf-8")
        run(S.live(LV.follow(spark, str(src), RECORD_SCHEMA + ", arrival timestamp"), delay="10 minutes"), check, emitted)
    arrived = spark.read.schema(RECORD_SCHEMA).json([str(src / f"p{i}.json") for i in range(4)]).dropDuplicates(["stream_id", "seq"])
    yield spark.read.parquet(emitted), check, analyze(arrived), arrived, tmp, late
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_snapshot_column(both):
    emitted, _, batch, *_ = both
    kinds = lambda d: [(f.name, f.dataType.simpleString()) for f in d.schema.fields]
    assert kinds(S.turns(emitted)) == kinds(batch.snapshots)
    want = {(r.stream_id, r.seq): r.asDict() for r in batch.snapshots.collect()}
    got = {(r.stream_id, r.seq): r.asDict() for r in S.turns(emitted).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    for k, row in want.items():
        assert row.keys() == got[k].keys()
        for name, value in row.items():
            assert close(got[k][name], value), (k, name, got[k][name], value)


def test_gaps_and_late_records(both):
    emitted, _, _, arrived, _, late = both
    key = lambda r: (r.stream_id, r.from_seq, r.to_seq)
    want = sorted(map(key, S.gaps(arrived).collect()))
    assert sorted(map(key, S.lost(emitted).collect())) == want and len(want) >= 5
    assert [(r.stream_id, r.seq) for r in emitted.where("kind = 'late'").collect()] == [(r["stream_id"], r["seq"]) for r in late]


def test_trends(spark, both):
    emitted, _, batch, _, tmp, _ = both
    S.turns(emitted).write.parquet(str(tmp / "snapshots" / "a"))
    snapshots = spark.readStream.schema(batch.snapshots.schema).parquet(str(tmp / "snapshots" / "a"))
    run(S.trends(snapshots), str(tmp / "trend-chk"), str(tmp / "trends"))
    rows = lambda d: sorted(tuple(r[c] for c in batch.trends.columns) for r in d.collect())
    assert rows(spark.read.parquet(str(tmp / "trends"))) == rows(batch.trends)


def test_inventory_at_a_stop(spark, both):
    _, check, batch, *_ = both
    want = {r.stream_id: r.asDict() for r in summary.state_at_stop(batch).collect()}
    got = {r.stream_id: r.asDict() for r in S.state_at_stop(spark, check).collect()}
    assert got == want
    events = S.stop_events(spark, check, "operator").collect()
    assert {(r.stream_id, r.kind) for r in events} >= {(s, k) for s in want for k in ("observation_stopped", "state_at_observation_stop")}
    assert all(json.loads(r.payload).get("epoch", 0) >= 0 for r in events)


def test_only_what_changed_is_written():
    """A batch that touches one requirement writes one entry."""
    class Map:
        def __init__(self):
            self.held, self.writes = {("a",): ('{"n": 1}',), ("b",): ('{"n": 2}',), ("c",): ('{"n": 3}',)}, []

        def exists(self):
            return bool(self.held)

        def iterator(self):
            return iter(self.held.items())

        def updateValue(self, k, v):
            self.writes.append(k)

        def removeKey(self, k):
            self.writes.append(("gone", *k))

    m = Map()
    t = S.Table(m)
    t.now["b"]["n"] = 5
    del t.now["c"]
    t.save()
    assert sorted(m.writes) == [("b",), ("gone", "c")]
