import json
import random

from helmline.plans.pipeline import analyze
from helmline.streaming import live as LV
from tests import streams

SAME = ("epoch", "new_obligations", "unresolved_obligations", "repeated_obligations", "released_obligations",
        "repair_open", "repair_depth", "repair_chars", "repair_records", "repair_status", "pollution_status")


def test_stream_equals_batch(spark, tmp_path):
    """Rows arrive shuffled, repeated and over several batches; the turns are those of the batch run."""
    df = streams.frame(spark, 11, streams=6, length=70, resets=0.05)
    rows = [json.loads(x) for x in df.toJSON().collect()]
    rng = random.Random(3)
    rows += rng.sample(rows, 20)
    rng.shuffle(rows)
    src = tmp_path / "in"
    src.mkdir()
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    for i in range(3):
        part = rows[i::3]
        (src / f"p{i}.json").write_text("\n".join(json.dumps(r) for r in part) + "\n", encoding="utf-8")
        q = LV.append_to(LV.live_turns(LV.follow(spark, str(src))), out, chk)
        q.awaitTermination(240)
        assert q.exception() is None
    live = {(r.stream_id, r.seq): r for r in spark.read.parquet(out).collect()}
    batch = {(r.stream_id, r.seq): r for r in analyze(df).snapshots.collect()}
    assert live.keys() == batch.keys() and len(live) > 50
    for k, b in batch.items():
        a = live[k]
        for name in SAME:
            assert a[name] == b[name], (k, name, a[name], b[name])
        assert (f"rep-{a.repair_no}" if a.repair_no else None) == b.repair_id
    last = {r.stream_id: r.seq for r in LV.latest(spark.read.parquet(out)).collect()}
    assert last == {s: max(q for t, q in live if t == s) for s in last}
