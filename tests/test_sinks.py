"""Upserts that survive a killed and a repeated batch; completions joined as they arrive against the batch selection."""

import json

from pyspark.sql import functions as F

from helmline.operators.semantic import select_completions
from helmline.streaming import sinks

ROW = "stream_id string, seq long, note string"


def test_killed_and_repeated_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "latest")
    upsert = sinks.keep_latest(path, buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, ROW)
    shown = lambda: sorted(tuple(r) for r in sinks.latest(spark, path).collect())
    first = [(f"s{i}", 1, "old") for i in range(9)]
    upsert(frame(first), 0)
    assert shown() == sorted(first)
    second = frame([("s1", 3, "new"), ("s1", 2, "between"), ("s12", 1, "old"), ("s2", 0, "older")])
    want = sorted([r for r in first if r[0] != "s1"] + [("s1", 3, "new"), ("s12", 1, "old")])

    write = sinks._write

    def killed(df, to, by):
        if to.endswith("manifest"):
            raise RuntimeError("killed")
        write(df, to, by)

    monkeypatch.setattr(sinks, "_write", killed)
    try:
        upsert(second, 1)
    except RuntimeError:
        pass
    assert shown() == sorted(first)
    monkeypatch.setattr(sinks, "_write", write)
    for _ in range(2):
        upsert(second, 1)
        assert shown() == want
    upsert(frame([]), 2)
    assert shown() == want


def test_followed_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        rows = [dict(stream_id=f"s{k}", seq=10 * i + k, note=str(i)) for k in range(5) if (k + i) % 2]
        (src / f"{i}.json").write_text("\n".join(map(json.dumps, rows)) + "\n")
        q = sinks.follow_latest(spark.readStream.schema(ROW).json(str(src)), str(tmp_path / "t"), str(tmp_path / "chk"))
        assert q.awaitTermination(120) and q.exception() is None
    got = {r.stream_id: (r.seq, r.note) for r in sinks.latest(spark, str(tmp_path / "t")).collect()}
    assert got == {"s0": (10, "1"), "s1": (21, "2"), "s2": (12, "1"), "s3": (23, "2"), "s4": (14, "1")}


def test_completions_as_they_arrive(spark, tmp_path):
    who = ("judge", "1", "h")
    at = lambda m: f"2024-05-01T{10 + m // 60:02}:{m % 60:02}:00Z"
    asked = [dict(stream_id=f"s{i % 3}", seq=i, input_hash=f"x{i}", asked_at=at(i)) for i in range(12)]

    def done(i, m, job="", **more):
        return dict(stream_id=f"s{i % 3}", source_seq=i, input_hash=f"x{i}", status="completed", result=f"r{i}", job_id=f"j{i}{job}",
                    classifier="judge", classifier_version="1", classifier_hash="h", completed_at=at(m)) | more

    completions = [done(0, 5), done(1, 20), done(2, 8), done(2, 9, "b"), done(3, 30, status="timed_out"), done(4, 12, classifier="other"),
                   done(5, 40), done(6, 50, result=None), done(7, 45, input_hash="y"), done(9, 30)]
    far = [dict(stream_id="tick", seq=1, input_hash="t", asked_at=at(400))], [done(999, 400)]
    left, right = tmp_path / "asked", tmp_path / "done"
    schema = ("stream_id string, source_seq long, input_hash string, status string, result string, job_id string, classifier string, "
              "classifier_version string, classifier_hash string, completed_at timestamp")
    asked_schema = "stream_id string, seq long, input_hash string, asked_at timestamp"
    left.mkdir(), right.mkdir()
    for i, (a, b) in enumerate([(asked[:7], completions[:4]), (asked[7:], completions[4:]), far]):
        (left / f"{i}.json").write_text("\n".join(map(json.dumps, a)) + "\n")
        (right / f"{i}.json").write_text("\n".join(map(json.dumps, b)) + "\n")
        joined = sinks.with_completions(spark.readStream.schema(asked_schema).json(str(left)), spark.readStream.schema(schema).json(str(right)), who)
        q = joined.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(200) and q.exception() is None
    good, bad = sinks.selected(spark.read.parquet(str(tmp_path / "out")))
    want_good, want_bad = select_completions(
        spark.read.schema(asked_schema).json(str(left)).where("stream_id <> 'tick'"), spark.read.schema(schema).json(str(right)), who)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(good) == rows(want_good) and rows(bad) == rows(want_bad) and len(rows(bad)) == 8
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("job_id").isNull()).count() == 7
