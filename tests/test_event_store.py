"""The event log as a store: buckets, refusal, replacement, writes that end half way."""

import pytest
from pyspark.sql import functions as F

from helmline.operators import events as EV


def rows(spark, streams, n=3, note=""):
    d = spark.createDataFrame([(s, i, k) for s in streams for i in range(n) for k in ("record_observed", "repair_opened")],
                              "stream_id string, seq long, kind string")
    return d.select("stream_id", "seq", F.lit(1).alias("emit_rank"), F.lit(0).alias("sub"), F.lit("").alias("item"),
                    F.lit(0).alias("epoch"), "kind", F.lit("observed").alias("class"), F.lit(note).alias("payload"))


def held(spark, root, kind=None):
    return sorted((r.stream_id, r.seq, r.kind, r.payload) for r in EV.read_events(spark, root, kind).collect())


def held_any(spark, root):
    return EV.read_events(spark, root).collect()


def test_writes_add_streams_and_refuse_known_ones(spark, tmp_path):
    root = str(tmp_path / "log")
    EV.write_events(rows(spark, ["a", "b"]), root, buckets=4)
    EV.write_events(rows(spark, ["c", None]), root)
    assert EV.read_events(spark, root).count() == 4 * 6
    with pytest.raises(ValueError, match="already exists"):
        EV.write_events(rows(spark, ["d", "a"], note="again"), root)
    assert EV.read_events(spark, root).where("stream_id = 'd' or payload = 'again'").isEmpty()
    assert EV.read_events(spark, root, "repair_opened").count() == 4 * 3
    folders = {p.name for p in (tmp_path / "log" / "data").rglob("bucket=*")}
    assert len(folders) <= 4


def test_force_replaces_only_the_streams_it_holds(spark, tmp_path):
    root, names = str(tmp_path / "log"), [f"s{i}" for i in range(12)]
    EV.write_events(rows(spark, names, note="old"), root, buckets=3)
    EV.write_events(rows(spark, ["s0", "s5"], n=1, note="new"), root, force=True)
    got = held(spark, root)
    assert len(got) == len(set(got)) == 10 * 6 + 2 * 2
    assert {g[3] for g in got if g[0] in ("s0", "s5")} == {"new"} and {g[3] for g in got if g[0] not in ("s0", "s5")} == {"old"}


def test_a_write_that_ends_half_way_is_not_readable(spark, tmp_path):
    root = str(tmp_path / "log")
    with pytest.raises(ValueError, match="no complete write"):
        EV.read_events(spark, root)
    EV.write_events(rows(spark, ["a"]), root, buckets=2)
    before = held(spark, root)
    # Killed before the manifest, and killed while writing it.
    EV._put(rows(spark, ["x"]).withColumn("file", EV.file_for(F.col("kind"))), root, "lost", 2)
    assert held(spark, root) == before
    (tmp_path / "log" / "manifest" / "0000000001.json").write_text('{"version": 1, "write": "lost", "buckets": [0, 1')
    assert held(spark, root) == before
    failing = rows(spark, ["y"]).withColumn("payload", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        EV.write_events(failing, root)
    assert held(spark, root) == before
    EV.write_events(rows(spark, ["z", None]), root)
    assert len(held_any(spark, root)) == 3 * 6
    with pytest.raises(ValueError, match="already exists"):
        EV.write_events(rows(spark, [None]), root)


def test_many_small_writes_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(EV, "_SIDE_BY_SIDE", 3)
    root = str(tmp_path / "log")
    for i in range(6):
        EV.write_events(rows(spark, [f"s{i}"], n=1, note=str(i)), root, buckets=1)
    assert sorted({(r.stream_id, r.payload) for r in held_any(spark, root)}) == [(f"s{i}", str(i)) for i in range(6)]
    assert len(held_any(spark, root)) == 12
    assert all(len(w) <= 3 for w in EV._live(EV._commits(spark, root)).values())


def test_an_empty_write_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "log")
    EV.write_events(rows(spark, ["a"]), root)
    EV.write_events(rows(spark, []), root)
    assert EV.read_events(spark, root).count() == 6
