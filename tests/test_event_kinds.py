"""Every kind of the event log, one checked row each; the kinds that need tables of their own come from these."""

import json

import pytest

from helmline.operators import events as EV
from helmline.plans.pipeline import analyze
from helmline.sources.records import RECORD_SCHEMA
from tests import streams


def row(seq, text="", who="human", writes=(), **more):
    return tuple((dict(
        stream_id="s", turn_id=f"seq-{seq}", seq=seq, ts=None, speaker=who, speaker_class=who, text=text,
        actions=[dict(verb="write", targets=list(writes), argv=[], failed=False)] if writes else None, reply_to=None, source=None,
        metadata=None, sidechain=False, input_mode="") | more).values())


@pytest.fixture(scope="module")
def log(spark):
    rows = [row(1, "Only touch src/a.py. Make sure the tests pass."), row(2, "Done.", "agent", ["src/a.py"]),
            row(3, "Thanks, looks good."), row(4, "Done.", "agent", ["src/a.py", "src/b.py"]), row(5, "Start a new session."),
            row(6, "Never edit the release workflow."), row(7, "ok", "agent")]
    a = analyze(spark.createDataFrame(rows, RECORD_SCHEMA))
    done = spark.createDataFrame([("s", 3, "j1", "completed", "m", "1", "h"), ("s", 99, "j2", "completed", "m", "1", "h")],
                                 "stream_id string, source_seq long, job_id string, status string, classifier string, "
                                 "classifier_version string, input_hash string")
    failed = spark.createDataFrame([("s", 6, "m", "1", "no answer")], "stream_id string, seq long, classifier string, version string, error string")
    stops = spark.createDataFrame([("s", "operator"), ("other", "operator")], "stream_id string, reason string")
    return [r.asDict() | {"p": json.loads(r.payload)} for r in EV.with_ids(EV.event_log(a, done, failed, stops)).orderBy(
        "seq", "emit_rank", "sub", "item").collect()]


def of(log, kind):
    return [r for r in log if r["kind"] == kind]


def test_structural_correction(log):
    found = [r for r in of(log, "correction_candidate") if r["p"]["correction_marker"] == "structural"]
    assert [(r["seq"], r["epoch"], r["class"], r["p"]["target_key"], r["p"]["target_paths"], r["p"]["source_turn"]) for r in found] == [
        (4, 0, "classified", "src/a.py", ["src/a.py"], 3)]
    opened = of(log, "repair_opened")[0]
    assert found[0]["emit_rank"] < opened["emit_rank"] and found[0]["p"]["trigger_agent_turn"] == 2


def test_epoch_names_what_became_unknown(log):
    (r,) = of(log, "epoch_advanced")
    keys = r["p"]["obligations_marked_unknown"]
    assert r["seq"] == 5 and (r["p"]["from"], r["p"]["to"]) == (0, 1)
    stated = [x["p"]["key"] for x in of(log, "obligation_introduced") if x["epoch"] == 0]
    assert keys == stated and len(keys) == 2


def test_failure_and_completion(log):
    (failed,), (done,) = of(log, "classifier_failed"), of(log, "semantic_classification_completed")
    assert (failed["seq"], failed["epoch"], failed["p"]["error"]) == (6, 1, "no answer")
    assert (done["seq"], done["epoch"], done["p"]["job_id"], done["p"]["status"]) == (3, 0, "j1", "completed")


def test_stop_and_inventory(log):
    (stopped,), (held,) = of(log, "observation_stopped"), of(log, "state_at_observation_stop")
    assert (stopped["seq"], stopped["class"], stopped["p"]) == (7, "observed", {"reason": "operator", "last_record": 7})
    assert (held["seq"], held["epoch"], held["p"]["epoch"]) == (7, 1, 1)
    assert held["p"]["unresolved_obligation_candidates"] == 1 and held["p"]["pending_pointers"] == 0
    assert [r["kind"] for r in log][-2:] == ["observation_stopped", "state_at_observation_stop"]


def test_every_kind_of_a_file_can_be_made(spark, log):
    """The kinds named in FILES all come out of some analysis; identifiers are unique."""
    near = [row(i + 1, t, stream_id="near") for i, t in enumerate(("Never edit the release workflow.", "Never edit the release workflow today."))]
    a = analyze(streams.frame(spark, 31, streams=12, length=80, resets=0.05).unionByName(spark.createDataFrame(near, RECORD_SCHEMA)))
    kinds = {r.kind for r in EV.event_log(a).select("kind").distinct().collect()} | {r["kind"] for r in log}
    named = {k for ks in EV.FILES.values() for k in ks}
    assert named <= kinds, named - kinds
    assert len({r["id"] for r in log}) == len(log)
