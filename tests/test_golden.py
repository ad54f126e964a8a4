"""Small whole conversations with stated properties, written for this suite."""

import datetime as dt

import pytest

from helmline.operators import events as EV
from helmline.operators import labels as L
from helmline.operators import summary as SU
from helmline.operators.units import cycle_context, excerpt
from helmline.plans.pipeline import analyze
from helmline.sources.records import RECORD_SCHEMA


def talk(stream, *turns):
    rows, now = [], dt.datetime(2026, 3, 2, 9)
    for seq, (who, text, *writes) in enumerate(turns, 1):
        now += dt.timedelta(seconds=60)
        acts = [dict(verb="write", targets=list(writes), argv=[], failed=False)] if writes else None
        rows.append((stream, f"seq-{seq}", seq, now, who, {"u": "human", "a": "agent", "i": "system"}[who], text,
                     acts, None, None, None, False, "interrupt" if who == "i" else ""))
    return rows


def calm(n):
    out = []
    for i in range(n):
        out += [("u", f"Add the parser case number {i} to the module."), ("a", "Done.")]
    return out


STREAMS = (
    talk("healthy", *calm(14))
    + talk("rescue", *calm(3), ("u", "No, wrong file src/x.py."), ("a", "Reverted it.", "src/x.py"),
           ("u", "Thanks, looks good."), ("a", "Ok."), *calm(12))
    + talk("released", ("u", "Never edit the release workflow."), ("a", "Ok."),
           ("u", "Forget about the release workflow edit."), ("a", "Ok."),
           ("u", "Never edit the release workflow."), ("a", "Ok."))
    + talk("thrash", *calm(9), ("u", "No, only touch the parser."), ("a", "Ok."),
           ("u", "No, only touch the parser."), ("a", "Ok."), ("u", "No, only touch the parser."), ("a", "Ok."),
           ("u", "Start a new session."), ("a", "Hi."), ("u", "Add a test."))
    + talk("rewrite", ("u", "Add it."), ("a", "Done.", "a.py"), ("u", "plain words"), ("a", "Again.", "a.py"),
           ("i", "stop"), ("i", "stop"), ("u", "Fix it."))
)


@pytest.fixture(scope="module")
def a(spark):
    return analyze(spark.createDataFrame(STREAMS, RECORD_SCHEMA))


def test_summaries(a):
    s = {r.stream_id: r for r in SU.session_summary(a).collect()}
    assert s["healthy"].corrections == 0 and s["healthy"].regimes_seen == ["FLOW"]
    assert s["healthy"].repair_episodes == 0 and s["healthy"].operator_turns == 14
    r = s["rescue"]
    assert (r.corrections, r.repair_episodes, r.max_repair_depth) == (1, 1, 1)
    assert r.regimes_seen == ["FLOW", "RECOVERY"] and r.final_regime == "FLOW"
    assert r.pollution_by_repair == {"rep-1": ["clean"]}
    assert s["released"].obligation_release_events == 1 and s["released"].obligation_revival_events == 1
    t = s["thrash"]
    assert t.max_repair_depth == 3 and "THRASH" in t.regimes_seen and t.regimes_seen[-1] == "RESET"
    assert t.epochs == 2 and t.obligation_repeat_events >= 2
    assert s["rewrite"].corrections == 1 and s["rewrite"].repair_episodes == 1


def test_unknown_is_never_zero(a):
    first = a.snapshots.where("turn_index = 1").collect()
    assert all(r.baseline_chars is None and r.serialization_inflation is None and r.dereference is None for r in first)


def test_durable_close_and_interrupts(a):
    kinds = [r.kind for r in a.episodes.where("stream_id = 'rescue' and out = 'event'").orderBy("seq", "phase", "ord").collect()]
    assert kinds == ["repair_opened", "repair_status", "repair_provisionally_closed", "repair_durably_closed"]
    last = a.snapshots.where("stream_id = 'rewrite'").orderBy("turn_index").collect()[-1]
    assert last.recent_interrupts == 2 and last.recent_corrections == 1
    assert last.regime_rule == "drift_control_actions"


def test_event_log_is_append_only_and_routed(spark, a, tmp_path):
    log = EV.with_ids(EV.event_log(a))
    root = str(tmp_path / "log")
    EV.write_events(log, root)
    with pytest.raises(Exception, match="already exists"):
        EV.write_events(log, root)
    EV.write_events(log, root, force=True)
    back = EV.read_events(spark, root)
    assert back.count() == log.count() == back.select("id").distinct().count()
    one = EV.read_events(spark, root, "repair_opened")
    assert {r.file for r in one.select("file").distinct().collect()} == {"repairs"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(file" in plan
    # Folding the log forward gives the same final status per episode.
    again = EV.with_ids(EV.event_log(a)).select("id").exceptAll(log.select("id"))
    assert again.count() == 0


def test_predictions_and_context(spark, a):
    from helmline.lexicon import DEFAULT

    p = {(r.session, r.record, r.family, r.value) for r in L.predictions(a, DEFAULT).collect()}
    assert ("rescue", "seq-7", "recovery", "opens") in p and ("rescue", "seq-7", "pollution", "clean") in p
    assert ("released", "seq-3", "obligation_pair", "releases") in p
    records = spark.createDataFrame(STREAMS, RECORD_SCHEMA)
    c = {(r.session, r.turn_index): r for r in cycle_context(records, a.records).collect()}
    r = c["rescue", 5]
    assert r.cycle_writes == ["src/x.py"] and r.agent_said == "Reverted it." and r.prior_operator_text == "No, wrong file src/x.py."
    assert c["rescue", 4].response_writes == ["src/x.py"] and c["rescue", 4].next_operator_text == "Thanks, looks good."
    assert c["rewrite", 3].cycle_interrupted and c["rewrite", 3].earlier_writes == ["a.py"]


def test_excerpt_cuts_on_characters(spark):
    texts = ["a" * 599 + "é" + "b", "é" * 301, "x" * 600, "€" * 200 + "y", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", excerpt(df.t).alias("x")).orderBy("i").collect()]

    def want(s):
        raw = s.encode()
        return s if len(raw) <= 600 else raw[:600].decode(errors="ignore") + "…"

    assert got == [want(t) for t in texts]


def test_alignment_is_greedy_and_survives_resegmentation(spark):
    ls = spark.createDataFrame([
        ("s", "r", "obligation", 0, 10, "directive", "me", 1), ("s", "r", "obligation", 10, 30, "description", "me", 2),
        ("", "q", "recovery", 0, 0, "opens", "me", 3), ("s", "z", "obligation", 0, 5, "directive", "me", 4)],
        "session string, record string, family string, start long, end long, label string, labeler string, li long")
    ps = spark.createDataFrame([
        ("s", "r", "obligation", 0, 14, "directive", 1), ("s", "r", "obligation", 8, 30, "description", 2),
        ("t", "q", "recovery", 0, 0, "opens", 3), ("s", "w", "obligation", 0, 5, "directive", 4)],
        "session string, record string, family string, start long, end long, value string, pi long")
    got = sorted((r.record, r.label, r.value, r.overlap) for r in L.align(ls, ps).where("label is not null and value is not null").collect())
    assert got == [("q", "opens", "opens", 1), ("r", "description", "description", 20), ("r", "directive", "directive", 10)]
    rest = L.align(ls, ps).where("label is null or value is null").count()
    assert rest == 2
    s = {r.family: r for r in L.score(L.align(ls, ps)).collect()}
    assert s["obligation"].false_negatives == 1 and s["obligation"].precision == 1.0
    assert L.score(L.align(ls, ps.where("pi = 4"))).where("family = 'recovery'").first().precision is None


def test_results_do_not_depend_on_partitions(spark, a):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = analyze(spark.createDataFrame(STREAMS, RECORD_SCHEMA))
        assert b.snapshots.exceptAll(a.snapshots).count() == 0 == a.snapshots.exceptAll(b.snapshots).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
