"""Per-stream projections: summary, multi-session rows, anchors, timeline, semantic operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmline.functions.ordered import RECORD_BLOCK, Run, block_of, running
from helmline.lexicon import DEFAULT as LEXICON
from helmline.lexicon import RULES_VERSION
from helmline.operators import measures as M


def regimes_seen(changes: DataFrame) -> DataFrame:
    """Regimes in order of first occurrence, FLOW first."""
    first = changes.where("to_regime <> 'FLOW'").groupBy("stream_id", "to_regime").agg(
        F.min("seq").alias("at"))
    return first.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("at", "to_regime")))
                                          .alias("r")).select(
        "stream_id",
        F.concat(F.array(F.lit("FLOW")), F.transform("r", lambda x: x["to_regime"]))
        .alias("regimes_seen"))


def last_names(records: DataFrame) -> DataFrame:
    """Latest stream name; the most recent record that carries one wins."""
    return records.where("stream_name is not null").groupBy("stream_id").agg(
        F.max_by("stream_name", "seq").alias("stream_name"))


def session_summary(a) -> DataFrame:
    """One row per stream with counts, regimes, repairs and the final snapshot."""
    per_record = a.records.groupBy("stream_id").agg(
        F.count("*").alias("records"), F.count_if("is_op").alias("operator_turns"),
        (F.max("epoch") + 1).alias("epochs"))
    fixes = a.turns.groupBy("stream_id").agg(F.count_if("is_correction").alias("c"))
    states = a.episodes.where("out = 'event'")
    structural = states.where("kind = 'repair_opened' and structural").groupBy("stream_id").agg(
        F.count("*").alias("s"))
    stated = a.occurrences.groupBy("stream_id").agg(
        F.count_if(F.col("event") == "repeated").alias("obligation_repeat_events"),
        F.count_if(F.col("event") == "revived").alias("obligation_revival_events"))
    released = a.claims.groupBy("stream_id").agg(F.count("*").alias("obligation_release_events"))
    repairs = states.groupBy("stream_id").agg(
        F.count_distinct("repair_id").alias("repair_episodes"),
        F.max("depth").alias("max_repair_depth"), F.max("chars").alias("max_repair_chars"))
    final = a.snapshots.groupBy("stream_id").agg(
        F.max_by(F.struct(*[c for c in a.snapshots.columns if c != "stream_id"]), "turn_index")
        .alias("final"))
    d = per_record
    for other in (fixes, structural, stated, released, repairs, final,
                  regimes_seen(M.regime_changes(a.snapshots)), pollution_history(states)):
        d = d.join(other, "stream_id", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return d.select(
        "stream_id", "records", "operator_turns", "epochs",
        (F.coalesce("c", F.lit(0)) + F.coalesce("s", F.lit(0))).alias("corrections"),
        *[zero(n) for n in ("obligation_repeat_events", "obligation_release_events",
                            "obligation_revival_events", "repair_episodes", "max_repair_depth",
                            "max_repair_chars")],
        F.coalesce("regimes_seen", F.array(F.lit("FLOW"))).alias("regimes_seen"),
        F.coalesce("final.regime", F.lit("FLOW")).alias("final_regime"),
        "pollution_by_repair", "final")


def pollution_history(states: DataFrame) -> DataFrame:
    """Every assessment of every episode, in order."""
    w = states.where("pollution_status is not null").groupBy("stream_id", "repair_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "stretch", "ord", "pollution_status"))).alias("h"))
    per = w.select("stream_id", "repair_id",
                   F.transform("h", lambda x: x["pollution_status"]).alias("statuses"))
    return per.groupBy("stream_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("repair_id", "statuses"))))
        .alias("pollution_by_repair"))


def corpus_rows(a, lex=LEXICON) -> DataFrame:
    """One comparable row per stream. Unknown stays NULL."""
    timed = F.when(F.col("ts").isNotNull(), F.col("seq"))
    base = a.records.groupBy("stream_id").agg(
        F.count("*").alias("record_count"), F.count_if("is_op").alias("operator_turn_count"),
        F.min_by("ts", timed).alias("start_time"), F.max_by("ts", timed).alias("end_time"),
        F.count_if(F.col("is_interrupt") & ~F.col("is_op") & ~F.col("is_agent"))
        .alias("interrupt_count"),
        F.count_if(F.col("input_mode") == "compact_summary").alias("compact_summary_count"))
    ch = M.regime_changes(a.snapshots)
    mark = lambda r: F.min_by(F.struct("seq", "ts", "rule"),
                              F.when(F.col("to_regime") == r, F.col("seq"))).alias(f"first_{r.lower()}")
    changes = ch.groupBy("stream_id").agg(
        mark("DRIFT"), mark("RECOVERY"), mark("THRASH"),
        F.array_sort(F.collect_list(F.struct("seq", "to_regime"))).alias("r"))
    snap = a.snapshots.groupBy("stream_id").agg(
        F.max("serialization_inflation").alias("max_known_si"),
        F.max("control_plane_burden").alias("max_cpb"), F.max_by("regime", "turn_index").alias("final_regime"),
        *[F.max_by(f"pointer_{o}", "turn_index").alias(f"pointer_{o}")
          for o in ("success", "failure", "unknown")])
    summary = session_summary(a).select("stream_id", F.col("corrections").alias("correction_count"),
                                        "repair_episodes", "max_repair_chars", "max_repair_depth")
    d = base.join(changes, "stream_id", "left").join(snap, "stream_id", "left").join(
        summary, "stream_id", "left")
    end, start = F.unix_seconds("end_time"), F.unix_seconds("start_time")
    return d.select(
        "stream_id", "record_count", "operator_turn_count", "start_time", "end_time",
        (end - start).cast("double").alias("duration_seconds"),
        F.lit("heuristic").alias("classifier_name"), F.lit(RULES_VERSION).alias("classifier_version"),
        F.lit(lex.rules_hash()).alias("classifier_hash"),
        "interrupt_count", "correction_count", "compact_summary_count",
        F.concat(F.array(F.lit("FLOW")), F.coalesce(
            F.transform("r", lambda x: x["to_regime"]), F.array().cast("array<string>")))
        .alias("regimes_seen"),
        F.coalesce("final_regime", F.lit("FLOW")).alias("final_regime"),
        "first_drift", "first_recovery", "first_thrash", "max_known_si", "max_cpb",
        "repair_episodes", "max_repair_chars", "max_repair_depth",
        "pointer_success", "pointer_failure", "pointer_unknown")


def top_inflation(snapshots: DataFrame, n: int = 3) -> DataFrame:
    """The n turns with the highest known inflation, ties in turn order.

    Each block of a stream keeps its own n first, so the final ranking sees n rows per block.
    """
    known = snapshots.where("serialization_inflation is not null").withColumn(
        "__blk", block_of(F.col("seq"), RECORD_BLOCK))
    by = [F.col("serialization_inflation").desc(), F.col("seq").asc()]
    local = known.withColumn("rank", F.row_number().over(
        Window.partitionBy("stream_id", "__blk").orderBy(*by))).where(F.col("rank") <= n)
    return local.withColumn("rank", F.row_number().over(
        Window.partitionBy("stream_id").orderBy(*by))).where(F.col("rank") <= n).drop("__blk")


def anchors(a) -> DataFrame:
    """Places worth reading, as source coordinates."""
    rec = a.records.select("stream_id", "seq", "ts", F.col("source.path").alias("path"),
                           F.col("source.offset").alias("offset"))
    ch = M.regime_changes(a.snapshots)
    states = a.episodes.where("out = 'event' and kind = 'repair_opened'")
    first = ch.where("to_regime <> 'FLOW'").groupBy("stream_id").agg(
        F.min_by(F.struct("seq", "rule"), "seq").alias("x")).select("stream_id", "x.seq", "x.rule")

    def kind(df, name, detail=F.lit("")):
        return df.select("stream_id", "seq", F.lit(name).alias("kind"), detail.alias("detail"))

    parts = [
        kind(a.turns.where("is_correction"), "correction"),
        kind(states.where("structural"), "correction"),
        kind(a.records.where("is_interrupt and not is_op and not is_agent"), "interrupt"),
        kind(states, "repair_open"),
        kind(ch.where("to_regime = 'THRASH'"), "thrash_transition", F.col("rule")),
        kind(first, "first_non_flow", F.col("rule")),
        kind(top_inflation(a.snapshots), "top_si", F.format_string(
            "%.1fx over %d chars", F.col("serialization_inflation"), F.col("user_chars"))),
    ]
    return reduce(DataFrame.unionByName, parts).join(rec, ["stream_id", "seq"])


def csv_value(v: Column) -> Column:
    return F.when(v.isNull(), "unknown").otherwise(F.format_string("%.4f", v.cast("double")))


def timeline(snapshots: DataFrame) -> DataFrame:
    """Fifteen printed columns per turn; unknown is spelled out."""
    c = F.col
    return snapshots.select(
        "stream_id", "seq", "epoch", "regime", "regime_rule", "user_chars",
        csv_value(c("baseline_chars")).alias("baseline_chars"),
        csv_value(c("serialization_inflation")).alias("serialization_inflation"),
        csv_value(c("forward_work_share")).alias("forward_work_share"),
        csv_value(c("control_plane_burden")).alias("control_plane_burden"),
        c("unresolved_obligations").alias("unresolved_obligation_candidates"),
        "repeated_obligations", "repair_depth", "repair_chars",
        csv_value(c("dereference")).alias("dereference_proxy"), "pollution_status")


def state_at_stop(a) -> DataFrame:
    """Inventory of what is open when observation stops. No conclusion is drawn."""
    last = a.snapshots.groupBy("stream_id").agg(F.max_by(F.struct(
        "epoch", "unresolved_obligations", "repair_id", "repair_open"), "turn_index").alias("s"))
    still = a.episodes.where("out = 'event' and kind = 'repair_status' and phase = 7 "
                             "and pollution_status is null").select(
        "stream_id", F.col("repair_id").alias("open_repair"))
    pend = a.pointers.where("evidence = 'source_end'").groupBy("stream_id").agg(
        F.count("*").alias("pending_pointers"))
    waiting = a.episodes.where("out = 'event'").groupBy("stream_id", "repair_id").agg(
        F.max_by("status", F.struct("seq", "phase", "ord")).alias("status")).where(
        "status = 'provisionally_closed'").groupBy("stream_id").agg(
        F.count("*").alias("repairs_awaiting_durability"))
    d = last.join(still, "stream_id", "left").join(pend, "stream_id", "left").join(
        waiting, "stream_id", "left")
    return d.select(
        "stream_id", "s.epoch", "open_repair",
        F.coalesce("pending_pointers", F.lit(0)).alias("pending_pointers"),
        F.coalesce("repairs_awaiting_durability", F.lit(0)).alias("repairs_awaiting_durability"),
        F.col("s.unresolved_obligations").alias("unresolved_obligation_candidates"))


def semantic_operations(completions: DataFrame) -> DataFrame:
    """Worker completions per stream: counts by status, nearest-rank latencies, identities.

    Nearest rank: latencies are counted per value first, so a stream is never collected.
    """
    who = F.concat_ws("/", "classifier", "classifier_version", "classifier_hash")
    known = ("completed", "timed_out", "canceled")
    counts = completions.groupBy("stream_id").agg(
        F.count("*").alias("recorded"),
        *[F.count_if(F.col("status") == s).alias(s) for s in known],
        F.count_if(~F.col("status").isin(*known)).alias("failed"),
        F.array_sort(F.collect_set(F.when(F.col("classifier") != "", who))).alias("classifiers"))
    hist = completions.where("latency_ms >= 0").groupBy("stream_id", "latency_ms").agg(
        F.count("*").alias("n"))
    run = running(hist, ["stream_id"], ["latency_ms"], block_of(F.col("latency_ms"), RECORD_BLOCK),
                  {"upto": Run("sum", F.col("n"))})
    total = hist.groupBy("stream_id").agg(F.sum("n").alias("total"))
    rank = lambda p: F.floor((F.col("total") * p + 99) / 100)
    pct = run.join(total, "stream_id").groupBy("stream_id").agg(*[
        F.min(F.when(F.col("upto") >= rank(p), F.col("latency_ms"))).alias(f"p{p}_latency_ms")
        for p in (50, 95)])
    return counts.join(pct, "stream_id", "left")
