"""The whole analysis of a corpus of records, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmline.config import DEFAULT as CONFIG
from helmline.functions.ordered import (
    TURN_BLOCK, Layout, Run, block_of, current, layout, running,
)
from helmline.lexicon import DEFAULT as LEXICON
from helmline.operators import episodes as E
from helmline.operators import measures as M
from helmline.operators import obligations as O
from helmline.operators import pointers as P
from helmline.operators import turns as W
from helmline.operators.features import record_features
from helmline.plans.stage import stage

KEY = ["stream_id", "turn_index"]
# Nested columns that stay with the sentence table and are not moved through later windows and joins.
NESTED = ("segs", "cands", "kept", "tokens", "line_norms", "release_sents", "restated", "path_targets",
          "write_paths", "snippet", "source", "named_paths")
CAPABILITIES = ("obligation_release", "verified_repair")


@dataclass
class Analysis:
    """Tables of one run. Everything downstream (events, summaries, predictions) reads these."""

    records: DataFrame      # sequenced feature rows
    sentences: DataFrame    # operator turns with their nested sentences, candidates and tokens
    turns: DataFrame        # operator turns with corrections, stretches and bucket characters
    cycles: DataFrame
    overlap: DataFrame
    occurrences: DataFrame  # obligation statements with their event
    introductions: DataFrame
    claims: DataFrame       # releases
    ledger: DataFrame
    violations: DataFrame
    near_repeats: DataFrame
    episodes: DataFrame     # fold output: transitions and per-turn episode state
    pointers: DataFrame
    snapshots: DataFrame
    trends: DataFrame


def turn_table(sequenced: DataFrame, config=CONFIG) -> DataFrame:
    """Operator turns with restatement resolved into bucket characters."""
    turns = W.operator_turns(sequenced)
    d = turns.join(W.restated_sentences(turns, config), KEY, "left")
    d = d.withColumn("b", W.bucket_chars(F.col("segs"), F.col("restated")))
    none = F.lit(False)
    steering = (
        (F.col("b.control") > 0) | (F.col("b.handoff") > 0) | (F.col("b.restate") > 0)
        | (F.col("b.recovery") > 0)
    )
    return d.withColumns({
        "moves": F.coalesce("acceptance", none) | (F.col("b.forward") > 0),
        "on_episode": F.coalesce("continuation", none) | F.coalesce("stop", none) | steering,
    })


#: Settings of the session: how streams are computed, and the rows of one block.
STREAMS, RECORD_ROWS, TURN_ROWS = "spark.helmline.streams", "spark.helmline.block.records", "spark.helmline.block.turns"


def fitting_layout(features: DataFrame) -> Layout:
    """How ordered values are computed; the rows are the same either way.

    `spark.helmline.streams` says `cut` (always by blocks), `whole` (plain windows) or `auto`, the default: by blocks
    once some stream is longer than one. `spark.helmline.block.records` and `.turns` set the rows of a block.
    """
    base, conf = current(), features.sparkSession.conf
    base = replace(base, record_rows=int(conf.get(RECORD_ROWS, str(base.record_rows))),
                   turn_rows=int(conf.get(TURN_ROWS, str(base.turn_rows))))
    how = conf.get(STREAMS, "auto")
    if how not in ("auto", "cut", "whole"):
        raise ValueError(f"{STREAMS}: {how!r} is none of auto, cut, whole")
    if how != "auto":
        return replace(base, split=how == "cut")
    longest = features.agg(F.max("seq")).first()[0] or 0
    return replace(base, split=base.split and longest >= min(base.record_rows, base.turn_rows))


def analyze(records: DataFrame, lex=LEXICON, config=CONFIG) -> Analysis:
    feats = stage(record_features(records, lex, config), "features")
    with layout(fitting_layout(feats)):
        return _analyze(feats, lex, config)


def _analyze(feats: DataFrame, lex, config) -> Analysis:
    seqd = stage(W.sequence(feats), "sequenced")
    turns0 = stage(turn_table(seqd, config), "turns")

    occ = stage(O.occurrences(turns0), "occurrences")
    intro = stage(O.introductions(occ), "introductions")
    pairs = stage(O.release_pairs(turns0, intro, lex), "pairs")
    claims = stage(O.releases(pairs, occ), "claims")
    led = stage(O.ledger(occ, claims), "ledger")
    stated = O.statements(occ, led)

    cyc = stage(E.cycles(seqd), "cycles")
    overlap = E.write_overlap(seqd)
    turns1 = E.decide_corrections(turns0, stated).drop(*NESTED)
    turns = stage(E.with_stretches(stage(turns1, "corrections"), cyc, overlap, config), "stretches")
    rows = E.fold_rows(turns, seqd, cyc, config)
    episodes = stage(E.number_repairs(stage(E.fold_episodes(rows, config), "folded")), "episodes")
    states = stage(E.turn_states(turns, episodes), "states")

    outs = stage(P.outcomes(turns, config), "pointers")
    viol = O.violations(stated, turns, intro)
    snaps = stage(snapshots(turns, turns0, cyc, states, episodes, outs, led, intro, viol, config),
                  "snapshots")
    return Analysis(
        records=seqd, sentences=turns0, turns=turns, cycles=cyc, overlap=overlap, occurrences=stated,
        introductions=intro, claims=claims, ledger=led, violations=viol,
        near_repeats=O.near_repeats(occ, intro, led, lex), episodes=episodes, pointers=outs,
        snapshots=snaps, trends=M.trends(M.bands(snaps, config), config),
    )


def baseline_entries(turns: DataFrame, states: DataFrame, outs: DataFrame) -> DataFrame:
    """Sizes joining the control baseline: own entry after measuring, references when they settle."""
    s = states.select(*KEY, "open_turn")
    own = turns.where("pointer is null and not is_correction").join(s, KEY).where(
        "not open_turn").select(
        "stream_id", "epoch_before", "turn_index", F.lit(True).alias("late"),
        F.col("turn_index").alias("ord"), "chars")
    eligible = turns.where("pointer is not null and not is_correction").join(s, KEY).where(
        "not open_turn").select(*KEY)
    late = outs.where("outcome <> 'failure' and evidence not in ('epoch_end', 'source_end')").join(
        eligible, KEY, "left_semi").select(
        "stream_id", "epoch_before", F.col("settled_turn").alias("turn_index"),
        F.lit(False).alias("late"), F.col("turn_index").alias("ord"), "chars")
    return own.unionByName(late)


def snapshots(turns, sentences, cyc, states, episodes, outs, led, intro, viol, config=CONFIG) -> DataFrame:
    """One row per operator turn: six measure families, regime and rule."""
    obs = turns.select(*KEY, "quoted_chars", "chars").join(
        W.repeated_lines(sentences, config), KEY, "left").select(
        *KEY, W.ratio(F.col("quoted_chars"), F.col("chars")).alias("q"),
        W.ratio(F.coalesce("repeat_chars", F.lit(0)), F.col("chars")).alias("r"))
    d = turns.join(states, KEY).join(obs, KEY)
    d = d.withColumns({
        "forward": F.col("b.forward"), "other": F.col("b.other"), "restate": F.col("b.restate"),
        "control": F.col("b.control") + F.when(F.col("open_before"), 0).otherwise(F.col("b.handoff")),
        "recovery": F.col("b.recovery") + F.when(F.col("open_before"), F.col("b.handoff")).otherwise(0),
    })
    d = W.window_shares(d.select(
        "stream_id", "epoch_before", "epoch", "turn_index", "seq", "turn_id", "ts", "chars", "reset",
        "opens_epoch", "is_correction", "q", "r", "open_after", "repair", "forward", "control",
        "recovery", "restate", "other"), config)
    d = M.control_baseline(d, baseline_entries(turns, states, outs), config)
    d = d.join(P.reliability(turns, outs), KEY)

    structural = episodes.where(
        "out = 'event' and kind = 'repair_opened' and structural").groupBy(
        "stream_id", (F.col("turn_index") + 1).alias("turn_index")).agg(
        F.count("*").alias("structural_before"))
    interrupts = cyc.where("interrupts > 0").select(
        "stream_id", (F.col("turn_index") + 1).alias("turn_index"),
        F.col("interrupts").alias("cycle_interrupts_before"))
    deltas = O.surface_deltas(led, viol)
    d = d.join(structural, KEY, "left").join(interrupts, KEY, "left").join(
        deltas, ["stream_id", "epoch_before", "turn_index"], "left")
    med = O.standing_medians(led, intro).withColumn("m", F.struct("median_index"))
    d = d.join(med.select("stream_id", "epoch_before", "turn_index", "m"),
               ["stream_id", "epoch_before", "turn_index"], "left")
    blk = block_of(F.col("turn_index"), TURN_BLOCK)
    d = running(d, ["stream_id", "epoch_before"], ["turn_index"], blk, {
        **{n: Run("sum", F.coalesce(F.col(f"d_{n}"), F.lit(0)))
           for n in ("unresolved", "repeated", "repeats", "violated")},
        "standing": Run("last", F.col("m")),
    })
    d = running(d, ["stream_id"], ["turn_index"], blk, {
        "released": Run("sum", F.coalesce(F.col("d_released"), F.lit(0)))})
    d = M.drift_counts(d)

    live = ~F.col("reset")
    count = lambda n: F.when(live, F.col(n)).otherwise(0)
    unresolved = count("unresolved")
    rep = F.col("repair")
    end_us = F.coalesce(rep["closed_us"], F.when(rep["status"] == "open", rep["last_us"]))
    span = F.when(end_us >= rep["start_us"], (end_us - rep["start_us"]) / F.lit(1e6))
    zero = F.lit(0)
    d = d.withColumns({
        "unresolved_obligations": unresolved,
        "repeated_obligations": count("repeated"),
        "violated_obligations": count("violated"),
        "released_obligations": F.col("released"),
        "mean_repeat_count": W.ratio(count("repeats"), unresolved),
        "median_candidate_age": F.when(
            unresolved > 0, F.col("turn_index") - F.col("standing.median_index")),
        "obligation_repeat_ratio": F.coalesce(W.ratio(count("repeated"), unresolved), F.lit(0.0)),
        "repair_open": F.col("open_after"),
        "repair_id": rep["repair_id"], "repair_depth": F.coalesce(rep["depth"], zero),
        "repair_chars": F.coalesce(rep["chars"], zero),
        "repair_records": F.coalesce(rep["records"], zero),
        "repair_seconds": span,
        "repair_magnification": F.when(rep["pointer_chars"] > 0, rep["chars"] / rep["pointer_chars"]),
        "repair_status": rep["status"],
        "repair_expansions": F.coalesce(rep["expansions"], zero),
        "pollution_status": F.coalesce(rep["pollution"], F.lit("")),
        "open_depth": F.when(F.col("open_after"), rep["depth"]),
        "open_chars": F.when(F.col("open_after"), rep["chars"]),
    })
    d = M.regime(d, config)
    return d.select(
        "stream_id", "seq", "turn_index", "turn_id", "ts", "epoch", "regime", "regime_rule",
        F.col("chars").alias("user_chars"), "baseline_chars", "baseline_turns",
        "serialization_inflation", F.coalesce("q", F.lit(0.0)).alias("quoted_fraction"),
        F.coalesce("r", F.lit(0.0)).alias("repeat_fraction"),
        "forward_chars", "control_chars", "recovery_chars", "restate_chars", "other_chars",
        "forward_work_share", "control_plane_burden", "restate_burden",
        "unresolved_obligations", F.coalesce("new_obligations", F.lit(0)).alias("new_obligations"),
        "repeated_obligations", "violated_obligations", "released_obligations",
        "mean_repeat_count", "median_candidate_age", "obligation_repeat_ratio",
        "pointer_success", "pointer_failure", "pointer_unknown", "dereference",
        "repair_id", "repair_open", "repair_depth", "repair_chars", "repair_records",
        "repair_seconds", "repair_magnification", "repair_status", "repair_expansions",
        "pollution_status", "recent_corrections", "recent_interrupts", "recent_dereference_misses",
    )
