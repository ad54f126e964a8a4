"""Order-dependent columns of records and operator turns: ordinals, epochs, gaps, repetition, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmline.config import DEFAULT as CONFIG
from helmline.functions import text as T
from helmline.functions.ordered import (
    RECORD_BLOCK, TURN_BLOCK, Run, block_of, framed, running, with_context,
)


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two timestamps; NULL when one is missing or time runs backwards."""
    start, end = start.cast("timestamp"), end.cast("timestamp")
    secs = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)
    return F.when(end >= start, secs)


def sequence(features: DataFrame) -> DataFrame:
    """Per-record running facts of a stream.

    Adds turn_index (operator turns so far), epoch_before/epoch (resets before / through this
    record), last_agent (seq and time of the agent record before), gap_seconds_previous,
    gap_seconds_previous_human and opens_epoch (first operator turn after a reset).
    """
    op = F.col("is_op")
    reset = op & F.coalesce(F.col("reset"), F.lit(False))
    agent_at = F.when(F.col("is_agent"), F.struct("seq", "ts"))
    d = running(
        features, ["stream_id"], ["seq"], block_of(F.col("seq"), RECORD_BLOCK),
        reread=True, outs={
            "turn_index": Run("sum", op.cast("long")),
            "epoch_before": Run("sum", reset.cast("long"), strict=True),
            "last_agent": Run("last", agent_at, strict=True),
            "__ts": Run("last", F.col("ts"), strict=True),
            "__human_ts": Run("last", F.when(op, F.col("ts")), strict=True),
            "__last_op": Run("last", F.when(op, F.col("seq")), strict=True),
            "__last_reset": Run("last", F.when(reset, F.col("seq")), strict=True),
        },
    )
    return d.select(
        *[c for c in d.columns if not c.startswith("__")],
        (F.col("epoch_before") + reset.cast("long")).alias("epoch"),
        elapsed(F.col("__ts"), F.col("ts")).alias("gap_seconds_previous"),
        elapsed(F.col("__human_ts"), F.col("ts")).alias("gap_seconds_previous_human"),
        (op & F.coalesce(F.col("__last_reset") == F.col("__last_op"), F.lit(False)))
        .alias("opens_epoch"),
    )


def operator_turns(sequenced: DataFrame) -> DataFrame:
    """One row per operator turn, with `first_before`: the latest earlier turn that opened an epoch."""
    turns = sequenced.where("is_op")
    return running(
        turns, ["stream_id"], ["turn_index"], block_of(F.col("turn_index"), TURN_BLOCK),
        {"first_before": Run("last", F.when(F.col("opens_epoch"), F.col("turn_index")), strict=True)},
    )


def recent_occurrence(items: DataFrame, reach: int) -> DataFrame:
    """Latest earlier turn of the same (stream, norm) within `reach` turns, per (stream, norm, turn).

    The turn axis is cut into blocks, so a norm that occurs in very many turns is many groups. Each
    block starts with copies of the `reach` turns before it.
    """
    d = items.select("stream_id", "norm", "turn_index").distinct()
    d, blk = with_context(d, F.col("turn_index"), reach)
    w = Window.partitionBy("stream_id", "norm", "__blk").orderBy("turn_index")
    return (
        d.withColumn("previous_turn", F.lag("turn_index").over(w))
        .where(F.col("__blk") == blk)
        .drop("__blk")
    )


def repeated_lines(turns: DataFrame, config=CONFIG) -> DataFrame:
    """(stream, turn_index) → repeat_chars: characters of lines already sent in the window.

    The first turn after a reset is compared with the epoch it left; its own lines are then dropped
    from the history.
    """
    reach = config.window.rolling_turns
    lines = turns.select(
        "stream_id", "turn_index", "first_before", F.explode("line_norms").alias("x")
    ).select("stream_id", "turn_index", "first_before", "x.norm", "x.chars")
    per_norm = lines.groupBy("stream_id", "turn_index", "first_before", "norm").agg(
        F.sum("chars").alias("chars")
    )
    seen = recent_occurrence(per_norm, reach)
    floor = F.greatest(
        F.col("turn_index") - reach, F.coalesce(F.col("first_before") + 1, F.lit(1).cast("long"))
    )
    return (
        per_norm.join(seen, ["stream_id", "norm", "turn_index"])
        .where(F.col("previous_turn") >= floor)
        .groupBy("stream_id", "turn_index")
        .agg(F.sum("chars").alias("repeat_chars"))
    )


def restated_sentences(turns: DataFrame, config=CONFIG) -> DataFrame:
    """(stream, turn_index) → positions of sentences an earlier turn of the window already sent."""
    reach = config.window.rolling_turns
    sents = turns.select(
        "stream_id", "turn_index", "first_before", F.explode("segs").alias("s")
    ).select(
        "stream_id", "turn_index", "first_before", F.col("s.norm").alias("norm"),
        F.col("s.pos").alias("pos"),
    ).where(F.octet_length("norm") >= 8)
    seen = recent_occurrence(sents, reach)
    floor = F.greatest(
        F.col("turn_index") - reach, F.coalesce(F.col("first_before"), F.lit(1).cast("long"))
    )
    return (
        sents.join(seen, ["stream_id", "norm", "turn_index"])
        .where(F.col("previous_turn") >= floor)
        .groupBy("stream_id", "turn_index")
        .agg(F.collect_set("pos").alias("restated"))
    )


def lexical_overlap(turns: DataFrame, config=CONFIG) -> DataFrame:
    """Token Jaccard with the previous operator turn and with the union of the window.

    The visible history starts after the turn that opened the epoch, so it is constant between two
    such turns and the frame only has to be cut at `first_before`.
    """
    reach = config.window.rolling_turns
    none = F.array().cast("array<string>")
    floor = F.coalesce(F.col("first_before") + 1, F.lit(1).cast("long"))
    d = framed(
        turns.select("stream_id", "turn_index", "first_before", "tokens"),
        ["stream_id"], "turn_index", reach,
        lambda w: {
            "__window": F.collect_list(F.struct("turn_index", "tokens")).over(
                w.rowsBetween(-reach, -1)
            )
        },
    )
    visible = F.filter(F.col("__window"), lambda h: h["turn_index"] >= floor)
    union = F.array_distinct(F.flatten(F.transform(visible, lambda h: h["tokens"])))
    previous = F.filter(
        F.col("__window"),
        lambda h: (h["turn_index"] >= floor) & (h["turn_index"] == F.col("turn_index") - 1),
    )
    prev_tokens = F.coalesce(F.get(F.transform(previous, lambda h: h["tokens"]), 0), none)
    return d.select(
        "stream_id", "turn_index",
        T.jaccard(F.col("tokens"), prev_tokens).alias("lexical_overlap_previous"),
        T.jaccard(F.col("tokens"), union).alias("lexical_overlap_window"),
    )


def bucket_chars(segs: Column, restated: Column) -> Column:
    """Characters per aggregate of one turn: struct<forward,control,recovery,restate,other,handoff>.

    `handoff` holds the characters of reset sentences: they are control, or recovery while an episode
    is open, which only the episode stage knows.
    """
    from helmline.operators.features import BUCKETS, RESTATED

    again = F.coalesce(restated, F.array().cast("array<int>"))
    labelled = F.transform(segs, lambda s: F.struct(
        s["chars"].alias("chars"),
        F.when(F.array_contains(again, s["pos"]) & ~s["label"].isin("handoff", "correction"),
               RESTATED).otherwise(s["label"]).alias("label"),
    ))

    def total(keep):
        return F.aggregate(
            F.filter(labelled, keep), F.lit(0).cast("long"), lambda a, s: a + s["chars"]
        )

    forward, control, recovery = BUCKETS["FORWARD"], BUCKETS["CONTROL"], BUCKETS["RECOVERY"]
    named = (*forward, *control, *recovery, RESTATED)
    return F.struct(
        total(lambda s: s["label"].isin(*forward)).alias("forward"),
        total(lambda s: s["label"].isin(*[c for c in control if c != "handoff"])).alias("control"),
        total(lambda s: s["label"].isin(*recovery)).alias("recovery"),
        total(lambda s: s["label"] == RESTATED).alias("restate"),
        total(lambda s: ~s["label"].isin(*named)).alias("other"),
        total(lambda s: s["label"] == "handoff").alias("handoff"),
    )


def window_shares(turns: DataFrame, config=CONFIG) -> DataFrame:
    """Bucket sums over the last operator turns of the epoch and the three shares.

    Expects stream_id, epoch_before, turn_index and the five per-turn bucket columns.
    """
    reach = config.window.rolling_turns
    names = ("forward", "control", "recovery", "restate", "other")
    d = framed(
        turns, ["stream_id"], "turn_index", reach,
        lambda w: {
            f"{n}_chars": F.sum(n).over(
                w.partitionBy("stream_id", "__blk", "epoch_before").rowsBetween(-(reach - 1), 0)
            )
            for n in names
        },
    )
    total = sum((F.col(f"{n}_chars") for n in names[1:]), F.col("forward_chars"))
    steering = F.col("control_chars") + F.col("recovery_chars") + F.col("restate_chars")
    return d.select(
        "*",
        ratio(F.col("forward_chars"), total).alias("forward_work_share"),
        ratio(steering, total).alias("control_plane_burden"),
        ratio(F.col("restate_chars"), total).alias("restate_burden"),
    )


def ratio(num: Column, den: Column) -> Column:
    """NULL over a zero denominator: unknown is not zero."""
    return F.when(den != 0, num.cast("double") / den)


def median_of(xs: Column) -> Column:
    """Median of an array, mean of the two middle values; NULL for an empty array."""
    s = F.array_sort(xs)
    n = F.size(xs)
    lo = F.get(s, F.floor((n - 1) / 2).cast("int"))
    hi = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / F.lit(2.0))
