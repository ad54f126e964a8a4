"""Measures of a turn: control baseline, drift counts, bands, regime, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helmline import config as C
from helmline.config import DEFAULT as CONFIG
from helmline.functions.ordered import TURN_BLOCK, Run, block_of, framed, running
from helmline.operators.turns import median_of


def control_baseline(turns: DataFrame, entries: DataFrame, config=CONFIG) -> DataFrame:
    """Median size of the last eligible turns appended before each turn is measured.

    `entries`: stream_id, epoch_before, turn_index (when appended), late (true for the turn's own
    entry, which comes after its measurement), ord, chars. The n-th entry carries the median of the
    n-th window; a turn looks up the number of entries it has seen.
    """
    keep = config.window.rolling_turns
    keys = ["stream_id", "epoch_before"]
    numbered = running(
        entries, keys, ["turn_index", "late", "ord"], block_of(F.col("turn_index"), TURN_BLOCK),
        {"nth": Run("sum", F.lit(1).cast("long"))},
    )
    medians = framed(
        numbered.select(*keys, "nth", "chars"), keys, "nth", keep,
        lambda w: {"recent": F.collect_list("chars").over(w.rowsBetween(-(keep - 1), 0))},
    ).select(*keys, F.col("nth").alias("seen"), median_of(F.col("recent")).alias("median"),
             F.size("recent").alias("baseline_turns"))
    # Entries seen by a turn: all of earlier turns, and the early ones of its own turn.
    per_turn = entries.groupBy(*keys, "turn_index").agg(
        F.sum((~F.col("late")).cast("long")).alias("early"), F.count("*").alias("all"))
    d = turns.join(per_turn, [*keys, "turn_index"], "left")
    d = running(d, keys, ["turn_index"], block_of(F.col("turn_index"), TURN_BLOCK), {
        "__before": Run("sum", F.coalesce(F.col("all"), F.lit(0)), strict=True)})
    d = d.withColumn("seen", F.col("__before") + F.coalesce(F.col("early"), F.lit(0)))
    d = d.drop("__before", "early", "all").join(medians, [*keys, "seen"], "left")
    known = F.col("baseline_turns") >= config.thresholds.minimum_control_baseline
    base = F.when(known, F.col("median"))
    return d.withColumns({
        "baseline_turns": F.coalesce("baseline_turns", F.lit(0)),
        "baseline_chars": base,
        "serialization_inflation": F.when(base != 0, F.col("chars") / base),
    }).drop("seen", "median")


def drift_counts(turns: DataFrame) -> DataFrame:
    """Events of the last operator turns of the epoch.

    Expects per turn: is_correction, misses, any_repeated, and for the cycle before it
    cycle_interrupts_before and structural_before. Marks of a cycle carry the ordinal of the turn
    that began it, so they sit one turn earlier; the turn that opens an epoch drops them.
    """
    w8 = C.DRIFT_WINDOW_TURNS

    def marks(col):
        return F.when(F.col("opens_epoch"), 0).otherwise(F.coalesce(F.col(col), F.lit(0)))

    def build(w):
        at = w.partitionBy("stream_id", "__blk", "epoch_before")
        near, earlier = at.rowsBetween(-(w8 - 1), 0), at.rowsBetween(-(w8 - 2), 0)
        structural = F.sum(marks("structural_before")).over(earlier)
        return {
            "recent_corrections": F.sum(F.col("is_correction").cast("long")).over(near) + structural,
            "recent_interrupts": F.sum(marks("cycle_interrupts_before")).over(earlier),
            "recent_dereference_misses": F.sum("misses").over(near),
            "recent_obligation_repeats": F.sum(
                F.coalesce(F.col("any_repeated"), F.lit(False)).cast("long")).over(near),
        }

    return framed(turns, ["stream_id"], "turn_index", w8, build)


# ---- bands ------------------------------------------------------------------------------------
def band_serialization(v: Column, t=CONFIG.thresholds) -> Column:
    return (
        F.when(v.isNull(), "unknown").when(v >= t.serialization_high, "bad")
        .when(v >= t.serialization_warn, "mid").otherwise("good")
    )


def _falling(v, good, mid):
    return F.when(v.isNull(), "unknown").when(v <= good, "good").when(v <= mid, "mid").otherwise("bad")


def _rising(v, good, mid):
    return F.when(v.isNull(), "unknown").when(v >= good, "good").when(v >= mid, "mid").otherwise("bad")


def band_control(v: Column) -> Column:
    return _falling(v, C.CONTROL_BURDEN_GOOD, C.CONTROL_BURDEN_MID)


def band_forward(v: Column) -> Column:
    return _rising(v, C.FORWARD_SHARE_GOOD, C.FORWARD_SHARE_MID)


def band_dereference(v: Column) -> Column:
    return _rising(v, C.DEREFERENCE_GOOD, C.DEREFERENCE_MID)


def band_depth(depth: Column, t=CONFIG.thresholds) -> Column:
    return F.when(depth >= t.thrash_repair_depth, "bad").when(depth > 0, "mid").otherwise("good")


def bands(df: DataFrame, config=CONFIG) -> DataFrame:
    t = config.thresholds
    return df.withColumns({
        "band_serialization_inflation": band_serialization(F.col("serialization_inflation"), t),
        "band_control_plane_burden": band_control(F.col("control_plane_burden")),
        "band_forward_work_share": band_forward(F.col("forward_work_share")),
        "band_dereference": band_dereference(F.col("dereference")),
        "band_repair_depth": band_depth(F.col("repair_depth"), t),
    })


TREND_METRICS = ("serialization_inflation", "control_plane_burden", "forward_work_share",
                 "dereference", "repair_depth")


def pollution(repaired: Column, expansions: Column, immediate: Column, writes: Column,
              named: Column) -> Column:
    """Status and premise of the response to a correction: struct<status,premise>."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("status"), F.lit("").alias("premise")))
    rules = (
        (repaired.isNull() & ~named, "unknown", "no path was named"),
        (repaired.isNull() & (writes == 0), "unknown", "no write was seen"),
        (repaired.isNull(), "unknown", "no write reached the target"),
        (~repaired, "failed", "the target was not repaired"),
        (expansions > 0, "polluted", "repaired with unrequested work"),
        (~immediate, "clean", "repaired, nothing added, not corrected"),
        (F.lit(True), "unknown", "repaired and still corrected"),
    )
    for cond, status, premise in rules:
        out = out.when(cond, F.struct(F.lit(status).alias("status"), F.lit(premise).alias("premise")))
    return out


def magnification(chars: Column, pointer_chars: Column) -> Column:
    return F.when(pointer_chars > 0, chars / pointer_chars)


# ---- regime -----------------------------------------------------------------------------------
def regime(df: DataFrame, config=CONFIG) -> DataFrame:
    """Regime and the rule that decided it. A NULL measure satisfies no comparison."""
    t, c = config.thresholds, F.col

    def true(cond):
        return F.coalesce(cond, F.lit(False))

    heavy = true(c("serialization_inflation") >= t.serialization_warn)
    rule = (
        F.when(c("reset"), "reset")
        .when(c("repair_open") & true(c("open_depth") >= t.thrash_repair_depth),
              "thrash_repair_depth")
        .when(c("repair_open")
              & true(c("open_chars") >= C.THRASH_RECOVERY_MULTIPLE * c("baseline_chars")),
              "thrash_recovery_chars")
        .when(c("repair_open") & (c("repeated_obligations") >= t.repeated_obligations_warn) & heavy
              & true(c("forward_work_share") <= C.THRASH_FORWARD_SHARE),
              "thrash_obligation_inflation")
        .when(c("repair_open"), "recovery_open")
        .when(c("recent_dereference_misses") >= C.DRIFT_EVENT_COUNT, "drift_dereference")
        .when(c("recent_corrections") + c("recent_interrupts") >= C.DRIFT_EVENT_COUNT,
              "drift_control_actions")
        .when(heavy & (c("recent_obligation_repeats") > 0), "drift_serialization_obligation")
        .otherwise("flow")
    )
    name = F.when(rule == "recovery_open", "RECOVERY").otherwise(
        F.upper(F.substring_index(rule, "_", 1)))
    return df.withColumn("regime_rule", rule).withColumn("regime", name)


def regime_changes(snapshots: DataFrame) -> DataFrame:
    """Turns whose regime differs from the turn before; a stream starts in FLOW."""
    d = framed(
        snapshots.select("stream_id", "turn_index", "seq", "ts", "regime", "regime_rule"),
        ["stream_id"], "turn_index", 1,
        lambda w: {"from_regime": F.coalesce(F.lag("regime").over(w), F.lit("FLOW"))},
    )
    return d.where("from_regime <> regime").select(
        "stream_id", "turn_index", "seq", "ts", "from_regime", F.col("regime").alias("to_regime"),
        F.col("regime_rule").alias("rule"))


# ---- trends -----------------------------------------------------------------------------------
_RANK = {"good": 1, "mid": 2, "bad": 3}


def trends(banded: DataFrame, config=CONFIG) -> DataFrame:
    """Band crossings that held. Islands of equal known bands; an island counts at its d-th turn.

    The first known band is confirmed silently at its first turn. Unknown turns are left out, so they
    neither break nor extend an island.
    """
    hold = config.window.trend_durability_turns
    keys = ["stream_id", "metric"]
    long = banded.select(
        "stream_id", "turn_index", "seq",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(f"band_{m}").alias("band"))
            for m in TREND_METRICS])).alias("x"),
    ).select("stream_id", "turn_index", "seq", "x.metric", "x.band").where("band <> 'unknown'")
    blk = block_of(F.col("turn_index"), TURN_BLOCK)
    d = running(long, keys, ["turn_index"], blk, {
        "prev_band": Run("last", F.col("band"), strict=True),
        "nth": Run("sum", F.lit(1).cast("long")),
    })
    new = F.col("prev_band").isNull() | (F.col("prev_band") != F.col("band"))
    d = running(d, keys, ["turn_index"], blk, {
        "island_at": Run("max", F.when(new, F.col("nth")))})
    held = F.col("nth") - F.col("island_at") + 1
    confirms = F.when(F.col("island_at") == 1, F.col("nth") == 1).otherwise(held == hold)
    d = d.withColumns({"held": held, "confirms": confirms})
    d = running(d, keys, ["turn_index"], blk, {
        "from_band": Run("last", F.when(F.col("confirms"), F.col("band")), strict=True)})
    rank = F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv])
    worse = rank[F.col("band")] > rank[F.col("from_band")]
    return d.where("confirms and from_band is not null and from_band <> band").select(
        "stream_id", "metric", "turn_index", "seq", "from_band", F.col("band").alias("to_band"),
        F.when(worse, "degrading").otherwise("improving").alias("direction"),
        F.col("held").alias("turns_held"))
