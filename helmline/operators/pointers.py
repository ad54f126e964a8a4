"""Compact references and their outcomes, as joins on turn ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmline.config import DEFAULT as CONFIG
from helmline.functions import text as T
from helmline.functions.ordered import TURN_BLOCK, Run, block_of, running


def outcomes(turns: DataFrame, config=CONFIG) -> DataFrame:
    """One row per reference: outcome, the turn that settled it, and the reason.

    Evaluation starts at the first operator turn after the first agent record after the reference.
    That turn decides by correction or progress; the following ones only by a correction that names
    the same target; a reset ends the wait. `turns` carries next_agent and next_reset.
    """
    n = config.window.dereference_outcome_turns
    p = turns.where("pointer is not null").select(
        "stream_id", "epoch_before", "turn_index", "seq", F.col("pointer.type").alias("pointer_type"),
        T.normalize(F.col("pointer.text")).alias("pointer_key"), "chars", "next_reset",
        (F.col("next_agent") + 1).alias("first_eval"),
    )
    evals = p.where("first_eval is not null").select(
        "stream_id", F.col("turn_index").alias("of"), "pointer_key", "next_reset",
        F.posexplode(F.sequence("first_eval", F.col("first_eval") + (n - 1))).alias("nth", "turn_index"),
    ).where(F.col("turn_index") <= F.coalesce("next_reset", F.col("turn_index")))
    facts = turns.select("stream_id", "turn_index", "is_correction", "target_key", "moves")
    met = evals.join(facts, ["stream_id", "turn_index"])
    own = F.col("nth") == 0
    named = (
        F.col("is_correction") & (F.col("target_key") != "")
        & (F.col("target_key") == F.col("pointer_key"))
    )
    got = met.groupBy("stream_id", "of").agg(
        F.max(own & F.col("is_correction")).alias("fixed_first"),
        F.max(own & ~F.col("is_correction") & F.col("moves")).alias("moved_first"),
        F.min(F.when(~own & named, F.col("turn_index"))).alias("named_at"),
        F.max(F.when(F.col("nth") == n - 1, F.col("turn_index"))).alias("last_eval"),
    ).withColumnRenamed("of", "turn_index")
    d = p.join(got, ["stream_id", "turn_index"], "left")
    first = F.coalesce("fixed_first", F.lit(False)) | F.coalesce("moved_first", F.lit(False))
    settled = (
        F.when(first, F.col("first_eval")).when(F.col("named_at").isNotNull(), F.col("named_at"))
        .when(F.col("last_eval").isNotNull(), F.col("last_eval"))
    )
    outcome = (
        F.when(F.coalesce("fixed_first", F.lit(False)), "failure")
        .when(F.coalesce("moved_first", F.lit(False)), "success")
        .when(F.col("named_at").isNotNull(), "failure").otherwise("unknown")
    )
    how = (
        F.when(settled.isNotNull(), F.when(outcome == "unknown", "window").otherwise(
            F.when(first, "first_response").otherwise("same_target")))
        .when(F.col("next_reset").isNotNull(), "epoch_end").otherwise("source_end")
    )
    return d.select(
        "stream_id", "epoch_before", "turn_index", "seq", "pointer_type", "pointer_key", "chars",
        outcome.alias("outcome"), how.alias("evidence"),
        F.coalesce(settled, F.col("next_reset")).alias("settled_turn"),
    )


def reliability(turns: DataFrame, outs: DataFrame) -> DataFrame:
    """Running success, failure and unknown counts of the stream, plus misses on each turn.

    An outcome that only the end of the source brings belongs to no turn.
    """
    per = outs.where("settled_turn is not null").groupBy(
        "stream_id", F.col("settled_turn").alias("turn_index")
    ).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "failure", "unknown")])
    d = turns.select("stream_id", "turn_index").join(per, ["stream_id", "turn_index"], "left")
    d = running(d, ["stream_id"], ["turn_index"], block_of(F.col("turn_index"), TURN_BLOCK), {
        f"pointer_{o}": Run("sum", F.coalesce(F.col(o), F.lit(0)))
        for o in ("success", "failure", "unknown")
    })
    decided = F.col("pointer_success") + F.col("pointer_failure")
    return d.select(
        "stream_id", "turn_index", "pointer_success", "pointer_failure", "pointer_unknown",
        F.coalesce("failure", F.lit(0)).alias("misses"),
        F.when(decided > 0, F.col("pointer_success") / decided).alias("dereference"),
    )
