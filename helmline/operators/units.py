"""Units handed to a labeler: sentences of operator turns, or turns with their observed context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helmline.functions import text as T
from helmline.functions.ordered import RECORD_BLOCK, Run, block_of, running
from helmline.operators.corpus import sampled

EXCERPT = 600


def excerpt(s: Column, n: Column | int = EXCERPT) -> Column:
    """At most n bytes, cut on a character boundary, with an ellipsis when cut."""
    n = F.lit(n) if isinstance(n, int) else n
    head = F.substring(s, F.lit(1), n)
    fits = F.size(F.filter(
        F.sequence(F.lit(1), F.length(head)),
        lambda i: F.octet_length(F.substring(head, F.lit(1), i)) <= n))
    exact = F.when(F.octet_length(head) == F.length(head), head).otherwise(
        F.substring(head, F.lit(1), fits))
    return F.when(F.octet_length(s) <= n, s).otherwise(F.concat(exact, F.lit("…")))


def sentence_units(records: DataFrame, per_mille: int = 0) -> DataFrame:
    """One unit per sentence of the sampled operator turns. `records` carries is_op and text."""
    t = records.where("is_op").where(sampled(F.col("turn_id"), per_mille))
    d = t.select("stream_id", "turn_id", T.n_lines(F.col("text")).alias("turn_lines"),
                 F.explode(T.sentences(F.col("text"))).alias("s"))
    return d.where("s.text <> ''").select(
        F.col("stream_id").alias("session"), F.col("turn_id").alias("record"),
        F.lit("obligation").alias("family"), "s.start", "s.end", "s.text", "turn_lines")


def cycle_context(records: DataFrame, sequenced: DataFrame, per_mille: int = 0) -> DataFrame:
    """Sampled operator turns with the cycle before, the one before that, and the response after.

    `records` has the texts, `sequenced` the turn ordinals. A cycle's agent excerpt needs its opening
    bytes only: records are cut first, and a running size drops what lies past the bound.
    """
    c, key = F.col, ["stream_id", "turn_index"]
    texts = records.select("stream_id", "seq", "text")
    said = sequenced.where("is_agent and chars > 0").select(*key, "seq").join(
        texts, ["stream_id", "seq"]).select(*key, "seq", excerpt(c("text")).alias("x"))
    said = running(said, key, ["seq"], block_of(c("seq"), RECORD_BLOCK),
                   {"before": Run("sum", F.octet_length("x") + 1, strict=True)})
    room = (F.lit(EXCERPT) - c("before")).cast("int")
    said = said.where(c("before") < EXCERPT).join(texts, ["stream_id", "seq"]).select(
        *key, "seq", "before", excerpt(c("text"), room).alias("x"))
    talk = said.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "before", "x"))).alias("t"))
    talk = talk.select(*key, F.trim(F.array_join(F.transform("t", lambda r: r["x"]), " ")).alias("agent_said"))
    rest = sequenced.where("not is_op").groupBy(*key).agg(
        F.sum("failed_actions").alias("failed_calls"),
        F.max(c("is_interrupt")).alias("interrupted"))
    paths = sequenced.where("is_agent").select(*key, "seq", F.posexplode("write_paths").alias("i", "path"))
    paths = paths.groupBy(*key, "path").agg(F.min(F.struct("seq", "i")).alias("at"))
    paths = paths.groupBy(*key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]).alias("writes"))
    cyc = rest.join(talk, key, "left").join(paths, key, "left")

    def shifted(by, names):
        return cyc.select("stream_id", (c("turn_index") + by).alias("turn_index"),
                          *[c(a).alias(b) for a, b in names.items()])

    turns = sequenced.where("is_op").select(*key, "seq", "turn_id")
    own = turns.join(texts, ["stream_id", "seq"])
    near = own.select("stream_id", "turn_index", excerpt(c("text")).alias("x"))
    d = own.where(sampled(c("turn_id"), per_mille))
    d = d.join(near.select("stream_id", (c("turn_index") + 1).alias("turn_index"),
                           c("x").alias("prior_operator_text")), key, "left")
    d = d.join(near.select("stream_id", (c("turn_index") - 1).alias("turn_index"),
                           c("x").alias("next_operator_text")), key, "left")
    d = d.join(shifted(1, dict(writes="cycle_writes", failed_calls="cycle_failed_calls",
                               interrupted="cycle_interrupted", agent_said="agent_said")), key, "left")
    d = d.join(shifted(2, dict(writes="earlier_writes")), key, "left")
    d = d.join(shifted(0, dict(writes="response_writes", failed_calls="response_failed_calls",
                               interrupted="response_interrupted", agent_said="response_agent_said")),
               key, "left")
    none = F.array().cast("array<string>")
    return d.select(
        c("stream_id").alias("session"), c("turn_id").alias("record"), "turn_index", "text",
        *[F.coalesce(n, none).alias(n) for n in ("cycle_writes", "earlier_writes", "response_writes")],
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("cycle_failed_calls", "response_failed_calls")],
        *[F.coalesce(n, F.lit(False)).alias(n) for n in ("cycle_interrupted", "response_interrupted")],
        *[F.coalesce(n, F.lit("")).alias(n) for n in (
            "agent_said", "response_agent_said", "prior_operator_text", "next_operator_text")])
