"""Externally produced classifications: eligibility, selection, validation, tiling, capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helmline.operators.features import BUCKETS

MAX_TURN_BYTES = 32 * 1024
MAX_PRIOR_TURNS = 4

# Closed vocabularies of an accepted result.
LABELS = tuple(n for names in BUCKETS.values() for n in names) + ("other",)
POINTER_TYPES = ("node", "alias", "file", "path", "task", "temporal", "quote", "namespace",
                 "relation", "operation", "unknown")
KINDS = ("stop", "scope", "negative", "positive")
RESOLUTIONS = {"released": "obligation_release", "superseded": "obligation_supersession",
               "satisfied": "obligation_satisfaction"}


def eligible(records: DataFrame) -> DataFrame:
    """Records a model may judge: operator turns, agent records of an open episode, bounded size.

    Expects is_op, is_agent, repair_open, bytes.
    """
    worth = F.col("is_op") | (F.col("is_agent") & F.coalesce("repair_open", F.lit(False)))
    return records.where(worth & (F.col("bytes") > 0) & (F.col("bytes") <= MAX_TURN_BYTES))


def prior_turns(turns: DataFrame) -> DataFrame:
    """The last few operator texts before each turn, oldest first."""
    from helmline.functions.ordered import framed

    return framed(turns, ["stream_id"], "turn_index", MAX_PRIOR_TURNS, lambda w: {
        "prior": F.collect_list("text").over(w.rowsBetween(-MAX_PRIOR_TURNS, -1))})


def select_completions(asked: DataFrame, completions: DataFrame, identity: tuple[str, str, str]):
    """Retained result per asked record; (selected, errors).

    Same stream, sequence and input hash, of the named classifier. None is `missing`; more than one
    is `ambiguous`. Neither is guessed.
    """
    name, version, rules = identity
    mine = completions.where(
        (F.col("status") == "completed") & F.col("result").isNotNull() & (F.col("classifier") == name)
        & (F.col("classifier_version") == version) & (F.col("classifier_hash") == rules))
    per = mine.groupBy("stream_id", F.col("source_seq").alias("seq"), "input_hash").agg(
        F.count("*").alias("n"), F.min_by(F.struct("job_id", "result"), "job_id").alias("c"))
    d = asked.join(per, ["stream_id", "seq", "input_hash"], "left")
    good = d.where("n = 1").select("stream_id", "seq", "c.job_id", "c.result")
    bad = d.where("n is null or n > 1").select(
        "stream_id", "seq", F.when(F.col("n").isNull(), "missing").otherwise("ambiguous").alias("problem"),
        F.coalesce("n", F.lit(0)).alias("matches"))
    return good, bad


def _utf8_boundary(text: Column, at: Column) -> Column:
    """A byte offset is a boundary unless the byte there continues a character."""
    byte = F.substr(F.hex(F.encode(text, "UTF-8")), at * 2 + 1, F.lit(2))
    return (at == F.octet_length(text)) | ~byte.rlike("^[89AB]")


def problem(text: Column, r: Column, outstanding: Column) -> Column:
    """First rule a result breaks, or NULL. Nothing is repaired.

    `r`: struct<confidence, segments, pointer, correction, obligations, resolutions>.
    """
    segs, n = r["segments"], F.octet_length(text)
    shifted = F.concat(F.array(F.lit(0)), F.transform(segs, lambda s: s["end"]))
    order = F.exists(F.zip_with(segs, F.slice(shifted, F.lit(1), F.size(segs)),
                                lambda s, p: s["start"] < p), lambda x: x)
    dup = lambda keys: F.size(F.array_distinct(keys)) < F.size(keys)
    obs, res = r["obligations"], r["resolutions"]
    keys = F.transform(obs, lambda o: F.coalesce(o["key"], F.lit("")))
    ptr, fix = r["pointer"], r["correction"]
    return (
        F.when(F.isnan(r["confidence"]) | ~r["confidence"].between(0, 1), "confidence")
        .when(F.exists(segs, lambda s: (s["start"] < 0) | (s["end"] > n) | (s["start"] > s["end"])),
              "span_outside_text")
        .when(order, "span_order")
        .when(F.exists(segs, lambda s: ~(_utf8_boundary(text, s["start"])
                                         & _utf8_boundary(text, s["end"]))), "span_splits_character")
        .when(F.exists(segs, lambda s: ~s["label"].isin(*LABELS)), "segment_label")
        .when(~ptr["type"].isin(*POINTER_TYPES), "pointer_type")
        .when(~ptr["is_pointer"] & ((ptr["text"] != "") | (ptr["type"] != "unknown")), "pointer_claims")
        .when(fix["is_correction"] & ~fix["target_type"].isin(*POINTER_TYPES), "target_type")
        .when(~fix["is_correction"] & ((fix["target_key"] != "") | ~fix["target_type"].isin("", "unknown")),
              "correction_claims")
        .when(F.exists(obs, lambda o: ~o["kind"].isin(*KINDS)), "obligation_kind")
        .when(F.exists(keys, lambda k: k == ""), "obligation_key")
        .when(dup(keys), "obligation_duplicate")
        .when(F.exists(res, lambda x: ~x["kind"].isin(*RESOLUTIONS)), "resolution_kind")
        .when(F.exists(res, lambda x: ~F.array_contains(outstanding, x["key"])), "resolution_target")
        .when(F.exists(res, lambda x: F.trim(x["evidence"]) == ""), "resolution_evidence")
        .when(dup(F.transform(res, lambda x: x["key"])), "resolution_duplicate"))


def validate(results: DataFrame) -> DataFrame:
    """Expects text, result, outstanding; adds `problem`."""
    return results.withColumn("problem", problem(F.col("text"), F.col("result"), F.col("outstanding")))


def tile(text: Column, segs: Column) -> Column:
    """Accepted spans plus `other` for what they leave out, in order and without empty spans."""
    ends = F.concat(F.array(F.lit(0)), F.transform(segs, lambda s: s["end"]))
    starts = F.concat(F.transform(segs, lambda s: s["start"]), F.array(F.octet_length(text)))
    gaps = F.zip_with(ends, starts, lambda e, s: F.struct(
        e.alias("start"), s.alias("end"), F.lit("other").alias("label")))
    own = F.transform(segs, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    return F.array_sort(F.filter(F.concat(gaps, own), lambda s: s["start"] < s["end"]))


def allowed_resolutions(resolutions: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Resolutions whose kind the classifier has declared, with a stated premise."""
    need = F.when(F.lit(False), "")
    for kind, cap in RESOLUTIONS.items():
        need = need.when(F.col("kind") == kind, cap)
    return resolutions.withColumn("capability", need).where(
        "trim(evidence) <> ''").join(capabilities, ["classifier", "capability"], "left_semi")
