"""Joins every transcript format needs: line provenance, failed calls, structured answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmline.functions.ordered import RECORD_BLOCK, Run, block_of, running
from helmline.functions.text import emitted


def lines_with_offsets(files: DataFrame) -> DataFrame:
    """`path, value` (whole text) to non-blank lines with ordinal, byte offset and SHA-256.

    A trailing carriage return is not part of a line. Offsets are sums inside the row that holds the
    file, so the lines need no shuffle.
    """
    item = "struct<pos:int,offset:bigint,line:string>"
    init = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("n"), F.array().cast(f"array<{item}>").alias("out"))

    def step(acc, ln):
        line = F.regexp_replace(ln, r"\r+\z", "")
        keep = F.trim(F.regexp_replace(line, r"\s", " ")) != ""
        entry = F.struct(acc["n"].alias("pos"), acc["at"].alias("offset"), line.alias("line"))
        return F.struct(
            (acc["at"] + F.octet_length(ln) + 1).alias("at"),
            (acc["n"] + keep.cast("int")).alias("n"),
            F.when(keep, F.concat(acc["out"], F.array(entry))).otherwise(acc["out"]).alias("out"))

    walked = emitted(F.split("value", "\n", -1), init, step, item)
    d = files.select("path", F.explode(walked).alias("x")).select("path", "x.*")
    return d.withColumn("record_sha256", F.sha2("line", 256))


def mark_failed(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (path, pos, call_id) with `failed` from an erring result later in the same file.

    A call id that is used again belongs to the latest call before the result.
    """
    bad = results.where("is_error and call_id <> ''").select("path", "call_id", "pos", F.lit(0).alias("made"))
    # An error at the place of a call comes first: only calls before it count.
    both = bad.unionByName(calls.select("path", "call_id", "pos", F.lit(1).alias("made")))
    latest = running(both, ["path", "call_id"], ["pos", "made"], block_of(F.col("pos"), RECORD_BLOCK), {
        "call": Run("last", F.when(F.col("made") == 1, F.col("pos")))})
    hit = latest.where("made = 0 and call is not null").select(
        "path", "call_id", F.col("call").alias("pos")).distinct().withColumn("failed", F.lit(True))
    return calls.join(hit, ["path", "call_id", "pos"], "left").withColumn(
        "failed", F.coalesce("failed", F.lit(False)))


def answers(results: DataFrame, calls: DataFrame, tool: str) -> DataFrame:
    """Operator answers to questions of one tool: values in key order, then sorted notes."""
    asked = calls.where(F.col("tool") == tool).select("path", "call_id").distinct()
    values = F.transform(F.array_sort(F.map_entries("answers")), lambda e: e["value"])
    notes = F.array_sort(F.filter(F.coalesce("notes", F.array().cast("array<string>")), lambda x: x != ""))
    return results.join(asked, ["path", "call_id"], "left_semi").where(
        F.size("answers") > 0).withColumn("text", F.array_join(F.concat(values, notes), "\n"))
