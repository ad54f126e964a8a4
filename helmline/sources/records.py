"""Canonical record schema and the tables it is read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helmline.functions.ordered import RECORD_BLOCK, block_of, dense_seq

VERBS = ("read", "write", "execute", "search", "ask", "unknown")
SPEAKER_CLASSES = ("human", "agent", "tool", "system", "unknown")
OPERATOR_MODES = ("", "typed", "structured_answer")
INPUT_MODES = ("typed", "structured_answer", "shell_escape", "cli_command", "interrupt",
               "compact_summary")

ACTIONS = "array<struct<verb:string,targets:array<string>,argv:array<string>,failed:boolean>>"
SOURCE = "struct<adapter:string,path:string,offset:bigint,record_sha256:string>"
RECORD_SCHEMA = (
    "stream_id string, turn_id string, seq bigint, ts timestamp, speaker string, "
    f"speaker_class string, text string, actions {ACTIONS}, reply_to string, source {SOURCE}, "
    "metadata map<string,string>, sidechain boolean, input_mode string"
)

# Speaker names of the neutral format.
SPEAKER_NAMES = {
    "human": ("user", "human", "operator"),
    "agent": ("assistant", "agent", "model"),
    "tool": ("tool", "tool_result", "function"),
    "system": ("system",),
}

_DEFAULTS = {
    "turn_id": "string", "ts": "timestamp", "speaker": "string", "actions": ACTIONS,
    "reply_to": "string", "source": SOURCE, "metadata": "map<string,string>",
}


def speaker_class(speaker: Column) -> Column:
    out = F.when(F.lit(False), "")
    for cls, names in SPEAKER_NAMES.items():
        out = out.when(speaker.isin(*names), cls)
    return out.otherwise("unknown")


def is_operator_turn(cls: Column, sidechain: Column, mode: Column) -> Column:
    return (
        (cls == "human")
        & ~F.coalesce(sidechain, F.lit(False))
        & F.coalesce(mode, F.lit("")).isin(*OPERATOR_MODES)
    )


def conform(df: DataFrame) -> DataFrame:
    """Fill absent optional columns with NULL and fix order and types."""
    for name, kind in _DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    if "sidechain" not in df.columns:
        df = df.withColumn("sidechain", F.lit(False))
    if "input_mode" not in df.columns:
        df = df.withColumn("input_mode", F.lit(""))
    fields = [p.strip() for p in _split_schema(RECORD_SCHEMA)]
    return df.select(*[
        F.col(n).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in fields)
    ])


def _split_schema(ddl: str):
    depth, cur, out = 0, "", []
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def read_conversations(df: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text` to canonical records, one stream per conversation."""
    d = df.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("stream_id"),
        F.col("turn").cast("long").alias("__order"),
        F.col("role").alias("speaker"),
        speaker_class(F.col("role")).alias("speaker_class"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    d = dense_seq(d, ["stream_id"], ["__order"], block_of(F.col("__order"), RECORD_BLOCK))
    d = d.withColumn("turn_id", F.concat(F.lit("seq-"), F.col("seq").cast("string")))
    return conform(d)


def write_targets(actions: Column) -> Column:
    return _targets(actions, lambda a: a["verb"] == "write")


def path_targets(actions: Column) -> Column:
    return _targets(actions, lambda a: F.lit(True))


def _targets(actions, keep):
    named = F.flatten(F.transform(
        F.filter(actions, keep), lambda a: F.coalesce(a["targets"], F.array().cast("array<string>"))
    ))
    found = F.array_distinct(F.filter(named, lambda t: t.isNotNull() & (t != "")))
    return F.coalesce(found, F.array().cast("array<string>"))


def failed_actions(actions: Column) -> Column:
    n = F.size(F.filter(actions, lambda a: F.coalesce(a["failed"], F.lit(False))))
    return F.when(actions.isNull(), 0).otherwise(n)
