"""Seeded transcripts: the conversations table with markers, times and actions derived by arithmetic.

The conversations table has no timestamps and no tool actions and little marker vocabulary. Every row
keeps its whole text; a phrase chosen from (conv_id, turn) is put in front of it. Twenty neighbouring
conversations form one stream, so that the turn windows fill. `SEED_SQL` runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmline.functions.ordered import RECORD_BLOCK, block_of, dense_seq
from helmline.sources.records import conform

OPERATOR_PHRASES = (
    "Add a retry to src/app.py.",
    "No, that is not what I asked in src/f1.py.",
    "Only touch src/f1.py.",
    "Never edit the release workflow.",
    "Forget about the release workflow edit.",
    "Make sure the tests pass.",
    "Thanks, looks good.",
    "Continue.",
    "Again. Make sure the tests pass.",
    "Stop here and wait for me.",
    "Start a new session.",
    "To recap, we use task 12 and issue #7.",
    "New task: fix the parser.",
    "That parser is wrong, only that parser in scope.",
    "Fix that parser.",
    "```~never do this inside~```",
    "> always quote this line",
    "Run `make test` before merge. Check docs/readme.md and `src/f2.py`.",
    "The installer must not touch /opt/data.",
    "Do not edit the release workflow.",
    "Never edit the release workflow today.",
    "I said nothing else. You must keep AB-12 and v1.2.3.",
    "",
    "",
)
AGENT_PHRASES = (
    "Done.",
    "I also updated the docs.",
    "Reverted it.",
    "I opened an issue.",
    "I added a test.",
    "From now on I check twice.",
    "",
)

_PHRASE = "CASE (conv_id * 31 + turn * 17 + CAST(FLOOR(conv_id / 24.0) AS BIGINT)) % {n} {whens} END"


def _case(phrases):
    whens = " ".join(
        f"WHEN {i} THEN replace('{p}', '~', chr(10))" for i, p in enumerate(phrases)
    )
    return _PHRASE.format(n=len(phrases), whens=whens)


SEED_SQL = f"""
SELECT
  concat('s-', CAST(CAST(FLOOR(conv_id / 20.0) AS BIGINT) AS VARCHAR(20))) AS stream_id,
  conv_id, turn,
  conv_id * 1000 + turn AS ord,
  CASE WHEN mode = 'interrupt' THEN ''
       WHEN role = 'user' AND phrase <> '' THEN concat(phrase, chr(10), text)
       WHEN role = 'assistant' AND phrase <> '' THEN concat(text, chr(10), phrase)
       ELSE text END AS text,
  CASE WHEN role = 'assistant' AND g = 9 THEN 'tool' ELSE role END AS speaker,
  CASE WHEN role = 'user' THEN 'human'
       WHEN role = 'assistant' AND g = 9 THEN 'tool'
       WHEN role = 'assistant' THEN 'agent'
       WHEN role = 'system' THEN 'system' ELSE 'unknown' END AS speaker_class,
  (role = 'assistant' AND g = 8) AS sidechain,
  mode AS input_mode,
  CASE WHEN (conv_id + turn * 3) % 11 <> 0
       THEN 1709251200 + conv_id * 600 + turn * 45 + turn % 3 END AS ts_s,
  CASE WHEN role = 'assistant' AND g IN (0, 3, 4, 6)
       THEN concat('src/f', CAST((conv_id + turn) % 3 AS VARCHAR(3)), '.py') END AS write_path,
  CASE WHEN role = 'assistant' AND g IN (3, 7) THEN 'src/app.py' END AS write_path2,
  (role = 'assistant' AND g IN (4, 9)) AS failed
FROM (
  SELECT conv_id, turn, role, text,
    (conv_id * 13 + turn * 7) % 10 AS g,
    CASE WHEN role = 'user' THEN {_case(OPERATOR_PHRASES)}
         WHEN role = 'assistant' THEN {_case(AGENT_PHRASES)} ELSE '' END AS phrase,
    CASE WHEN role = 'user' AND (conv_id * 5 + turn) % 19 = 0 THEN 'interrupt'
         WHEN role = 'user' AND (conv_id * 5 + turn) % 23 = 0 THEN 'shell_escape'
         ELSE '' END AS mode
  FROM conversations
) q
"""


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records of the seeded transcripts."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    raw = spark.sql(SEED_SQL.replace("FROM conversations", "FROM {conversations}"), conversations=table)
    d = dense_seq(raw, ["stream_id"], ["ord"], block_of(F.col("conv_id"), RECORD_BLOCK))
    strings = "array<string>"
    action = lambda path: F.when(path.isNotNull(), F.struct(
        F.lit("write").alias("verb"), F.array(path).alias("targets"),
        F.array().cast(strings).alias("argv"), F.col("failed").alias("failed")))
    execute = F.when(F.col("failed") & F.col("write_path").isNull(), F.struct(
        F.lit("execute").alias("verb"), F.array().cast(strings).alias("targets"),
        F.array(F.lit("make")).alias("argv"), F.lit(True).alias("failed")))
    return conform(d.select(
        "stream_id", F.concat(F.lit("seq-"), F.col("seq").cast("string")).alias("turn_id"), "seq",
        F.timestamp_seconds("ts_s").alias("ts"), "speaker", "speaker_class", "text",
        F.array_compact(F.array(action(F.col("write_path")), action(F.col("write_path2")), execute))
        .alias("actions"), "sidechain", "input_mode",
    ))
