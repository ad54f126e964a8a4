"""Corrections, response cycles and repair episodes.

The fold needs every row of an episode in order, but not every row of a stream. Stretches are cut
where the state is known without folding: at a correction (it always leaves exactly one episode open,
about its own target), at a turn that certainly closes whatever is open, and after the durability
window has run dry. A cut is dropped when an equal target key on both sides may link the episodes.
What remains in one group is one lineage of corrections about the same target.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmline.config import DEFAULT as CONFIG
from helmline.functions.fold import REPAIR_FIELDS, EpisodeFold
from helmline.functions.ordered import RECORD_BLOCK, TURN_BLOCK, Run, block_of, running

CYCLE = ["stream_id", "turn_index"]
NEVER = 1 << 62


def decide_corrections(turns: DataFrame, statements: DataFrame) -> DataFrame:
    """Tier one, or tier two backed by a repeat of a requirement that stood before the turn."""
    again = statements.where("stood_before").select("stream_id", "seq").distinct().withColumn(
        "repeats_unresolved", F.lit(True))
    d = turns.join(again, ["stream_id", "seq"], "left")
    backed = F.coalesce(F.col("repeats_unresolved"), F.lit(False))
    marker = F.coalesce(F.col("tier1"), F.when(backed, F.col("tier2")))
    fixed = marker.isNotNull()
    return d.withColumns({
        "is_correction": fixed,
        "correction_marker": marker,
        "target_type": F.when(fixed, F.col("target_type")).otherwise("unknown"),
        "target_key": F.when(fixed, F.col("target_key")).otherwise(""),
        "target_paths": F.when(fixed, F.col("named_paths")).otherwise(
            F.array().cast("array<string>")),
    }).drop("repeats_unresolved")


def cycles(sequenced: DataFrame) -> DataFrame:
    """Totals of the records between one operator turn and the next, per (stream, turn_index)."""
    agent, writes = F.col("is_agent"), F.size("write_paths")
    interrupt = ~agent & F.col("is_interrupt")
    return sequenced.where(~F.col("is_op")).groupBy(*CYCLE).agg(
        F.count("*").alias("records"),
        F.sum(agent.cast("long")).alias("agent_turns"),
        F.sum(F.when(agent, writes).otherwise(0)).alias("writes"),
        F.sum(interrupt.cast("long")).alias("interrupts"),
        F.sum(F.when(~agent | (writes > 0), F.col("failed_actions")).otherwise(0)).alias("failed"),
        F.sum(F.when(agent, F.col("exp_task") + F.col("exp_validation") + F.col("exp_constraint")
                     + F.col("exp_scope")).otherwise(0)).alias("text_expansions"),
        F.max(F.col("claim")).alias("claim_text"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
    )


def write_overlap(sequenced: DataFrame) -> DataFrame:
    """Per cycle, the first record that writes a path the previous cycle wrote, and those paths.

    Only cycles after an operator turn count as a previous cycle.
    """
    w = sequenced.where("is_agent and size(write_paths) > 0 and turn_index >= 1").select(
        *CYCLE, "seq", F.posexplode("write_paths").alias("i", "path"))
    before = w.select("stream_id", (F.col("turn_index") + 1).alias("turn_index"), "path").distinct()
    hit = w.join(before, [*CYCLE, "path"], "left_semi")
    per_record = hit.groupBy(*CYCLE, "seq").agg(
        F.array_sort(F.collect_list(F.struct("i", "path"))).alias("o"))
    return per_record.groupBy(*CYCLE).agg(F.min_by(F.struct("seq", "o"), "seq").alias("f")).select(
        *CYCLE, F.col("f.seq").alias("overlap_seq"),
        F.transform("f.o", lambda x: x["path"]).alias("overlap"),
    )


def with_stretches(turns: DataFrame, cyc: DataFrame, overlap: DataFrame, config=CONFIG) -> DataFrame:
    """Operator turns with look-ahead marks and the stretch each one belongs to.

    `turns` carries is_correction, target_key, moves, on_episode and reset. Adds next_agent and
    next_reset (used for reference outcomes too), starts, stretch, live_until.
    """
    D = config.window.correction_durability_turns
    idx = F.col("turn_index")
    d = (
        turns.join(cyc.select(*CYCLE, F.col("records").alias("cycle_records"),
                              F.col("agent_turns").alias("cycle_agents")), CYCLE, "left")
        .join(cyc.select("stream_id", (idx + 1).alias("turn_index"),
                         F.col("records").alias("before_records")), CYCLE, "left")
        .join(overlap, CYCLE, "left")
    )
    blk = block_of(idx, TURN_BLOCK)
    d = running(d, ["stream_id"], ["turn_index"], blk, {
        "next_answer": Run("last", F.when(F.col("cycle_records") > 0, idx)),
        "next_agent": Run("last", F.when(F.col("cycle_agents") > 0, idx)),
        "next_reset": Run("last", F.when(F.col("reset"), idx)),
        "later_reset": Run("last", F.when(F.col("reset"), idx), strict=True),
    }, descending=True)
    # A correction leaves its episode open over the whole cycle, unless its own turn resets.
    text = F.col("is_correction")
    struct = F.col("overlap").isNotNull() & (~text | F.col("reset"))
    quiet = F.greatest(F.coalesce(F.col("next_answer"), F.lit(NEVER)) + 1, idx + D) + D
    text_quiet = F.when(text, F.least(quiet, F.col("next_reset")))
    struct_quiet = F.when(struct, F.least(quiet, F.col("later_reset")))
    d = d.withColumns({
        "opens": F.when(text, "text").when(struct, "structural"),
        "quiet_at": F.greatest(text_quiet, struct_quiet),
        "open_keys": F.array_compact(F.array(
            F.when(text, F.struct(F.col("target_key").alias("key"), text_quiet.alias("until"))),
            F.when(struct, F.struct(F.get("overlap", 0).alias("key"), struct_quiet.alias("until"))),
        )),
        "closes": ~text & (F.col("moves") | ~F.col("on_episode"))
        & F.coalesce(F.col("before_records") > 0, F.lit(False)),
    })
    keyed = d.select(*CYCLE, F.explode("open_keys").alias("o")).select(
        *CYCLE, F.col("o.key").alias("open_key"), F.col("o.until").alias("until")
    ).where("open_key <> ''").groupBy(*CYCLE, "open_key").agg(F.max("until").alias("until"))
    linked = running(keyed, ["stream_id", "open_key"], ["turn_index"], blk, {
        "again": Run("last", idx, strict=True)}, descending=True)
    linked = linked.where("again <= until").groupBy(*CYCLE).agg(F.max("again").alias("link_end"))
    d = d.join(linked, CYCLE, "left")
    d = running(d, ["stream_id"], ["turn_index"], blk, {
        "live_before": Run("max", F.col("quiet_at"), strict=True),
        "live_until": Run("max", F.col("quiet_at")),
        "linked_before": Run("max", F.col("link_end"), strict=True),
        "opened_before": Run("last", F.when(F.col("opens").isNotNull(), idx), strict=True),
        "closed_at": Run("last", F.when(F.col("closes"), idx)),
    })
    fresh = (
        text | F.coalesce(idx > F.col("live_before"), F.lit(True))
        | F.coalesce(F.col("closed_at") > F.col("opened_before"), F.lit(False))
    )
    free = F.coalesce(F.col("linked_before") < idx, F.lit(True))
    d = d.withColumn("starts", F.col("opens").isNotNull() & fresh & free)
    start = F.when(F.col("starts"), idx)
    return running(d, ["stream_id"], ["turn_index"], blk, {
        "stretch": Run("last", start), "stretch_before": Run("last", start, strict=True),
    })


FOLD_ROW = (
    "stream_id", "stretch", "turn_index", "part", "role", "seq", "epoch", "ts_us", "chars",
    "is_correction", "target_type", "target_key", "target_paths", "pointer_chars", "moves",
    "on_episode", "reset", "last_agent_seq", "last_agent_us", "n", "writes", "overlap", "failed",
    "interrupts", "expansions", "claim", "first_seq", "last_seq", "last_us", "operator_seq",
    "operator_us",
)


def _row(df: DataFrame, **cols) -> DataFrame:
    kinds = dict(
        stream_id="string", stretch="long", turn_index="long", part="int", role="string", seq="long",
        epoch="long", ts_us="long", chars="int", is_correction="boolean", target_type="string",
        target_key="string", target_paths="array<string>", pointer_chars="int", moves="boolean",
        on_episode="boolean", reset="boolean", last_agent_seq="long", last_agent_us="long", n="long",
        writes="array<string>", overlap="array<string>", failed="long", interrupts="long",
        expansions="long", claim="boolean", first_seq="long", last_seq="long", last_us="long",
        operator_seq="long", operator_us="long",
    )
    return df.select(*[
        (cols[n] if n in cols else F.lit(None)).cast(kinds[n]).alias(n) for n in FOLD_ROW
    ])


def operator_row(df: DataFrame, stretch, role) -> DataFrame:
    c = F.col
    return _row(
        df, stream_id=c("stream_id"), stretch=stretch, turn_index=c("turn_index"), part=F.lit(-1),
        role=role, seq=c("seq"), epoch=c("epoch_before"), ts_us=F.unix_micros("ts"), chars=c("chars"),
        is_correction=c("is_correction"), target_type=c("target_type"), target_key=c("target_key"),
        target_paths=c("target_paths"), pointer_chars=F.coalesce(c("pointer.chars"), F.lit(0)),
        moves=c("moves"), on_episode=c("on_episode"), reset=c("reset"),
        last_agent_seq=c("last_agent.seq"), last_agent_us=F.unix_micros("last_agent.ts"),
    )


def fold_rows(turns: DataFrame, sequenced: DataFrame, cyc: DataFrame, config=CONFIG) -> DataFrame:
    """Rows of every stretch: operator turns, writing records, and counts of everything else.

    Records without writes of one cycle are summed (apart before and after the overlapping write), so
    a long cycle is a handful of rows. The join to the cycle's marks is spread over blocks of `seq`.
    """
    D = config.window.correction_durability_turns
    idx, c = F.col("turn_index"), F.col
    own = F.when(c("starts") & (c("opens") == "structural"), c("stretch_before")).otherwise(c("stretch"))
    reach = F.when(c("starts") & (c("opens") == "structural"), c("live_before")).otherwise(c("live_until"))
    ops = operator_row(turns.where(own.isNotNull() & (idx <= reach)), own, F.lit("operator"))

    ends = turns.where(c("starts") & c("stretch_before").isNotNull() & (idx <= c("live_before")))
    after = ends.select(
        "stream_id", c("stretch_before").alias("of"), idx.alias("at"),
        (c("opens") == "text").alias("cuts"),
        F.explode(F.sequence(idx, F.least(idx + D, c("live_before")))).alias("turn_index"),
    ).where((c("turn_index") > c("at")) | c("cuts"))
    rest = after.join(turns, CYCLE).withColumn(
        "__role", F.when(c("turn_index") == c("at"), "cut").otherwise("tail"))
    rest = operator_row(rest, c("of"), c("__role"))

    marks = turns.where(c("stretch").isNotNull() & (idx <= c("live_until"))).join(
        cyc.select(*CYCLE, "first_seq", "last_seq"), CYCLE
    ).select(
        *CYCLE, "stretch", "overlap_seq", "overlap", c("seq").alias("operator_seq"),
        F.unix_micros("ts").alias("operator_us"),
        F.explode(F.sequence(block_of(c("first_seq"), RECORD_BLOCK),
                             block_of(c("last_seq"), RECORD_BLOCK))).alias("__rb"),
    )
    body = sequenced.where("not is_op and turn_index >= 1").withColumn(
        "__rb", block_of(c("seq"), RECORD_BLOCK)
    ).join(marks, [*CYCLE, "__rb"])
    part = F.when(c("seq") < c("overlap_seq"), 0).when(c("seq") == c("overlap_seq"), 1).otherwise(
        F.when(c("overlap_seq").isNull(), 0).otherwise(2))
    body = body.withColumn("part", part)
    us = F.unix_micros("ts")
    expansions = c("exp_task") + c("exp_validation") + c("exp_constraint") + c("exp_scope")
    writing = c("is_agent") & (F.size("write_paths") > 0)
    write_rows = _row(
        body.where(writing), stream_id=c("stream_id"), stretch=c("stretch"), turn_index=idx,
        part=c("part"), role=F.lit("agent"), seq=c("seq"), epoch=c("epoch"), n=F.lit(1),
        writes=c("write_paths"),
        overlap=F.when(c("part") == 1, c("overlap")), failed=c("failed_actions"),
        expansions=expansions, claim=c("claim"), first_seq=c("seq"),
        last_seq=F.when(us.isNotNull(), c("seq")), last_us=us,
        last_agent_seq=c("last_agent.seq"), last_agent_us=F.unix_micros("last_agent.ts"),
        operator_seq=c("operator_seq"), operator_us=c("operator_us"),
    )
    timed = F.when(us.isNotNull(), c("seq"))
    sums = body.where(~writing).groupBy(*CYCLE, "stretch", "part", "is_agent").agg(
        F.count("*").alias("n"), F.sum("failed_actions").alias("failed_"),
        F.sum((~c("is_agent") & c("is_interrupt")).cast("long")).alias("interrupts_"),
        F.sum(expansions).alias("expansions_"), F.max("claim").alias("claim_"),
        F.min("seq").alias("first_"), F.max(timed).alias("last_"), F.max_by(us, timed).alias("us_"),
        F.max("seq").alias("seq_"), F.max("epoch").alias("epoch_"),
    )
    sum_rows = _row(
        sums, stream_id=c("stream_id"), stretch=c("stretch"), turn_index=idx, part=c("part"),
        role=F.when(c("is_agent"), "agent").otherwise("other"), seq=c("seq_"), epoch=c("epoch_"),
        n=c("n"), failed=c("failed_"), interrupts=c("interrupts_"), expansions=c("expansions_"),
        claim=c("claim_"), first_seq=c("first_"), last_seq=c("last_"), last_us=c("us_"),
    )
    ends_of = sequenced.groupBy("stream_id").agg(
        F.max("seq").alias("seq_"), F.max("turn_index").alias("turn_"), F.max("epoch").alias("epoch_"))
    last = turns.where("stretch is not null").groupBy("stream_id").agg(
        F.max("stretch").alias("stretch_"))
    finish = _row(
        last.join(ends_of, "stream_id"), stream_id=c("stream_id"), stretch=c("stretch_"),
        turn_index=c("turn_"), part=F.lit(9), role=F.lit("finish"), seq=c("seq_"), epoch=c("epoch_"),
    )
    return ops.unionByName(rest).unionByName(write_rows).unionByName(sum_rows).unionByName(finish)


_REPAIR_DDL = (
    "local_no long, trigger_agent_turn long, first_correction_turn long, target_type string, "
    "target_key string, target_paths array<string>, structural boolean, depth int, status string, "
    "start_us long, last_us long, closed_us long, epoch long, chars long, records long, "
    "pointer_chars int, expansions long, pollution string, recurred boolean, repair_claimed boolean"
)
FOLD_OUT = (
    "stream_id string, stretch long, out string, ord long, seq long, turn_index long, phase int, "
    f"kind string, reason string, {_REPAIR_DDL}, pollution_status string, agent_turn long, "
    "cycle_records long, cycle_claimed boolean, target_repaired boolean, cycle_expansions long, "
    "immediate_correction boolean, cycle_writes long, cycle_interrupts long, cycle_failed long, "
    "open_before boolean, open_turn boolean, open_after boolean"
)
_ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()),
}
_OUT_SCHEMA = pa.schema([
    (part.split()[0], _ARROW[part.split()[1]]) for part in FOLD_OUT.split(", ")
])


def _folder(durability: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, key, ord_ = EpisodeFold(durability), None, 0
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["stream_id"], row["stretch"])
                f.feed(row)
            made = [(kind, body) for kind, found in
                    (("event", f.events), ("turn", f.turns), ("cut", f.cuts)) for body in found]
            f.events, f.turns, f.cuts = [], [], []
            rows = []
            for kind, body in made:
                ord_ += 1
                rows.append({"stream_id": key[0], "stretch": key[1], "out": kind, "ord": ord_, **body})
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT_SCHEMA)
    return fold


def fold_episodes(rows: DataFrame, config=CONFIG) -> DataFrame:
    keys = ["stream_id", "stretch"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "turn_index", "part", "seq")
    return ordered.groupBy(*keys).applyInArrow(
        _folder(config.window.correction_durability_turns), FOLD_OUT)


def number_repairs(folded: DataFrame) -> DataFrame:
    """Replace stretch-local numbers by the stream-wide opening order."""
    opened = folded.where("out = 'event' and kind = 'repair_opened'").select(
        "stream_id", "stretch", "local_no", "seq")
    numbered = running(opened, ["stream_id"], ["seq"], block_of(F.col("seq"), RECORD_BLOCK),
                       {"repair_no": Run("sum", F.lit(1).cast("long"))}).drop("seq")
    return folded.join(numbered, ["stream_id", "stretch", "local_no"], "left").withColumn(
        "repair_id", F.concat(F.lit("rep-"), F.col("repair_no").cast("string")))


def turn_states(turns: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episode columns of every operator turn: its own when folded, else the last opened episode's."""
    shown = ("repair_id", *[f for f in REPAIR_FIELDS if f != "local_no"])
    at = episodes.where("out = 'turn'").select(
        "stream_id", "turn_index", "open_before", "open_turn", "open_after",
        F.when(F.col("local_no").isNotNull(), F.struct(*shown)).alias("state"))
    cut = episodes.where("out = 'cut'").select(
        "stream_id", "turn_index", F.col("open_before").alias("cut_open"))
    d = turns.select("stream_id", "turn_index").join(at, CYCLE, "left").join(cut, CYCLE, "left")
    d = running(d, ["stream_id"], ["turn_index"], block_of(F.col("turn_index"), TURN_BLOCK),
                {"repair": Run("last", F.col("state"))})
    no = F.lit(False)
    return d.select(
        *CYCLE, F.coalesce("cut_open", "open_before", no).alias("open_before"),
        F.coalesce("open_turn", no).alias("open_turn"),
        F.coalesce("open_after", no).alias("open_after"), "repair",
    )


def verified_repairs(turns: DataFrame, sequenced: DataFrame) -> DataFrame:
    """Writes of the cycle after a correction against the paths it named (raw, one correction deep)."""
    named = turns.where("is_correction and size(target_paths) > 0").select(
        *CYCLE, F.explode("target_paths").alias("path"))
    w = sequenced.where("is_agent and size(write_paths) > 0").select(
        *CYCLE, "seq", F.explode("write_paths").alias("path"))
    w = w.join(named.select(*CYCLE).distinct(), CYCLE, "left_semi")
    inside = w.join(named, [*CYCLE, "path"], "left_semi").groupBy(*CYCLE, "seq").agg(
        F.count("*").alias("inside"))
    outside = w.join(named, [*CYCLE, "path"], "left_anti").groupBy(*CYCLE, "seq").agg(
        F.count("*").alias("outside"))
    d = inside.join(outside, [*CYCLE, "seq"], "full_outer")
    return d.select(
        *CYCLE, "seq", (F.coalesce("inside", F.lit(0)) > 0).alias("target_repaired"),
        (F.coalesce("outside", F.lit(0)) > 0).cast("int").alias("new_scope"))
