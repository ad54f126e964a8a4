"""Append-only event log: one row per fact, in emission order, with a deterministic identifier."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helmline.operators import measures as M
from helmline.plans.stage import stage

VERSION = 1

# Event kinds by the file they are kept in; routing is by exact kind.
FILES = {
    "observations": ("record_observed", "observation_stopped", "operator_interrupt"),
    "classifications": (
        "segments_classified", "correction_candidate", "stop_candidate", "reset_candidate",
        "pointer_candidate", "obligation_candidate", "near_repeat_candidate",
        "repair_expansion_candidate", "classifier_failed", "semantic_classification_completed",
    ),
    "metrics": ("pointer_resolved", "epoch_advanced", "regime_changed", "trend_emerged",
                "metrics_computed", "state_at_observation_stop"),
}

SCHEMA = ("stream_id", "seq", "emit_rank", "sub", "item", "epoch", "kind", "class", "payload")


def file_for(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, kinds in FILES.items():
        out = out.when(kind.isin(*kinds), name)
    return (
        out.when(kind.startswith("obligation_"), "obligations")
        .when(kind.startswith("repair_"), "repairs").otherwise("classifications")
    )


def event_id(stream, seq, kind, ordinal, version=VERSION) -> Column:
    """First 32 hex digits of SHA-256 over the NUL-joined identity."""
    parts = [stream, seq.cast("string"), kind, ordinal.cast("string"), F.lit(str(version))]
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 32)


def marked_unknown(a) -> DataFrame:
    """(stream_id, epoch_before, marked): keys of the requirements that stand when an epoch ends, in order of statement.

    A requirement's last state is found by its own key first; only what is listed in one event meets in one row.
    """
    own = ["stream_id", "epoch_before", "identity"]
    left = a.ledger.groupBy(*own).agg(F.max_by("end_state", "turn_index").alias("s")).where("s = 'unresolved'")
    told = left.join(a.introductions.select(*own, "turn_index", "pos", "key"), own)
    return told.groupBy("stream_id", "epoch_before").agg(
        F.array_sort(F.collect_list(F.struct("turn_index", "pos", "key"))).alias("xs")).select(
        "stream_id", "epoch_before", F.transform("xs", lambda x: x["key"]).alias("marked"))


def event_log(a, completions: DataFrame | None = None, failures: DataFrame | None = None, stops: DataFrame | None = None) -> DataFrame:
    """All events of an analysis. `emit_rank`, `sub` and `item` give the order inside a record.

    What an analysis doesn't know by itself comes in tables: completions of deferred classifications (stream_id,
    source_seq, job_id, status, classifier, classifier_version, input_hash), failures of a classifier on a record
    (stream_id, seq, classifier, version, error), and streams whose observation stopped (stream_id, reason). A stop is
    two events after the last record; neither draws a conclusion.
    """
    c, js = F.col, lambda *cols: F.to_json(F.struct(*cols))
    rec, turns, snaps = a.records, a.turns, a.snapshots
    op, said = [d.withColumn("e", c("epoch_before")) for d in (turns, a.sentences)]

    def made(df, rank, kind, cls, payload, sub=F.lit(0), epoch="e", item=F.lit(0)):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        rank = F.lit(rank) if isinstance(rank, int) else rank
        return df.select(
            "stream_id", c("seq").cast("long").alias("seq"), rank.alias("emit_rank"),
            sub.cast("long").alias("sub"), item.cast("long").alias("item"), c(epoch).cast("long").alias("epoch"), kind.alias("kind"),
            F.lit(cls).alias("class"), payload.alias("payload"))

    observed = ("turn_id", "speaker", "speaker_class", "ts", "bytes", "chars", "words", "lines",
                "is_op", "action_count", "failed_actions", "path_targets", "write_paths",
                "quoted_chars", "gap_seconds_previous", "gap_seconds_previous_human", "snippet")
    at_turn = turns.select("stream_id", "turn_index", c("seq").alias("at_seq"),
                           c("epoch_before").alias("e"))
    both = turns.select("stream_id", "turn_index", "epoch_before", c("epoch").alias("epoch_after"))
    # Derived tables without texts are written first, so that the union stays a row of scans and plain joins.
    states = stage(a.episodes.where("out = 'event'").join(both, ["stream_id", "turn_index"]).withColumn(
        "e", F.when(c("phase") <= 5, c("epoch_before")).otherwise(c("epoch_after"))), "states-by-epoch")
    unknown, changes, crossings = (stage(d, n) for d, n in (
        (marked_unknown(a), "unknown"), (M.regime_changes(snaps), "regimes"), (a.trends, "trends")))
    phase = c("phase")
    parts = [
        made(rec, 10, "record_observed", "observed", js(*observed), epoch="epoch_before"),
        made(said.where("size(segs) > 0"), 20, "segments_classified", "classified", js("segs", "b")),
        made(op.where("is_correction"), 21, "correction_candidate", "classified",
             js("correction_marker", "target_type", "target_key", "target_paths",
                c("last_agent.seq").alias("trigger_agent_turn"))),
        made(states.where("kind = 'repair_opened' and structural"), 28, "correction_candidate", "classified",
             js(F.lit("structural").alias("correction_marker"), "target_type", "target_key", "target_paths", "trigger_agent_turn",
                c("first_correction_turn").alias("source_turn"))),
        made(op.where("stop"), 22, "stop_candidate", "classified", js(F.lit("stop").alias("marker"))),
        made(op.where("reset"), 23, "reset_candidate", "classified",
             js(F.lit("reset").alias("marker"))),
        made(op.where("pointer is not null"), 24, "pointer_candidate", "classified", js("pointer")),
        made(said.select("stream_id", "seq", "e", F.explode("kept").alias("k")), 25, "obligation_candidate", "classified",
             js("k"), sub=c("k.pos")),
        made(a.near_repeats, 26, "near_repeat_candidate", "classified",
             js("key", "prior_key", "jaccard", "text"), epoch="epoch_before"),
        made(rec.where("is_agent and (exp_task + exp_validation + exp_constraint + exp_scope > 0)"),
             27, "repair_expansion_candidate", "classified",
             js("exp_task", "exp_validation", "exp_constraint", "exp_scope", "claim"), epoch="epoch"),
        made(rec.where("is_interrupt and not is_op and not is_agent"), 28, "operator_interrupt",
             "observed", js("turn_index"), epoch="epoch"),
        made(states, F.when(phase == 1, 30).when(phase == 2, 33).when(phase == 3, 40)
             .when(phase <= 5, 43 + phase).otherwise(29), c("kind"), "derived",
             js("repair_id", "status", "reason", "depth", "target_type", "target_key", "structural",
                "chars", "records", "pollution_status", "agent_turn", "cycle_records",
                "target_repaired", "cycle_expansions", "immediate_correction"),
             sub=c("stretch"), item=c("ord")),
        made(a.pointers.where("settled_turn is not null").withColumn("turn_index", c("settled_turn"))
             .drop("seq").withColumnRenamed("epoch_before", "e0")
             .join(at_turn, ["stream_id", "turn_index"]).withColumn("seq", c("at_seq")),
             F.when(c("evidence") == "epoch_end", 49).otherwise(31), "pointer_resolved", "derived",
             js("pointer_type", "outcome", "evidence")),
        made(a.claims, 34, "obligation_released", "derived", js("key", "marker", "cover"),
             sub=c("pos"), epoch="epoch_before"),
        made(a.occurrences, F.when(c("event") == "introduced", 35)
             .when(c("event") == "revived", 36).otherwise(37),
             F.concat(F.lit("obligation_"), c("event")), "derived",
             js("key", "kind", "repeat_count"), sub=c("pos"), epoch="epoch_before"),
        made(a.violations, 38, "obligation_violated", "derived", js("identity"),
             epoch="epoch_before"),
        made(op.where("reset").join(unknown, ["stream_id", "epoch_before"], "left"), 50, "epoch_advanced", "derived",
             js(c("epoch_before").alias("from"), c("epoch").alias("to"),
                F.coalesce("marked", F.array().cast("array<string>")).alias("obligations_marked_unknown"))),
        made(changes.join(
            snaps.select("stream_id", "turn_index", "epoch"), ["stream_id", "turn_index"]),
             51, "regime_changed", "derived", js("from_regime", "to_regime", "rule"), epoch="epoch"),
        made(snaps, 52, "metrics_computed", "derived", js(*snaps.columns), epoch="epoch"),
        made(crossings.join(snaps.select("stream_id", "turn_index", "epoch"),
                           ["stream_id", "turn_index"]), 53, "trend_emerged", "derived",
             js("metric", "from_band", "to_band", "direction", "turns_held"),
             sub=F.array_position(F.array(*[F.lit(m) for m in M.TREND_METRICS]), c("metric")),
             epoch="epoch"),
    ]
    at = rec.select("stream_id", c("seq").cast("long").alias("seq"), "epoch_before")
    if failures is not None:
        failed = failures.select("stream_id", c("seq").cast("long").alias("seq"), "classifier", "version", "error").join(at, ["stream_id", "seq"])
        parts.append(made(failed, 19, "classifier_failed", "classified", js("classifier", "version", "error"), epoch="epoch_before"))
    if completions is not None:
        done = completions.withColumn("seq", c("source_seq").cast("long")).join(at, ["stream_id", "seq"])
        parts.append(made(done, 60, "semantic_classification_completed", "classified",
                          js("job_id", "status", "classifier", "classifier_version", "input_hash"), epoch="epoch_before"))
    if stops is not None:
        from helmline.operators.summary import state_at_stop

        last = rec.groupBy("stream_id").agg(F.max_by(F.struct("seq", "epoch"), "seq").alias("l")).select(
            "stream_id", c("l.seq").alias("seq"), c("l.epoch").alias("e"))
        ended = last.join(stops.select("stream_id", "reason"), "stream_id")
        # A stream without operator turns has nothing open.
        held = ended.join(stage(state_at_stop(a).drop("epoch"), "inventory"), "stream_id", "left")
        none = lambda n: F.coalesce(c(n), F.lit(0)).alias(n)
        parts += [
            made(ended, 70, "observation_stopped", "observed", js("reason", c("seq").alias("last_record"))),
            made(held, 71, "state_at_observation_stop", "derived",
                 js(c("e").alias("epoch"), "open_repair", none("pending_pointers"), none("repairs_awaiting_durability"),
                    none("unresolved_obligation_candidates")))]
    return reduce(DataFrame.unionByName, parts)


def with_ids(events: DataFrame) -> DataFrame:
    """Ordinal among events of one kind of one record, and the identifier derived from it.

    A record emits few events, but one kind of one record is the only partition: no stream is held.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id", "seq", "kind").orderBy("emit_rank", "sub", "item", "payload")
    d = events.withColumn("ordinal", F.row_number().over(w) - 1)
    return d.withColumn("id", event_id(F.col("stream_id"), F.col("seq"), F.col("kind"), F.col("ordinal")))


BUCKETS = 64
#: Writes that stand side by side in a bucket; the next one folds them into its own.
_SIDE_BY_SIDE = 16
#: Records of one stream that a task writes; a longer stream is several files of its bucket.
_STRETCH = 100_000
_PLACE = ["stream_id", "seq", "emit_rank", "sub", "item"]


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commits(spark: SparkSession, root: str) -> list:
    """(version, write, buckets, replaced) of each complete manifest, oldest first. A manifest cut short doesn't parse and counts as none."""
    fs, p = _files(spark, f"{root}/manifest")
    if not fs.exists(p):
        return []
    d = spark.read.schema("version long, write string, buckets array<int>, replaced array<int>, complete boolean").json(f"{root}/manifest")
    return d.where("complete").select("version", "write", "buckets", "replaced").orderBy("version").collect()


def _live(commits: list) -> dict[int, list[str]]:
    """The writes whose rows stand in each bucket: those since the last one that replaced it."""
    live: dict[int, list[str]] = {}
    for r in commits:
        for b in r["buckets"]:
            live[b] = [r["write"]] if b in r["replaced"] else [*live.get(b, []), r["write"]]
    return live


def _committed(spark: SparkSession, root: str, file: str | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """Rows of complete writes: a filter on partition columns, with at most `_SIDE_BY_SIDE` entries a bucket."""
    live = _live(_commits(spark, root))
    kept = [f"{w}/{b}" for b, writes in sorted(live.items()) for w in writes if buckets is None or b in buckets]
    if not live:
        return None
    d = spark.read.parquet(f"{root}/data")
    if file is not None:
        d = d.where(F.col("file") == file)
    return d.where(F.concat_ws("/", "write", F.col("bucket").cast("string")).isin(kept)).drop("write", "bucket")


def _put(events: DataFrame, root: str, write: str, buckets: int) -> None:
    d = events.withColumn("bucket", F.pmod(F.xxhash64("stream_id"), F.lit(buckets)).cast("int"))
    d = d.repartition("file", "bucket", F.floor(F.col("seq") / _STRETCH)).sortWithinPartitions("file", "bucket", *_PLACE)
    d.write.mode("append").partitionBy("file", "bucket").parquet(f"{root}/data/write={write}")


def write_events(events: DataFrame, root: str, force: bool = False, buckets: int = BUCKETS) -> None:
    """Append-only log: a fixed number of buckets of streams a file, sorted by stream and place.

    The rows of a write become readable at once, by one manifest that is created last and never replaced; a write that fails,
    is killed or meets another writer's manifest leaves nothing readable. A stream that is in the log already is refused, and
    with it the whole write. With force, its rows are replaced: buckets it touches are written anew with their other streams.
    `buckets` is fixed by the first write and read from the log later. An empty write leaves the log as it is.
    """
    spark = events.sparkSession
    # The next place is taken before the log is read, so that a writer who commits meanwhile makes this write fail. The place
    # of a manifest that was cut short stays taken.
    fs, p = _files(spark, f"{root}/manifest")
    version = 1 + max((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(p)), default=-1) if fs.exists(p) else 0
    commits = _commits(spark, root)
    if commits:
        fs, p = _files(spark, f"{root}/layout")
        at = fs.open(p)
        buckets = int(at.readLine())
        at.close()
    write = f"w{uuid.uuid4().hex}"
    _put(events.withColumn("file", file_for(F.col("kind"))), root, write, buckets)
    mine = f"{root}/data/write={write}"
    written = spark.read.parquet(mine) if any(
        f.isDirectory() for f in _files(spark, mine)[0].listStatus(_files(spark, mine)[1])) else None
    if written is None:
        return
    touched = sorted(r[0] for r in written.select("bucket").distinct().collect())  # at most `buckets` numbers
    live = _live(commits)
    replaced = [b for b in touched if force or len(live.get(b, [])) >= _SIDE_BY_SIDE]
    if commits:
        held = _committed(spark, root, buckets=touched)
        streams = stage(written.select(F.col("stream_id").alias("mine")).distinct(), "logged")
        same = F.col("stream_id").eqNullSafe(F.col("mine"))
        if not force:
            again = held.join(streams, same, "left_semi").select("stream_id").first()
            if again is not None:
                fs, p = _files(spark, mine)
                fs.delete(p, True)
                raise ValueError(f"stream {again.stream_id} already exists in {root}")
        if replaced:
            _put(_committed(spark, root, buckets=replaced).join(streams, same, "left_anti"), root, write, buckets)
    if not commits:
        _create(spark, f"{root}/layout", str(buckets), keep=True)
    _create(spark, f"{root}/manifest/{version:010d}.json", json.dumps(
        {"version": version, "write": write, "buckets": touched, "replaced": replaced, "complete": True}))


def _create(spark: SparkSession, path: str, text: str, keep: bool = False) -> None:
    """A new file; one that exists is an error, or stays when `keep` is set."""
    fs, p = _files(spark, path)
    if keep and fs.exists(p):
        return
    out = fs.create(p, False)
    out.write(bytearray(text + "\n", "utf-8"))
    out.close()


def read_events(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """Rows of complete writes; naming a kind reads only the file that holds it."""
    if kind is None:
        name = None
    else:
        name = next((f for f, kinds in FILES.items() if kind in kinds), None) or (
            "obligations" if kind.startswith("obligation_")
            else "repairs" if kind.startswith("repair_") else "classifications")
    d = _committed(spark, root, name)
    if d is None:
        raise ValueError(f"no complete write in {root}")
    return d if kind is None else d.where(F.col("kind") == kind)


def current_objects(events: DataFrame, id_col: str) -> DataFrame:
    """Last event per object: its current state."""
    at = F.struct("seq", "emit_rank", "sub", "item")
    cols = [c for c in events.columns if c not in ("stream_id", id_col)]
    return events.groupBy("stream_id", id_col).agg(
        F.max_by(F.struct(*cols), at).alias("last")).select("stream_id", id_col, "last.*")
