"""Every snapshot column live: keyed state per stream, one entry per requirement, reference and episode.

A record's own facts are the column stage of the batch run; they reach the state as one JSON text. The state is split
into variables that are written only where they changed: a map per standing requirement, per pending reference, per
episode, per turn of history, per record that waits for its turn, and a value for each running measure. The state emits
counts; ratios, regime and bands are the batch run's expressions over them.

Records are applied in order of `seq`. A missing one is waited for: a timer on the watermark of the arrival time gives up
on it once a record behind it has waited for the stated delay. The gap comes out as a row, and so does a record that
arrives after it was given up; a repeated record is dropped. `gaps` says the same of a finished table. Arrival decides
nothing else, so a repeated run gives the same rows.

The state needs the RocksDB provider: `configure(spark)`.
"""

from __future__ import annotations

import json
import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from helmline.config import DEFAULT as CONFIG
from helmline.config import DRIFT_WINDOW_TURNS
from helmline.functions import text as T
from helmline.functions.fold import EpisodeFold
from helmline.lexicon import DEFAULT as LEXICON
from helmline.operators import measures as M
from helmline.operators import turns as W
from helmline.operators.features import bucket_of, record_features

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = ("forward", "control", "recovery", "restate", "other")
OUT = "stream_id string, kind string, seq long, body string"
TURN = (
    "turn_index long, turn_id string, us long, epoch long, user_chars int, quoted_chars long, repeat_chars long, "
    "forward_chars long, control_chars long, recovery_chars long, restate_chars long, other_chars long, "
    "baseline_median double, baseline_turns int, new_obligations long, unresolved long, repeated long, violated long, "
    "released long, repeats long, median_age double, pointer_success long, pointer_failure long, pointer_unknown long, "
    "recent_corrections long, recent_interrupts long, recent_dereference_misses long, recent_obligation_repeats long, "
    "is_correction boolean, reset boolean, repair_no long, repair_open boolean, depth int, chars long, records long, "
    "start_us long, last_us long, closed_us long, pointer_chars long, status string, expansions long, pollution string"
)


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def facts(records: DataFrame, lex=LEXICON, config=CONFIG, *more) -> DataFrame:
    """(stream_id, seq, body) and more columns of each record: what the state reads of it. Sentences are normalized, no text leaves."""
    f = record_features(records, lex, config)
    long_enough = lambda x: F.octet_length(x) >= 8
    body = F.struct(
        F.when(F.col("is_op"), "operator").when(F.col("is_agent"), "agent").otherwise("other").alias("role"),
        "turn_id", F.unix_micros("ts").alias("us"), "chars", "quoted_chars", "is_interrupt", "write_paths",
        "failed_actions", (F.col("exp_task") + F.col("exp_validation") + F.col("exp_constraint") + F.col("exp_scope")).alias("expansions"),
        "claim", F.col("tier1").isNotNull().alias("worded"), F.col("tier2").isNotNull().alias("hinted"),
        F.coalesce("reset", F.lit(False)).alias("reset"), F.coalesce("acceptance", F.lit(False)).alias("acceptance"),
        (F.coalesce("continuation", F.lit(False)) | F.coalesce("stop", F.lit(False))).alias("steering"),
        "target_type", "target_key", "named_paths",
        F.col("pointer.chars").alias("pointer_chars"), T.normalize(F.col("pointer.text")).alias("pointer_key"),
        F.transform("segs", lambda s: F.struct(
            s["chars"].alias("chars"), s["label"].alias("label"), F.lower(bucket_of(s["label"])).alias("bucket"),
            F.when(long_enough(s["norm"]), s["norm"]).alias("norm"))).alias("segs"),
        F.transform("line_norms", lambda x: F.struct(x["norm"].alias("norm"), x["chars"].alias("chars"))).alias("lines"),
        F.transform("kept", lambda k: F.struct(
            k["key"].alias("key"), F.coalesce(F.nullif(k["content_key"], F.lit("")), k["key"]).alias("id"),
            T.token_set(k["key"]).alias("tokens"))).alias("kept"),
        F.transform("release_sents", lambda r: T.token_set(T.without_first(r["text"], r["marker"]))).alias("release"))
    return f.select("stream_id", "seq", F.to_json(body).alias("body"), *more)


class Table:
    """A map variable of the state: read once a batch, written back entry by entry where it changed."""

    def __init__(self, state) -> None:
        self.state = state
        self.was = {k[0]: v[0] for k, v in state.iterator()} if state.exists() else {}
        self.now = {k: json.loads(v) for k, v in self.was.items()}

    def save(self) -> None:
        for k in self.was.keys() - self.now.keys():
            self.state.removeKey((k,))
        for k, v in self.now.items():
            text = json.dumps(v, sort_keys=True)
            if self.was.get(k) != text:
                self.state.updateValue((k,), (text,))


class Values:
    """A value variable of the state, with the names and first values of its parts."""

    def __init__(self, state, first: dict) -> None:
        self.state = state
        held = state.get() if state.exists() else None
        self.was = None if held is None else {k: list(v) if isinstance(first[k], list) else v for k, v in zip(first, held)}
        # Lists are changed in place: what was is kept apart.
        self.now = {k: list(v) if isinstance(v, list) else v for k, v in (self.was or first).items()}

    def save(self) -> None:
        if self.now != self.was:
            self.state.update(tuple(self.now.values()))


#: Variables of the state. Maps hold a JSON text per entry; values hold the parts with these first values.
MAPS = {"held": "seq long", "lost": "seq long", "standing": "id string", "pending": "seq long", "episodes": "no long",
        "lines": "turn long", "sentences": "turn long"}
VALUES = {
    "place": ("next long, turn long, epoch long, fresh boolean, agent_seq long, agent_us long, op_seq long, op_us long",
              dict(next=1, turn=0, epoch=0, fresh=False, agent_seq=0, agent_us=None, op_seq=0, op_us=None)),
    "counts": ("released long, success long, failure long, unknown long", dict(released=0, success=0, failure=0, unknown=0)),
    "totals": ("opened long, chars long, records long, clock_seq long, clock_us long",
               dict(opened=0, chars=0, records=0, clock_seq=0, clock_us=None)),
    "sizes": ("baseline array<long>", dict(baseline=[])),
    "buckets": (", ".join(f"{b} array<long>" for b in BUCKETS), {b: [] for b in BUCKETS}),
    "marks": ("corrections array<long>, misses array<long>, interrupts array<long>, repeats array<long>",
              dict(corrections=[], misses=[], interrupts=[], repeats=[])),
    "writes": ("before array<string>, now array<string>", dict(before=[], now=[])),
}


class Stream:
    """The working copy of one stream's state; `feed` takes its records in order and returns the turn it made, if any."""

    def __init__(self, variables: dict, config, least_shared: int, coverage: float) -> None:
        self.v, self.config, self.least_shared, self.coverage = variables, config, least_shared, coverage
        for name in (*MAPS, *VALUES):
            setattr(self, name, variables[name].now)
        t = self.totals
        self.fold = EpisodeFold(config.window.correction_durability_turns, dict(
            opened=t["opened"], chars=t["chars"], records=t["records"], clock=[t["clock_seq"], t["clock_us"]],
            episodes=[e for _, e in sorted(self.episodes.items(), key=lambda x: x[1]["place"])]))

    def save(self) -> None:
        s = self.fold.s
        self.totals.update(opened=s["opened"], chars=s["chars"], records=s["records"], clock_seq=s["clock"][0], clock_us=s["clock"][1])
        self.episodes.clear()
        self.episodes.update({e["local_no"]: e | {"place": k} for k, e in enumerate(s["episodes"])})
        for x in self.v.values():
            x.save()

    # ---- records ------------------------------------------------------------------------------------
    def feed(self, seq: int, r: dict) -> dict | None:
        p, w = self.place, self.writes
        if r["role"] == "operator":
            w["before"], w["now"] = w["now"], []
            p["op_seq"], p["op_us"] = seq, r.get("us")
            made = self.operator(seq, r)
            self.fold.turns.clear()
        else:
            made = None
            row = dict(n=1, failed=r["failed_actions"], last_seq=seq, last_us=r.get("us"))
            if r["role"] == "agent":
                self.agent(seq, r, row)
            else:
                if r["is_interrupt"]:
                    self.marks["interrupts"].append(p["turn"])
                self.fold.other(row | {"interrupts": int(r["is_interrupt"])})
        self.fold.events.clear()
        return made

    def agent(self, seq: int, r: dict, row: dict) -> None:
        p, w, paths = self.place, self.writes, r.get("write_paths") or []
        again = [x for x in paths if x in w["before"]] if p["turn"] else []
        if p["turn"]:
            w["now"] = sorted({*w["now"], *paths})
        rewrites = bool(again) and self.fold.current is None
        if rewrites:
            w["before"] = []
            self.marks["corrections"].append(p["turn"])
        self.fold.agent(row | dict(
            seq=seq, turn_index=p["turn"], epoch=p["epoch"], writes=paths, overlap=again if rewrites else None,
            expansions=r["expansions"], claim=r.get("claim"), first_seq=seq, last_agent_seq=p["agent_seq"],
            last_agent_us=p["agent_us"], operator_seq=p["op_seq"], operator_us=p["op_us"]))
        p["agent_seq"], p["agent_us"] = seq, r.get("us")

    def operator(self, seq: int, r: dict) -> dict:
        p, keep = self.place, self.config.window.rolling_turns
        p["turn"] += 1
        t = p["turn"]
        repeat_chars = self.observe(t, r.get("lines") or [], keep)
        sums = self.bucket_sums(r.get("segs") or [])
        if p["fresh"]:
            self.forget()
        open_ones = {k for k, o in self.standing.items() if not o["gone"]}
        kept = r.get("kept") or []
        fixed = r["worded"] or (r["hinted"] and any(k["id"] in open_ones for k in kept))
        key = (r.get("target_key") or "") if fixed else ""
        moves = r["acceptance"] or sums["forward"] > 0
        self.settle_references(t, fixed, key, moves, keep)
        self.release(r.get("release") or [], open_ones)
        new = self.state(t, kept, fixed, key)
        self.fold.operator(dict(
            seq=seq, turn_index=t, epoch=p["epoch"], ts_us=r.get("us"), chars=r["chars"], is_correction=fixed,
            target_type=r.get("target_type") if fixed else "unknown", target_key=key,
            target_paths=(r.get("named_paths") or []) if fixed else [], pointer_chars=r.get("pointer_chars") or 0, moves=moves,
            on_episode=r["steering"] or any(sums[b] for b in ("control", "recovery", "restate")), reset=r["reset"],
            last_agent_seq=p["agent_seq"], last_agent_us=p["agent_us"]))
        shown = self.fold.turns[-1]
        refers = r.get("pointer_chars") is not None
        if refers:
            self.pending[seq] = dict(key=r.get("pointer_key") or "", seen=False, left=self.config.window.dereference_outcome_turns,
                                     chars=r["chars"], base=not fixed and not shown["open_turn"])
        for b in BUCKETS:
            self.buckets[b] = (self.buckets[b] + [sums[b]])[-keep:]
        if fixed:
            self.marks["corrections"].append(t)
        self.sentences[t] = sorted({s["norm"] for s in r.get("segs") or [] if s.get("norm")})
        for old in [k for k in self.sentences if k <= t - keep]:
            del self.sentences[old]
        if r["reset"]:
            self.counts["unknown"] += len(self.pending)
            self.pending.clear()
            self.standing.clear()
            p["epoch"] += 1
            p["fresh"] = True
        made = self.measured(t, r, shown, new, repeat_chars)
        made["is_correction"] = fixed
        if not refers and not fixed and not shown["open_after"]:
            self.sizes["baseline"] = (self.sizes["baseline"] + [r["chars"]])[-keep:]
        return made

    # ---- parts of a turn ----------------------------------------------------------------------------
    def observe(self, t: int, lines: list[dict], keep: int) -> int:
        """Characters of lines an earlier turn of the window sent; the first turn of an epoch still sees the one it left."""
        seen = {n for norms in self.lines.values() for n in norms}
        self.lines[t] = sorted({x["norm"] for x in lines})
        for old in [k for k in self.lines if k <= t - keep]:
            del self.lines[old]
        return sum(x["chars"] for x in lines if x["norm"] in seen)

    def bucket_sums(self, segs: list[dict]) -> dict[str, int]:
        said = {n for norms in self.sentences.values() for n in norms}
        active, sums = self.fold.current is not None, dict.fromkeys(BUCKETS, 0)
        for s in segs:
            if s["label"] == "handoff":
                b = "recovery" if active else "control"
            else:
                b = "restate" if s["label"] != "correction" and s.get("norm") in said else s["bucket"]
            sums[b] += s["chars"]
        return sums

    def forget(self) -> None:
        """The first turn after a reset starts without history."""
        self.place["fresh"] = False
        self.lines.clear()
        self.sentences.clear()
        self.sizes["baseline"] = []
        self.buckets.update({b: [] for b in BUCKETS})
        self.marks.update({k: [] for k in self.marks})

    def settle_references(self, t: int, fixed: bool, key: str, moves: bool, keep: int) -> None:
        for seq in sorted(self.pending):
            ref = self.pending[seq]
            if self.place["agent_seq"] <= seq:
                continue
            first, ref["seen"] = not ref["seen"], True
            if first and (fixed or moves):
                outcome = "failure" if fixed else "success"
            elif fixed and key and key == ref["key"]:
                outcome = "failure"
            else:
                ref["left"] -= 1
                if ref["left"]:
                    continue
                outcome = "unknown"
            del self.pending[seq]
            self.counts[outcome] += 1
            if outcome == "failure":
                self.marks["misses"].append(t)
            elif ref["base"]:
                self.sizes["baseline"] = (self.sizes["baseline"] + [ref["chars"]])[-keep:]

    def release(self, sentences: list[list[str]], open_ones: set[str]) -> None:
        """Each release sentence ends the one requirement that fits it best, if there is just one."""
        left = set(open_ones)
        for words in map(set, sentences):
            fits: dict[float, list[str]] = {}
            for k in left:
                want = set(self.standing[k]["tokens"])
                shared = len(want & words)
                if shared >= self.least_shared and shared / len(want) >= self.coverage:
                    fits.setdefault(shared / len(want), []).append(k)
            best = fits[max(fits)] if fits else []
            if len(best) == 1:
                left.discard(best[0])
                self.standing[best[0]].update(gone=True, violated=False)
                self.counts["released"] += 1

    def state(self, t: int, kept: list[dict], fixed: bool, key: str) -> int:
        """New requirements; known ones are repeated, or stand again after a release."""
        new, repeated = 0, False
        for k in {k["key"]: k for k in reversed(kept)}.values().__reversed__():
            o = self.standing.get(k["id"])
            if o is None:
                self.standing[k["id"]] = dict(key=k["key"], tokens=k["tokens"], n=0, gone=False, violated=False, at=t)
                new += 1
                continue
            o["n"] += 1
            if o["gone"]:
                o["gone"] = False
                self.counts["released"] -= 1
                continue
            repeated = True
            if fixed and key == o["key"]:
                o["violated"] = True
        if repeated:
            self.marks["repeats"].append(t)
        return new

    def measured(self, t: int, r: dict, shown: dict, new: int, repeat_chars: int) -> dict:
        for k, at in self.marks.items():
            self.marks[k] = [x for x in at if t - x < DRIFT_WINDOW_TURNS]
        open_ones = [o for o in self.standing.values() if not o["gone"]]
        sizes, n = self.sizes["baseline"], len(self.sizes["baseline"])
        return dict(
            turn_index=t, turn_id=r.get("turn_id"), us=r.get("us"), epoch=self.place["epoch"], user_chars=r["chars"],
            quoted_chars=r["quoted_chars"], repeat_chars=repeat_chars, **{f"{b}_chars": sum(self.buckets[b]) for b in BUCKETS},
            baseline_median=float(statistics.median(sizes)) if n else None, baseline_turns=n, new_obligations=new,
            unresolved=len(open_ones), repeated=sum(o["n"] > 0 for o in open_ones), violated=sum(o["violated"] for o in open_ones),
            released=self.counts["released"], repeats=sum(o["n"] for o in open_ones),
            median_age=float(statistics.median(t - o["at"] for o in open_ones)) if open_ones else None,
            **{f"pointer_{k}": self.counts[k] for k in ("success", "failure", "unknown")},
            recent_corrections=len(self.marks["corrections"]), recent_interrupts=len(self.marks["interrupts"]),
            recent_dereference_misses=len(self.marks["misses"]), recent_obligation_repeats=len(self.marks["repeats"]),
            reset=r["reset"], repair_no=shown.get("local_no"), repair_open=shown["open_after"],
            **{k: shown.get(k) for k in ("depth", "chars", "records", "start_us", "last_us", "closed_us", "pointer_chars", "status", "expansions", "pollution")})


class Snapshots(StatefulProcessor):
    """Applies records in order; gives up on a missing one once the watermark has passed a record behind it."""

    def __init__(self, config, least_shared: int, coverage: float) -> None:
        self.rules = config, least_shared, coverage

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.maps = {n: handle.getMapState(n, key, "body string") for n, key in MAPS.items()}
        self.values = {n: handle.getValueState(n, schema) for n, (schema, _) in VALUES.items()}

    def opened(self) -> Stream:
        return Stream({n: Table(s) for n, s in self.maps.items()} | {n: Values(s, VALUES[n][1]) for n, s in self.values.items()}, *self.rules)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self.opened(), []
        for frame in rows:
            for seq, body, at in zip(frame["seq"].tolist(), frame["body"].tolist(), frame["at"].tolist()):
                if seq >= s.place["next"]:
                    if seq not in s.held or at < s.held[seq]["at"]:
                        s.held[seq] = dict(at=at, row=json.loads(body))
                elif any(a <= seq <= b for a, b in s.lost.items()):
                    out.append(("late", seq, {}))
            self.in_order(s, out)
        yield self.closed(key, s, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out, reached = self.opened(), [], max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        while s.held and min(x["at"] for x in s.held.values()) <= reached:
            first = min(s.held)
            s.lost[s.place["next"]] = first - 1
            out.append(("gap", s.place["next"], dict(to=first - 1)))
            s.place["next"] = first
            self.in_order(s, out)
        yield self.closed(key, s, out)

    def in_order(self, s: Stream, out: list) -> None:
        while (x := s.held.pop(s.place["next"], None)) is not None:
            seq = s.place["next"]
            if (made := s.feed(seq, x["row"])) is not None:
                out.append(("turn", seq, made))
            s.place["next"] += 1

    def closed(self, key, s: Stream, out: list) -> pd.DataFrame:
        for at in [*self.handle.listTimers()]:
            self.handle.deleteTimer(at)
        if s.held:
            self.handle.registerTimer(min(x["at"] for x in s.held.values()))
        s.save()
        return pd.DataFrame([(key[0], kind, seq, json.dumps(body)) for kind, seq, body in out], columns=["stream_id", "kind", "seq", "body"])

    def close(self) -> None:
        pass


def live(records: DataFrame, arrival: str = "arrival", delay: str = "1 minute", lex=LEXICON, config=CONFIG) -> DataFrame:
    """(stream_id, kind, seq, body): turns, gaps and late records of a stream of records, as they become certain.

    arrival: the time a record came in; a gap is given up once a record that came `delay` later than one behind it is in.
    """
    rules = (config, int(lex.param("release_shared_tokens", 2)), float(lex.param("release_coverage", 0.5)))
    # The column stage hands on `source` as it is; the time of arrival travels in it.
    marked = records.withColumn("source", F.struct("source", F.col(arrival).alias("arrival")))
    came = F.col("source.arrival")
    held = facts(marked, lex, config, came.alias("arrival"), F.unix_millis(came).alias("at")).withWatermark("arrival", delay)
    return held.groupBy("stream_id").transformWithStateInPandas(Snapshots(*rules), OUT, "append", "EventTime")


def turns(emitted: DataFrame, config=CONFIG) -> DataFrame:
    """The snapshot columns of the batch run from emitted rows; a row at a time, so also on a stream."""
    d = emitted.where("kind = 'turn'").select("stream_id", "seq", F.from_json("body", TURN).alias("x")).select("stream_id", "seq", "x.*")
    c, zero = F.col, F.lit(0)
    total = sum((c(f"{b}_chars") for b in BUCKETS[1:]), c("forward_chars"))
    base = F.when(c("baseline_turns") >= config.thresholds.minimum_control_baseline, c("baseline_median"))
    end = F.coalesce("closed_us", F.when(c("status") == "open", c("last_us")))
    decided = c("pointer_success") + c("pointer_failure")
    d = d.withColumns({
        "ts": F.timestamp_micros("us"), "baseline_chars": base,
        "serialization_inflation": F.when(base != 0, c("user_chars") / base),
        "quoted_fraction": F.coalesce(W.ratio(c("quoted_chars"), c("user_chars")), F.lit(0.0)),
        "repeat_fraction": F.coalesce(W.ratio(c("repeat_chars"), c("user_chars")), F.lit(0.0)),
        "forward_work_share": W.ratio(c("forward_chars"), total),
        "control_plane_burden": W.ratio(c("control_chars") + c("recovery_chars") + c("restate_chars"), total),
        "restate_burden": W.ratio(c("restate_chars"), total),
        "unresolved_obligations": c("unresolved"), "repeated_obligations": c("repeated"), "violated_obligations": c("violated"),
        "released_obligations": c("released"), "mean_repeat_count": W.ratio(c("repeats"), c("unresolved")),
        "median_candidate_age": c("median_age"),
        "obligation_repeat_ratio": F.coalesce(W.ratio(c("repeated"), c("unresolved")), F.lit(0.0)),
        "dereference": F.when(decided > 0, c("pointer_success") / decided),
        "repair_id": F.when(c("repair_no").isNotNull(), F.concat(F.lit("rep-"), c("repair_no").cast("string"))),
        "repair_depth": F.coalesce("depth", zero), "repair_chars": F.coalesce("chars", zero), "repair_records": F.coalesce("records", zero),
        "repair_seconds": F.when(end >= c("start_us"), (end - c("start_us")) / F.lit(1e6)),
        "repair_magnification": F.when(c("pointer_chars") > 0, c("chars") / c("pointer_chars")),
        "repair_status": c("status"), "repair_expansions": F.coalesce("expansions", zero),
        "pollution_status": F.coalesce("pollution", F.lit("")),
        "open_depth": F.when(c("repair_open"), c("depth")), "open_chars": F.when(c("repair_open"), c("chars")),
    })
    return M.regime(d, config).select(
        "stream_id", "seq", "turn_index", "turn_id", "ts", "epoch", "regime", "regime_rule", "user_chars", "baseline_chars",
        "baseline_turns", "serialization_inflation", "quoted_fraction", "repeat_fraction", *(f"{b}_chars" for b in BUCKETS),
        "forward_work_share", "control_plane_burden", "restate_burden", "unresolved_obligations", "new_obligations",
        "repeated_obligations", "violated_obligations", "released_obligations", "mean_repeat_count", "median_candidate_age",
        "obligation_repeat_ratio", "pointer_success", "pointer_failure", "pointer_unknown", "dereference", "repair_id",
        "repair_open", "repair_depth", "repair_chars", "repair_records", "repair_seconds", "repair_magnification",
        "repair_status", "repair_expansions", "pollution_status", "recent_corrections", "recent_interrupts",
        "recent_dereference_misses")


def lost(emitted: DataFrame) -> DataFrame:
    """(stream_id, from_seq, to_seq) of the gaps that were given up."""
    return emitted.where("kind = 'gap'").select(
        "stream_id", F.col("seq").alias("from_seq"), F.get_json_object("body", "$.to").cast("long").alias("to_seq"))


def gaps(records: DataFrame) -> DataFrame:
    """(stream_id, from_seq, to_seq): missing records of a finished table, before a record that is there.

    A stream is cut into blocks of seq; each block looks back at the last seq of the blocks before it.
    """
    from helmline.functions.ordered import RECORD_BLOCK, Run, block_of, running

    seqs = records.select("stream_id", "seq").distinct()
    d = running(seqs, ["stream_id"], ["seq"], block_of(F.col("seq"), RECORD_BLOCK), {"before": Run("last", F.col("seq"), strict=True)})
    since = F.coalesce("before", F.lit(0)) + 1
    return d.where(F.col("seq") > since).select("stream_id", since.cast("long").alias("from_seq"), (F.col("seq") - 1).alias("to_seq"))


# ---- trends ---------------------------------------------------------------------------------------
TREND_OUT = "stream_id string, metric string, turn_index long, seq long, from_band string, to_band string, direction string, turns_held long"


class Crossings(StatefulProcessor):
    """Band crossings of one measure of one stream: the confirmed band, and how long another one has held."""

    def __init__(self, hold: int) -> None:
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.band = handle.getValueState("band", "confirmed string, last string, held long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        confirmed, last, held = self.band.get() if self.band.exists() else (None, None, 0)
        out, rank = [], {"good": 1, "mid": 2, "bad": 3}
        found = sorted((t, q, b) for f in rows for t, q, b in zip(f["turn_index"].tolist(), f["seq"].tolist(), f["band"].tolist()))
        for turn, seq, band in found:
            held = held + 1 if band == last else 1
            last = band
            if confirmed is None:
                confirmed = band
            elif band != confirmed and held == self.hold:
                out.append((key[0], key[1], turn, seq, confirmed, band, "degrading" if rank[band] > rank[confirmed] else "improving", held))
                confirmed = band
        self.band.update((confirmed, last, held))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TREND_OUT.split(", ")])

    def close(self) -> None:
        pass


def trends(snapshots: DataFrame, config=CONFIG) -> DataFrame:
    """Band crossings of a stream of snapshots that come in turn order, such as the table that `turns` is written to."""
    banded = M.bands(snapshots, config)
    long = banded.select("stream_id", "turn_index", "seq", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"band_{m}").alias("band")) for m in M.TREND_METRICS])).alias("x"),
    ).select("stream_id", "x.metric", "turn_index", "seq", "x.band").where("band <> 'unknown'")
    return long.groupBy("stream_id", "metric").transformWithStateInPandas(
        Crossings(config.window.trend_durability_turns), TREND_OUT, "append", "None")


# ---- stop -----------------------------------------------------------------------------------------
def variable(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """(stream_id, entry, …) of a variable of a stopped query's state; entry and body of a map, the parts of a value."""
    d = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    key = F.col("key.stream_id").alias("stream_id")
    if name in MAPS:
        return d.select(key, F.col(f"user_map_key.{MAPS[name].split()[0]}").alias("entry"), F.col("user_map_value.body").alias("body"))
    return d.select(key, "value.*")


def state_at_stop(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Inventory of what is open in a stopped query, read from its state. No conclusion is drawn."""
    status = F.get_json_object("body", "$.status")
    per = variable(spark, checkpoint, "episodes").groupBy("stream_id").agg(
        F.max(F.when(status == "open", F.concat(F.lit("rep-"), F.col("entry").cast("string")))).alias("open_repair"),
        F.count_if(status == "provisionally_closed").alias("waiting"))
    pending = variable(spark, checkpoint, "pending").groupBy("stream_id").agg(F.count("*").alias("pending"))
    standing = variable(spark, checkpoint, "standing").where("get_json_object(body, '$.gone') = 'false'").groupBy("stream_id").agg(
        F.count("*").alias("standing"))
    d = variable(spark, checkpoint, "place").where("turn > 0").select("stream_id", "epoch")
    for part in (per, pending, standing):
        d = d.join(part, "stream_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return d.select("stream_id", "epoch", "open_repair", none("pending").alias("pending_pointers"),
                    none("waiting").alias("repairs_awaiting_durability"), none("standing").alias("unresolved_obligation_candidates"))


def stop_events(spark: SparkSession, checkpoint: str, reason: str) -> DataFrame:
    """(stream_id, seq, kind, payload): that observation stopped after a record, and what was open then."""
    at = variable(spark, checkpoint, "place").select("stream_id", (F.col("next") - 1).alias("seq"))
    inventory = state_at_stop(spark, checkpoint)
    stopped = at.select("stream_id", "seq", F.lit("observation_stopped").alias("kind"), F.to_json(F.struct(F.lit(reason).alias("reason"))).alias("payload"))
    held = inventory.join(at, "stream_id").select(
        "stream_id", "seq", F.lit("state_at_observation_stop").alias("kind"),
        F.to_json(F.struct(*[c for c in inventory.columns if c != "stream_id"])).alias("payload"))
    return stopped.unionByName(held)
