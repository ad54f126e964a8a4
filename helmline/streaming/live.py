"""Live variant: records arrive as rows or JSON lines, state is kept per stream between batches.

Everything a record says on its own is the same column stage as in batch. The state function only
moves counters, standing requirements, recent sentences and the shared episode fold.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from helmline.config import DEFAULT as CONFIG
from helmline.functions import text as T
from helmline.functions.fold import EpisodeFold, new_state
from helmline.lexicon import DEFAULT as LEXICON
from helmline.operators.features import bucket_of, record_features
from helmline.sources.records import RECORD_SCHEMA

TURNS = (
    "stream_id string, seq long, turn_index long, epoch long, is_correction boolean, "
    "forward long, control long, recovery long, restate long, other long, new_obligations long, "
    "unresolved_obligations long, repeated_obligations long, released_obligations long, "
    "repair_no long, repair_open boolean, repair_depth long, repair_chars long, repair_records long, "
    "repair_status string, pollution_status string"
)
_COLUMNS = [c.split()[0] for c in TURNS.split(", ")]
STATE = "body string"


def follow(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, per_trigger: int = 1000) -> DataFrame:
    """Record rows from JSON-lines files as they arrive. The producer writes whole lines."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def live_rows(records: DataFrame, lex=LEXICON, config=CONFIG) -> DataFrame:
    """Feature rows cut down to what the state reads; no text leaves this step."""
    f = record_features(records, lex, config)
    c = F.col
    segs = F.transform("segs", lambda s: F.struct(
        s["chars"].alias("chars"), s["label"].alias("label"), bucket_of(s["label"]).alias("bucket"),
        F.when(F.octet_length(s["norm"]) >= 8, s["norm"]).alias("norm")))
    kept = F.transform("kept", lambda k: F.struct(
        k["key"].alias("key"), F.coalesce(F.nullif(k["content_key"], F.lit("")), k["key"]).alias("id"),
        T.token_set(k["key"]).alias("tokens")))
    release = F.transform("release_sents", lambda r: T.token_set(T.without_first(r["text"], r["marker"])))
    return f.select(
        "stream_id", "seq", "is_op", "is_agent", "is_interrupt", "chars", "write_paths", "failed_actions",
        F.unix_micros("ts").alias("us"), "tier1", "tier2", "reset", "stop", "acceptance", "continuation",
        "target_type", "target_key", "named_paths", F.coalesce("pointer.chars", F.lit(0)).alias("pointer_chars"),
        (c("exp_task") + c("exp_validation") + c("exp_constraint") + c("exp_scope")).alias("expansions"), "claim",
        F.to_json(F.struct(segs.alias("segs"), kept.alias("kept"), release.alias("release"))).alias("parts"))


class _Live:
    """State of one stream; `body` is everything that has to survive a batch."""

    def __init__(self, body: dict, config, least_shared: int, coverage: float):
        self.b, self.config = body, config
        self.least_shared, self.coverage = least_shared, coverage
        self.fold = EpisodeFold(config.window.correction_durability_turns, body["fold"])

    @staticmethod
    def fresh():
        return dict(next=1, held={}, turn=0, epoch=0, agent=[0, None], op=[0, None], writes=[], before=[],
                    fold=new_state(), ids={}, released=0, recent=[], reset_pending=False)

    def feed(self, r):
        b = self.b
        if r["is_op"]:
            b["before"], b["writes"], b["op"] = b["writes"], [], [r["seq"], r["us"]]
            return self.operator(r)
        if r["is_agent"]:
            over = [w for w in r["write_paths"] if w in b["before"]] if b["turn"] else []
            if b["turn"]:
                b["writes"] = sorted({*b["writes"], *r["write_paths"]})
            fires = bool(over) and self.fold.current is None
            if fires:
                b["before"] = []
            self.fold.agent(dict(
                seq=r["seq"], turn_index=b["turn"], epoch=b["epoch"], writes=r["write_paths"],
                overlap=over if fires else None, failed=r["failed_actions"], n=1, expansions=r["expansions"],
                claim=r["claim"], first_seq=r["seq"], last_seq=r["seq"], last_us=r["us"],
                last_agent_seq=b["agent"][0], last_agent_us=b["agent"][1], operator_seq=b["op"][0],
                operator_us=b["op"][1]))
            b["agent"] = [r["seq"], r["us"]]
        else:
            self.fold.other(dict(n=1, failed=r["failed_actions"], interrupts=int(r["is_interrupt"]),
                                 last_seq=r["seq"], last_us=r["us"]))
        return None

    def operator(self, r):
        b, parts = self.b, json.loads(r["parts"])
        b["turn"] += 1
        seen = {n for turn in b["recent"] for n in turn}
        sums = dict.fromkeys(("forward", "control", "recovery", "restate", "other"), 0)
        open_before = self.fold.current is not None
        for s in parts.get("segs") or []:
            kind = s["bucket"].lower()
            if s["label"] == "handoff":
                kind = "recovery" if open_before else "control"
            elif s["label"] != "correction" and s.get("norm") in seen:
                kind = "restate"
            sums[kind] += s["chars"]
        if b["reset_pending"]:
            b["reset_pending"], b["recent"] = False, []
        kept, standing = parts.get("kept") or [], {k for k, o in b["ids"].items() if not o["gone"]}
        fixed = r["tier1"] is not None or (r["tier2"] is not None and any(k["id"] in standing for k in kept))
        self._release(parts.get("release") or [], standing)
        fresh = self._state(kept)
        moves = bool(r["acceptance"]) or sums["forward"] > 0
        on = bool(r["continuation"]) or bool(r["stop"]) or any(sums[k] for k in ("control", "recovery", "restate"))
        self.fold.operator(dict(
            seq=r["seq"], turn_index=b["turn"], epoch=b["epoch"], ts_us=r["us"], chars=r["chars"],
            is_correction=fixed, target_type=r["target_type"] if fixed else "unknown",
            target_key=r["target_key"] if fixed else "", target_paths=r["named_paths"] if fixed else [],
            pointer_chars=r["pointer_chars"], moves=moves, on_episode=on, reset=bool(r["reset"]),
            last_agent_seq=b["agent"][0], last_agent_us=b["agent"][1]))
        keep = self.config.window.rolling_turns
        b["recent"] = (b["recent"] + [[s["norm"] for s in parts.get("segs") or [] if s.get("norm")]])[-keep:]
        if r["reset"]:
            b["epoch"] += 1
            b["reset_pending"], b["ids"] = True, {}
        left = [o for o in b["ids"].values() if not o["gone"]]
        st = self.fold.turns.pop()
        self.fold.events.clear()
        return dict(
            seq=r["seq"], turn_index=b["turn"], epoch=b["epoch"], is_correction=fixed, **sums,
            new_obligations=fresh, unresolved_obligations=len(left),
            repeated_obligations=sum(o["n"] > 0 for o in left), released_obligations=b["released"],
            repair_no=st.get("local_no"), repair_open=st["open_after"], repair_depth=st.get("depth") or 0,
            repair_chars=st.get("chars") or 0, repair_records=st.get("records") or 0,
            repair_status=st.get("status"), pollution_status=st.get("pollution") or "")

    def _release(self, sentences, standing):
        claimed = set()
        for words in sentences:
            have, fits = set(words), []
            for k in standing - claimed:
                want = set(self.b["ids"][k]["tokens"])
                if len(want & have) >= self.least_shared and len(want & have) / len(want) >= self.coverage:
                    fits.append((len(want & have) / len(want), k))
            top = max((f for f, _ in fits), default=None)
            best = [k for f, k in fits if f == top]
            if len(best) == 1:
                claimed.add(best[0])
                self.b["ids"][best[0]]["gone"] = True
                self.b["released"] += 1

    def _state(self, kept):
        fresh, keys = 0, set()
        for k in kept:
            if k["key"] in keys:
                continue
            keys.add(k["key"])
            o = self.b["ids"].get(k["id"])
            if o is None:
                self.b["ids"][k["id"]] = dict(n=0, gone=False, tokens=k["tokens"])
                fresh += 1
                continue
            o["n"] += 1
            if o["gone"]:
                o["gone"] = False
                self.b["released"] -= 1
        return fresh


def _plain(row):
    out = {}
    for k, v in row.items():
        if hasattr(v, "tolist"):
            v = v.tolist()
        elif isinstance(v, float) and v != v:
            v = None
        out[k] = v
    out["us"] = None if out["us"] is None else int(out["us"])
    return out


def _stepper(config, least_shared: int, coverage: float):
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        body = json.loads(state.get[0]) if state.exists else _Live.fresh()
        live, out = _Live(body, config, least_shared, coverage), []
        for frame in frames:
            for row in frame.to_dict("records"):
                row = _plain(row)
                if row["seq"] >= body["next"]:
                    body["held"][str(row["seq"])] = row
        # Rows are applied only in contiguous order; earlier and repeated ones are dropped above.
        while str(body["next"]) in body["held"]:
            made = live.feed(body["held"].pop(str(body["next"])))
            body["next"] += 1
            if made is not None:
                out.append({"stream_id": key[0], **made})
        live.fold.events.clear()
        body["fold"] = live.fold.s
        state.update((json.dumps(body),))
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"repair_no": "Int64"})
    return step


def live_turns(records: DataFrame, lex=LEXICON, config=CONFIG) -> DataFrame:
    """Per-turn state of every stream, emitted as soon as the turn and all records before it are in."""
    return live_rows(records, lex, config).groupBy("stream_id").applyInPandasWithState(
        _stepper(config, int(lex.param("release_shared_tokens", 2)), float(lex.param("release_coverage", 0.5))), TURNS, STATE, "append", GroupStateTimeout.NoTimeout)


def without_repeats(records: DataFrame, arrival: str, delay: str) -> DataFrame:
    """Drop repeated (stream, seq) rows that arrive within `delay` of each other, before the state."""
    return records.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(["stream_id", "seq"])


def append_to(turns: DataFrame, path: str, checkpoint: str):
    """Append-only sink of emitted turns; `checkpoint` is a folder every executor reaches."""
    return turns.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def append_completions(completions: DataFrame, path: str, checkpoint: str):
    """Deferred classifications go to their own table. They are selected later and revise nothing."""
    return append_to(completions, path, checkpoint)


def latest(turns: DataFrame) -> DataFrame:
    """Newest state per stream from the append-only table."""
    return turns.groupBy("stream_id").agg(
        F.max_by(F.struct(*[c for c in turns.columns if c != "stream_id"]), "seq").alias("t")
    ).select("stream_id", "t.*")
