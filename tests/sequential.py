"""Brute force for tests: one record after the other, plain Python state, no Spark.

Reads the row-local features of a stream and keeps every running list itself. Used only to check the
joins, windows and stretches of the library on small random streams.
"""

from __future__ import annotations

import re
import statistics
import unicodedata

from tests.repairs import Episodes

CONTROL = {"scope_constraint", "negative_constraint", "positive_constraint", "stop_condition",
           "meta_process"}
RECOVERY = {"correction", "referent_disambiguation", "temporal_disambiguation",
            "restart_reconstruction"}
FORWARD = {"forward_work", "new_task", "new_evidence"}


def toks(s):
    found = re.findall(r"[\w\-/.]+", s.lower())
    return {t.strip("-./_") for t in found if t.strip("-./_")}


def us(ts):
    return None if ts is None else int(ts.timestamp() * 1_000_000)


class Stream:
    def __init__(self):
        self.turn = self.epoch = 0
        self.fold = Episodes(10)
        self.obl, self.index = [], {}
        self.pend, self.baseline, self.window = [], [], []
        self.corr, self.miss, self.intr, self.reps = [], [], [], []
        self.prior_sents, self.hist = [], []
        self.ptr = dict(success=0, failure=0, unknown=0)
        self.reset_pending = False
        self.last_agent = (0, None)
        self.cyc_w, self.pri_w = set(), set()
        self.op = (0, None)
        self.regime = "FLOW"
        self.snaps, self.outcomes, self.near, self.released = [], [], [], []

    def standing(self):
        return [o for o in self.obl if o["status"] in ("unresolved", "violated")]

    def feed(self, r):
        active = self.fold.open is not None
        if r.is_op:
            self.pri_w, self.cyc_w = self.cyc_w, set()
            self.op = (r.seq, us(r.ts))
            self.operator(r)
        elif r.is_agent:
            over = []
            if self.turn:
                over = [w for w in r.write_paths if w in self.pri_w]
                self.cyc_w |= set(r.write_paths)
            fires = bool(over) and not active
            if fires:
                self.pri_w = set()
                self.corr.append(self.turn)
            self.fold.agent(dict(
                seq=r.seq, turn_index=self.turn, epoch=self.epoch, writes=r.write_paths,
                overlap=over if fires else None, failed=r.failed_actions, n=1,
                expansions=r.exp_task + r.exp_validation + r.exp_constraint + r.exp_scope,
                claim=r.claim, first_seq=r.seq, last_seq=r.seq, last_us=us(r.ts),
                last_agent_seq=self.last_agent[0], last_agent_us=us(self.last_agent[1]),
                operator_seq=self.op[0], operator_us=self.op[1]))
            self.last_agent = (r.seq, r.ts)
        else:
            if r.is_interrupt:
                self.intr.append(self.turn)
            self.fold.other(dict(n=1, failed=r.failed_actions, interrupts=int(r.is_interrupt),
                                 last_seq=r.seq, last_us=us(r.ts)))

    def operator(self, r):
        self.turn += 1
        t = self.turn
        # observation, against the history before any clearing
        rep = sum(x.chars for x in r.line_norms if any(x.norm in h[0] for h in self.hist))
        own = set(r.tokens)
        prev = self.hist[-1][1] if self.hist else set()
        union = set().union(*[h[1] for h in self.hist]) if self.hist else set()
        jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        overlap = (jac(own, prev), jac(own, union))
        self.hist = (self.hist + [({x.norm for x in r.line_norms}, own)])[-30:]
        # classification context
        restated = {n for h in self.prior_sents for n in h}
        start_standing = self.standing()
        active = self.fold.open is not None
        b = dict(forward=0, control=0, recovery=0, restate=0, other=0)
        for s in r.segs:
            lab = s.label
            if lab == "handoff":
                k = "recovery" if active else "control"
            elif lab != "correction" and len(s.norm.encode()) >= 8 and s.norm in restated:
                k = "restate"
            elif lab in CONTROL:
                k = "control"
            elif lab in RECOVERY:
                k = "recovery"
            elif lab in FORWARD:
                k = "forward"
            else:
                k = "other"
            b[k] += s.chars
        match = lambda c, o: c.key == o["key"] or (c.content_key and c.content_key == o["ck"])
        for c in r.kept:
            for o in start_standing:
                if not match(c, o) and jac(toks(c.key), toks(o["key"])) >= 0.8:
                    self.near.append((r.seq, c.key, o["key"]))
        resolved, claimed = [], set()
        for s in r.release_sents or []:
            words = toks(s.text.replace(s.marker, " ", 1))
            fits = []
            for o in start_standing:
                if o["key"] in claimed:
                    continue
                want = toks(o["key"])
                shared = len(want & words)
                if shared >= 2 and shared / len(want) >= 0.5:
                    fits.append((shared / len(want), o))
            top = max((f for f, _ in fits), default=None)
            best = [o for f, o in fits if f == top]
            if len(best) == 1:
                claimed.add(best[0]["key"])
                resolved.append(best[0])
        repeats = any(match(c, o) for c in r.kept for o in start_standing)
        fixed = r.tier1 is not None or (r.tier2 is not None and repeats)
        key = r.target_key if fixed else ""
        moves = bool(r.acceptance) or b["forward"] > 0
        on = (bool(r.continuation) or bool(r.stop) or b["control"] > 0 or b["restate"] > 0
              or b["recovery"] > 0)
        # state
        if self.reset_pending:
            self.reset_pending = False
            self.hist, self.baseline, self.window = [], [], []
            self.corr, self.miss, self.intr, self.reps, self.prior_sents = [], [], [], [], []
        keep = []
        for p in self.pend:
            if self.last_agent[0] <= p["seq"]:
                keep.append(p)
                continue
            first = not p["seen"]
            named = fixed and key and key == p["key"]
            if (first and fixed) or (named and not (first and moves)):
                out = "failure"
            elif first and moves:
                out = "success"
            else:
                p["seen"] = True
                p["left"] -= 1
                if p["left"]:
                    keep.append(p)
                    continue
                out = "unknown"
            self.ptr[out] += 1
            self.outcomes.append((p["seq"], out, t))
            if out == "failure":
                self.miss.append(t)
            elif p["base"]:
                self.baseline = (self.baseline + [p["chars"]])[-30:]
        self.pend = keep
        for o in resolved:
            o["status"] = "released"
            self.released.append((r.seq, o["key"]))
        new, any_rep, seen = 0, False, set()
        for c in r.kept:
            if c.key in seen:
                continue
            seen.add(c.key)
            o = self.index.get(("k", c.key)) or (c.content_key and self.index.get(("c", c.content_key)))
            if o:
                o["n"] += 1
                if o["status"] == "released":
                    o["status"] = "unresolved"
                    continue
                any_rep = True
                if fixed and key == o["key"]:
                    o["status"] = "violated"
                continue
            o = dict(key=c.key, ck=c.content_key, status="unresolved", n=0, at=t)
            self.obl.append(o)
            self.index[("k", c.key)] = o
            if c.content_key:
                self.index[("c", c.content_key)] = o
            new += 1
        if any_rep:
            self.reps.append(t)
        self.fold.operator(dict(
            seq=r.seq, turn_index=t, epoch=self.epoch, ts_us=us(r.ts), chars=r.chars,
            is_correction=fixed, target_type=r.target_type if fixed else "unknown", target_key=key,
            target_paths=r.named_paths if fixed else [],
            pointer_chars=r.pointer.chars if r.pointer else 0, moves=moves, on_episode=on,
            reset=bool(r.reset), last_agent_seq=self.last_agent[0],
            last_agent_us=us(self.last_agent[1])))
        state = self.fold.turns[-1]
        if r.pointer:
            self.pend.append(dict(
                seq=r.seq, key=norm(r.pointer.text), seen=False, left=3, chars=r.chars,
                base=not fixed and not state["open_turn"]))
        self.window = (self.window + [b])[-30:]
        if fixed:
            self.corr.append(t)
        self.prior_sents = (self.prior_sents + [{s.norm for s in r.segs if len(s.norm.encode()) >= 8}])[-30:]
        if r.reset:
            for p in self.pend:
                self.ptr["unknown"] += 1
                self.outcomes.append((p["seq"], "unknown", t))
            self.pend = []
            for o in self.standing():
                o["status"] = "unknown"
            self.index = {}
            self.epoch += 1
            self.reset_pending = True
        # measure
        st = self.standing()
        w = {k: sum(x[k] for x in self.window) for k in b}
        total = sum(w.values())
        base = statistics.median(self.baseline) if len(self.baseline) >= 8 else None
        near = lambda marks: sum(1 for m in marks if t - m < 8)
        dec = self.ptr["success"] + self.ptr["failure"]
        s = dict(
            seq=r.seq, turn_index=t, epoch=self.epoch, user_chars=r.chars, baseline_chars=base,
            baseline_turns=len(self.baseline),
            serialization_inflation=r.chars / base if base else None,
            repeat_fraction=rep / r.chars if r.chars else 0.0,
            forward_chars=w["forward"], control_chars=w["control"], recovery_chars=w["recovery"],
            restate_chars=w["restate"], other_chars=w["other"],
            forward_work_share=w["forward"] / total if total else None,
            unresolved_obligations=len(st), new_obligations=new,
            repeated_obligations=sum(o["n"] > 0 for o in st),
            violated_obligations=sum(o["status"] == "violated" for o in self.obl),
            released_obligations=sum(o["status"] == "released" for o in self.obl),
            mean_repeat_count=sum(o["n"] for o in st) / len(st) if st else None,
            median_candidate_age=statistics.median([t - o["at"] for o in st]) if st else None,
            pointer_success=self.ptr["success"], pointer_failure=self.ptr["failure"],
            pointer_unknown=self.ptr["unknown"],
            dereference=self.ptr["success"] / dec if dec else None,
            recent_corrections=near(self.corr), recent_interrupts=near(self.intr),
            recent_dereference_misses=near(self.miss),
            repair_depth=state.get("depth") or 0, repair_chars=state.get("chars") or 0,
            repair_records=state.get("records") or 0, repair_status=state.get("status"),
            repair_open=state["open_after"], pollution_status=state.get("pollution") or "",
            repair_expansions=state.get("expansions") or 0,
            repair_no=state.get("local_no"),
            repair_seconds=span(state),
            lexical_overlap_previous=overlap[0], lexical_overlap_window=overlap[1],
        )
        if not r.pointer and not fixed and not state["open_after"]:
            self.baseline = (self.baseline + [r.chars])[-30:]
        s["regime_rule"] = rule(s, bool(r.reset), near(self.reps))
        self.snaps.append(s)

    def finish(self, seq):
        for p in self.pend:
            self.outcomes.append((p["seq"], "unknown", None))
        self.fold.finish(dict(seq=seq, turn_index=self.turn))


def span(st):
    if not st.get("local_no"):
        return None
    end = st["last_us"] if st["status"] == "open" else st["closed_us"]
    if st["start_us"] is None or end is None or end < st["start_us"]:
        return None
    return (end - st["start_us"]) / 1e6


def norm(s):
    s = " ".join(s.lower().split())
    edge = lambda c: c == " " or unicodedata.category(c).startswith("P")
    while s and edge(s[0]):
        s = s[1:]
    while s and edge(s[-1]):
        s = s[:-1]
    return s


def rule(s, reset, reps):
    si, fws = s["serialization_inflation"], s["forward_work_share"]
    heavy = si is not None and si >= 3
    if reset:
        return "reset"
    if s["repair_open"]:
        if s["repair_depth"] >= 3:
            return "thrash_repair_depth"
        if s["baseline_chars"] is not None and s["repair_chars"] >= 5 * s["baseline_chars"]:
            return "thrash_recovery_chars"
        if s["repeated_obligations"] >= 2 and heavy and fws is not None and fws <= 0.4:
            return "thrash_obligation_inflation"
        return "recovery_open"
    if s["recent_dereference_misses"] >= 2:
        return "drift_dereference"
    if s["recent_corrections"] + s["recent_interrupts"] >= 2:
        return "drift_control_actions"
    if heavy and reps:
        return "drift_serialization_obligation"
    return "flow"
