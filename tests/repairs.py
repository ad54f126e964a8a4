"""Brute force of repair episodes for tests: the whole log is kept, and every total is counted again from it.

Nothing of the library is imported. An episode knows the pieces of the log it was open for; the response to a
correction is a piece of the log as well.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(eq=False)
class Episode:
    no: int
    trigger: int
    key: str
    paths: list
    epoch: int
    start: int | None
    status: str = "open"
    depth: int = 1
    spans: list = field(default_factory=list)   # [from, to) in the log; to is None while open
    moved: int = 0                              # turn of the last correction, or of the closing
    closed: int | None = None
    expansions: int = 0
    pollution: str = ""


class Episodes:
    """Same rows in, same reports out as the library's fold; `open` is the open episode."""

    def __init__(self, durability):
        self.durability = durability
        self.log, self.all, self.queue = [], [], []
        self.open = None
        self.since = None       # where the response that nobody has judged yet begins
        self.events, self.turns = [], []

    # ---- totals, from the log --------------------------------------------------------------------
    def rows(self, e):
        return [r for a, b in e.spans for r in self.log[a:len(self.log) if b is None else b]]

    def shape(self, e):
        rows = self.rows(e)
        timed = [r["us"] for r in rows if r["us"] is not None]
        return dict(local_no=e.no, target_key=e.key, status=e.status, depth=e.depth, start_us=e.start,
                    chars=sum(r["chars"] for r in rows), records=len(rows), last_us=timed[-1] if timed else e.start,
                    closed_us=e.closed, expansions=e.expansions, pollution=e.pollution)

    def tell(self, seq, kind, e, **more):
        self.events.append(dict(seq=seq, kind=kind, **self.shape(e), **more))

    # ---- what can happen -------------------------------------------------------------------------
    def leave(self, e, status, us):
        e.spans[-1][1] = len(self.log)
        e.status, e.closed, self.open, self.since = status, us, None, None

    def enter(self, e, turn, at):
        e.spans.append([at, None])
        e.status, e.closed, e.moved, self.open = "open", None, turn, e

    def judge(self, seq, corrected):
        e = self.open
        answer = self.log[self.since:] if e is not None and self.since is not None else []
        if not answer:
            return
        agents = [r for r in answer if r["who"] == "agent"]
        known = set(e.paths)
        # The record that opened the episode by itself is part of the response, but is not held against it.
        later = [r for r in agents if not r["opener"]]
        on = any(w in known for r in later for w in r["writes"])
        off = sum(any(w not in known for w in r["writes"]) for r in later) if known else 0
        extra = sum(r["expansions"] for r in agents) + off
        writes = sum(len(r["writes"]) for r in later)
        e.pollution = ("polluted" if extra else "unknown" if corrected else "clean") if on else "unknown"
        e.expansions += extra
        self.since = None
        self.tell(seq, "repair_status", e, pollution_status=e.pollution, cycle_records=len(answer),
                  agent_turn=agents[0]["seq"] if agents else 0, cycle_writes=writes,
                  cycle_failed=sum(r["failed"] for r in later if r["writes"])
                  + sum(r["failed"] for r in answer if r["who"] == "other"),
                  cycle_interrupts=sum(r["interrupts"] for r in answer))

    # ---- rows ----------------------------------------------------------------------------------------
    def agent(self, r):
        opener = bool(r["overlap"]) and self.open is None
        if opener:
            start = r["operator_us"] if r["operator_us"] is not None else r["last_us"]
            e = Episode(len(self.all) + 1, r["last_agent_seq"] or 0, r["overlap"][0], list(r["overlap"]), r["epoch"], start)
            self.all.append(e)
            self.enter(e, r["turn_index"], len(self.log))
            self.since = len(self.log)
            self.tell(r["seq"], "repair_opened", e)
        self.log.append(dict(who="agent", seq=r["seq"], us=r["last_us"], chars=0, writes=r["writes"], failed=r["failed"],
                             interrupts=0, expansions=r["expansions"], opener=opener))

    def other(self, r):
        self.log.append(dict(who="other", seq=r["last_seq"], us=r["last_us"], chars=0, failed=r["failed"],
                             interrupts=r["interrupts"]))

    def operator(self, r):
        seq, t, us, key = r["seq"], r["turn_index"], r["ts_us"], r["target_key"]
        before = self.open is not None
        self.judge(seq, r["is_correction"])
        for e in [e for e in self.queue if t - e.moved >= self.durability]:
            self.queue.remove(e)
            e.status = "durably_closed" if e.key else "unknown"
            self.tell(seq, "repair_durably_closed" if e.key else "repair_status", e)
        if r["is_correction"]:
            e, kind = self.open, "repair_deepened"
            if e is None or not key or e.key != key:
                if e is not None:
                    self.leave(e, "unknown", us)
                    self.tell(seq, "repair_status", e)
                e, kind = next((x for x in self.queue if key and x.key == key), None), "repair_recurred"
                if e is not None:
                    self.queue.remove(e)
                    self.enter(e, t, len(self.log))
            if e is not None:
                e.depth, e.moved = e.depth + 1, t
                e.paths += [p for p in r["target_paths"] if p not in e.paths]
            else:
                start = r["last_agent_us"] if r["last_agent_us"] is not None else us
                e, kind = Episode(len(self.all) + 1, r["last_agent_seq"] or 0, key, list(r["target_paths"]), r["epoch"],
                                  start), "repair_opened"
                self.all.append(e)
                self.enter(e, t, len(self.log))
            self.since = len(self.log) + 1
            self.tell(seq, kind, e)
        elif self.open is not None and self.since is None:
            e = self.open
            if r["moves"] or not r["on_episode"]:
                self.leave(e, "provisionally_closed", us)
                e.moved = t
                self.queue.append(e)
                self.tell(seq, "repair_provisionally_closed", e)
            elif t - e.moved >= self.durability:
                self.leave(e, "unknown", us)
                self.tell(seq, "repair_status", e)
        elif self.open is not None:
            self.since = len(self.log) + 1     # nothing answered; an operator turn is no part of a response
        self.log.append(dict(who="operator", seq=seq, us=us, chars=r["chars"]))
        here = self.open is not None
        if r["reset"]:
            if (e := self.open) is not None:
                self.leave(e, "reset", us)
                self.tell(seq, "repair_reset", e)
            for e in self.queue:
                e.status = "unknown"
                self.tell(seq, "repair_status", e)
            self.queue = []
        shown = self.open or (self.all[-1] if self.all else None)
        self.turns.append(dict(open_before=before, open_turn=here, open_after=self.open is not None,
                               **(self.shape(shown) if shown else {})))

    def finish(self, r):
        self.judge(r["seq"], False)
        if (e := self.open) is not None:
            self.leave(e, "unknown", self.shape(e)["last_us"])
            self.tell(r["seq"], "repair_status", e)
