"""Marker lexicon: named groups of surface forms compiled to Column expressions.

The lexicon is written in the RE2 dialect. Spark evaluates Java regular expressions, so every
pattern is rewritten once on the driver (`to_java`); the result is a literal in the plan.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES_VERSION = "5"

# ---------------------------------------------------------------------------------------------
# The shipped marker table, its parameters and discriminator switches.
# ---------------------------------------------------------------------------------------------
BASELINE_MARKERS = {
    "acceptance": r"^(good|correct|right|perfect|nice|thanks|thank you|yes|ok|okay|lgtm)\b|\b(that works|looks good|ship it)\b",
    "code_span": r"`[^`]+`",
    "continuation": r"^(continue|proceed|go ahead|carry on|keep going)\b",
    "correction_tier1": r"^(no|nope)\b|\bwrong\b|\bthat'?s not\b|\bnot what i\b|\bi said\b|\bi'?m saying\b|\bi meant\b|\bwhy are you\b|\byou just\b|\bi did ?n'?o?t\b|\bdid ?n'?o?t ask\b|\bi told you\b",
    "correction_tier2": r"\b(again|as i said|i already|this is the (second|third|fourth) time)\b",
    "evidence": r"^(===|---|\+\+\+|ok\s|fail\b|pass\b)|\bhere is the\b|\bhere'?s the\b|\bpasted below\b",
    "expansion_constraint": r"\b(from now on i|i will always|going forward i)\b",
    "expansion_scope": r"\b(i also (updated|changed|modified|edited|touched|documented|refactored)|also updated|while i was (at it|there)|took the liberty)\b",
    "expansion_task": r"\b(i (also )?(opened|created|filed|started) (a |an |the )?(issue|pr|ticket|follow[ -]?up|task)|i went ahead|i fixed the first)\b",
    "expansion_validation": r"\b(i (also )?added (a |an |the )?(validation|check|assertion|test)|added a validation|is asserted)\b",
    "forward": r"^(add|implement|write|create|build|run|fix|refactor|document|commit|remove|delete|update|open|read|check|test|measure|record|wire|rename|move|extract|generate|install|set|find|list|paste|show|give|tell|point|switch|split|merge|bump|tag|push|pull|profile|benchmark)\b",
    "meta": r"\b(from now on|going forward|next time|in future)\b",
    "negative": r"\b(do not|don'?t|never|avoid|no more)\b",
    "new_task_line": r"^(new task|next task|next up|task:|now do|then do)\b",
    "path_token": r"\b[\w.-]*/[\w./-]+\b|\b[\w-]+\.[a-z]{1,5}\b",
    "pointer_alias": r"\b(that|the same|this|those|the one)\s+[a-z][\w-]*",
    "pointer_file": r"\b([\w.-]+/[\w./-]+|[\w-]+\.(go|md|ya?ml|json|ts|js|py|toml|txt|csv|sh))\b",
    "pointer_namespace": r"\b([A-Z]{2,}-\d+|[Mm]\d+[a-z]?|v\d+(\.\d+)+)\b",
    "pointer_operation": r"\b(after ci|before merge|on push|at release|after the merge)\b",
    "pointer_quote": r"`[^`]+`",
    "pointer_task": r"\b(task \d+|issue #?\d+|pr \d+|step \d+|#\d+)\b",
    "positive": r"\b(always|make sure|ensure|keep|preserve|must|verify|wait for)\b",
    "reconstruction": r"\b(to recap|restating|as i said before|where we left off|here is where we are)\b",
    "referent": r"\b(i mean|to be clear|the one i|as in|by that i mean)\b",
    "release": r"\bnever ?mind\b|\bdisregard\b|\bscratch that\b|\bforget (that|about|it)\b|\bignore what i said\b|\byou (can|may|should) (now )?(drop|stop|ignore|forget|skip)\b|\bno longer (applies|needed|necessary|required|relevant|matters)\b|\b(drop|lift|cancel|withdraw) (that|the|this) (rule|constraint|requirement|restriction|scope|limit)\b|\b(that|this) (rule|constraint|requirement|restriction) (is|no longer) (lifted|gone|off|applies)\b",
    "repair_verb": r"\b(reverted|removed|restored|undid|undone|closed|deleted|rolled back|put back|unchanged|back to)\b",
    "reset": r"\b(context clear|clear context|model switch|new chat)\b|\bhand(ing)? (this|it|things|the session|the work) off to (a |another )?new (session|context|agent)\b|\b(start|open|spin up|move to|switch to|hand off to)( a| another)? new session\b",
    "scope": r"(^|[^\w-])only\b|\b(in scope|out of scope|scope|limited to|nothing else|just the|do not touch)\b",
    "second_person": r"\b(you|your|yours|yourself)\b",
    "stop": r"^stop\b|\bstop\s*[.!]|\b(you must stop|stop after|stop here|hard stop|nothing else|wait for me|wait for instructions|do not perform (any )?follow[ -]?up|no follow[ -]?up)\b",
    "temporal": r"\b(earlier|previously|previous|before that|the last one|you just)\b",
}
CASE_SENSITIVE_GROUPS = ("code_span", "path_token", "pointer_namespace", "pointer_quote")
BASELINE_PARAMETERS = {
    "bulk_paste_lines": 40.0,
    "near_repeat_threshold": 0.8,
    "release_coverage": 0.5,
    "release_shared_tokens": 2.0,
    "min_obligation_chars": 8.0,
}
BASELINE_DISCRIMINATORS = {
    "subject_before_marker": True,
    "second_person": True,
    "contained": True,
    "code_density": False,
}
# ---------------------------------------------------------------------------------------------

# Flags are switched off inside: case folding would let two non-ASCII letters pass for k and s.
_WORD = "(?-iu:[0-9A-Za-z_])"
_START = f"(?<!{_WORD})(?={_WORD})"
_END = f"(?<={_WORD})(?!{_WORD})"
_EDGE = f"(?:{_START}|{_END})"
_ASCII_WORD = frozenset(string.ascii_letters + string.digits + "_")


def _spell_out(pattern: str, fold: bool) -> str:
    """Spell out what Java reads differently: word boundary, whitespace, folded word characters."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] != "\\" or i + 1 >= len(pattern):
            out.append(pattern[i])
            i += 1
            continue
        esc = pattern[i + 1]
        if esc == "b":
            before = pattern[i - 1 : i]
            closes = before.isalnum() and pattern[i - 2 : i - 1] != "\\"
            out.append(_END if closes and before.lower() not in "ks" else _EDGE)
        elif esc in "sw":
            in_class = pattern[:i].count("[") > pattern[:i].count("]")
            if esc == "w":
                body = r"\w\u017F\u212A" if fold else r"\w"
                out.append(body if in_class else f"[{body}]")
                i += 2
                continue
            out.append(r"\t\n\f\r " if in_class else r"[\t\n\f\r ]")
        else:
            out.append("\\" + esc)
        i += 2
    return "".join(out)


def _alternatives(pattern: str) -> list[str]:
    """Top-level branches of a pattern."""
    depth, in_class, cur, out, i = 0, False, "", [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            cur += pattern[i : i + 2]
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        else:
            depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0 and not in_class:
            out.append(cur)
            cur = ""
        else:
            cur += ch
        i += 1
    return [*out, cur]


def _first_letters(branch: str) -> set[str] | None:
    """Letters a branch can begin with, or None when that is not a set of ASCII word characters."""
    letters = set()
    for alt in _alternatives(branch):
        if alt[:1] == "(" and alt[1:2] != "?":
            depth = end = 0
            for end, ch in enumerate(alt):
                depth += (ch == "(") - (ch == ")")
                if depth == 0:
                    break
            inner = _first_letters(alt[1:end])
            if inner is None:
                return None
            letters |= inner
            optional, rest = alt[end + 1 : end + 2] in ("?", "*"), alt[end + 2 :]
        elif alt[:1] in _ASCII_WORD and alt:
            letters.add(alt[0].lower())
            optional, rest = alt[1:2] in ("?", "*"), alt[2:]
        else:
            return None
        if optional:
            more = _first_letters(rest)
            if more is None:
                return None
            letters |= more
    return letters or None


def to_java(pattern: str, fold: bool = True) -> str:
    """Rewrite an RE2 pattern so that Java gives the same matches.

    RE2's word boundary is ASCII; Java's counts accented letters as word characters, so it is spelled
    out with look-around. Neighbouring branches that begin with a boundary and a known letter share
    one test of that letter, which keeps the scan over a text cheap.
    """
    out, run, letters = [], [], set()

    def flush():
        if run:
            heads = "".join(sorted(letters))
            edge = _EDGE if fold and letters & {"k", "s"} else f"(?<!{_WORD})(?={_WORD})"
            out.append(f"(?=[{heads}]){edge}(?:{'|'.join(run)})")
            run.clear()
            letters.clear()

    for branch in _alternatives(pattern):
        heads = _first_letters(branch[2:]) if branch.startswith(r"\b") else None
        if heads is None:
            flush()
            out.append(_spell_out(branch, fold))
        else:
            run.append(_spell_out(branch[2:], fold))
            letters.update(heads)
    flush()
    return "|".join(out)


@dataclass(frozen=True)
class MarkerGroup:
    phrases: tuple[str, ...] = ()
    anchored: tuple[str, ...] = ()
    pattern: str = ""
    case_sensitive: bool = False
    replace: bool = False

    def source(self) -> str | None:
        """The RE2 form, or None for an emptied group, which matches nothing."""
        parts = [self.pattern] if self.pattern else []
        parts += [rf"\b{re.escape(p.strip())}\b" for p in self.phrases if p.strip()]
        parts += [rf"^{re.escape(p.strip())}\b" for p in self.anchored if p.strip()]
        return "|".join(parts) or None


def _union(a, b):
    seen, out = set(), []
    for item in (*a, *b):
        item = item.strip()
        if item and item.lower() not in seen:
            seen.add(item.lower())
            out.append(item)
    return tuple(out)


@dataclass(frozen=True)
class Profile:
    name: str
    version: str = ""
    description: str = ""
    language: str = ""
    markers: dict = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)
    discriminators: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> "Profile":
        raw = json.loads(text)
        unknown = set(raw) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown profile key {sorted(unknown)[0]!r}")
        if not raw.get("name"):
            raise ValueError("the profile carries no name")
        groups = {}
        allowed = {f.name for f in fields(MarkerGroup)}
        for name, body in raw.pop("markers", {}).items():
            bad = set(body) - allowed
            if bad:
                raise ValueError(f"unknown key {sorted(bad)[0]!r} in marker group {name!r}")
            groups[name] = MarkerGroup(
                **{k: tuple(v) if isinstance(v, list) else v for k, v in body.items()}
            )
        return cls(markers=groups, **raw)

    def overlay(self, other: "Profile | None") -> "Profile":
        """Layer another profile on top: markers add unless they ask to replace; numbers override."""
        if other is None:
            return self
        markers = dict(self.markers)
        for name, add in other.markers.items():
            cur = markers.get(name)
            if cur is None or add.replace:
                markers[name] = replace(add, replace=False)
                continue
            both = [p for p in (cur.pattern, add.pattern) if p]
            markers[name] = MarkerGroup(
                phrases=_union(cur.phrases, add.phrases),
                anchored=_union(cur.anchored, add.anchored),
                pattern=both[0] if len(both) == 1 else "|".join(f"(?:{p})" for p in both),
                case_sensitive=cur.case_sensitive and add.case_sensitive,
            )
        return replace(
            self,
            name=f"{self.name}+{other.name}" if other.name else self.name,
            language=other.language or self.language,
            markers=markers,
            parameters={**self.parameters, **other.parameters},
            discriminators={**self.discriminators, **other.discriminators},
        )

    def fingerprint(self) -> str:
        def number(x):
            return str(int(x)) if float(x).is_integer() else repr(float(x))

        def truth(x):
            return "true" if x else "false"

        parts = [self.name, self.version]
        for k in sorted(self.markers):
            g = self.markers[k]
            parts.append(
                "|".join(
                    [k, g.pattern, truth(g.case_sensitive),
                     ",".join(sorted(g.phrases)), ",".join(sorted(g.anchored))]
                )
            )
        parts += [f"{k}={number(self.parameters[k])}" for k in sorted(self.parameters)]
        parts += [f"{k}={truth(self.discriminators[k])}" for k in sorted(self.discriminators)]
        return "\x00".join(parts)


BASELINE = Profile(
    name="baseline",
    version="1",
    language="en",
    markers={
        k: MarkerGroup(pattern=v, case_sensitive=k in CASE_SENSITIVE_GROUPS)
        for k, v in BASELINE_MARKERS.items()
    },
    parameters=BASELINE_PARAMETERS,
    discriminators=BASELINE_DISCRIMINATORS,
)


class Lexicon:
    """A profile compiled to literal Java patterns."""

    def __init__(self, profile: Profile = BASELINE):
        self.profile = profile
        self.java = {}
        for name, group in profile.markers.items():
            src = group.source()
            if src is not None:
                self.java[name] = ("" if group.case_sensitive else "(?iu)") + to_java(
                    src, fold=not group.case_sensitive)

    def rules_hash(self) -> str:
        body = f"{RULES_VERSION}\x00{self.profile.fingerprint()}"
        return hashlib.sha256(body.encode()).hexdigest()[:16]

    def param(self, name: str, default: float) -> float:
        return self.profile.parameters.get(name, default)

    def on(self, name: str) -> bool:
        return self.profile.discriminators.get(name, True)

    def match_any(self, groups, col: Column) -> Column:
        """True when some of the groups matches: one scan for all that ignore case."""
        folded, rest = [], F.lit(False)
        for name in groups:
            group = self.profile.markers.get(name)
            if group is None or group.source() is None:
                continue
            if group.case_sensitive:
                rest = rest | self.match(name, col)
            else:
                folded += _alternatives(group.source())
        # Branches with a leading boundary first, so that they end up in one run.
        folded.sort(key=lambda b: not b.startswith(r"\b"))
        return rest | col.rlike("(?iu)" + to_java("|".join(folded))) if folded else rest

    def match(self, group: str, col: Column) -> Column:
        p = self.java.get(group)
        return F.lit(False) if p is None else col.rlike(p)

    def find(self, group: str, col: Column) -> Column:
        """Leftmost match, or the empty string."""
        p = self.java.get(group)
        return F.lit("") if p is None else F.regexp_extract(col, p, 0)

    def position(self, group: str, col: Column) -> Column:
        """1-based character position of the leftmost match, 0 when there is none."""
        p = self.java.get(group)
        return F.lit(0) if p is None else F.regexp_instr(col, F.lit(p))

    def find_all(self, group: str, col: Column) -> Column:
        p = self.java.get(group)
        return (
            F.array().cast("array<string>") if p is None
            else F.regexp_extract_all(col, F.lit(p), F.lit(0))
        )


DEFAULT = Lexicon()
