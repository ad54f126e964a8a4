"""Run configuration. Values become literals in the plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Windows:
    rolling_turns: int = 30
    correction_durability_turns: int = 10
    dereference_outcome_turns: int = 3
    trend_durability_turns: int = 2


@dataclass(frozen=True)
class Thresholds:
    minimum_control_baseline: int = 8
    thrash_repair_depth: int = 3
    serialization_warn: float = 3.0
    serialization_high: float = 6.0
    repeated_obligations_warn: int = 2


@dataclass(frozen=True)
class Privacy:
    store_text: bool = False
    store_snippets: bool = True
    snippet_chars: int = 160


# Fixed values of the regime rules; these carry no dial.
THRASH_RECOVERY_MULTIPLE = 5
THRASH_FORWARD_SHARE = 0.40
DRIFT_WINDOW_TURNS = 8
DRIFT_EVENT_COUNT = 2

# Fixed values of the quality bands.
CONTROL_BURDEN_GOOD, CONTROL_BURDEN_MID = 0.25, 0.50
FORWARD_SHARE_GOOD, FORWARD_SHARE_MID = 0.60, 0.35
DEREFERENCE_GOOD, DEREFERENCE_MID = 0.80, 0.50


@dataclass(frozen=True)
class Config:
    window: Windows = field(default_factory=Windows)
    thresholds: Thresholds = field(default_factory=Thresholds)
    privacy: Privacy = field(default_factory=Privacy)

    def __post_init__(self):
        positive = {
            "window.rolling_turns": self.window.rolling_turns,
            "window.correction_durability_turns": self.window.correction_durability_turns,
            "window.dereference_outcome_turns": self.window.dereference_outcome_turns,
            "window.trend_durability_turns": self.window.trend_durability_turns,
            "thresholds.minimum_control_baseline": self.thresholds.minimum_control_baseline,
            "thresholds.thrash_repair_depth": self.thresholds.thrash_repair_depth,
            "thresholds.repeated_obligations_warn": self.thresholds.repeated_obligations_warn,
        }
        for name, value in positive.items():
            if value < 1:
                raise ValueError(f"{name} must be >= 1, got {value}")
        if self.privacy.snippet_chars < 0:
            raise ValueError("privacy.snippet_chars must be >= 0")
        if self.thresholds.serialization_warn <= 0:
            raise ValueError("thresholds.serialization_warn must be > 0")
        if self.thresholds.serialization_high < self.thresholds.serialization_warn:
            raise ValueError("thresholds.serialization_high must be >= serialization_warn")

    @classmethod
    def from_json(cls, text: str) -> "Config":
        """Strict: an unknown key is an error, never a silent default."""
        raw = json.loads(text)
        sections = {"window": Windows, "thresholds": Thresholds, "privacy": Privacy}
        built = {}
        for name, body in raw.items():
            if name not in sections:
                raise ValueError(f"unknown configuration section {name!r}")
            known = {f.name for f in fields(sections[name])}
            unknown = set(body) - known
            if unknown:
                raise ValueError(f"unknown configuration key {name}.{sorted(unknown)[0]}")
            built[name] = sections[name](**body)
        return cls(**built)


DEFAULT = Config()
