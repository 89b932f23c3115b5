"""Configuration of a review: defaults that a JSON file can override; unknown keys and repeated keys are errors."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from riffle.functions import tables as T


@dataclass(frozen=True)
class Config:
    """Toggles and limits. detectors: which of them run; thresholds as in the tables of fixed values."""

    detectors: tuple[str, ...] = ("secrets", "sentinel", "reports", "packages", "structure")
    baseline: bool = True
    triage: bool = False
    gate_floor: str = T.GATE_FLOOR
    gate_confidence: int = T.GATE_CONFIDENCE
    file_churn: float = T.FILE_CHURN
    edge_churn: float = T.EDGE_CHURN
    most_hops: int = T.MOST_HOPS
    most_slice_lines: int = 120

    def __post_init__(self) -> None:
        if self.gate_floor not in T.SEVERITIES:
            raise ValueError(f"no severity: {self.gate_floor!r}")
        if not 0 <= self.gate_confidence <= 10:
            raise ValueError("a confidence is between 0 and 10")
        if unknown := set(self.detectors) - set(Config.__dataclass_fields__["detectors"].default):
            raise ValueError(f"no such detectors: {sorted(unknown)}")


def _once(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise ValueError(f"the key {k!r} is there twice")
        out[k] = v
    return out


def load(text: str) -> Config:
    """A Config from JSON; what it doesn't name keeps its default."""
    given = json.loads(text, object_pairs_hook=_once)
    if unknown := set(given) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return replace(Config(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
