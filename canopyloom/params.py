"""Parameters with their effective defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import TypeVar

P = TypeVar("P")


def from_environment(kind: type[P], name: str, environment: Mapping[str, str] = os.environ) -> P:
    """Parameters with their defaults, overridden by variables such as CANOPYLOOM_MICRO_BUDGET; a value that can't be read is an error."""
    own = {}
    for f in fields(kind):
        told = environment.get(f"CANOPYLOOM_{name}_{f.name}".upper())
        if told is None:
            continue
        if isinstance(f.default, bool):
            if told.strip().lower() not in ("0", "1", "true", "false", "yes", "no"):
                raise ValueError(f"{f.name}: {told!r} is neither true nor false")
            own[f.name] = told.strip().lower() in ("1", "true", "yes")
        else:
            own[f.name] = type(f.default)(told)
    return kind(**own)


@dataclass(frozen=True)
class ChunkParams:
    threshold: int = 500
    size: int = 300
    step: int = 200
    head: int = 200
    tail: int = 100


@dataclass(frozen=True)
class MicroParams:
    """Detail-first retrieval."""

    graph: bool = True
    search_k: int = 10
    anchors: int = 5
    anchor_quota_ratio: float = 0.3
    neighbor_quota_ratio: float = 0.3
    force_recall: int = 20
    fanout: int = 5
    threshold: float = 0.4
    weight_threshold: float = 0.7
    budget: int = 32_000
    chars_per_unit: int = 500
    fallback_k: int = 100


@dataclass(frozen=True)
class MacroParams:
    """Overview-first retrieval."""

    top_k: int = 3
    bridge_fanout: int = 5
    bridge_weight: float = 0.8
    max_findings: int = 5
    evidence_per_finding: int = 2
    supplement: int = 10
    threshold: float = 0.65
    budget: int = 32_000


@dataclass(frozen=True)
class GraphParams:
    low: float = 0.60
    high: float = 0.96
    rescue: float = 0.35
    rescued_score: float = 0.99
    exempt: float = 0.98
    shadow: float = 0.92
    parent_margin: float = 0.0
    per_source: int = 50
    min_audit: int = 7
    hub_sigmas: float = 3.0
    keep_weight: float = 0.8
    hops: int = 3


@dataclass(frozen=True)
class ReportParams:
    single_bin: int = 15_000
    target: int = 12_000
    slack: float = 1.1
    sparse: int = 200
