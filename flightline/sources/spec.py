"""Checking a domain specification before a build: a nested mapping, as read from TOML or JSON."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping
from pathlib import Path
from typing import Any


def read(path: str) -> dict[str, Any]:
    """A specification from a ``.toml`` or ``.json`` file on the driver; ValueError names everything wrong with it."""
    text = Path(path).read_text(encoding="utf-8")
    spec = tomllib.loads(text) if path.endswith(".toml") else json.loads(text)
    wrong = problems(spec)
    if wrong:
        raise ValueError("; ".join(wrong))
    return spec


def _at(spec: Mapping, path: str) -> Any:
    value: Any = spec
    for part in path.split("."):
        value = value.get(part) if isinstance(value, Mapping) else None
    return value


def _positive(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and value > 0


CHECKS = (
    ("domain", bool, "is missing"), ("version", bool, "is missing"), ("database.total_patients", _positive, "must be positive"), ("database.cohorts", bool, "must name a cohort"),
    ("signal_processing.expected_feature_count", _positive, "must be positive"), ("building_blocks.canonical_diagnosis_count", _positive, "must be positive"), ("building_blocks.pipeline_stages", bool, "must not be empty"),
    ("acceptance.overall_f1_target", lambda v: _positive(v) and v <= 1, "must be above 0 and at most 1"), ("acceptance.inference_time_ms", _positive, "must be positive"),
)


def problems(spec: Mapping) -> list[str]:
    """What is wrong with a specification (nothing: it is valid)."""
    wrong = [f"{path} {says}" for path, good, says in CHECKS if not good(_at(spec, path))]
    cohorts = _at(spec, "database.cohorts") or {}
    if not by_role(spec, "training"):
        wrong.append("database.cohorts has no training cohort")
    if (name := _at(spec, "acceptance.validation_cohort")) not in cohorts:
        wrong.append(f"acceptance.validation_cohort {name!r} is no cohort")
    return wrong


def by_role(spec: Mapping, role: str) -> dict[str, Any]:
    return {name: c for name, c in (_at(spec, "database.cohorts") or {}).items() if isinstance(c, Mapping) and c.get("role") == role}
