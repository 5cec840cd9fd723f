"""Checks of nested configurations against a schema: all errors, each with its path."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Rule:
    """What a value must be. kind: 'object', 'array', 'number', 'string', 'boolean'. checks: messages of values that fail, tried where the kind is right."""

    kind: str
    fields: dict[str, Rule] = field(default_factory=dict)  # of an object, each required
    open: bool = False  # an object may have other fields
    items: Rule | None = None  # of an array
    optional: bool = False
    checks: list[Callable[[object], str | None]] = field(default_factory=list)


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    for name, types in (("object", dict), ("array", list), ("number", (int, float)), ("string", str)):
        if isinstance(value, types):
            return name
    return "null"


def errors(value, rule: Rule, path: str = "$") -> list[str]:
    """'path: what is wrong' for everything that is, fields in order of their names. An object's own checks are tried where its fields are right."""
    if _kind(value) != rule.kind:
        return [f"{path}: {_kind(value)} is no {rule.kind}"]
    out: list[str] = []
    if rule.kind == "object":
        for name in sorted({*value, *rule.fields}):
            if name not in rule.fields:
                out += [] if rule.open else [f"{path}.{name}: unknown"]
            elif name not in value:
                out += [] if rule.fields[name].optional else [f"{path}.{name}: missing"]
            else:
                out += errors(value[name], rule.fields[name], f"{path}.{name}")
    elif rule.kind == "array" and rule.items is not None:
        for k, item in enumerate(value):
            out += errors(item, rule.items, f"{path}[{k}]")
    if rule.kind not in ("object", "array") or not out:
        out += [f"{path}: {said}" for check in rule.checks if (said := check(value))]
    return out


# Fixed values of the composite score.
COMPOSITE_VERSION = "1.0.0"
WEIGHTS = ("code_generation_pass_at_1", "boundary_pass_at_1", "static_repair_success", "execution_repair_success", "hidden_pass_rate")


def _weight(v) -> str | None:
    if not math.isfinite(v):
        return "not finite"
    return None if 0 <= v <= 1 else "outside 0 to 1"


def _sum(v) -> str | None:
    total = sum(v[k] for k in WEIGHTS)
    return None if abs(total - 1) <= 1e-9 else "weights do not sum to 1"


COMPOSITE = Rule("object", {"schema_version": Rule("string", checks=[lambda v: None if v == COMPOSITE_VERSION else "other version"]), "hard_constraint": Rule("object", open=True), **{k: Rule("number", checks=[_weight]) for k in WEIGHTS}}, checks=[_sum])
CONFIG = Rule("object", {"composite_score": COMPOSITE}, open=True)


def composite_errors(config) -> list[str]:
    """Errors of the composite_score block of a configuration, whose other blocks are not looked at."""
    return errors(config, CONFIG)
