"""The condition language of workflow edges and filters, as boolean columns.

A condition is a dict: {"op": "and" | "or", "conditions": [...]}, {"op": "not", "condition": {...}}, or a leaf
{"op": ..., "left": ..., "right": ...}, whose operands are "$.column" or "$.column.field" references, or literals. Null
compares as a value: it equals only null, and no ordering holds for it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def operand(value: Any) -> Column:
    """A reference or a literal; lists are arrays."""
    if isinstance(value, str) and value.startswith("$."):
        return F.col(value[2:])
    if isinstance(value, list):
        return F.array(*map(operand, value))
    return value if isinstance(value, Column) else F.lit(value)


def _safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _text(c: Column) -> Column:
    return c.cast("string")


def _length(c: Column, is_list: bool) -> Column:
    return F.coalesce(F.size(c) if is_list else F.length(_text(c)), F.lit(0))


LEAVES: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a.eqNullSafe(b),
    "!=": lambda a, b: ~a.eqNullSafe(b),
    ">": lambda a, b: _safe(a > b),
    "<": lambda a, b: _safe(a < b),
    ">=": lambda a, b: _safe(a >= b),
    "<=": lambda a, b: _safe(a <= b),
    "startswith": lambda a, b: _safe(F.startswith(_text(a), _text(b))),
    "endswith": lambda a, b: _safe(F.endswith(_text(a), _text(b))),
    "regex": lambda a, b: _safe(F.regexp_like(_text(a), _text(b))),
    "contains_item": lambda a, b: _safe(F.array_contains(a, b)),
}


def condition(spec: dict[str, Any] | None, lists: frozenset[str] = frozenset()) -> Column:
    """The column of a condition; None holds always. ``lists`` names the columns that are arrays.

    An unknown or missing operator raises ValueError.
    """
    if spec is None:
        return F.lit(True)
    op = spec.get("op")
    if op in ("and", "or"):
        parts = [condition(c, lists) for c in spec.get("conditions", [])]
        return reduce(Column.__and__ if op == "and" else Column.__or__, parts, F.lit(op == "and"))
    if op == "not":
        return ~condition(spec["condition"], lists)
    left, right = spec.get("left"), spec.get("right")
    listed = isinstance(left, list) or isinstance(left, str) and left[2:] in lists
    a, b = operand(left), operand(right)
    if op == "contains":
        return _safe(F.array_contains(a, b) if listed else F.contains(_text(a), _text(b)))
    if op == "in":
        held = isinstance(right, list) or isinstance(right, str) and right[2:] in lists
        return _safe(F.array_contains(b, a) if held else F.contains(_text(b), _text(a)))
    if op in ("length_eq", "length_gt", "length_lt"):
        n = _length(a, listed)
        return {"length_eq": n == b, "length_gt": n > b, "length_lt": n < b}[op]
    if op not in LEAVES:
        raise ValueError(f"unknown operator: {op!r}")
    return LEAVES[op](a, b)


def first_case(cases: list[tuple[dict[str, Any], str]], default: str) -> Column:
    """The label of the first case whose condition holds, else the default."""
    head = F.when(F.lit(False), F.lit(default))
    return reduce(lambda c, case: c.when(condition(case[0]), case[1]), cases, head).otherwise(default)


def classified(rules: list[tuple[dict[str, Any], str, float | None]], confidences: dict[str, float], default: str = "unknown") -> Column:
    """category, confidence (the rule's, else the category's, else a half) and matched_rule (from 0, null without a match)."""
    out = F.when(F.lit(False), F.struct(F.lit(default).alias("category"), F.lit(0.5).alias("confidence"), F.lit(None).cast("int").alias("matched_rule")))
    for i, (spec, category, confidence) in enumerate(rules):
        sure = confidence if confidence is not None else confidences.get(category, 0.5)
        out = out.when(condition(spec), F.struct(F.lit(category).alias("category"), F.lit(float(sure)).alias("confidence"), F.lit(i).alias("matched_rule")))
    return out.otherwise(F.struct(F.lit(default).alias("category"), F.lit(float(confidences.get(default, 0.5))).alias("confidence"), F.lit(None).cast("int").alias("matched_rule")))
