"""Declared rules compiled to columns: a rule batch is one projection.

Strategies: ``first_match`` (ordered CASE), ``all`` (conjunction with collected
reasons), ``max_requirement`` (highest of all matching results in a given
order) and ``gated_any`` (a gate and at least one trigger).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Resolver = Callable[[str], Column]


@dataclass
class Condition:
    field: str = ""
    operator: str = "eq"
    value: Any = None
    result: Any = None
    reason: str = ""
    source_object: str = ""


@dataclass
class Rule:
    name: str
    result_field: str
    conditions: list[Condition]
    strategy: str = "first_match"
    default: Any = None
    requirement_order: list[str] = field(default_factory=list)
    gate: Condition | None = None
    applies_to: list[str] = field(default_factory=list)
    description: str = ""


def column_resolver(df: DataFrame) -> Resolver:
    """``Object.field`` resolves to column ``Object__field`` when present, else to ``field``."""
    names = set(df.columns)

    def resolve(reference: str) -> Column:
        flat = reference.replace(".", "__")
        return F.col(flat if flat in names else reference.split(".")[-1])

    return resolve


def _literal(value: Any) -> Column:
    return F.lit(json.dumps(value, ensure_ascii=False, sort_keys=True) if isinstance(value, (dict, list)) else value)


def _compare(name: str, left: Column, right: Column) -> Column:
    table = {
        "eq": lambda: left.eqNullSafe(right),
        "ne": lambda: ~left.eqNullSafe(right),
        "gt": lambda: left > right,
        "gte": lambda: left >= right,
        "lt": lambda: left < right,
        "lte": lambda: left <= right,
    }
    return table[name]()


_ORDERING = ("eq", "ne", "gt", "gte", "lt", "lte")


def _basic(cond: Condition, col: Column, resolve: Resolver) -> Column:
    op, value = cond.operator, cond.value
    if op in _ORDERING:
        return _compare(op, col, F.lit(value))
    if op == "in":
        return col.isin(list(value))
    if op == "between":
        return col.between(value[0], value[1])
    if op == "like":
        return col.cast("string").contains(str(value))
    if op == "exists":
        return col.isNotNull() if value in (None, True) else col.isNull()
    if op == "none_eq":
        return F.coalesce(F.forall(col, lambda x: ~x.eqNullSafe(F.lit(value))), F.lit(True))
    if op == "distinct_count_gte":
        return F.size(F.array_distinct(col)) >= F.lit(value)
    if op == "in_field":
        return F.array_contains(resolve(value), col)
    if op == "contains_field":
        return F.array_contains(col, resolve(value))
    if op == "lte_field_km_as_m":
        return col <= resolve(value) * 1000
    if op == "gte_context":
        return col >= resolve(value)
    if op.endswith("_field") and op[:-6] in _ORDERING:
        return _compare(op[:-6], col, resolve(value))
    raise ValueError(f"unknown rule operator {op!r}")


def parse_condition(raw: Condition | dict) -> Condition:
    """Accept declared mappings, with or without ``field`` on compound conditions."""
    if isinstance(raw, Condition):
        return raw
    for name in ("all", "any"):
        if name in raw and not raw.get("field"):
            return Condition("__compound__", name, raw[name], raw.get("result"), raw.get("fail_reason", ""))
    return Condition(
        field=raw.get("field", ""),
        operator=raw.get("operator", "eq"),
        value=raw.get("value"),
        result=raw.get("result"),
        reason=raw.get("fail_reason") or raw.get("trigger_reason") or raw.get("reason") or "",
        source_object=raw.get("source_object", ""),
    )


def condition_column(raw: Condition | dict, resolve: Resolver) -> Column:
    """A condition as a boolean column; a comparison with a missing value is false."""
    cond = parse_condition(raw)
    if cond.operator in ("all", "any"):
        parts = [condition_column(c, resolve) for c in cond.value]
        return reduce((lambda a, b: a & b) if cond.operator == "all" else (lambda a, b: a | b), parts)
    reference = f"{cond.source_object}.{cond.field}" if cond.source_object else cond.field
    return F.coalesce(_basic(cond, resolve(reference), resolve), F.lit(False))


def _first_match(rule: Rule, resolve: Resolver) -> dict[str, Column]:
    chain = None
    for cond in rule.conditions:
        chain = (F.when if chain is None else chain.when)(condition_column(cond, resolve), _literal(cond.result))
    return {rule.result_field: chain.otherwise(_literal(rule.default))}


def _all(rule: Rule, resolve: Resolver) -> dict[str, Column]:
    checks = [condition_column(c, resolve) for c in rule.conditions]
    reasons = [F.when(~ok, F.lit(c.reason or c.field)) for ok, c in zip(checks, rule.conditions)]
    return {
        rule.result_field: reduce(lambda a, b: a & b, checks),
        f"{rule.result_field}_reasons": F.concat_ws(";", *reasons),
    }


def _max_requirement(rule: Rule, resolve: Resolver) -> dict[str, Column]:
    ranks = [
        F.when(condition_column(c, resolve), F.lit(rule.requirement_order.index(c.result))) for c in rule.conditions
    ]
    highest = F.greatest(*ranks, F.lit(None).cast("int"))
    names = F.array(*[F.lit(n) for n in rule.requirement_order])
    return {rule.result_field: F.coalesce(F.get(names, highest), _literal(rule.default))}


def _gated_any(rule: Rule, resolve: Resolver) -> dict[str, Column]:
    gate = condition_column(rule.gate, resolve) if rule.gate else F.lit(True)
    checks = [condition_column(c, resolve) for c in rule.conditions]
    reasons = [F.when(ok, F.lit(c.reason or c.field)) for ok, c in zip(checks, rule.conditions)]
    return {
        rule.result_field: gate & reduce(lambda a, b: a | b, checks),
        f"{rule.result_field}_reasons": F.concat_ws(";", *reasons),
    }


_STRATEGIES = {
    "first_match": _first_match,
    "all": _all,
    "max_requirement": _max_requirement,
    "gated_any": _gated_any,
}


def rule_columns(rule: Rule, resolve: Resolver) -> dict[str, Column]:
    if rule.strategy not in _STRATEGIES:
        raise ValueError(f"unknown match strategy {rule.strategy!r}")
    return _STRATEGIES[rule.strategy](rule, resolve)


def apply_rules(df: DataFrame, *rules: Rule) -> DataFrame:
    """Evaluate several rules in one projection."""
    resolve = column_resolver(df)
    columns: dict[str, Column] = {}
    for rule in rules:
        columns.update(rule_columns(rule, resolve))
    return df.withColumns(columns)
