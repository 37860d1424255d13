"""Governance checks: mutability, transitions, constraints, preconditions, deadlines, workflows."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.operators.filters import predicate

_WRITES = {"read_only": set(), "append_only": {"insert"}, "mutable": {"insert", "update", "delete"}}


def check_mutability(object_type: str, mutability: str, action: str) -> None:
    if action not in _WRITES.get(mutability, _WRITES["mutable"]):
        raise ValueError(f"{object_type} is {mutability}: {action} refused")


def transition_allowed(old: Column, new: Column, transitions: dict[str, list[str]]) -> Column:
    """An unchanged status is always legal; a state without declared targets is final."""
    moves = [(old == state) & new.isin(targets) for state, targets in transitions.items() if targets]
    declared = reduce(lambda a, b: a | b, moves, F.lit(False))
    return F.coalesce(old.eqNullSafe(new) | declared, F.lit(False))


def _when(match: dict[str, Any]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(predicate(F.col(k), "eq", v), F.lit(False)) for k, v in match.items()])


def exclusion_reasons(function: str, excluded: list[str], constraints: list[dict]) -> Column:
    """Reasons why ``function`` may not be called on a row; empty text when it may."""
    reasons = [F.lit(f"{function} excluded")] if function in excluded else []
    for rule in constraints:
        if function in rule["excluded_functions"]:
            reasons.append(F.when(_when(rule["when"]), F.lit(rule.get("reason") or "excluded")))
    return F.concat_ws(";", *reasons) if reasons else F.lit("")


def precondition_column(field: str, operator: str, value: Any = None) -> Column:
    col = F.col(field)
    if operator == "in":
        return F.coalesce(col.isin(list(value)), F.lit(False))
    if operator == "exists":
        return col.isNotNull()
    if operator == "not_exists":
        return col.isNull()
    return F.coalesce(predicate(col, operator, value), F.lit(False))


def meets_preconditions(targets: DataFrame, key: str, requirements: list[tuple[DataFrame, dict]]) -> DataFrame:
    """Targets for which every required object has a matching row.

    A requirement is (rows carrying ``key``, {field, operator, value}); a
    ``not_exists`` requirement asks that no row has the field set.
    """
    out = targets
    for rows, need in requirements:
        negated = need["operator"] == "not_exists"
        test = F.col(need["field"]).isNotNull() if negated else precondition_column(**need)
        out = out.join(rows.filter(test).select(key), key, "left_anti" if negated else "left_semi")
    return out


_DEADLINE = re.compile(r"^\s*(?P<base>\S+)\s*\+\s*(?P<count>\d+)\s*(?P<unit>[smhd])\s*$")
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def deadline_column(expression: str, base: Column | None = None) -> Column:
    """``"event_time + 2h"`` as a timestamp column."""
    found = _DEADLINE.match(expression)
    if not found:
        raise ValueError(f"unreadable deadline {expression!r}")
    start = base if base is not None else F.col(found["base"])
    seconds = int(found["count"]) * _SECONDS[found["unit"]]
    return start + F.make_dt_interval(secs=F.lit(seconds))


def check_sla(df: DataFrame, constraints: list[dict], finished: str) -> DataFrame:
    """Deadline and status per row; the first constraint whose ``when`` fits applies."""
    deadline = label = None
    for rule in constraints:
        fits = _when(rule["when"]) if rule.get("when") else F.lit(True)
        due, text = deadline_column(rule["deadline"]), F.lit(rule.get("sla", ""))
        deadline = (F.when if deadline is None else deadline.when)(fits, due)
        label = (F.when if label is None else label.when)(fits, text)
    status = (
        F.when(F.col("deadline").isNull(), "no_deadline")
        .when(F.col(finished).isNull(), "open")
        .when(F.col(finished) <= F.col("deadline"), "met")
        .otherwise("breached")
    )
    return df.withColumns({"deadline": deadline, "sla": label}).withColumn("sla_status", status)


def next_step(steps: list[dict], step: Column, outcome: Column) -> Column:
    """Next workflow step per instance: fixed, by outcome, or the following step in the list.

    A declared branch that does not know the outcome keeps the instance where
    it is; past the last step the result is null.
    """
    chain = None
    for i, spec in enumerate(steps):
        following = steps[i + 1]["name"] if i + 1 < len(steps) else None
        target = spec.get("next") or following
        if isinstance(target, dict):
            branch = None
            for result, name in target.items():
                branch = (F.when if branch is None else branch.when)(outcome == result, F.lit(name))
            value = branch.otherwise(F.lit(spec["name"]))
        else:
            value = F.lit(target).cast("string")
        chain = (F.when if chain is None else chain.when)(step == spec["name"], value)
    return chain
