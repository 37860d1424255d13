"""The ``field__op`` filter grammar compiled to Spark predicates.

The result is a plain ``Column``: Catalyst pushes comparisons into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
OPERATORS = {"eq", "ne", "like", *COMPARISONS}


def _equals(col: Column, value: Any) -> Column:
    # A plain '=' with a non-null literal prunes row groups; null needs its own test.
    return col.isNull() if value is None else col == F.lit(value)


def _differs(col: Column, value: Any) -> Column:
    """``ne`` keeps null rows unless the value itself is null."""
    return col.isNotNull() if value is None else (col != F.lit(value)) | col.isNull()


def _contains(col: Column, value: str, case_sensitive: bool) -> Column:
    if not case_sensitive:
        return col.cast("string").ilike(f"%{value}%")
    text = col.cast("string")
    # A missing value reads as the text "None", so only needles inside it can match a null.
    return F.coalesce(text, F.lit("None")).contains(value) if value in "None" else text.contains(value)


def split_key(key: str) -> tuple[str, str]:
    field, _, op = key.partition("__")
    return field, op or "eq"


def predicate(col: Column, op: str, value: Any, case_sensitive: bool = True) -> Column:
    if op == "eq":
        return _equals(col, value)
    if op == "ne":
        return _differs(col, value)
    if op == "like":
        return _contains(col, str(value), case_sensitive)
    if op in COMPARISONS:
        return COMPARISONS[op](col, F.lit(value))
    raise ValueError(f"unknown filter operator {op!r}; known: {sorted(OPERATORS)}")


def filter_column(
    filters: dict[str, Any] | None,
    allowed: Iterable[str] | None = None,
    operators: Iterable[str] | None = None,
    case_sensitive: bool = True,
) -> Column | None:
    """Conjunction of all filters, or None when there is nothing to filter.

    ``allowed`` ignores fields outside a column list (view sources);
    ``operators`` narrows the grammar, every other suffix then means equality.
    """
    known = None if allowed is None else set(allowed)
    narrowed = None if operators is None else set(operators)
    parts = []
    for key, value in (filters or {}).items():
        field, op = split_key(key)
        if known is not None and field not in known:
            continue
        if narrowed is not None and op not in narrowed:
            op = "eq"
        parts.append(predicate(F.col(field), op, value, case_sensitive))
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply_filters(df: DataFrame, filters: dict[str, Any] | None, **options: Any) -> DataFrame:
    condition = filter_column(filters, **options)
    return df if condition is None else df.filter(condition)


def present(filters: dict[str, Any]) -> dict[str, Any]:
    """Drop filters whose value was left out (lookup parameters)."""
    return {k: v for k, v in filters.items() if v not in ("", None)}


def either_equals(columns: list[str], value: Any) -> Column:
    """A value at either end of an undirected edge."""
    return reduce(lambda a, b: a | b, [F.col(c) == F.lit(value) for c in columns])


def search_text(df: DataFrame, keyword: str, columns: list[str], object_type: str = "") -> DataFrame:
    """Rows where any text column contains the keyword, with the list of matching columns."""
    if not keyword:
        return df.limit(0).withColumns({"_object_type": F.lit(object_type), "_matched_field": F.lit("")})
    hits = [F.when(F.col(c).contains(keyword), F.lit(c)) for c in columns]
    any_hit = reduce(lambda a, b: a | b, [F.col(c).contains(keyword) for c in columns])
    return df.filter(any_hit).withColumns(
        {"_object_type": F.lit(object_type), "_matched_field": F.concat_ws(", ", *hits)}
    )
