"""Effective-dated rows, period rules and bracket lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.operators.grouping import last_wins

# A bracket table is a rule table: up to this many rows it becomes one CASE expression.
CASE_BRACKET_ROWS = 256


def _open(col: Column) -> Column:
    return col.isNull() | (col == "")


def valid_at(as_of: Column, effective: str = "effective_date", expiry: str = "expiry_date") -> Column:
    """ISO date strings compare as text; an empty bound is open."""
    start, end = F.col(effective), F.col(expiry)
    return (_open(start) | (start <= as_of)) & (_open(end) | (end >= as_of))


def select_effective(
    df: DataFrame, keys: list[str], as_of: str, effective: str = "effective_date", expiry: str = "expiry_date",
    tiebreak: list[str] | None = None,
) -> DataFrame:
    """The version of each key that is valid at ``as_of``, latest effective date first."""
    valid = df.filter(valid_at(F.lit(as_of), effective, expiry))
    order = [F.coalesce(F.col(effective), F.lit("")), *(tiebreak or [])]
    return last_wins(valid, keys, order)


def effective_rules(df: DataFrame, period: str, column: str = "effective_period") -> DataFrame:
    return df.filter(_open(F.col(column)) | (F.col(column) <= period))


def select_period_rule(
    df: DataFrame, keys: list[str], period: str, column: str = "effective_period", tiebreak: list[str] | None = None
) -> DataFrame:
    """Latest rule per key whose period is not after ``period``."""
    order = [F.coalesce(F.col(column), F.lit("")), *(tiebreak or [])]
    return last_wins(effective_rules(df, period, column), keys, order)


def bracket_lookup(
    df: DataFrame, value: str, brackets: DataFrame, lower: str, upper: str, outputs: list[str],
    cells: int = 1024,
) -> DataFrame:
    """Attach the first bracket with ``lower <= value <= upper``; a null upper bound is open.

    Both bounds are inclusive, so a value on a boundary takes the lower
    bracket. Values outside every bracket take the last one. A small table is
    compiled into the projection; a large one is joined on value cells.
    """
    ordered = brackets.select(lower, upper, *outputs).orderBy(lower)
    rows = ordered.limit(CASE_BRACKET_ROWS + 1).collect()
    if not rows:
        return df.withColumns({o: F.lit(None).cast(brackets.schema[o].dataType) for o in outputs})
    if len(rows) <= CASE_BRACKET_ROWS:
        return df.withColumns({o: _case(F.col(value), rows, lower, upper, o, brackets.schema[o].dataType) for o in outputs})
    return _cell_lookup(df, value, ordered, lower, upper, outputs, cells)


def _case(value: Column, rows: list, lower: str, upper: str, output: str, dtype) -> Column:
    chain = None
    for row in rows:
        inside = value >= row[lower]
        if row[upper] is not None:
            inside = inside & (value <= row[upper])
        chain = (F.when if chain is None else chain.when)(inside, F.lit(row[output]).cast(dtype))
    return chain.otherwise(F.lit(rows[-1][output]).cast(dtype))


def _cell_lookup(df, value, brackets, lower, upper, outputs, cells) -> DataFrame:
    low, high, last = brackets.agg(
        F.min(lower), F.max(lower), F.max_by(F.struct(*outputs), F.col(lower))
    ).first()
    width = max((high - low) / cells, 1e-9)

    def cell(col: Column) -> Column:
        # Clipping keeps the mapping monotone, so open ends fall into the outer cells.
        return F.greatest(F.lit(0), F.least(F.lit(cells), F.floor((col - low) / width).cast("int")))

    spread = brackets.withColumn(
        "_cell", F.explode(F.sequence(cell(F.col(lower)), F.coalesce(cell(F.col(upper)), F.lit(cells))))
    ).select("_cell", *[F.col(c).alias(f"_b_{c}") for c in [lower, upper, *outputs]])
    # Only distinct values are looked up, so a hot value costs one row.
    values = df.select(value).distinct().filter(F.col(value).isNotNull()).withColumn("_cell", cell(F.col(value)))
    inside = (F.col(value) >= F.col(f"_b_{lower}")) & (
        F.col(f"_b_{upper}").isNull() | (F.col(value) <= F.col(f"_b_{upper}"))
    )
    matched = (
        values.join(spread, "_cell").filter(inside)
        .groupBy(value)
        .agg(F.min_by(F.struct(*[F.col(f"_b_{o}").alias(o) for o in outputs]), F.col(f"_b_{lower}")).alias("_hit"))
    )
    fallback = {o: F.coalesce(F.col(f"_hit.{o}"), F.lit(last[o])) for o in outputs}
    return df.join(matched, value, "left").withColumns(fallback).drop("_hit")
