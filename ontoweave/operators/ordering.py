"""Sorting, paging and bounded ranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_key(order_by: str) -> tuple[str, bool]:
    return order_by.lstrip("-"), order_by.startswith("-")


def apply_order(df: DataFrame, order_by: str | None, tiebreak: list[str] | None = None) -> DataFrame:
    """``field`` ascending or ``-field`` descending; ``tiebreak`` makes the order total."""
    if not order_by:
        return df
    field, descending = sort_key(order_by)
    first = F.col(field).desc_nulls_last() if descending else F.col(field).asc_nulls_first()
    return df.orderBy(first, *[F.col(c).asc() for c in tiebreak or [] if c != field])


def safe_order_by(df: DataFrame, order_by: str | None, default: str) -> str:
    """The requested key when it names a column, else the default."""
    field = sort_key(order_by)[0] if order_by else ""
    usable = re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", field) and field in df.columns
    return order_by if usable else default


def apply_window(df: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    """Offset first, then limit; zero or None leaves either out."""
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit else df


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key, numbered from 1.

    The rank filter lets Spark keep only ``k`` rows per key and map task before
    the shuffle, so a key holding a large share of the rows stays cheap.
    """
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(rank) <= k)


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(int(value or default), high))
