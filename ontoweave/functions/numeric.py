"""Numeric column functions with the rounding and coercion rules of the domain.

Spark runs ANSI by default, so every lenient conversion is a guarded cast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Veltkamp's constant 2**27 + 1: splits a double into two 26-bit halves.
_SPLITTER = 134217729.0


def lenient_int(col: Column, is_text: bool = True) -> Column:
    """Whole-number text becomes an integer; decimals in text, blanks and junk become 0."""
    if is_text:
        clean = F.trim(col)
        return F.when(clean.rlike(r"^[+-]?\d{1,18}$"), clean.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return F.coalesce(col.cast("bigint"), F.lit(0).cast("bigint"))


def as_number(col: Column) -> Column:
    """Blank text and null read as 0.0; other text must be a number."""
    return F.coalesce(F.nullif(F.trim(col.cast("string")), F.lit("")).cast("double"), F.lit(0.0))


def first_truthy(*cols: Column) -> Column:
    """First value that is neither null nor zero."""
    return F.coalesce(*[F.when(c != 0, c) for c in cols], F.lit(0.0))


def first_text(*cols: Column) -> Column:
    """First value that is neither null nor empty text, else empty text."""
    return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(""))


def round_exact(col: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to even, to ``digits`` decimals.

    ``F.round`` and ``F.bround`` round the shortest decimal text of the double
    (2.675 -> 2.68), while the domain needs the value the double really has
    (2.67). The product with 10**digits is formed without error as ``p + e``
    (Dekker's product), so the tie test is exact and stays inside code
    generation. Pass a plain column: the expression mentions it many times.
    """
    scale = F.lit(float(10**digits))
    high = col * F.lit(_SPLITTER) - (col * F.lit(_SPLITTER) - col)
    low = col - high
    product = col * scale
    error = low * scale - (product - high * scale)
    nearest = F.rint(product)
    gap = product - nearest
    nudge = (
        F.when((gap == 0.5) & (error > 0), 1.0)
        .when((gap == -0.5) & (error < 0), -1.0)
        .otherwise(0.0)
    )
    return F.when(F.abs(product) >= 4503599627370496.0, col).otherwise((nearest + nudge) / scale)


def with_rounded(df: DataFrame, digits: int, **exprs: Column) -> DataFrame:
    """Add columns rounded by :func:`round_exact`, evaluating each input expression once."""
    raw = {f"_raw_{name}": expr.cast("double") for name, expr in exprs.items()}
    staged = df.withColumns(raw)
    out = staged.withColumns({name: round_exact(F.col(f"_raw_{name}"), digits) for name in exprs})
    return out.drop(*raw)


def computed_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add costly columns that later filters must not evaluate again.

    A filter on a plain computed column is pushed below it and repeats the whole
    expression. Columns that come out of a generator stay where they are.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def half_up_hundreds(col: Column) -> Column:
    return (F.floor(col / 100 + 0.5) * 100).cast("bigint")


def clamp_open(value: Column, lower: Column, upper: Column) -> Column:
    """Clamp to [lower, upper]; a bound of 0 (or null) is open."""
    lifted = F.when(F.coalesce(lower, F.lit(0.0)) != 0, F.greatest(value, lower)).otherwise(value)
    return F.when(F.coalesce(upper, F.lit(0.0)) != 0, F.least(lifted, upper)).otherwise(lifted)


def sum_columns(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, cols)


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column, radius: float) -> Column:
    """Great-circle distance in the unit of ``radius`` (6371 km or 6371000 m)."""
    dlat = F.radians(lat2 - lat1)
    dlng = F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(radius) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
