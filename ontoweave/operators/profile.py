"""Generic profile tools over any object: describe, distribution, pivot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("row_count"))


def pivot_sum(df: DataFrame, rows: list[str], column: str, values: list, measure) -> DataFrame:
    """One column per given value; naming the values spares the extra pass that finds them."""
    return df.groupBy(*rows).agg(
        *[F.coalesce(F.sum(F.when(F.col(column) == v, measure)), F.lit(0)).alias(f"{column}_{v}") for v in values]
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, nulls, min and max of every column in one aggregate, one output row per column."""
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("field"),
                F.count(c).alias("value_count"),
                F.count(F.when(F.col(c).isNull(), 1)).alias("null_count"),
                F.min(c).cast("string").alias("min_value"),
                F.max(c).cast("string").alias("max_value"),
            ).alias(f"s_{i}")
            for i, c in enumerate(columns)
        ]
    )
    return stats.select(F.inline(F.array(*[f"s_{i}" for i in range(len(columns))])))


def inspect(schema: T.StructType) -> list[dict]:
    """Declared shape of an object: the schema is metadata, no job is run."""
    return [
        {"field": f.name, "type": f.dataType.simpleString(), "required": not f.nullable, **f.metadata} for f in schema
    ]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
