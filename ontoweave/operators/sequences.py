"""Row-to-row operators over ordered groups of any size.

Every function splits a group into ordinal blocks first. A window then sees one
block, never the whole group, so a group with a third of all rows is spread
over as many tasks as it has blocks; a small per-block summary carries the
state across block borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame, keys: list[str], ordinal: str, value: Column, name: str, block: Column
) -> DataFrame:
    """Inclusive running sum of ``value`` along ``ordinal`` within ``keys``.

    ``block`` must grow with ``ordinal`` (for example ordinal div 1024).
    """
    staged = df.withColumns({"_block": block, "_value": value})
    sums = staged.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys, "_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    return (
        staged.join(carried, [*keys, "_block"])
        .withColumn(name, F.col("_carry") + F.sum("_value").over(within))
        .drop("_block", "_value", "_carry")
    )


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, block: Column
) -> DataFrame:
    """The ``value`` of the preceding row along ``order`` within ``keys``; null on the first row."""
    staged = df.withColumn("_block", block)
    tails = staged.groupBy(*keys, "_block").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_tail")
    )
    carried = tails.withColumn(
        "_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_block"))
    ).drop("_tail")
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        staged.join(carried, [*keys, "_block"])
        .withColumn("_first", F.row_number().over(within) == 1)
        .withColumn(name, F.when(F.col("_first"), F.col("_carry.v")).otherwise(F.lag(value).over(within)))
        .drop("_block", "_carry", "_first")
    )


def neighbours(hits: DataFrame, rows: DataFrame, keys: list[str], ordinal: str, reach: int) -> DataFrame:
    """Rows within ``reach`` ordinals of any hit, as an equi-join on (keys, ordinal)."""
    wanted = (
        hits.select(*keys, ordinal)
        .withColumn(ordinal, F.explode(F.sequence(F.col(ordinal) - reach, F.col(ordinal) + reach)))
        .distinct()
    )
    return rows.join(wanted, [*keys, ordinal], "left_semi")


def within_budget(df: DataFrame, keys: list[str], ordinal: str, size: Column, budget: int, block: Column) -> DataFrame:
    """Leading rows of each group whose running size fits the budget."""
    return running_total(df, keys, ordinal, size, "running_size", block).filter(F.col("running_size") <= budget)
