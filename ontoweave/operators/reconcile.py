"""Compare generated rows with expected rows, and listings with listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoweave.functions.numeric import round_exact


def _changed(left: Column, right: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)):
        a = round_exact(F.coalesce(left.cast("double"), F.lit(0.0)), 2)
        b = round_exact(F.coalesce(right.cast("double"), F.lit(0.0)), 2)
        return a != b
    return ~left.eqNullSafe(right)


def diff(generated: DataFrame, expected: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key that differs: ``status`` and the list of differing fields.

    Numbers are equal when they agree to two decimals.
    """
    left = generated.select(*keys, F.struct(*fields).alias("_left"))
    right = expected.select(*keys, F.struct(*fields).alias("_right"))
    both = left.join(right, keys, "full_outer")
    names = [
        F.when(_changed(F.col(f"_left.{f}"), F.col(f"_right.{f}"), generated.schema[f].dataType), F.lit(f))
        for f in fields
    ]
    status = (
        F.when(F.col("_right").isNull(), "missing_expected")
        .when(F.col("_left").isNull(), "missing_generated")
        .otherwise("changed")
    )
    return (
        both.withColumns({"status": status, "changed_fields": F.concat_ws(",", *names)})
        .filter((F.col("status") != "changed") | (F.col("changed_fields") != ""))
        .withColumn("changed_fields", F.when(F.col("status") == "changed", F.col("changed_fields")).otherwise(""))
        .select(*keys, "status", "changed_fields")
    )


def sync_actions(
    stored: DataFrame, listing: DataFrame, keys: list[str], version: str, tolerance: float | None = None
) -> DataFrame:
    """Action per key that brings ``stored`` up to ``listing``: add, update, delete or keep."""
    old = stored.select(*keys, F.struct(F.col(version).alias("v")).alias("_old"))
    new = listing.select(*keys, F.struct(F.col(version).alias("v")).alias("_new"))
    same = F.col("_old.v").eqNullSafe(F.col("_new.v"))
    if tolerance is not None:
        same = F.abs(F.col("_old.v") - F.col("_new.v")) <= tolerance
    action = (
        F.when(F.col("_old").isNull(), "add")
        .when(F.col("_new").isNull(), "delete")
        .when(same, "keep")
        .otherwise("update")
    )
    return old.join(new, keys, "full_outer").withColumn("action", action).select(*keys, "action")


def apply_sync(stored: DataFrame, listing: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows after the actions: kept rows, plus added and updated rows of the listing."""
    kept = stored.join(actions.filter("action = 'keep'"), keys, "left_semi")
    fresh = listing.join(actions.filter("action in ('add', 'update')"), keys, "left_semi")
    return kept.unionByName(fresh)


def upsert(rows: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Replace rows whose key occurs in the patch and append the patch."""
    return rows.join(patch.select(*keys).distinct(), keys, "left_anti").unionByName(patch)


def all_equal(columns: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in columns])
