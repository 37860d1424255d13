"""Order-aware reductions: one row per key, built as mergeable aggregates.

``min_by``/``max_by`` over a struct combine on the map side, so no task ever
holds a whole group, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[Column | str], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ordinal = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest), ordinal).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key in ``order`` (ordered dedupe, first matching rule)."""
    return _pick(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Last row per key in ``order`` (latest version, last rule in the file)."""
    return _pick(df, keys, order, F.max_by)


def strongest(df: DataFrame, keys: list[str], score: str, ordinal: str) -> DataFrame:
    """Highest score per key; among equal scores the first by ``ordinal``."""
    return last_wins(df, keys, [F.col(score), -F.col(ordinal)])


def with_duplicate_count(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """First row per key together with the number of rows that share the key."""
    rest = [c for c in df.columns if c not in keys]
    ordinal = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("_row"), F.count("*").alias(name))
    return out.select(*keys, "_row.*", name)


def divide(requirements: DataFrame, done: DataFrame, group: list[str], item: str) -> DataFrame:
    """Groups all of whose required items are present in ``done`` (relational division).

    Both sides meet in one aggregation without sort or join, in as many tasks as the session shuffles to:
    keys pack so well that a task of a fixed number of bytes would hold too many of them. A null matches nothing.
    """
    keys = [*group, item]
    asked = requirements.select(*keys, F.lit(1).alias("_asked"), F.lit(False).alias("_done"))
    held = done.select(*keys).dropna().select(*keys, F.lit(0).alias("_asked"), F.lit(True).alias("_done"))
    tasks = int(requirements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = asked.unionByName(held).repartition(tasks, *keys).groupBy(*keys).agg(F.sum("_asked").alias("_asked"), F.bool_or("_done").alias("_done"))
    types = {c: requirements.schema[c].dataType for c in group}
    return (
        marked.filter("_asked > 0").groupBy(*group)
        .agg(F.bool_and("_done").alias("_all"), F.sum("_asked").alias("required"))
        .filter("_all")
        .select(*[F.col(c).cast(t).alias(c) for c, t in types.items()], "required")
    )
