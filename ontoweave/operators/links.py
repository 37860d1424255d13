"""Declared links as joins: single, composite and list keys, multi-hop walks.

No join is hinted: Spark broadcasts a side only when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and splits skewed partitions at run time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Link:
    name: str
    source: str
    target: str
    source_key: str
    target_key: str
    link_type: str = "contains"
    cardinality: str = ""
    description: str = ""

    @property
    def key_pairs(self) -> list[tuple[str, str]]:
        left = [k.strip() for k in self.source_key.split(",") if k.strip()]
        right = [k.strip() for k in self.target_key.split(",") if k.strip()]
        if len(left) != len(right):
            raise ValueError(f"link {self.name}: {len(left)} source keys but {len(right)} target keys")
        return list(zip(left, right))


def _scalar_key(df: DataFrame, column: str, name: str) -> DataFrame:
    """Expose a join key under ``name``; a list key becomes one row per distinct element."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return df.withColumn(name, F.explode(F.array_distinct(F.col(column))))
    return df.withColumn(name, F.col(column))


def query_link(
    source: DataFrame, target: DataFrame, link: Link, how: str = "inner", prefix: str = "target_"
) -> DataFrame:
    """Source rows with the linked target rows; target columns carry ``prefix``."""
    left, right, on = source, target.select(*[F.col(c).alias(f"{prefix}{c}") for c in target.columns]), []
    for i, (source_key, target_key) in enumerate(link.key_pairs):
        left = _scalar_key(left, source_key, f"_left_{i}")
        right = _scalar_key(right, f"{prefix}{target_key}", f"_right_{i}")
        on.append(F.col(f"_left_{i}") == F.col(f"_right_{i}"))
    joined = left.join(right, reduce(lambda a, b: a & b, on), how)
    return joined.drop(*[f"_{side}_{i}" for side in ("left", "right") for i in range(len(on))])


def walk(tables: dict[str, DataFrame], links: list[Link]) -> DataFrame:
    """Follow several links in a row; each hop prefixes its columns with the object name."""
    first = links[0].source
    current = tables[first].select(*[F.col(c).alias(f"{first}_{c}") for c in tables[first].columns])
    for link in links:
        hop = Link(
            link.name, link.source, link.target,
            ",".join(f"{link.source}_{a}" for a, _ in link.key_pairs), link.target_key,
        )
        current = query_link(current, tables[link.target], hop, prefix=f"{link.target}_")
    return current


def exists(source: DataFrame, target: DataFrame, link: Link) -> DataFrame:
    return query_link(source, target.select(*dict.fromkeys(b for _, b in link.key_pairs)), link, how="left_semi")


def missing(source: DataFrame, target: DataFrame, link: Link) -> DataFrame:
    return query_link(source, target.select(*dict.fromkeys(b for _, b in link.key_pairs)), link, how="left_anti")


def resolve_in_order(ids: DataFrame, key: str, candidates: list[tuple[str, DataFrame, str]], fields: list[str]) -> DataFrame:
    """Look an id up in several object types; the first type that has it wins.

    ``candidates`` are (type name, rows, id column); ids found nowhere keep
    ``object_type`` null.
    """
    tagged = [
        rows.select(F.col(id_column).alias(key), *fields, F.lit(i).alias("_priority"), F.lit(name).alias("object_type"))
        for i, (name, rows, id_column) in enumerate(candidates)
    ]
    pool = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    best = pool.groupBy(key).agg(
        F.min_by(F.struct("object_type", *fields), F.struct("_priority", *fields)).alias("_best")
    )
    return ids.join(best, key, "left").select(*ids.columns, "_best.*")
