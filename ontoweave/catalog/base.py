"""Registry, table access and the SQL fragments shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ontoweave.sources.files import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is checked on small fixtures in the tests."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@dataclass(frozen=True)
class View:
    """A domain object over one table: every column is an expression both SQL dialects read alike."""

    source: str
    columns: dict[str, str]
    where: str = ""
    heavy: bool = False
    task_bytes: int | None = None

    def df(self, spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, self.source)
        if self.heavy:
            rows = spread(rows, self.task_bytes)
        if self.where:
            rows = rows.where(self.where)
        return rows.selectExpr(*[f"{e} as {c}" for c, e in self.columns.items()])

    def sql(self) -> str:
        cols = ", ".join(f"{e} AS {c}" for c, e in self.columns.items())
        return f"SELECT {cols} FROM {self.source}" + (f" WHERE {self.where}" if self.where else "")


def ctes(**views: View | str) -> str:
    """``WITH`` clause naming each view or SQL text."""
    parts = [f"{n} AS MATERIALIZED ({v.sql() if isinstance(v, View) else v})" for n, v in views.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def sql_round(x: str, digits: int) -> str:
    """DuckDB text for rounding the exact value of a double, ties to even."""
    s = f"1e{digits}"
    c = "134217729::DOUBLE"
    err = f"((v - h) * {s} - (p - h * {s}))"
    body = (
        f"(round_even(p, 0) + CASE WHEN p - round_even(p, 0) = 0.5 AND {err} > 0 THEN 1e0 "
        f"WHEN p - round_even(p, 0) = -0.5 AND {err} < 0 THEN -1e0 ELSE 0e0 END) / {s}"
    )
    inner = f"list_transform([v * {s}], lambda p: {body})[1]"
    split = f"list_transform([v * {c} - (v * {c} - v)], lambda h: {inner})[1]"
    return f"(list_transform([({x})::DOUBLE], lambda v: {split})[1])"


def sql_haversine(lng1: str, lat1: str, lng2: str, lat2: str, radius: str) -> str:
    a = (
        f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin(radians({lng2} - {lng1}) / 2), 2))"
    )
    return f"({radius}::DOUBLE * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


def money(col: str) -> str:
    """Exact sum of a two-decimal column, as a double."""
    return f"CAST(SUM(CAST({col} AS DECIMAL(18,2))) AS DOUBLE)"


WORDS = r"list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"


def sql_words(text: str) -> str:
    return WORDS.format(text)
