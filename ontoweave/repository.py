"""Object access by name: query, count, lookup, search, links, rules, and governed writes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.functions.text import stable_id
from ontoweave.model import ObjectType, Ontology
from ontoweave.operators import filters as flt
from ontoweave.operators import guards, links, ordering, profile, rules
from ontoweave.operators.reconcile import upsert
from ontoweave.session import cut_lineage
from ontoweave.sources import files

READ_ONLY_SOURCES = {"json_file", "csv_file", "resolver", "parquet", "sql", "sqlite_table"}
# Writes to an object are chained onto its rows; every few of them the chain is materialised.
WRITES_PER_CUT = 8


class ObjectRepository:
    """DataFrames of the declared objects.

    Writable objects are immutable versions: every change derives a new
    DataFrame from the last one, readers of an older version are not disturbed.
    """

    def __init__(self, spark: SparkSession, ontology: Ontology, base_dir: str = ""):
        self.spark, self.ontology, self.base_dir = spark, ontology, base_dir.rstrip("/")
        self._resolvers: dict[str, Callable[[], DataFrame]] = {}
        self._readers: dict[str, Callable[[ObjectType], DataFrame]] = {}
        self._versions: dict[str, DataFrame] = {}
        self._writes: dict[str, int] = {}

    # --- sources ---------------------------------------------------------------------

    def register_resolver(self, name: str, build: Callable[[], DataFrame]) -> None:
        self._resolvers[name] = build

    def register_reader(self, source_type: str, build: Callable[[ObjectType], DataFrame]) -> None:
        self._readers[source_type] = build

    def provide(self, object_type: str, df: DataFrame) -> None:
        """Use these rows for an object, whatever source it declares."""
        self._versions[object_type] = df

    def object(self, name: str) -> ObjectType:
        if name not in self.ontology.objects:
            raise KeyError(f"unknown object {name!r}")
        return self.ontology.objects[name]

    def _location(self, path: str) -> str:
        return path if "://" in path or path.startswith("/") or not self.base_dir else f"{self.base_dir}/{path}"

    def df(self, name: str) -> DataFrame:
        """Lazy rows of an object."""
        if name in self._versions:
            return self._versions[name]
        spec = self.object(name)
        source = spec.source
        if source.type in self._readers:
            return self._readers[source.type](spec)
        if source.type == "resolver":
            return self._resolvers[source.resolver]()
        config = source.config
        path = config.get("path") or config.get("file")
        if source.type in ("json_file", "csv_file", "parquet"):
            return files.read_source(self.spark, spec.schema, source.type, self._location(path or f"data/{spec.table}.csv"))
        if source.type == "runtime_memory":
            seed = config.get("seed_path")
            return files.read_json(self.spark, self._location(seed), spec.schema) if seed else files.empty(self.spark, spec.schema)
        if source.type == "sqlite_table":
            return files.read_source(self.spark, spec.schema, "sqlite_table", spec.table, db_path=self._location(config["db_path"]))
        if source.type == "sql":
            return self.spark.sql(config["query"])
        return self.spark.table(spec.table)

    # --- reads -----------------------------------------------------------------------

    def query(
        self, name: str, filters: dict[str, Any] | None = None, limit: int | None = None, order_by: str | None = None, offset: int | None = None
    ) -> DataFrame:
        key = self.object(name).id_field
        rows = flt.apply_filters(self.df(name), filters)
        rows = ordering.apply_order(rows, order_by, [key] if key in rows.columns else None)
        return ordering.apply_window(rows, limit, offset)

    def count(self, name: str, filters: dict[str, Any] | None = None) -> int:
        return self.query(name, filters).count()

    def query_by_id(self, name: str, value: Any) -> DataFrame:
        return self.query(name, {self.object(name).id_field: value}, limit=1)

    def search(self, keyword: str, names: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Keyword over the text properties of several objects, as (object, id, matched fields)."""
        hits = []
        for name in names or list(self.ontology.objects):
            spec, rows = self.object(name), self.df(name)
            text = [c for c in spec.text_columns if c in rows.columns]
            if text:
                found = flt.search_text(rows, keyword, text, name)
                hits.append(found.select("_object_type", F.col(spec.id_field).cast("string").alias("id"), "_matched_field"))
        found = profile.union_all(hits)
        return found if limit is None else found.orderBy("_object_type", "id").limit(limit)

    def query_links(self, link_name: str, filters: dict[str, Any] | None = None, how: str = "inner") -> DataFrame:
        link = self.ontology.links[link_name]
        return links.query_link(flt.apply_filters(self.df(link.source), filters), self.df(link.target), link, how)

    def apply_rule(self, rule_name: str, df: DataFrame | None = None) -> DataFrame:
        """Evaluate a rule over given rows, or over the first object it applies to."""
        rule = self.ontology.rules[rule_name]
        return rules.apply_rules(df if df is not None else self.df(rule.applies_to[0]), rule)

    def describe(self, name: str) -> DataFrame:
        rows = self.df(name)
        return profile.describe(rows, [c for c in self.object(name).schema.names if c in rows.columns])

    def inspect(self, name: str) -> list[dict]:
        return profile.inspect(self.object(name).schema)

    def distribution(self, name: str, columns: list[str]) -> DataFrame:
        return profile.distribution(self.df(name), columns)

    # --- governed writes --------------------------------------------------------------

    def _guard(self, name: str, action: str) -> ObjectType:
        spec = self.object(name)
        if spec.source.type in READ_ONLY_SOURCES:
            raise ValueError(f"{name} is a read-only {spec.source.type} object")
        guards.check_mutability(name, spec.mutability, action)
        return spec

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        self._writes[name] = self._writes.get(name, 0) + 1
        if self._writes[name] % WRITES_PER_CUT == 0:
            df = cut_lineage(df)
        self._versions[name] = df
        return df

    def _fitted(self, spec: ObjectType, rows: DataFrame) -> DataFrame:
        """Declared columns only, typed; a missing id becomes a hash of the record."""
        known = [f for f in spec.schema if f.name in rows.columns]
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known])
        key = spec.id_field
        if key and key not in out.columns and isinstance(spec.schema[key].dataType.simpleString(), str):
            out = out.withColumn(key, stable_id(F.to_json(F.struct(*out.columns))).cast(spec.schema[key].dataType))
        return out

    def _complete(self, spec: ObjectType, rows: DataFrame) -> DataFrame:
        return rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in spec.schema
        ])

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        spec = self._guard(name, "insert")
        fresh = self._complete(spec, self._fitted(spec, rows))
        return self._store(name, self._complete(spec, self.df(name)).unionByName(fresh))

    def upsert(self, name: str, rows: DataFrame) -> DataFrame:
        spec = self._guard(name, "update")
        fresh = self._complete(spec, self._fitted(spec, rows))
        return self._store(name, upsert(self._complete(spec, self.df(name)), fresh, [spec.id_field]))

    def update(self, name: str, filters: dict[str, Any], changes: dict[str, Any]) -> DataFrame:
        """Set columns on the matching rows; a status change must follow the declared transitions."""
        spec = self._guard(name, "update")
        rows = self.df(name)
        hit = F.coalesce(flt.filter_column(filters), F.lit(False)) if filters else F.lit(True)
        if "status" in changes and spec.status_transitions:
            bad = rows.filter(hit & ~guards.transition_allowed(F.col("status"), F.lit(changes["status"]), spec.status_transitions))
            if not bad.isEmpty():
                raise ValueError(f"{name}: illegal status change to {changes['status']!r}")
        new = {k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in changes.items() if k in rows.columns and k != spec.id_field}
        return self._store(name, rows.withColumns(new) if new else rows)

    def delete(self, name: str, filters: dict[str, Any]) -> DataFrame:
        self._guard(name, "delete")
        hit: Column = F.coalesce(flt.filter_column(filters), F.lit(False))
        return self._store(name, self.df(name).filter(~hit))

    def replace_all(self, name: str, rows: DataFrame) -> DataFrame:
        """Rebuild a derived object. Derived objects are replaced whole, so append-only does not forbid it."""
        spec = self.object(name)
        if spec.source.type in READ_ONLY_SOURCES:
            raise ValueError(f"{name} is a read-only {spec.source.type} object")
        return self._store(name, self._complete(spec, self._fitted(spec, rows)))
