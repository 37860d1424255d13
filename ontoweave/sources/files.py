"""Readers and writers for object data. All readers are lazy and schema-typed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontoweave.operators.filters import apply_filters

BOM = "﻿"


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def composite_key(*columns: str) -> Column:
    """Key text of several columns; a missing part reads ``None``."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns])


def read_json(
    spark: SparkSession, path: str, schema: T.StructType, rename: dict[str, str] | None = None,
    derived: dict[str, Column] | None = None, lines: bool = False,
) -> DataFrame:
    """Records of JSON files: an array of objects, or an object holding them under ``data`` or ``items``.

    ``rename`` maps source names to declared names. ``lines`` reads one record
    per line, which Spark can split; a plain JSON file is one task per file. A
    missing path is an empty table.
    """
    back = {v: k for k, v in (rename or {}).items()}
    raw = T.StructType([T.StructField(back.get(f.name, f.name), f.dataType) for f in schema])
    wrapped = T.StructType([*raw.fields, T.StructField("data", T.ArrayType(raw)), T.StructField("items", T.ArrayType(raw))]) \
        if not {"data", "items"} & set(raw.names) else raw
    try:
        rows = spark.read.schema(wrapped).option("multiLine", not lines).json(path)
    except AnalysisException as e:
        if _missing(e):
            return empty(spark, schema)
        raise
    if wrapped is not raw:
        rows = rows.select(F.inline(F.coalesce("data", "items", F.array(F.struct(*raw.names)).cast(T.ArrayType(raw)))))
    out = rows.select(*[F.col(f"`{back.get(n, n)}`").alias(n) for n in schema.names if n not in (derived or {})])
    return out.withColumns(derived) if derived else out


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, by column name: every declared property is present, text stays text.

    A byte order mark before the first name is dropped. Numbers are read
    leniently: empty text is null, whole numbers may be written as decimals.
    """
    try:
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    except AnalysisException as e:
        if _missing(e):
            return empty(spark, schema)
        raise
    named = raw.toDF(*[c.removeprefix(BOM) for c in raw.columns])
    return named.select(*[_coerced(named, f).alias(f.name) for f in schema])


def _coerced(df: DataFrame, spec: T.StructField) -> Column:
    if spec.name not in df.columns:
        return F.lit("" if isinstance(spec.dataType, T.StringType) else None).cast(spec.dataType)
    text = F.col(f"`{spec.name}`")
    if isinstance(spec.dataType, T.StringType):
        return F.coalesce(text, F.lit(""))
    number = F.nullif(F.trim(text), F.lit(""))
    if isinstance(spec.dataType, T.LongType):
        return number.cast("double").cast("bigint")
    return number.cast(spec.dataType)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """An existing database table or view; needs its JDBC driver on the class path.

    ``partition`` is (column, lower, upper, count) and lets executors read in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, low, high, count = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", count)
    return reader.load()


def read_markdown(spark: SparkSession, root: str, excluded_dirs: tuple[str, ...] = ("其他",), manifest: DataFrame | None = None) -> DataFrame:
    """Whole markdown files below a folder with path, modification time and front matter.

    ``manifest`` (path, ...) adds its columns to the files it lists.
    """
    files = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
        .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("modified_at"))
    )
    # The folder may be given as a path or a URI; the relative path starts after its last part.
    base = root.rstrip("/").split("://")[-1].replace("file:", "")
    relative = F.regexp_replace(F.url_decode("_file"), "^.*?" + _quoted(base) + "/", "")
    located = files.withColumn("path", relative)
    kept = located.filter(~F.split_part("path", F.lit("/"), F.lit(1)).isin(list(excluded_dirs))) if excluded_dirs else located
    has_front = F.col("value").rlike(r"(?s)^---\n.*?\n---\n")
    front = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.split(front, "\n"), lambda x: x.contains(":"))
    meta = F.map_from_entries(F.transform(pairs, lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"),
    )))
    out = kept.select(
        F.sha1(F.col("path").cast("binary")).substr(1, 16).alias("document_id"), "path", "modified_at",
        F.when(has_front, meta).alias("front_matter"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n", "").alias("text"),
    )
    return out if manifest is None else out.join(manifest, "path", "left")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c in "/_-") else c for c in text)


def spread(scan: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core.

    For row-local work that costs much more than reading (parsing, tokenising).
    A scan that is large enough to occupy the cluster is returned unchanged, so
    this adds a shuffle only where the data is too small for it to matter. Pass
    a plain scan: the split count is read from its plan. ``task_bytes`` bounds the bytes of the
    files that one partition stands for, where a whole split would keep a task too long.
    """
    parts = scan.sparkSession.sparkContext.defaultParallelism
    if task_bytes:
        size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        parts = max(parts, -(-size // task_bytes))
    return scan.repartition(parts) if scan.rdd.getNumPartitions() < parts else scan


def read_source(spark: SparkSession, schema: T.StructType, kind: str, location: str, **options) -> DataFrame:
    """Dispatch by declared source type."""
    if kind in ("json_file", "json"):
        return read_json(spark, location, schema, **options)
    if kind in ("csv_file", "csv"):
        return read_csv(spark, location, schema)
    if kind == "parquet":
        return spark.read.parquet(location)
    if kind == "table":
        return spark.table(location)
    if kind == "sqlite_table":
        return read_jdbc(spark, **{"url": f"jdbc:sqlite:{options['db_path']}", "table": location})
    if kind == "sql":
        return spark.sql(location)
    raise ValueError(f"unknown source type {kind!r}")


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Store an object's rows; partition columns become folders that later filters prune."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.option("header", True).option("emptyValue", "").csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.format(kind).save(path)


def select_declared(df: DataFrame, schema: T.StructType, filters: dict | None = None) -> DataFrame:
    """Projection to the declared properties the rows have, filtered in the scan."""
    return apply_filters(df, filters).select(*[n for n in schema.names if n in df.columns])
