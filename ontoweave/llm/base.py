"""Registry of the queries of this subpackage and the shared-folder tables they cut lineage with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ontoweave.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; one without ``sql`` is tested against brute force in tests/llm."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes: ten thousand long texts in one batch would fill a Python worker and the memory beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its plan restarts there, and so does a lost executor's work."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sql_crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB's SQL, which has no such function: eight steps of the polynomial a byte."""
    byte = f"('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::UBIGINT"
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
    start = "4294967295::UBIGINT"
    data = f"list_transform(range(0, octet_length(encode({text})), 1), lambda i: {byte})"
    return f"xor({start}, list_reduce(list_concat([{start}], {data}), lambda c, b: {bits}))"
