"""Incremental sync as streams: new document versions and alarm texts are processed as they arrive.

Both transformations are stateless, so a stream only appends. A document store
keeps every version; readers take the latest one per document. The stream
checkpoint makes each input file count once, also after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ontoweave.operators.grouping import last_wins
from ontoweave.plans import alarms, documents


def sync_documents(stream: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append changed documents with their content signature. ``stream``: document_id, title, text, version."""
    signed = stream.select(
        "document_id", "title", "text", "version",
        documents.kb_signature(["title", "text"]).alias("signature"), F.length("text").cast("bigint").alias("char_count"),
    )
    return signed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start(target)


def latest_documents(store: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Latest version per document; ``deleted`` (document_id, version) hides versions up to its own."""
    rows = last_wins(store, ["document_id"], ["version", "signature"])
    if deleted is None:
        return rows
    gone = deleted.groupBy("document_id").agg(F.max("version").alias("_gone"))
    return rows.join(gone, "document_id", "left").filter(F.col("_gone").isNull() | (F.col("_gone") < F.col("version"))).drop("_gone")


def parse_alarms(stream: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append parsed and flagged alarm events. ``stream``: chain_id, event_text, station_name."""
    flagged = alarms.with_flags(alarms.parse_events(stream))
    return flagged.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start(target)
