"""Searches from the posting store: the same results as the scans of the corpus, and after an incremental sync."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoweave.catalog.base import View, ctes, query
from ontoweave.catalog.docs import (
    CHUNKS_SQL, DOCS, LISTED, PROFILE, RECALL_TOKENS, STORED, TOKENS, _bm25_sql, _recall_sql, _rerank_sql, chunks,
)
from ontoweave.functions import text as tx
from ontoweave.operators import retrieval
from ontoweave.operators.postings import PostingStore
from ontoweave.session import shared_folder

BUCKETS = 16
CHUNK_COLUMNS = "ordinal int, title string, path string, category string, heading string, content string, hay string"


def text_store(spark, rows):
    """A new store over (document_id, text), one row a document."""
    store = PostingStore(spark, shared_folder(spark, "text_store"), "text string", "text", BUCKETS)
    store.sync(rows.select(F.col("document_id").cast("string").alias("row_id"), "document_id", "text"))
    return store


def chunk_store(spark, sf):
    hay = F.concat_ws(" ", "title", "path", "category", "heading", "content")
    store = PostingStore(spark, shared_folder(spark, "chunk_store"), CHUNK_COLUMNS, "hay", BUCKETS)
    store.sync(chunks(spark, sf).withColumn("hay", hay).withColumnRenamed("chunk_id", "row_id"))
    return store


@query("store_search_bm25", ctes(d=DOCS) + f", {_bm25_sql('d', 'text', TOKENS, 'b')} SELECT document_id, round(bm25, 6) AS bm25 FROM b WHERE bm25 > 0")
def store_search_bm25(spark, sf):
    found = text_store(spark, DOCS.df(spark, sf)).bm25(TOKENS)
    return found.select(F.col("document_id").cast("bigint").alias("document_id"), F.round("bm25", 6).alias("bm25"))


def _recalled(spark, sf):
    found = chunk_store(spark, sf).recall("the thation", RECALL_TOKENS, RECALL_TOKENS)
    return found.withColumnRenamed("row_id", "chunk_id").withColumn("document_id", F.col("document_id").cast("bigint"))


@query("store_search_recall", ctes(d=DOCS, c=CHUNKS_SQL) + f", {_recall_sql()} SELECT chunk_id, round(score, 6) AS score, recall_sources FROM recalled")
def store_search_recall(spark, sf):
    return _recalled(spark, sf).select("chunk_id", F.round("score", 6).alias("score"), "recall_sources")


@query("store_search_rerank", ctes(d=DOCS, c=CHUNKS_SQL) + f", {_recall_sql()}, {_rerank_sql()}")
def store_search_rerank(spark, sf):
    hits = _recalled(spark, sf).withColumn("snippet", tx.snippet(F.col("content"), "the thation", RECALL_TOKENS))
    ranked = retrieval.rerank(hits, PROFILE, [-F.round("score", 6), F.col("ordinal")])
    rounded = [F.round(c, 6).alias(c) for c in ("related_score", "matched_importance", "anchor_importance")]
    return ranked.select("document_id", "matched_chunk_count", *rounded)


@query("store_sync_search", ctes(l=LISTED) + f""", {_bm25_sql('l', 'title', TOKENS, 'b')} SELECT document_id, round(bm25, 6) AS bm25 FROM b WHERE bm25 > 0""")
def store_sync_search(spark, sf):
    """A store of one listing is brought to another: documents are added, rewritten and taken away, then searched."""
    before, after = (v.df(spark, sf).withColumnRenamed("title", "text") for v in (STORED, LISTED))
    store = text_store(spark, before)
    store.sync(after.select(F.col("document_id").cast("string").alias("row_id"), "document_id", "text"))
    return store.bm25(TOKENS).select(F.col("document_id").cast("bigint").alias("document_id"), F.round("bm25", 6).alias("bm25"))


SAME_TEXT = View("documents", {"document_id": "doc_id", "title": "text"}, "source <> 'src3'")


@query("store_sync_actions", ctes(a=SAME_TEXT, b=LISTED) + """
SELECT CAST(coalesce(a.document_id, b.document_id) AS VARCHAR) AS document_id,
  CASE WHEN a.document_id IS NULL THEN 'add' WHEN b.document_id IS NULL THEN 'delete' WHEN a.title IS NOT DISTINCT FROM b.title THEN 'keep' ELSE 'update' END AS action
FROM a FULL JOIN b ON a.document_id = b.document_id""")
def store_sync_actions(spark, sf):
    before, after = (v.df(spark, sf).withColumnRenamed("title", "text") for v in (SAME_TEXT, LISTED))
    rows = after.select(F.col("document_id").cast("string").alias("row_id"), "document_id", "text")
    return text_store(spark, before).sync(rows).select("document_id", "action")
