"""Answer preparation: lexical and vector rankings joined by document, relations, asked years, and a reading budget.

Every stage is one table by document: ranked hits, similar documents, suggested neighbours.
They meet in one full join by document, so a document found in several ways is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.operators.sequences import running_total

# Fixed values of the fusion.
TITLE_BONUS = 8.0  # a term of the question stands in the title
SEMANTIC_WEIGHT = 8.0  # of a similarity
RELATION_WEIGHT = 4.0  # of a relation's confidence, for documents that no search found
LATER_HITS = 0.25  # of a further hit in the same document
SHORT_DOCUMENT = 200  # characters under which a document comes after others of its score


def fuse_documents(hits: DataFrame, order: list[Column], similar: DataFrame | None = None) -> DataFrame:
    """(document_id, lexical, similarity, search_hit_count, best_chunk_id): both rankings, one row a document.

    ``hits``: document_id, chunk_id, score; the first in ``order`` counts in full, further hits
    a quarter. ``similar``: document_id, similarity; a document counts with its best. A document
    of only one ranking has no value of the other.
    """
    staged = hits.withColumn("_order", F.struct(*order))
    lexical = staged.groupBy("document_id").agg(
        F.min_by("score", "_order").alias("_first"), F.sum("score").alias("_all"), F.count("*").alias("search_hit_count"),
        F.max_by("chunk_id", F.struct("score", "chunk_id")).alias("best_chunk_id"),
    ).withColumn("lexical", F.col("_first") + LATER_HITS * (F.col("_all") - F.col("_first"))).drop("_first", "_all")
    if similar is None:
        return lexical.withColumn("similarity", F.lit(None).cast("double"))
    best = similar.groupBy("document_id").agg(F.max("similarity").alias("similarity"))
    return lexical.join(best, "document_id", "full_outer")


def context_scores(fused: DataFrame, documents: DataFrame, terms: list[str]) -> DataFrame:
    """The fused documents with their columns and ``context_score``; hits of documents that are gone drop out."""
    in_title = reduce(lambda a, b: a | b, [F.coalesce(F.col("title"), F.lit("")).contains(t) for t in terms], F.lit(False))
    score = (
        F.coalesce("lexical", F.lit(0.0)) + F.when(in_title, TITLE_BONUS).otherwise(0.0) + SEMANTIC_WEIGHT * F.coalesce("similarity", F.lit(0.0))
    )
    return fused.join(documents, "document_id").withColumn("context_score", score).withColumn("search_hit_count", F.coalesce("search_hit_count", F.lit(0)))


def suggested_neighbours(scored: DataFrame, relations: DataFrame, seeds: int) -> DataFrame:
    """(document_id, relation_type, confidence, seed_id): the strongest relation of each document beside the best ``seeds``.

    ``relations``: source_document_id, target_document_id, relation_type, confidence. Both directions count;
    documents that are seeds or found themselves are none.
    """
    top = scored.orderBy(F.col("context_score").desc(), "document_id").limit(seeds).select(F.col("document_id").alias("seed_id"))
    ways = [("source_document_id", "target_document_id"), ("target_document_id", "source_document_id")]
    around = reduce(DataFrame.unionByName, [
        relations.select(F.col(a).alias("seed_id"), F.col(b).alias("document_id"), "relation_type", "confidence").join(top, "seed_id", "left_semi") for a, b in ways
    ])
    strongest = F.min_by(F.struct("relation_type", "confidence", "seed_id"), F.struct(-F.col("confidence"), "relation_type", "seed_id")).alias("_b")
    fresh = around.join(scored.select("document_id"), "document_id", "left_anti")
    return fresh.groupBy("document_id").agg(strongest).select("document_id", "_b.*")


def reading_order() -> list[Column]:
    """Order in which selected documents are read: asked years, hits before suggestions, best first."""
    return [
        F.col("matches_year").desc(), (F.col("search_hit_count") == 0), F.col("out_of_range"), F.round("context_score", 6).desc(),
        (F.coalesce("char_count", F.lit(0)) < SHORT_DOCUMENT), F.coalesce("title", F.lit("")), F.col("document_id"),
    ]


def select_documents(scored: DataFrame, documents: DataFrame, suggested: DataFrame | None, years: DataFrame, asked: list[str], limit: int) -> DataFrame:
    """The documents to read: hits and suggestions, those of the asked years, best first.

    ``years``: document_id, year. Without two documents (or ``limit``) of the asked years all stay and those of other
    years come last; a document without a year is of no asked year, and out of none.
    """
    columns = ["document_id", "title", "char_count", "context_score", "search_hit_count", "reason"]
    rows = scored.withColumn("reason", F.lit("search")).select(columns)
    if suggested is not None:
        more = suggested.join(documents, "document_id").withColumns({
            "context_score": F.greatest(F.lit(0.0), F.col("confidence") * RELATION_WEIGHT), "search_hit_count": F.lit(0).cast("bigint"),
            "reason": F.concat(F.lit("relation:"), "relation_type"),
        })
        rows = rows.unionByName(more.select(columns))
    dated = rows.join(years.select("document_id", "year"), "document_id", "left")
    asked_year = F.col("year").isin(asked) if asked else F.lit(False)
    dated = dated.withColumn("matches_year", F.coalesce(asked_year, F.lit(False)))
    dated = dated.withColumn("out_of_range", F.lit(bool(asked)) & F.col("year").isNotNull() & ~F.col("matches_year"))
    if asked:
        enough = dated.agg(F.count_if("matches_year") >= min(limit, 2)).scalar()
        dated = dated.filter(F.col("matches_year") | ~enough)
    return dated.orderBy(*reading_order()).limit(limit)


def read_selected(selected: DataFrame, chunks: DataFrame, max_chars: int) -> DataFrame:
    """The selected documents with the numbers of their leading chunks that fit ``max_chars``, and whether any is left out.

    ``chunks``: document_id, ordinal, chunk_id, content. A document without chunks has an empty list.
    """
    own = chunks.join(selected.select("document_id"), "document_id", "left_semi").select("document_id", "ordinal", "chunk_id", F.length("content").cast("bigint").alias("_n"))
    sized = running_total(own, ["document_id"], "ordinal", F.col("_n"), "running_chars", F.floor(F.col("ordinal") / 1024))
    fits = F.col("running_chars") <= max_chars
    read = sized.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.when(fits, F.struct("ordinal", "chunk_id")))).alias("_read"),  # at most max_chars of text
        F.coalesce(F.max(F.when(fits, F.col("running_chars"))), F.lit(0)).alias("included_chars"), (F.max("running_chars") > max_chars).alias("truncated"),
    )
    return selected.join(read, "document_id", "left").select(
        *selected.columns, F.coalesce(F.transform("_read", lambda r: r["chunk_id"]), F.array().cast("array<string>")).alias("included_chunk_ids"),
        F.coalesce("included_chars", F.lit(0)).alias("included_chars"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


def prepare_answer_context(
    hits: DataFrame, order: list[Column], documents: DataFrame, chunks: DataFrame, years: DataFrame, terms: list[str], asked: list[str],
    similar: DataFrame | None = None, relations: DataFrame | None = None, limit: int = 6, max_chars: int = 4000,
) -> DataFrame:
    """All stages: fuse the rankings, score, add related documents, keep the asked years, read within the budget."""
    scored = context_scores(fuse_documents(hits, order, similar), documents, terms)
    suggested = None if relations is None else suggested_neighbours(scored, relations, max(limit * 2, 8))
    return read_selected(select_documents(scored, documents, suggested, years, asked, limit), chunks, max_chars)
