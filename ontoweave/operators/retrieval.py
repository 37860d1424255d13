"""Search over text rows: BM25, keyword scores, recall merging, reranking, vectors.

A query is one short text, so its terms are literals. Scores are computed where
the row is; only the few corpus statistics and the top rows cross the network.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.functions import text as tx
from ontoweave.functions.numeric import computed_once

K1, B = 1.2, 0.75
# Where a term is found and what the place is worth.
LOCATION_WEIGHTS = [("title", 2.0), ("heading", 1.2), ("snippet", 0.6), ("content", 0.35)]
MIN_IMPORTANCE, MIN_ANCHOR = 8.0, 3.0
PROFILE_TERMS = 20


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols, F.lit(0.0))


def _term_counts(df: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """Counts of the query terms as whole words, ignoring case, and the word count of each text.

    Words are brought to single blanks once; counting is then plain text
    replacement, which stays in generated code. Blanks are doubled so that
    neighbouring words do not share one.
    """
    staged = df.withColumn("_words", F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), tx.NON_WORD, " ")))
    blanks = F.length("_words") - F.length(F.replace("_words", F.lit(" "), F.lit("")))
    padded = staged.withColumns({
        "_dl": F.when(F.col("_words") == "", 0).otherwise(blanks + 1),
        "_padded": F.concat(F.lit(" "), F.replace("_words", F.lit(" "), F.lit("  ")), F.lit(" ")),
    })

    def count_of(term: str) -> Column:
        gone = F.replace("_padded", F.lit(f" {term.lower()} "), F.lit(""))
        return ((F.length("_padded") - F.length(gone)) / (len(term) + 2)).cast("int")

    counted = computed_once(padded.drop("_words"), **{f"_tf_{i}": count_of(t) for i, t in enumerate(terms)})
    return counted.drop("_padded")


def bm25(df: DataFrame, text: str, terms: list[str], name: str = "bm25") -> DataFrame:
    """Okapi BM25 of the query terms over whole texts; rows without a hit score 0.

    Document count, average length and document frequencies are one aggregate
    row, read back as a scalar subquery: no inverted index has to be shuffled.
    """
    counted = _term_counts(df, F.col(text), terms)
    stats = counted.agg(F.struct(
        F.count("*").alias("n"), F.avg("_dl").alias("avgdl"),
        *[F.count(F.when(F.col(f"_tf_{i}") > 0, 1)).alias(f"df_{i}") for i in range(len(terms))],
    )).scalar()
    scored = counted.withColumn("_s", stats)
    parts = []
    for i in range(len(terms)):
        df_i, tf = F.col(f"_s.df_{i}"), F.col(f"_tf_{i}")
        raw = F.log((F.col("_s.n") - df_i + 0.5) / (df_i + 0.5))
        weight = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        parts.append(weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_s.avgdl"))))
    return scored.withColumn(name, _sum(parts)).drop("_s", "_dl", *[f"_tf_{i}" for i in range(len(terms))])


def keyword_score(hay: Column, terms: list[str]) -> Column:
    """Occurrences of each term, at most 8, longer terms 2.5 times as much."""
    parts = [
        F.least(tx.occurrences(hay, t), F.lit(8)) * F.lit(2.5 if len(t) >= 4 else 1.0) for t in terms
    ]
    return _sum(parts)


def evidence_search(
    chunks: DataFrame, terms: list[str], limit: int, prefer_primary: bool = False,
    primary_role: str = "emergency_procedure", primary_boost: float = 100.0, high_value_boost: float = 8.0, toc_penalty: float = 80.0,
) -> DataFrame:
    """Keyword search with role boosts and a penalty for tables of contents.

    ``chunks``: chunk_id, title, heading, content, doc_role, evidence_role. All
    matching chunks are scored; only the ``limit`` best leave the executors.
    """
    hay = F.concat_ws("\n", "title", "heading", "content")
    any_hit = reduce(lambda a, b: a | b, [F.lower(hay).contains(t.lower()) for t in terms], F.lit(False)) if terms else F.lit(True)
    score = keyword_score(hay, terms)
    if prefer_primary:
        score = score + F.when(F.col("doc_role") == primary_role, primary_boost).otherwise(0.0)
    score = score + F.when(F.col("evidence_role").isin("handling_rule", "severe_signal", "abnormal_signal"), high_value_boost).otherwise(0.0)
    staged = computed_once(chunks.filter(any_hit), is_toc=is_toc(F.col("heading"), F.col("content")), _score=score)
    scored = staged.withColumn("score", F.col("_score") - F.when(F.col("is_toc"), toc_penalty).otherwise(0.0)).drop("_score")
    return scored.filter("score > 0").orderBy(F.col("score").desc(), F.col("chunk_id")).limit(limit)


# Headings of a table of contents, and the words that mark one inside a longer heading.
TOC_HEADINGS = ["目录", "目 录", "contents", "content"]
TOC_WORDS = "目 录"


def is_toc(heading: Column, content: Column) -> Column:
    """A table of contents, told by its heading.

    The text is one line once its blanks are collapsed, so counting numbered lines never
    decides; ``content`` is there for callers that pass whole chunks.
    """
    named = F.lower(tx.compact(heading))
    return named.isin(TOC_HEADINGS) | named.contains(TOC_WORDS)


def evidence_role(text: Column) -> Column:
    # Role by the first word list that occurs.
    table = [
        ("handling_rule", ["处理预案", "处理原则", "事故处理", "异常处理", "故障应急"]),
        ("severe_signal", ["保护动作", "闭锁", "跳闸", "低电压", "故障穿越"]),
        ("abnormal_signal", ["异常", "告警", "轻微故障", "自监视"]),
        ("normal_operation", ["解锁", "功率控制", "滤波器", "分接", "运行方式", "操作"]),
        ("event_record", ["录波", "SER", "事件记录"]),
    ]
    chain = None
    for role, words in table:
        chain = (F.when if chain is None else chain.when)(tx.any_of(text, words), role)
    return chain.when(text.rlike(r"!\[[^\]]*\]\([^)]+\)"), "figure_context").otherwise("definition")


def recall(chunks: DataFrame, query: str, tokens: list[str], anchors: list[str]) -> DataFrame:
    """Lexical recall: ranked full text, titles and anchored phrases, merged per chunk.

    Every source that finds a chunk adds its base score (12 plus up to 8 by
    BM25, 8 per title term, 16 for all anchors) and, each time, 3 per matched
    token and 20 for the exact phrase. With two or more tokens a chunk needs the
    phrase or two of them. ``chunks``: chunk_id, title, path, category, heading, content.
    """
    hay = F.concat_ws(" ", "title", "path", "category", "heading", "content")
    return recall_ranked(bm25(chunks.withColumn("_hay", hay), "_hay", tokens, "_bm25"), query, tokens, anchors)


def _matched(hay: Column, tokens: list[str]) -> Column:
    return _sum([F.when(hay.contains(t), 1.0).otherwise(0.0) for t in tokens])


def _enough(matched: Column, exact: Column, tokens: list[str]) -> Column:
    return F.lit(True) if len(tokens) < 2 else exact | (matched >= 2)


def accepted(hay: Column, query: str, tokens: list[str]) -> Column:
    """Whether ``recall`` can return a row with this text: it holds the phrase or two of the tokens, when there are two."""
    return _enough(_matched(hay, tokens), hay.contains(query), tokens)


def recall_ranked(ranked: DataFrame, query: str, tokens: list[str], anchors: list[str]) -> DataFrame:
    """``recall`` of rows that have their whole text (_hay) and its BM25 (_bm25) already."""
    flags = computed_once(ranked, _matched=_matched(F.col("_hay"), tokens), _exact=F.col("_hay").contains(query))
    bonus = F.col("_matched") * 3 + F.when(F.col("_exact"), 20.0).otherwise(0.0)
    full = F.when(F.col("_bm25") > 0, 12.0 + F.greatest(F.lit(0.0), 8.0 - F.col("_bm25")) + bonus).otherwise(0.0)
    in_title = [F.when(F.col("title").contains(t) | F.col("path").contains(t), 8.0 + bonus).otherwise(0.0) for t in dict.fromkeys([query, *tokens])]
    parts = [full, *in_title]
    sources = [F.when(F.col("_bm25") > 0, "full_text"), F.when(_sum(in_title) > 0, "title")]
    if len(anchors) >= 2:
        held = reduce(lambda a, b: a & b, [
            F.col("content").contains(a) | F.col("heading").contains(a) | F.col("title").contains(a) | F.col("path").contains(a)
            for a in anchors
        ])
        parts.append(F.when(held, 16.0 + bonus).otherwise(0.0))
        sources.append(F.when(held, "anchored"))
    return (
        flags.filter(_enough(F.col("_matched"), F.col("_exact"), tokens))
        .withColumns({"score": _sum(parts), "recall_sources": F.concat_ws(",", *sources)})
        .filter("score > 0").drop("_hay", "_bm25", "_matched", "_exact")
    )


SEMANTIC_SCORE = 18.0  # fixed value: what a full similarity adds to a chunk


def merge_semantic(recalled: DataFrame, chunks: DataFrame, similar: DataFrame) -> DataFrame:
    """The lexical recall joined with similar chunks (chunk_id, similarity): a chunk of both has both scores and sources.

    A chunk found only by similarity takes its columns from ``chunks``. A chunk counts with its best similarity,
    negative or missing ones add nothing.
    """
    worth = F.round(F.greatest(F.col("similarity"), F.lit(0.0)) * SEMANTIC_SCORE, 3)
    best = similar.dropna().groupBy("chunk_id").agg(F.max("similarity").alias("similarity")).withColumn("_semantic", worth)
    columns = [c for c in chunks.columns if c in recalled.columns]
    both = recalled.select("chunk_id", "score", "recall_sources").join(best, "chunk_id", "full_outer")
    merged = both.select(
        "chunk_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("_semantic", F.lit(0.0))).alias("score"), "similarity",
        F.concat_ws(",", "recall_sources", F.when(F.col("similarity").isNotNull(), "semantic")).alias("recall_sources"),
    )
    return chunks.select(columns).join(merged, "chunk_id")


def source_histogram(hits: DataFrame) -> DataFrame:
    named = F.explode(F.split(F.coalesce(F.nullif("recall_sources", F.lit("")), F.lit("unknown")), ","))
    return hits.select(named.alias("source")).groupBy("source").agg(F.count("*").alias("hits"))


def rerank(hits: DataFrame, profile: list[tuple[str, str, float]], recall_order: list[Column]) -> DataFrame:
    """Documents ranked by profile terms: (term, kind, score).

    Per hit every term counts once, where it is found first (title, heading,
    snippet, content). Per document the first recalled hit counts fully, further
    hits a quarter of their score and half of their importance.
    """
    terms = profile

    def place(term: str) -> Column:
        chain = None
        for column, weight in LOCATION_WEIGHTS:
            chain = (F.when if chain is None else chain.when)(F.coalesce(F.col(column), F.lit("")).contains(term), weight)
        return chain.otherwise(0.0)

    staged = computed_once(hits, **{f"_w_{i}": place(t) for i, (t, _, _) in enumerate(terms)})
    weight = [max(score, 1.0) ** 0.5 * tx.KIND_MATCH.get(kind, 1.0) for _, kind, score in terms]
    found = [F.col(f"_w_{i}") > 0 for i in range(len(terms))]
    importance = _sum([F.when(f, w).otherwise(0.0) for f, w in zip(found, weight)])
    anchor = _sum([
        F.when(f, w).otherwise(0.0) for f, w, t in zip(found, weight, terms) if t[1] in tx.ANCHOR_KINDS
    ])
    phrase = _sum([F.col(f"_w_{i}") * w for i, w in enumerate(weight)])
    per_hit = staged.withColumns({
        "_related": tx.rerank_base(F.col("score")) + phrase, "_importance": importance, "_anchor": anchor,
        "_order": F.struct(*recall_order),
    }).filter("_importance > 0")
    docs = per_hit.groupBy("document_id").agg(
        F.min_by(F.struct("_related", "_importance", "_anchor"), "_order").alias("_first"),
        F.sum("_related").alias("_r"), F.sum("_importance").alias("_i"), F.sum("_anchor").alias("_a"),
        F.count("*").alias("matched_chunk_count"),
        F.max_by("chunk_id", F.struct("_related", "chunk_id")).alias("best_chunk_id"),
    )
    decayed = lambda first, total, rate: F.col(f"_first.{first}") + rate * (F.col(total) - F.col(f"_first.{first}"))
    return docs.select(
        "document_id", "best_chunk_id", "matched_chunk_count", decayed("_related", "_r", 0.25).alias("related_score"),
        decayed("_importance", "_i", 0.5).alias("matched_importance"), decayed("_anchor", "_a", 0.5).alias("anchor_importance"),
    ).filter((F.col("matched_importance") >= MIN_IMPORTANCE) & (F.col("anchor_importance") >= MIN_ANCHOR))


# --- vectors --------------------------------------------------------------------------


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalize(vector: Column) -> Column:
    length = norm(vector)
    return F.when(length == 0, vector.cast("array<double>")).otherwise(F.transform(vector, lambda x: x.cast("double") / length))


def vector_search(
    vectors: DataFrame, vector: str, query: Column, limit: int, min_similarity: float, tiebreak: str
) -> DataFrame:
    """Exact similarity scan: best ``limit`` rows at or above the threshold.

    ``query`` is a vector literal or a scalar subquery; each task keeps its own
    best rows before anything is exchanged.
    """
    scored = computed_once(vectors.withColumn("_query", query), similarity=dot(F.col(vector), F.col("_query"))).drop("_query")
    scored = scored.filter(F.col("similarity") >= min_similarity)
    return scored.orderBy(F.col("similarity").desc(), F.col(tiebreak)).limit(limit)


def mean_vectors(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Average vector per key as one aggregate per position: no exploding, full map-side combine."""
    sums = vectors.groupBy(key).agg(*[F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)])
    return sums.select(key, F.array(*[f"_{i}" for i in range(dim)]).alias("mean_vector"))
