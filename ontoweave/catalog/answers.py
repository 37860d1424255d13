"""The preparation of an answer: both rankings, related documents, asked years, reading budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoweave.catalog.base import View, ctes, query
from ontoweave.catalog.docs import CHUNKS_SQL, DIM, DOCS, MEANS, PROFILE, RECALL_TOKENS, _recall_sql, _recalled, _rerank_sql, chunks, vectors
from ontoweave.catalog.graphs import CITES
from ontoweave.functions import text as tx
from ontoweave.operators import retrieval
from ontoweave.plans import answers, documents

QUESTION = "2012至2014 the thation"
LIMIT, MAX_CHARS, CONFIDENCE = 6, 1500, 0.6
DATES = View("documents", {"document_id": "doc_id", "year": "cast(2010 + doc_id % 15 as string)"})
_TITLED = " OR ".join(f"contains(title, '{t}')" for t in RECALL_TOKENS)
_ASKED = ", ".join(f"'{y}'" for y in documents.asked_years(QUESTION))
_SEEDS = max(LIMIT * 2, 8)


@query("doc_answer_context", ctes(d=DOCS, c=CHUNKS_SQL, e=CITES, yr=DATES) + f""", {_recall_sql()}, {_rerank_sql().rsplit('SELECT document_id, n AS', 1)[0].rstrip()},
{MEANS}, q AS (SELECT list(v ORDER BY i) AS q FROM mean WHERE label = (SELECT min(label) FROM embeddings)),
sim AS (SELECT vec_id AS document_id, list_dot_product(embedding::DOUBLE[], q) AS similarity FROM embeddings, q
  WHERE list_dot_product(embedding::DOUBLE[], q) >= 0.05 ORDER BY 2 DESC, 1 LIMIT 25),
lex AS (SELECT document_id, r1 + 0.25 * (r - r1) AS lexical FROM dd WHERE i1 + 0.5 * (i - i1) >= 8 AND a1 + 0.5 * (a - a1) >= 3),
fused AS (SELECT coalesce(lex.document_id, sim.document_id) AS document_id, lexical, similarity, CAST(lex.document_id IS NOT NULL AS BIGINT) AS hit
  FROM lex FULL JOIN sim ON lex.document_id = sim.document_id),
sc AS (SELECT f.document_id, title, char_count, hit, coalesce(lexical, 0) + CASE WHEN {_TITLED} THEN 8 ELSE 0 END + 8 * coalesce(similarity, 0) AS cs
  FROM fused f JOIN d ON d.document_id = f.document_id),
seeds AS (SELECT document_id FROM sc ORDER BY cs DESC, document_id LIMIT {_SEEDS}),
sug AS (SELECT DISTINCT n FROM (SELECT dst AS n FROM e JOIN seeds ON src = document_id UNION ALL SELECT src FROM e JOIN seeds ON dst = document_id) WHERE n NOT IN (SELECT document_id FROM sc)),
cand AS (SELECT document_id, title, char_count, cs, hit, 'search' AS reason FROM sc
  UNION ALL SELECT document_id, title, char_count, {CONFIDENCE}::DOUBLE * 4, 0, 'relation:cites' FROM sug JOIN d ON document_id = n),
dt AS (SELECT cand.*, coalesce(year IN ({_ASKED}), false) AS matches_year, year IS NOT NULL AND year NOT IN ({_ASKED}) AS out FROM cand LEFT JOIN yr USING (document_id)),
sel AS (SELECT * FROM dt WHERE matches_year OR (SELECT count(*) FILTER (matches_year) < {min(LIMIT, 2)} FROM dt)
  ORDER BY matches_year DESC, hit = 0, out, round(cs, 6) DESC, char_count < 200, title, document_id LIMIT {LIMIT}),
rd AS (SELECT document_id, SUM(length(content)) OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS s FROM c WHERE document_id IN (SELECT document_id FROM sel)),
rs AS (SELECT document_id, count(*) FILTER (s <= {MAX_CHARS}) AS included, coalesce(max(s) FILTER (s <= {MAX_CHARS}), 0) AS included_chars, max(s) > {MAX_CHARS} AS truncated FROM rd GROUP BY 1)
SELECT document_id, round(cs, 6) AS context_score, hit AS search_hit_count, reason, matches_year, coalesce(included, 0) AS included,
  CAST(coalesce(included_chars, 0) AS BIGINT) AS included_chars, coalesce(truncated, false) AS truncated
FROM sel LEFT JOIN rs USING (document_id)""".replace(",,", ","))
def doc_answer_context(spark, sf):
    d = DOCS.df(spark, sf)
    found = _recalled(spark, sf).withColumn("snippet", tx.snippet(F.col("content"), "the thation", RECALL_TOKENS))
    ranked = retrieval.rerank(found, PROFILE, [-F.round("score", 6), F.col("ordinal")])
    hits = ranked.select("document_id", F.col("best_chunk_id").alias("chunk_id"), F.col("related_score").alias("score"))
    rows = vectors(spark, sf)
    mean = retrieval.mean_vectors(rows.filter(F.col("label") == rows.agg(F.min("label")).scalar()), "label", "vector", DIM).select("mean_vector").scalar()
    similar = retrieval.vector_search(rows, "vector", mean, 25, 0.05, "document_id").select("document_id", "similarity")
    cites = CITES.df(spark, sf).select(
        F.col("src").alias("source_document_id"), F.col("dst").alias("target_document_id"), F.lit("cites").alias("relation_type"), F.lit(CONFIDENCE).alias("confidence"))
    out = answers.prepare_answer_context(
        hits, [F.col("document_id")], d.select("document_id", "title", "char_count"), chunks(spark, sf), DATES.df(spark, sf), RECALL_TOKENS,
        documents.asked_years(QUESTION), similar, cites, LIMIT, MAX_CHARS,
    )
    return out.select(
        "document_id", F.round("context_score", 6).alias("context_score"), "search_hit_count", "reason", "matches_year",
        F.size("included_chunk_ids").cast("bigint").alias("included"), "included_chars", "truncated",
    )
