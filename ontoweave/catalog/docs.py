"""Document queries: term profiles, search, reranking, vectors, metadata, reading, sync."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoweave.catalog.base import View, ctes, query, sql_words, table
from ontoweave.functions import text as tx
from ontoweave.operators import reconcile, retrieval
from ontoweave.plans import documents, evidence, sections

DOCS = View("documents", {
    "document_id": "doc_id", "title": "split_part(split_part(text, chr(10), 1), '.', 1)", "category": "lang", "agency": "source",
    "text": "text", "char_count": "n_chars", "path": "concat(lang, '/', source, '/', cast(doc_id as string), '.md')",
}, heavy=True)
# Lines of every document as its chunks.
CHUNKS_SQL = """SELECT document_id, CAST(i AS INTEGER) AS ordinal, document_id || '#' || i AS chunk_id, title, path, category, '' AS heading, list_extract(ls, i) AS content
FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM d))"""


def chunks(spark, sf):
    d = DOCS.df(spark, sf)
    lines = d.select("document_id", "title", "path", "category", F.posexplode(F.split("text", "\n")).alias("_pos", "content"))
    return lines.select(
        "document_id", (F.col("_pos") + 1).alias("ordinal"), F.concat_ws("#", "document_id", F.col("_pos") + 1).alias("chunk_id"),
        "title", "path", "category", F.lit("").alias("heading"), "content",
    )


# --- term profiles -----------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
USEFUL = f"length(t) >= 2 AND t NOT IN ({STOP}) AND regexp_matches(t, '[一-鿿A-Za-z]')"
BONUS = "least(2.5::DOUBLE, 1::DOUBLE + length(t) / 12::DOUBLE)"
QUALITY = f"CASE WHEN regexp_matches(t, '{tx.YEAR_TERM}') THEN 0.2 WHEN length(t) <= 2 THEN 0.45 WHEN length(t) <= 4 AND regexp_matches(t, '{tx.FORM_TERM}') THEN 0.35 ELSE 1 END::DOUBLE"
KIND = (
    f"CASE WHEN regexp_full_match(t, '[0-9A-Za-z.+-]+') THEN 'numeric_or_code' WHEN regexp_matches(t, '{tx.YEAR_TERM}') THEN 'form' WHEN length(t) <= 2 THEN 'short' "
    f"WHEN length(t) <= 6 AND regexp_matches(t, '{tx.FORM_TERM}') THEN 'form' WHEN length(t) >= 10 THEN 'quoted_theme' ELSE 'topic' END"
)


def _field_terms(column: str, weight: str) -> str:
    clean = f"regexp_replace({column}, '\\s+', '', 'g')"
    return f"""SELECT document_id, t, {weight}::DOUBLE AS w FROM (SELECT document_id, {clean} AS t FROM d) WHERE {USEFUL} AND length(t) <= 24
UNION ALL SELECT document_id, t, {weight}::DOUBLE FROM (SELECT DISTINCT document_id, unnest({sql_words(column)}) AS t FROM d) WHERE {USEFUL}"""


QUOTED_SQL = f"""SELECT document_id, t, 12::DOUBLE AS w FROM (SELECT document_id, regexp_replace(unnest(regexp_extract_all(title, '[《“"]([^》”"]{{2,80}})[》”"]', 1)), '\\s+', '', 'g') AS t FROM d) WHERE {USEFUL} AND length(t) <= 60"""
TERMS = f"""body AS (SELECT document_id, t FROM (SELECT DISTINCT document_id, unnest({sql_words('text')}) AS t FROM d) WHERE {USEFUL}
),
raw AS (SELECT document_id, t, 0.5::DOUBLE AS w FROM body UNION ALL {_field_terms('title', '8')} UNION ALL {QUOTED_SQL} UNION ALL {_field_terms('agency', '3')} UNION ALL {_field_terms('category', '2')}),
tw AS (SELECT document_id, t, CAST(SUM(CAST(w * {BONUS} * ({QUALITY}) AS DECIMAL(20,8))) AS DOUBLE) AS term_weight FROM raw GROUP BY ALL),
terms AS (SELECT document_id, t, term_weight, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY round(term_weight * {BONUS}, 8) DESC, length(t) DESC, t) AS k FROM tw) WHERE k <= 30),
stats AS (SELECT t, count(*) AS doc_freq, ln(((SELECT count(*) FROM d) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM terms GROUP BY 1)"""


@query("doc_terms", ctes(d=DOCS) + f", {TERMS} SELECT document_id, t AS term, term_weight, rank FROM terms")
def doc_terms(spark, sf):
    return documents.document_terms(DOCS.df(spark, sf))


@query("doc_term_statistics", ctes(d=DOCS) + f", {TERMS} SELECT t AS term, doc_freq, round(idf, 9) AS idf FROM stats")
def doc_term_statistics(spark, sf):
    d = DOCS.df(spark, sf)
    stats = documents.term_statistics(documents.document_terms(d), d)
    return stats.withColumn("idf", F.round("idf", 9))


@query("doc_term_kinds", ctes(d=DOCS) + f", {TERMS} SELECT t AS term, {KIND} AS kind, {BONUS} AS bonus, {QUALITY} AS quality FROM stats")
def doc_term_kinds(spark, sf):
    d = DOCS.df(spark, sf)
    term = F.col("term")
    return documents.document_terms(d).select("term").distinct().select(
        "term", tx.classify_term(term).alias("kind"), tx.length_bonus(term).alias("bonus"), tx.term_quality(term).alias("quality")
    )


# --- search ------------------------------------------------------------------------------

QUERY = "theres thation erhe"
TOKENS = ["theres", "thation", "erhe"]


def _bm25_sql(source: str, text: str, terms: list[str], name: str) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t.lower()}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    parts = " + ".join(
        f"CASE WHEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) END * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
        for i in range(len(terms))
    )
    return f"""{name}_w AS (SELECT *, {sql_words(f'lower({text})')} AS w FROM {source}),
{name}_c AS (SELECT * EXCLUDE (w), len(w) AS dl, {tf} FROM {name}_w),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM {name}_c),
{name} AS (SELECT {name}_c.*, {parts} AS bm25 FROM {name}_c, {name}_s)"""


@query("search_bm25", ctes(d=DOCS) + f", {_bm25_sql('d', 'text', TOKENS, 'b')} SELECT document_id, round(bm25, 6) AS bm25 FROM b WHERE bm25 > 0")
def search_bm25(spark, sf):
    scored = retrieval.bm25(DOCS.df(spark, sf).select("document_id", "text"), "text", TOKENS)
    return scored.filter("bm25 > 0").select("document_id", F.round("bm25", 6).alias("bm25"))


HAY = "concat_ws(' ', title, path, category, heading, content)"
RECALL_TOKENS = ["the", "thation"]


def _recall_sql() -> str:
    m = " + ".join(f"CASE WHEN contains(hay, '{t}') THEN 1 ELSE 0 END" for t in RECALL_TOKENS)
    title = " + ".join(
        f"CASE WHEN contains(title, '{t}') OR contains(path, '{t}') THEN 8 + bonus ELSE 0 END" for t in ["the thation", *RECALL_TOKENS]
    )
    held = " AND ".join(f"(contains(content, '{t}') OR contains(heading, '{t}') OR contains(title, '{t}') OR contains(path, '{t}'))" for t in RECALL_TOKENS)
    return f"""h AS (SELECT *, {HAY} AS hay FROM c), {_bm25_sql('h', 'hay', RECALL_TOKENS, 'b')},
m AS (SELECT *, {m} AS matched, contains(hay, 'the thation') AS exact FROM b),
x AS (SELECT *, matched * 3::DOUBLE + CASE WHEN exact THEN 20 ELSE 0 END AS bonus FROM m WHERE exact OR matched >= 2),
y AS (SELECT *, CASE WHEN bm25 > 0 THEN 12 + greatest(0, 8 - bm25) + bonus ELSE 0 END AS f, {title} AS ti, CASE WHEN {held} THEN 16 + bonus ELSE 0 END AS an FROM x),
recalled AS (SELECT document_id, ordinal, chunk_id, title, path, heading, content, f + ti + an AS score, concat_ws(',', CASE WHEN f > 0 THEN 'full_text' END, CASE WHEN ti > 0 THEN 'title' END, CASE WHEN an > 0 THEN 'anchored' END) AS recall_sources FROM y WHERE f + ti + an > 0)"""


def _recalled(spark, sf):
    return retrieval.recall(chunks(spark, sf), "the thation", RECALL_TOKENS, RECALL_TOKENS)


@query("search_recall", ctes(d=DOCS, c=CHUNKS_SQL) + f", {_recall_sql()} SELECT chunk_id, round(score, 6) AS score, recall_sources FROM recalled")
def search_recall(spark, sf):
    return _recalled(spark, sf).select("chunk_id", F.round("score", 6).alias("score"), "recall_sources")


@query("search_source_histogram", ctes(d=DOCS, c=CHUNKS_SQL) + f", {_recall_sql()}, s AS (SELECT unnest(string_split(recall_sources, ',')) AS source FROM recalled) SELECT source, count(*) AS hits FROM s GROUP BY 1")
def search_source_histogram(spark, sf):
    return retrieval.source_histogram(_recalled(spark, sf))


PROFILE = [("thation", "topic", 60.0), ("the", "topic", 30.0), ("erhe", "short", 20.0), ("and", "topic", 12.0), ("theres", "quoted_theme", 40.0), ("2024年", "form", 9.0)]


def _snippet_sql(rows: str, text: str, needles: list[str]) -> str:
    """``hw``: the rows with the text around the first hit of any needle."""
    first = ", ".join(f"nullif(strpos(clean, '{n}'), 0)" for n in needles)
    return f"""sn0 AS (SELECT *, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS clean FROM {rows}),
sn1 AS (SELECT *, greatest(coalesce(least({first}), 1) - 1 - 60, 0) AS st FROM sn0),
hw AS (SELECT * EXCLUDE (clean, st), CASE WHEN st > 0 THEN '...' ELSE '' END || substr(clean, st + 1, 260) || CASE WHEN st + 260 < length(clean) THEN '...' ELSE '' END AS snippet FROM sn1)"""


def _rerank_sql() -> str:
    place, weights = [], []
    for i, (term, kind, score) in enumerate(PROFILE):
        place.append(f"CASE WHEN contains(title, '{term}') THEN 2 WHEN contains(heading, '{term}') THEN 1.2 WHEN contains(snippet, '{term}') THEN 0.6 WHEN contains(content, '{term}') THEN 0.35 ELSE 0 END::DOUBLE AS w{i}")
        weights.append(max(score, 1.0) ** 0.5 * tx.KIND_MATCH[kind])
    phrase = " + ".join(f"w{i} * {w!r}::DOUBLE" for i, w in enumerate(weights))
    imp = " + ".join(f"CASE WHEN w{i} > 0 THEN {w!r}::DOUBLE ELSE 0 END" for i, w in enumerate(weights))
    anchor = " + ".join(f"CASE WHEN w{i} > 0 THEN {w!r}::DOUBLE ELSE 0 END" for i, w in enumerate(weights) if PROFILE[i][1] in tx.ANCHOR_KINDS)
    return f"""{_snippet_sql('recalled', 'content', ["the thation", *RECALL_TOKENS])},
hp AS (SELECT *, {', '.join(place)} FROM hw),
hs AS (SELECT *, least(8::DOUBLE, ln(1 + score) * 1.5::DOUBLE) + {phrase} AS rel, {imp} AS imp, {anchor} AS anc, row_number() OVER (PARTITION BY document_id ORDER BY round(score, 6) DESC, ordinal) AS k FROM hp),
dd AS (SELECT document_id, sum(rel) AS r, sum(imp) AS i, sum(anc) AS a, max(CASE WHEN k = 1 THEN rel END) AS r1, max(CASE WHEN k = 1 THEN imp END) AS i1, max(CASE WHEN k = 1 THEN anc END) AS a1, count(*) AS n FROM hs WHERE imp > 0 GROUP BY 1)
SELECT document_id, n AS matched_chunk_count, round(r1 + 0.25 * (r - r1), 6) AS related_score, round(i1 + 0.5 * (i - i1), 6) AS matched_importance, round(a1 + 0.5 * (a - a1), 6) AS anchor_importance
FROM dd WHERE i1 + 0.5 * (i - i1) >= 8 AND a1 + 0.5 * (a - a1) >= 3"""


@query("search_rerank", ctes(d=DOCS, c=CHUNKS_SQL) + f", {_recall_sql()}, {_rerank_sql()}")
def search_rerank(spark, sf):
    hits = _recalled(spark, sf).withColumn("snippet", tx.snippet(F.col("content"), "the thation", RECALL_TOKENS))
    ranked = retrieval.rerank(hits, PROFILE, [-F.round("score", 6), F.col("ordinal")])
    rounded = [F.round(c, 6).alias(c) for c in ("related_score", "matched_importance", "anchor_importance")]
    return ranked.select("document_id", "matched_chunk_count", *rounded)


EVIDENCE_TERMS = ["thation", "erh", "the", "ANDTHE"]
OCC = "(length(low) - length(replace(low, '{t}', ''))) // {n}"


def _evidence_sql() -> str:
    score = " + ".join(
        f"least({OCC.format(t=t.lower(), n=len(t))}, 8) * {2.5 if len(t) >= 4 else 1.0}::DOUBLE" for t in EVIDENCE_TERMS
    )
    return f"""e AS (SELECT *, lower(title || chr(10) || '' || chr(10) || text) AS low, CASE WHEN contains(text, '异常') THEN 'abnormal_signal' WHEN category = 'fr' THEN 'handling_rule' ELSE 'definition' END AS role FROM d),
s AS (SELECT *, {score} + CASE WHEN role IN ('handling_rule', 'severe_signal', 'abnormal_signal') THEN 8 ELSE 0 END AS score FROM e WHERE {' OR '.join(f"contains(low, '{t.lower()}')" for t in EVIDENCE_TERMS)})
SELECT document_id AS chunk_id, score FROM s WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 8"""


@query("search_evidence", ctes(d=DOCS) + f", {_evidence_sql()}")
def search_evidence(spark, sf):
    role = F.when(F.col("text").contains("异常"), "abnormal_signal").when(F.col("category") == "fr", "handling_rule").otherwise("definition")
    rows = DOCS.df(spark, sf).select(
        F.col("document_id").alias("chunk_id"), "title", F.lit("").alias("heading"), F.col("text").alias("content"),
        F.lit("document").alias("doc_role"), role.alias("evidence_role"),
    )
    return retrieval.evidence_search(rows, EVIDENCE_TERMS, 8).select("chunk_id", "score")


@query("search_snippets", ctes(d=DOCS) + r""",
n AS (SELECT document_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM d),
p AS (SELECT *, greatest(coalesce(least(nullif(strpos(t, 'thation the'), 0), nullif(strpos(t, 'thation'), 0), nullif(strpos(t, 'avec'), 0)), 1) - 1 - 60, 0) AS s FROM n)
SELECT document_id, CASE WHEN s > 0 THEN '...' ELSE '' END || substr(t, s + 1, 260) || CASE WHEN s + 260 < length(t) THEN '...' ELSE '' END AS snippet FROM p""")
def search_snippets(spark, sf):
    d = DOCS.df(spark, sf)
    return d.select("document_id", tx.snippet(F.col("text"), "thation the", ["thation", "avec"]).alias("snippet"))


# --- vectors -----------------------------------------------------------------------------

DIM = 64


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"), "label", F.col("embedding").alias("vector"))


MEANS = "mean AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL)"


@query("vector_means", f"WITH {MEANS} SELECT label, CAST(i - 1 AS INTEGER) AS position, round(v, 6) AS mean_value FROM mean")
def vector_means(spark, sf):
    means = retrieval.mean_vectors(vectors(spark, sf), "label", "vector", DIM)
    return means.select("label", F.posexplode("mean_vector").alias("position", "v")).select("label", "position", F.round("v", 6).alias("mean_value"))


@query("vector_search", f"""WITH {MEANS}, q AS (SELECT list(v ORDER BY i) AS q FROM mean WHERE label = (SELECT min(label) FROM embeddings)),
s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q) AS s FROM embeddings, q)
SELECT vec_id AS document_id, round(s, 6) AS similarity FROM s WHERE s >= 0.05 ORDER BY s DESC, vec_id LIMIT 25""")
def vector_search(spark, sf):
    rows = vectors(spark, sf)
    first = rows.agg(F.min("label")).scalar()
    q = retrieval.mean_vectors(rows.filter(F.col("label") == first), "label", "vector", DIM).select("mean_vector").scalar()
    found = retrieval.vector_search(rows, "vector", q, 25, 0.05, "document_id")
    return found.select("document_id", F.round("similarity", 6).alias("similarity"))


@query("vector_normalize", """SELECT vec_id AS document_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length, round(embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first_value FROM embeddings""")
def vector_normalize(spark, sf):
    v = F.col("vector")
    return vectors(spark, sf).select(
        "document_id", F.round(retrieval.norm(v), 6).alias("length"), F.round(retrieval.normalize(v)[0], 6).alias("first_value")
    )


# --- chunks, metadata, reading, sync -----------------------------------------------------

MARKDOWN = "concat('# ', title, chr(10), chr(10), replace(text, chr(10), concat(chr(10), chr(10))))"


@query("doc_markdown_chunks")
def doc_markdown_chunks(spark, sf):
    docs = DOCS.df(spark, sf).select("document_id", F.expr(MARKDOWN).alias("text"))
    out = documents.chunk_documents(docs)
    return out.select("document_id", "ordinal", "heading", "char_start", F.length("content").alias("chars"), F.sha1(F.col("content").cast("binary")).alias("digest"))


@query("doc_plain_chunks", ctes(d=DOCS) + r"""
SELECT CAST(document_id AS VARCHAR) AS document_id, 1 AS ordinal, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS chars FROM d WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''""")
def doc_plain_chunks(spark, sf):
    out = documents.chunk_documents(DOCS.df(spark, sf).select("document_id", "text"))
    return out.select("document_id", "ordinal", F.length("content").cast("bigint").alias("chars"))


DATED = View("documents", {
    "document_id": "doc_id", "text": "text", "char_count": "n_chars",
    "title": "concat('关于', lang, '的通知 ', cast(2010 + doc_id % 15 as string), '年', cast(1 + doc_id % 14 as string), '月', cast(1 + doc_id % 33 as string), '日 国办发〔', cast(2012 + doc_id % 9 as string), '〕', cast(1 + doc_id % 500 as string), '号')",
}, heavy=True)


@query("doc_metadata")
def doc_metadata(spark, sf):
    meta = documents.document_metadata(DATED.df(spark, sf))
    return meta.withColumn("confidence", F.round("confidence", 3))


@query("doc_best_year")
def doc_best_year(spark, sf):
    best = documents.best_year(documents.document_metadata(DATED.df(spark, sf)))
    return best.withColumn("confidence", F.round("confidence", 3))


@query("doc_title_metadata", ctes(d=DATED) + """,
x AS (SELECT document_id, 2010 + document_id % 15 AS y, 1 + document_id % 14 AS m, 1 + document_id % 33 AS dd, 2012 + document_id % 9 AS ny, 1 + document_id % 500 AS n, char_count FROM d)
SELECT document_id, 'date' AS key, printf('%d-%02d-%02d', y, m, dd) AS value, 'full_date' AS method FROM x WHERE m <= 12 AND dd <= 31
UNION ALL SELECT document_id, 'date', printf('%d-%02d', y, m), 'year_month' FROM x WHERE m <= 12
UNION ALL SELECT document_id, 'year', CAST(y AS VARCHAR), 'full_date' FROM x WHERE m <= 12 AND dd <= 31
UNION ALL SELECT document_id, 'year', CAST(y AS VARCHAR), 'year_month' FROM x WHERE m <= 12
UNION ALL SELECT document_id, 'year', CAST(ny AS VARCHAR), 'doc_number_year' FROM x
UNION ALL SELECT document_id, 'year', CAST(y AS VARCHAR), 'plain_year' FROM x
UNION ALL SELECT document_id, 'doc_number', '国办发〔' || ny || '〕' || n, 'structural_doc_number' FROM x
UNION ALL SELECT document_id, 'extraction_quality', CASE WHEN char_count < 80 THEN 'empty' WHEN char_count < 500 THEN 'low' ELSE 'usable' END, 'char_count' FROM x""")
def doc_title_metadata(spark, sf):
    meta = documents.document_metadata(DATED.df(spark, sf).withColumn("text", F.lit("")))
    return meta.select("document_id", "key", "value", "method")


@query("doc_list", ctes(d=DOCS) + "SELECT document_id, title, path FROM d WHERE category ILIKE '%EN%' AND agency ILIKE '%rc1%'")
def doc_list(spark, sf):
    return documents.list_documents(DOCS.df(spark, sf), category="EN", agency="rc1").select("document_id", "title", "path")


@query("doc_read_budget", ctes(d=DOCS, c=CHUNKS_SQL) + """,
r AS (SELECT document_id, SUM(length(content)) OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS s FROM c)
SELECT document_id, count(*) FILTER (s <= 1200) AS included, CAST(coalesce(max(s) FILTER (s <= 1200), 0) AS BIGINT) AS included_chars, max(s) > 1200 AS truncated FROM r GROUP BY 1""")
def doc_read_budget(spark, sf):
    return documents.read_within_budget(chunks(spark, sf), ["document_id"], "ordinal", "content", 1200)


STORED = View("documents", {"document_id": "doc_id", "title": "text", "char_count": "n_chars"}, "source <> 'src3'")
LISTED = View("documents", {
    "document_id": "doc_id", "title": "case when lang = 'de' then concat(text, '!') else text end", "char_count": "n_chars",
}, "source <> 'src7'")
SIG = "substr(sha1(concat_ws(chr(1), '2', title, CAST(char_count AS VARCHAR))), 1, 16)"


@query("doc_kb_incremental", ctes(s=STORED, l=LISTED) + f""",
a AS (SELECT document_id, {SIG} AS sig FROM s), b AS (SELECT document_id, {SIG} AS sig FROM l)
SELECT coalesce(a.document_id, b.document_id) AS document_id, CASE WHEN a.sig IS NULL THEN 'add' WHEN b.sig IS NULL THEN 'delete' WHEN a.sig = b.sig THEN 'keep' ELSE 'update' END AS action FROM a FULL JOIN b ON a.document_id = b.document_id""")
def doc_kb_incremental(spark, sf):
    signed = [v.df(spark, sf).withColumn("sig", documents.kb_signature(["title", "char_count"])) for v in (STORED, LISTED)]
    return reconcile.sync_actions(signed[0], signed[1], ["document_id"], "sig")


TITLED = View("documents", {
    "document_id": "doc_id",
    "title": "concat(case when doc_id % 4 = 0 then '关于' when doc_id % 4 = 1 then '转发' else '' end, ' ', split_part(text, chr(10), 1), case when doc_id % 5 = 0 then '第二次会议3月5日' when doc_id % 5 = 1 then '2023年度' when doc_id % 5 = 2 then '副本7' else '' end, case when doc_id % 3 = 0 then '的通知' when doc_id % 3 = 1 then '的请示' else '' end)",
})


def _strip_sql(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return x


KEY_PATTERNS = [r"\s+", tx.TITLE_PUNCT, tx.TITLE_PREFIX, tx.TITLE_SUFFIX, tx.TITLE_YEAR, "[0-9]+$"]
TITLE_KEY = _strip_sql(_strip_sql("title", KEY_PATTERNS), ["副本", "附件"])
SERIES_KEY = _strip_sql(TITLE_KEY, [tx.SERIES_SESSION, tx.SERIES_MONTH, tx.SERIES_DAY, tx.SERIES_TAIL])


@query("doc_title_keys", ctes(d=TITLED) + f" SELECT document_id, {TITLE_KEY} AS title_key, {SERIES_KEY} AS series_key, CASE WHEN contains(title, '通知') THEN '通知' WHEN contains(title, '请示') THEN '请示' ELSE '' END AS doc_type FROM d")
def doc_title_keys(spark, sf):
    title = F.col("title")
    return TITLED.df(spark, sf).select(
        "document_id", tx.title_key(title).alias("title_key"), tx.series_key(title).alias("series_key"), documents.doc_type(title).alias("doc_type")
    )


# --- evidence for a question -------------------------------------------------------------

QUESTION = "thation erhe 是否异常"
ANSWER_ROWS = View("documents", {
    "chunk_id": "doc_id", "title": "concat(source, lang)", "heading": "split_part(split_part(text, chr(10), 1), '.', 1)", "content": "text",
    "doc_role": "case when lang = 'fr' then 'emergency_procedure' when lang = 'de' then 'control_protection_spec' else 'document' end",
    "evidence_role": "case when source = 'src4' then 'handling_rule' else 'definition' end",
}, heavy=True)


def _answer_sql() -> str:
    def score(text: str) -> str:
        parts = [f"least({OCC.format(t=t.lower(), n=len(t))}, 8) * {2.5 if len(t) >= 4 else 1.0}::DOUBLE" for t in evidence.query_terms(text)]
        return " + ".join(parts)

    searches = evidence.scenario_searches(QUESTION, "diagnosis")
    runs = " UNION ALL ".join(
        f"SELECT *, {i} AS search, {score(t)} AS hits FROM h" + (f" WHERE doc_role = '{r}'" if r else "") for i, (t, r) in enumerate(searches)
    )
    return f"""h AS (SELECT *, lower(title || chr(10) || heading || chr(10) || content) AS low, title || ' ' || heading || ' ' || content AS txt,
  len(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS n FROM a),
runs AS ({runs}),
sc AS (SELECT *, hits + CASE WHEN evidence_role = 'handling_rule' THEN 8 ELSE 0 END + CASE WHEN doc_role = 'emergency_procedure' THEN 100 ELSE 0 END AS score FROM runs WHERE hits > 0),
mg AS (SELECT chunk_id, any_value(title) AS title, any_value(heading) AS heading, any_value(doc_role) AS doc_role, any_value(txt) AS txt, max(score) AS score FROM sc GROUP BY 1),
rk AS (SELECT *, score + CASE WHEN doc_role = 'emergency_procedure' THEN 80 ELSE 0 END + CASE WHEN contains(txt, '处理') OR contains(txt, '异常') OR contains(txt, '不一致') OR contains(txt, '无法调节') THEN 35 ELSE 0 END AS answer_score FROM mg)
SELECT chunk_id, title, heading, score, answer_score FROM rk QUALIFY row_number() OVER (PARTITION BY title, heading ORDER BY answer_score DESC, chunk_id) = 1 ORDER BY answer_score DESC, chunk_id LIMIT 5"""


@query("search_answer_context", ctes(a=ANSWER_ROWS) + f", {_answer_sql()}")
def search_answer_context(spark, sf):
    return evidence.answer_context(ANSWER_ROWS.df(spark, sf), QUESTION).select("chunk_id", "title", "heading", "score", "answer_score")




@query("doc_answer_reading", ctes(d=DOCS, c=CHUNKS_SQL) + f", {_recall_sql()}, {_rerank_sql().rsplit('SELECT document_id, n AS', 1)[0]}" + """,
rk AS (SELECT document_id, r1 + 0.25 * (r - r1) AS related_score FROM dd WHERE i1 + 0.5 * (i - i1) >= 8 AND a1 + 0.5 * (a - a1) >= 3 ORDER BY round(r1 + 0.25 * (r - r1), 6) DESC, document_id LIMIT 4),
rd AS (SELECT c.document_id, c.ordinal, SUM(length(c.content)) OVER (PARTITION BY c.document_id ORDER BY c.ordinal ROWS UNBOUNDED PRECEDING) AS s FROM c JOIN rk USING (document_id))
SELECT document_id, ordinal, CAST(s AS BIGINT) AS running_chars FROM rd WHERE s <= 1500""".replace("), ,", "),"))
def doc_answer_reading(spark, sf):
    hits = _recalled(spark, sf).withColumn("snippet", tx.snippet(F.col("content"), "the thation", RECALL_TOKENS))
    ranked = retrieval.rerank(hits, PROFILE, [-F.round("score", 6), F.col("ordinal")]).withColumn("related_score", F.round("related_score", 6))
    read = documents.answer_context(ranked, chunks(spark, sf), limit_docs=4, max_chars=1500)
    return read.select("document_id", "ordinal", "running_chars")


@query("doc_sections")
def doc_sections(spark, sf):
    docs = DOCS.df(spark, sf).select("document_id", F.expr(MARKDOWN).alias("text"))
    out = documents.chunk_documents(docs, documents.SECTION_CHARS, documents.split_sections)
    return out.select(
        "document_id", "ordinal", "heading", "char_start", F.length("content").alias("chars"),
        retrieval.evidence_role(F.concat_ws("\n", "heading", "content")).alias("evidence_role"),
    )


# --- evidence for many requests ----------------------------------------------------------------

LONG_WORD, KEYWORD, PER_DOCUMENT, BUDGET = 12, 10, 2, 600


def _long_words_sql(text: str, size: int) -> str:
    return f"list_distinct(list_filter({sql_words(f'lower({text})')}, lambda w: length(w) >= {size}))"


@query("doc_evidence_bundles", ctes(d=DOCS, c=CHUNKS_SQL) + f""",
rt AS (SELECT item_id AS request_id, unnest({_long_words_sql('text', LONG_WORD)}) AS term FROM benchmark),
ct AS (SELECT chunk_id, document_id, path, title, content, {_long_words_sql("coalesce(title, '')", LONG_WORD)} AS tt, {_long_words_sql("coalesce(content, '')", LONG_WORD)} AS bt,
  len({_long_words_sql("coalesce(content, '')", KEYWORD)}) AS nk FROM c),
h AS (SELECT chunk_id, term, max(w) AS w FROM (SELECT chunk_id, unnest(tt) AS term, 4 AS w FROM ct UNION ALL SELECT chunk_id, unnest(bt), 1 FROM ct) GROUP BY ALL),
s AS (SELECT request_id, chunk_id, CAST(sum(w) AS BIGINT) AS hits FROM rt JOIN h USING (term) GROUP BY ALL),
sc AS (SELECT request_id, s.chunk_id, document_id, path, title, content, hits + least(nk, 5) AS score FROM s JOIN ct ON ct.chunk_id = s.chunk_id),
o AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY request_id, document_id ORDER BY score DESC, chunk_id) <= {PER_DOCUMENT}),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS INTEGER) AS pick FROM o QUALIFY pick <= 4),
f AS (SELECT b.request_id, b.pick, b.chunk_id, length('section_id: ' || chunk_id || chr(10) || 'document: ' || path || chr(10) || 'title: ' || title || chr(10)) AS hl, coalesce(content, '') AS content FROM b
  UNION ALL SELECT item_id, 1, '0#1', length('section_id: 0#1' || chr(10) || 'document: ' || path || chr(10) || 'title: ' || title || chr(10)), content
    FROM benchmark, c WHERE chunk_id = '0#1' AND item_id NOT IN (SELECT request_id FROM b)),
p1 AS (SELECT *, sum(hl + length(content)) OVER (PARTITION BY request_id ORDER BY pick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
p2 AS (SELECT *, {BUDGET} - coalesce(before, 0) - hl AS room FROM p1),
p3 AS (SELECT *, bool_or(room <= 0) OVER (PARTITION BY request_id ORDER BY pick ROWS UNBOUNDED PRECEDING) AS over FROM p2)
SELECT request_id, pick, chunk_id AS section_id, substr(content, 1, CAST(room AS BIGINT)) AS text, CAST(coalesce(before, 0) + hl + least(room, length(content)) AS INTEGER) AS used_chars
FROM p3 WHERE NOT over""")
def doc_evidence_bundles(spark, sf):
    """Every benchmark text asks with its long words; the lines of all documents are the sections."""
    def long_words(text, size):
        return F.array_distinct(F.filter(tx.word_array(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.length(w) >= size))

    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    terms = asked.select("request_id", F.explode(long_words(F.col("text"), LONG_WORD)).alias("term"))
    lines = chunks(spark, sf).withColumnRenamed("chunk_id", "section_id")
    hits = lines.select("section_id", F.explode(long_words(F.col("title"), LONG_WORD)).alias("term"), F.lit(True).alias("in_title")).unionByName(
        lines.select("section_id", F.explode(long_words(F.col("content"), LONG_WORD)).alias("term"), F.lit(False).alias("in_title")))
    counted = lines.select("section_id", "document_id", F.size(long_words(F.col("content"), KEYWORD)).alias("n_keywords"))
    picks = sections.choose_sections(
        sections.section_scores(terms, counted, hits), asked.select("request_id", F.lit("0#1").alias("source_section_id")), per_document=PER_DOCUMENT)
    return sections.evidence_bundles(picks, lines, BUDGET).drop("header")
