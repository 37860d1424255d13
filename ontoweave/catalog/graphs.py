"""Document relation and graph queries: every document cites the one at half its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoweave.catalog.base import View, ctes, query, sql_round, table
from ontoweave.catalog.docs import DOCS, KIND, SERIES_KEY, TERMS, TITLE_KEY, _strip_sql, KEY_PATTERNS, vectors
from ontoweave.functions import text as tx
from ontoweave.operators import graph, retrieval
from ontoweave.operators.ordering import top_per_group
from ontoweave.plans import docgraph, documents
from ontoweave.session import cut_lineage, stored

WORDS = ["根据", "修订", "废止", "落实", "见", "征求意见稿用于征求意见"]
ROLES = ["", "附件", "请示", "", "反馈意见", ""]
_LINE = "split_part(split_part(text, chr(10), 1), '.', 1)"
PLAIN = View("documents", {
    "document_id": "doc_id", "parent_id": "cast(floor(doc_id / 2) as bigint)", "title": _LINE, "path": "concat(lang, '/', source, '/', cast(doc_id as string))",
    "word": "case " + " ".join(f"when doc_id % 6 = {i} then '{w}'" for i, w in enumerate(WORDS)) + " end",
    "role": "case " + " ".join(f"when doc_id % 6 = {i} then '{w}'" for i, w in enumerate(ROLES)) + " end",
    "number": "concat('国办发〔2020〕', cast(cast(floor(doc_id / 3) as bigint) as string), '号')",
})
CITING = """SELECT a.document_id, a.path, a.title || a.role AS title, a.word || '《' || b.title || '》，并参照' || b.number AS relation_text, b.title AS quote, a.number, b.number AS cited FROM p a JOIN p b ON b.document_id = a.parent_id"""


def citing(spark, sf):
    p = PLAIN.df(spark, sf)
    parent = p.select(F.col("document_id").alias("parent_id"), F.col("title").alias("quote"), F.col("number").alias("cited"))
    return p.join(parent, "parent_id").select(
        "document_id", "path", F.concat("title", "role").alias("title"),
        F.concat("word", F.lit("《"), "quote", F.lit("》，并参照"), "cited").alias("relation_text"), "quote", "number", "cited",
    )


def quotes_of(docs):
    return docs.select("document_id", F.explode(tx.quoted_terms(F.concat_ws("\n", "title", "relation_text"))).alias("quote"))


STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
USEFUL_Q = f"length(quote) >= 2 AND quote NOT IN ({STOP}) AND regexp_matches(quote, '[一-鿿A-Za-z]')"
QUOTES = f"""qs AS (SELECT DISTINCT document_id, quote FROM (SELECT document_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(title || chr(10) || relation_text, '{tx.QUOTED}', 1)), '\\s+', '', 'g'), '[（(]征求意见稿[）)]$', '', 'g') AS quote FROM c) WHERE {USEFUL_Q}),
qk AS (SELECT document_id, quote, {_strip_sql('quote', KEY_PATTERNS)} AS quote_key FROM qs)"""


def _role_sql(title: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({title}, '{p}') THEN '{n}'" for n, p in docgraph.ROLE_PATTERNS) + " ELSE '' END"


def _type_sql(text: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for n, p in docgraph.TYPE_PATTERNS) + f" ELSE '{default}' END"


def _map_sql(col: str, table_: dict, default) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table_.items()) + f" ELSE {default!r} END"


def _dedupe_sql(parts: str) -> str:
    return f"""SELECT source_document_id, target_document_id, relation_type, max({sql_round('greatest(0, least(confidence, 1))', 3)}) AS confidence, method FROM ({parts}) WHERE source_document_id <> target_document_id GROUP BY source_document_id, target_document_id, relation_type, method"""


AROUND = "CASE WHEN strpos(relation_text, {n}) > 0 THEN substr(relation_text, greatest(strpos(relation_text, {n}) - 180, 1), 2000) ELSE substr(relation_text, 1, 180) END"
SHARED = """sg AS (SELECT quote_key FROM qk WHERE length(quote_key) >= 6 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 10),
shared AS (SELECT a.document_id AS source_document_id, b.document_id AS target_document_id, 'shared_reference' AS relation_type, least(0.84::DOUBLE, 0.62::DOUBLE + length(a.quote_key) / 80::DOUBLE) AS confidence, 'rule' AS method
  FROM qk a JOIN sg USING (quote_key) JOIN qk b ON b.quote_key = a.quote_key AND a.document_id <> b.document_id)"""
SERIES = f"""sk AS (SELECT document_id, {SERIES_KEY} AS k, {TITLE_KEY} AS t FROM c), ss AS (SELECT k FROM sk WHERE length(k) >= 8 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8),
series AS (SELECT a.document_id AS source_document_id, b.document_id AS target_document_id, CASE WHEN a.t = b.t THEN 'same_matter' ELSE 'same_series' END AS relation_type, CASE WHEN a.t = b.t THEN 0.78 ELSE 0.68 END::DOUBLE AS confidence, 'rule' AS method
  FROM sk a JOIN ss USING (k) JOIN sk b ON b.k = a.k AND a.document_id <> b.document_id)"""
NUMBERS = f"""nn AS (SELECT DISTINCT document_id, regexp_replace(number, '号$', '') AS n FROM c), ng AS (SELECT n FROM nn GROUP BY 1 HAVING count(*) BETWEEN 1 AND 5),
numbers AS (SELECT c.document_id AS source_document_id, nn.document_id AS target_document_id, {_type_sql("(c.title || chr(10) || " + AROUND.format(n="nn.n") + ")", 'cites_by_doc_no')} AS relation_type, 0::DOUBLE AS confidence, 'doc_number' AS method
  FROM c JOIN nn ON nn.n = regexp_replace(c.cited, '号$', '') JOIN ng ON ng.n = nn.n WHERE c.document_id <> nn.document_id),
numbered AS (SELECT source_document_id, target_document_id, relation_type, {_map_sql('relation_type', docgraph.TYPE_CONFIDENCE, 0.74)}::DOUBLE AS confidence, method FROM numbers)"""
TITLES = f"""tk AS (SELECT document_id, path, title, {TITLE_KEY} AS title_key FROM c),
tm AS (SELECT q.quote_key, t.document_id, t.path, {_role_sql('t.title')} AS trole FROM (SELECT DISTINCT quote_key FROM qk WHERE length(quote_key) >= 8) q JOIN tk t ON length(t.title_key) >= 8 AND (contains(t.title_key, q.quote_key) OR contains(q.quote_key, t.title_key))
  QUALIFY row_number() OVER (PARTITION BY q.quote_key ORDER BY t.path) <= 12),
tc AS (SELECT c.document_id AS s, tm.document_id AS t, {_role_sql('c.title')} AS role, trole, c.title || chr(10) || {AROUND.format(n="qk.quote")} AS wording FROM qk JOIN c USING (document_id) JOIN tm USING (quote_key) WHERE c.document_id <> tm.document_id),
titled0 AS (SELECT s AS source_document_id, t AS target_document_id, role, CASE WHEN role <> '' THEN {_map_sql('role', docgraph.ROLE_TYPES, 'cites')} ELSE {_type_sql('wording', 'cites')} END AS relation_type FROM tc WHERE role = '' OR role <> trole),
titled AS (SELECT source_document_id, target_document_id, relation_type, CASE WHEN role <> '' THEN {_map_sql('role', docgraph.ROLE_CONFIDENCE, 0.74)} ELSE {_map_sql('relation_type', docgraph.TYPE_CONFIDENCE, 0.74)} END::DOUBLE AS confidence, 'rule' AS method FROM titled0)"""
HEAD = ctes(p=PLAIN, c=CITING) + f", {QUOTES}"
UNION = " UNION ALL ".join(f"SELECT * FROM {t}" for t in ("shared", "series", "numbered", "titled"))
RELATIONS = HEAD + f", {SHARED}, {SERIES}, {NUMBERS}, {TITLES}, rel AS ({_dedupe_sql(UNION)})"


def relations(spark, sf):
    docs = citing(spark, sf)
    quotes = quotes_of(docs)
    numbered = docs.withColumns({"own_numbers": tx.doc_numbers(F.col("number")), "cited_numbers": tx.doc_numbers(F.col("cited"))})
    parts = [
        docgraph.shared_references(quotes), docgraph.series_relations(docs), docgraph.number_citations(numbered),
        docgraph.title_citations(docs, quotes),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    # The relation table is a stored object; every query below reads it, some several times.
    return cut_lineage(docgraph.dedupe_relations(whole))


@query("relation_shared_references", HEAD + f", {SHARED} {_dedupe_sql('SELECT * FROM shared')}")
def relation_shared_references(spark, sf):
    return docgraph.dedupe_relations(docgraph.shared_references(quotes_of(citing(spark, sf))))


@query("relation_series", HEAD + f", {SERIES} {_dedupe_sql('SELECT * FROM series')}")
def relation_series(spark, sf):
    return docgraph.dedupe_relations(docgraph.series_relations(citing(spark, sf)))


@query("relation_members", HEAD + f""", gm AS (SELECT DISTINCT 'quote' AS kind, quote_key AS group_key, document_id FROM qk WHERE length(quote_key) >= 6
UNION ALL SELECT DISTINCT 'series', k, document_id FROM (SELECT document_id, {SERIES_KEY} AS k FROM c) WHERE length(k) >= 8
UNION ALL SELECT DISTINCT 'number', regexp_replace(number, '号$', ''), document_id FROM c)
SELECT *, min(document_id) OVER (PARTITION BY kind, group_key) AS representative, count(*) OVER (PARTITION BY kind, group_key) AS size FROM gm""")
def relation_members(spark, sf):
    docs = citing(spark, sf)
    return docgraph.relation_members(docs.withColumn("own_numbers", tx.doc_numbers(F.col("number"))), quotes_of(docs))


@query("relation_title_citations", HEAD + f", {TITLES} {_dedupe_sql('SELECT * FROM titled')}")
def relation_title_citations(spark, sf):
    docs = citing(spark, sf)
    return docgraph.dedupe_relations(docgraph.title_citations(docs, quotes_of(docs)))


@query("relation_all", RELATIONS + " SELECT * FROM rel")
def relation_all(spark, sf):
    return relations(spark, sf)


@query("relation_stats", RELATIONS + " SELECT relation_type, method, count(*) AS relations, CAST(sum(CAST(confidence AS DECIMAL(18,3))) AS DOUBLE) AS confidence_sum FROM rel GROUP BY ALL")
def relation_stats(spark, sf):
    return docgraph.relation_stats(relations(spark, sf))


@query("relation_context", RELATIONS + """,
f AS (SELECT document_id FROM c WHERE relation_text LIKE '根据%'),
x AS (SELECT source_document_id AS document_id, target_document_id AS other_document_id, 'outgoing' AS direction, relation_type, confidence FROM rel WHERE source_document_id IN (SELECT document_id FROM f)
UNION ALL SELECT target_document_id, source_document_id, 'incoming', relation_type, confidence FROM rel WHERE target_document_id IN (SELECT document_id FROM f))
SELECT document_id, other_document_id, confidence, relation_type, direction FROM x QUALIFY row_number() OVER (PARTITION BY document_id, other_document_id ORDER BY confidence DESC, relation_type DESC, direction DESC) = 1""")
def relation_context(spark, sf):
    focus = citing(spark, sf).filter(F.col("relation_text").startswith("根据")).select("document_id")
    return docgraph.expand_context(relations(spark, sf), focus)


GROUPS = f"""rel AS ({_dedupe_sql('SELECT * FROM shared UNION ALL SELECT * FROM series')}),
bi AS (SELECT source_document_id AS a, target_document_id AS b FROM rel UNION SELECT target_document_id, source_document_id FROM rel),
r AS (SELECT DISTINCT a AS node, a AS reach FROM bi UNION SELECT r.node, bi.b FROM r JOIN bi ON bi.a = r.reach),
cp AS (SELECT node, min(reach) AS component FROM r GROUP BY 1),
rc AS (SELECT rel.*, component FROM rel JOIN cp ON node = source_document_id),
en AS (SELECT component, source_document_id AS d FROM rc UNION ALL SELECT component, target_document_id FROM rc),
cn AS (SELECT component, d, count(*) AS n FROM en GROUP BY ALL),
ti AS (SELECT cn.*, c.title, coalesce(nullif({TITLE_KEY}, ''), CAST(d AS VARCHAR)) AS k FROM cn JOIN c ON c.document_id = d),
de AS (SELECT * FROM ti QUALIFY row_number() OVER (PARTITION BY component, k ORDER BY n DESC, title, d) = 1),
tp AS (SELECT component, d FROM de QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, title, d) <= 8),
ins AS (SELECT rc.* FROM rc JOIN tp a ON a.component = rc.component AND a.d = source_document_id JOIN tp b ON b.component = rc.component AND b.d = target_document_id),
gs AS (SELECT component, count(*) AS n, sum(confidence * {_map_sql('relation_type', docgraph.TYPE_WEIGHTS, 0.7)}::DOUBLE) AS e, count(*) FILTER (relation_type NOT IN ('same_matter', 'shared_reference', 'topically_related', 'semantically_related')) AS hard,
  count(DISTINCT relation_type) AS types, string_agg(DISTINCT relation_type, ',' ORDER BY relation_type) AS relation_types FROM ins GROUP BY 1),
mb AS (SELECT component, count(*) AS m FROM tp GROUP BY 1)
SELECT component, {sql_round('CAST(CAST(e AS DECIMAL(20,6)) AS DOUBLE) + hard * 0.25::DOUBLE + m * 0.12::DOUBLE + types * 0.35::DOUBLE', 3)} AS score, m AS document_count, n AS relation_count, relation_types FROM gs JOIN mb USING (component) WHERE n >= 2 AND m >= 2"""


@query("relation_groups", HEAD.replace("WITH", "WITH RECURSIVE", 1) + f", {SHARED}, {SERIES}, {GROUPS}")
def relation_groups(spark, sf):
    docs = citing(spark, sf)
    found = docgraph.dedupe_relations(docgraph.shared_references(quotes_of(docs)).unionByName(docgraph.series_relations(docs)))
    return docgraph.relation_groups(found, docs.select("document_id", "title"))


VECTORS = f"""{TERMS},
t24 AS (SELECT terms.document_id, terms.t, term_weight * idf AS s FROM terms JOIN stats USING (t) QUALIFY row_number() OVER (PARTITION BY terms.document_id ORDER BY round(term_weight * idf, 8) DESC, terms.t) <= 24),
tot AS (SELECT document_id, sum(s) AS total FROM t24 GROUP BY 1),
un AS (SELECT document_id, t, sqrt(s / total) AS u FROM t24 JOIN tot USING (document_id) WHERE length(t) >= 3 AND ({KIND}) NOT IN ('form', 'short')),
ov AS (SELECT a.document_id AS s, b.document_id AS t, round(sum(a.u * b.u), 9) AS o FROM un a JOIN un b ON a.t = b.t AND a.document_id <> b.document_id GROUP BY ALL)"""


def best_terms(d):
    # The terms are read twice, for their statistics and for their scores.
    terms = stored(documents.document_terms(d), "terms")
    scored = documents.scored_terms(terms, documents.term_statistics(terms, d))
    return top_per_group(
        scored.select("document_id", "term", "score"), ["document_id"], [F.round("score", 8).desc(), F.col("term")], docgraph.SOFT_TERMS
    ).drop("rank")


@query("relation_soft_terms", ctes(d=DOCS) + f", {VECTORS}" + """
SELECT s AS source_document_id, t AS target_document_id, 'topically_related' AS relation_type, round(least(0.76::DOUBLE, 0.5::DOUBLE + o), 6) AS confidence, 'lexical_profile' AS method FROM ov WHERE o >= 0.22
QUALIFY row_number() OVER (PARTITION BY s ORDER BY o DESC, t DESC) <= 4""")
def relation_soft_terms(spark, sf):
    return docgraph.soft_term_relations(best_terms(DOCS.df(spark, sf))).withColumn("confidence", F.round("confidence", 6))


@query("relation_role_profiles", ctes(d=DOCS, p=PLAIN) + f", {VECTORS}, rt AS (SELECT document_id, title || role AS title FROM p), " + f"""
rk AS (SELECT document_id, title, {SERIES_KEY} AS k, {_role_sql('title')} AS role FROM rt),
sc AS (SELECT s, t, a.role, b.role AS trole, b.title, round(o + CASE WHEN a.k <> '' AND b.k <> '' AND (contains(a.k, b.k) OR contains(b.k, a.k)) THEN 0.2 ELSE 0 END, 9) AS score
  FROM ov JOIN rk a ON a.document_id = s JOIN rk b ON b.document_id = t WHERE a.role <> '' AND o > 0),
tp AS (SELECT * FROM sc WHERE score >= 0.18 QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, title, t) <= 4)
SELECT s AS source_document_id, t AS target_document_id, {_map_sql('role', docgraph.ROLE_TYPES, 'cites')} AS relation_type, round({_map_sql('role', docgraph.ROLE_CONFIDENCE, 0.74)}::DOUBLE - 0.08, 6) AS confidence, 'lexical_profile' AS method FROM tp WHERE role <> trole""")
def relation_role_profiles(spark, sf):
    docs = PLAIN.df(spark, sf).select("document_id", F.concat("title", "role").alias("title"))
    found = docgraph.role_profile_relations(docs, best_terms(DOCS.df(spark, sf)))
    return found.withColumn("confidence", F.round("confidence", 6))


MEANS = "mean AS (SELECT label, list(v ORDER BY i) AS q FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1)"


@query("relation_semantic", f"""WITH {MEANS},
f AS (SELECT CAST(-1 - label AS BIGINT) AS id, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS q FROM mean),
e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
s AS (SELECT id, vec_id, list_dot_product(q, v) AS s FROM f, e WHERE list_dot_product(q, v) >= 0.1)
SELECT id AS source_document_id, vec_id AS target_document_id, 'semantically_related' AS relation_type, round(least(0.82, s), 6) AS confidence, 'embedding' AS method FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, vec_id DESC) <= 3""")
def relation_semantic(spark, sf):
    rows = vectors(spark, sf)
    means = retrieval.mean_vectors(rows, "label", "vector", 64)
    focus = means.select((-1 - F.col("label")).cast("bigint").alias("document_id"), retrieval.normalize(F.col("mean_vector")).alias("vector"))
    unit = rows.select("document_id", retrieval.normalize(F.col("vector")).alias("vector"))
    return docgraph.semantic_relations(unit, focus, threshold=0.1).withColumn("confidence", F.round("confidence", 6))


# --- graphs over the trade network -------------------------------------------------------

# Customer nation -> supplier nation, weighted by traded lines; and parts bought together by supplier.
TRADE_SQL = """SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL"""


def trade(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    nations = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    ).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("src"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    return lines.join(nations, "l_orderkey").join(suppliers, "l_suppkey").groupBy("src", "dst").agg(F.count("*").alias("weight"))


CITES = View("documents", {"src": "doc_id", "dst": "cast(floor(doc_id / 2) as bigint)", "weight": "cast(n_chars as double)"})


@query("graph_degrees", ctes(t=TRADE_SQL) + """,
m AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM t WHERE src <> dst GROUP BY ALL),
x AS (SELECT a AS node, w FROM m UNION ALL SELECT b, w FROM m) SELECT node, count(*) AS degree, CAST(sum(w) AS BIGINT) AS weighted_degree FROM x GROUP BY 1""")
def graph_degrees(spark, sf):
    return graph.degrees(trade(spark, sf))


@query("graph_components", "WITH RECURSIVE e AS (" + CITES.sql() + """), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
bi AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r AS (SELECT node, node AS reach FROM n UNION SELECT r.node, bi.b FROM r JOIN bi ON bi.a = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def graph_components(spark, sf):
    return graph.connected_components(CITES.df(spark, sf))


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT node, 1e0 / (SELECT count(*) FROM n) AS rank FROM n)"]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE node NOT IN (SELECT src FROM sh)) / (SELECT count(*) FROM n)
  + 0.85::DOUBLE * coalesce(f.flow, 0) AS rank FROM n LEFT JOIN (SELECT dst, sum(rank * share) AS flow FROM sh JOIN r{i - 1} ON node = src GROUP BY 1) f ON f.dst = n.node)""")
    return ",\n".join(steps) + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query("graph_pagerank", ctes(t=TRADE_SQL) + """,
n AS (SELECT src AS node FROM t UNION SELECT dst FROM t), o AS (SELECT src, sum(weight) AS total FROM t GROUP BY 1),
sh AS MATERIALIZED (SELECT src, dst, weight / total::DOUBLE AS share FROM t JOIN o USING (src)),
""" + _pagerank_sql(8))
def graph_pagerank(spark, sf):
    ranks = graph.pagerank(trade(spark, sf), iterations=8, tolerance=0.0)
    return ranks.select("node", F.round("rank", 9).alias("rank"))


@query("graph_shortest_paths", ctes(t=TRADE_SQL) + """,
w AS (SELECT src, dst, weight FROM t WHERE src <> dst),
d0 AS (SELECT 0 AS dst, CAST(0 AS BIGINT) AS cost, [0] AS path),
""" + ",\n".join(
    f"""d{i} AS MATERIALIZED (SELECT dst, m.c AS cost, m.p AS path FROM (SELECT dst, min({{'c': cost, 'h': len(path), 'p': path}}) AS m FROM (SELECT * FROM d{i - 1} UNION ALL SELECT w.dst, d.cost + w.weight, list_append(d.path, w.dst) FROM d{i - 1} d JOIN w ON w.src = d.dst) GROUP BY dst))"""
    for i in range(1, 25)
) + " SELECT 0 AS src, dst, cost, array_to_string(path, '>') AS path FROM d24")
def graph_shortest_paths(spark, sf):
    t = trade(spark, sf).filter("src <> dst")
    starts = table(spark, sf, "nation").filter("n_name = 'NATION_0'").select(F.col("n_nationkey").alias("src"))
    return graph.shortest_paths(t, starts).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query("graph_bounded_paths", RELATIONS + f""",
ed AS (SELECT CAST(source_document_id AS VARCHAR) AS src, CAST(target_document_id AS VARCHAR) AS dst, relation_type AS label, confidence * {_map_sql('relation_type', docgraph.TYPE_WEIGHTS, 0.7)}::DOUBLE AS score FROM rel
  QUALIFY row_number() OVER (PARTITION BY source_document_id ORDER BY confidence * {_map_sql('relation_type', docgraph.TYPE_WEIGHTS, 0.7)}::DOUBLE DESC, relation_type, CAST(target_document_id AS VARCHAR)) <= 80),
st AS (SELECT CAST(document_id AS VARCHAR) AS node FROM p WHERE path LIKE 'de/src1/%'),
p1 AS (SELECT st.node AS a, dst AS node, [st.node, dst] AS path, [label] AS labels, score FROM st JOIN ed ON src = st.node WHERE dst <> st.node),
p2 AS (SELECT dst AS node, list_append(path, dst) AS path, list_append(labels, label) AS labels, p1.score + ed.score AS score FROM p1 JOIN ed ON src = p1.node WHERE NOT list_contains(path, dst)),
p3 AS (SELECT dst AS node, list_append(path, dst) AS path, list_append(labels, label) AS labels, p2.score + ed.score AS score FROM p2 JOIN ed ON src = p2.node WHERE NOT list_contains(path, dst)),
al AS (SELECT node, path, labels, score, 1 AS depth FROM p1 UNION ALL SELECT node, path, labels, score, 2 FROM p2 UNION ALL SELECT node, path, labels, score, 3 FROM p3)
SELECT node, array_to_string(path, '>') AS path, array_to_string(labels, '>') AS labels, round(score + 0.2::DOUBLE * len(list_distinct(labels)), 6) AS score, depth FROM al""")
def graph_bounded_paths(spark, sf):
    rel = relations(spark, sf)
    edges = rel.select(
        F.col("source_document_id").cast("string").alias("src"), F.col("target_document_id").cast("string").alias("dst"),
        F.col("relation_type").alias("label"), docgraph.edge_score().alias("score"),
    )
    starts = PLAIN.df(spark, sf).filter(F.col("path").startswith("de/src1/")).select(F.col("document_id").cast("string").alias("src"))
    paths = graph.bounded_paths(edges, starts, max_depth=3, fan_out=80)
    return paths.select(
        "node", F.array_join("path", ">").alias("path"), F.array_join("labels", ">").alias("labels"),
        F.round(F.col("score") + F.size(F.array_distinct("labels")) * 0.2, 6).alias("score"), "depth",
    )


@query("graph_paths_between", ctes(e=CITES, d=DOCS) + """,
ar AS (SELECT src AS a, dst AS b, weight, 'outgoing' AS way FROM e UNION ALL SELECT dst, src, weight, 'incoming' FROM e),
p1 AS (SELECT b AS node, [a, b] AS path, weight AS score, [way] AS ways FROM ar JOIN d ON document_id = a WHERE category = 'de' AND agency = 'src1' AND a <> b),
p2 AS (SELECT b AS node, list_append(path, b) AS path, score + weight AS score, list_append(ways, way) AS ways FROM p1 JOIN ar ON a = node WHERE NOT list_contains(path, b)),
p3 AS (SELECT b AS node, list_append(path, b) AS path, score + weight AS score, list_append(ways, way) AS ways FROM p2 JOIN ar ON a = node WHERE NOT list_contains(path, b)),
al AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
SELECT array_to_string(path, '>') AS path, array_to_string(ways, '>') AS directions, CAST(score AS DOUBLE) AS score, CAST(len(ways) AS INTEGER) AS depth FROM al
WHERE node IN (SELECT document_id FROM d WHERE category = 'en')""")
def graph_paths_between(spark, sf):
    d = DOCS.df(spark, sf)
    edges = CITES.df(spark, sf).select("src", "dst", F.lit("cites").alias("label"), F.col("weight").cast("double").alias("score"))
    starts = d.filter("category = 'de' and agency = 'src1'").select(F.col("document_id").alias("src"))
    ends = d.filter("category = 'en'").select(F.col("document_id").alias("dst"))
    paths = graph.bounded_paths(edges, starts, max_depth=3, direction="both", ends=ends)
    return paths.select(
        F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.array_join("directions", ">").alias("directions"), "score", "depth")


def _communities_sql(rounds: int) -> str:
    steps = ["l0 AS (SELECT node, node AS label FROM own)"]
    for i in range(1, rounds + 1):
        steps.append(f"""l{i} AS MATERIALIZED (SELECT node, label FROM (SELECT a.node, label, sum(w) AS w FROM arcs a JOIN l{i - 1} l ON l.node = a.other GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, label) = 1)""")
    return ",\n".join(steps) + f" SELECT node, label AS community FROM l{rounds}"


@query("graph_communities", ctes(e=CITES) + """,
m AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM e WHERE src <> dst GROUP BY ALL),
bi AS (SELECT a AS node, b AS other, w FROM m UNION ALL SELECT b, a, w FROM m), own AS (SELECT node, max(w) AS w FROM bi GROUP BY 1),
arcs AS MATERIALIZED (SELECT * FROM bi UNION ALL SELECT node, node, w FROM own),
""" + _communities_sql(3))
def graph_communities(spark, sf):
    return graph.communities(CITES.df(spark, sf), rounds=3)


# The whole text of every document, with its number between the first line and the rest in one of four spellings.
SPELLINGS = ["国办发〔2020〕{0}", "国办发［2020］ {0}", "国办发 [2020]{0}", "国 办发（2020）\u3000{0}"]
_SPELLED = "case " + " ".join(f"when doc_id % 5 = {i} then concat('" + p.replace("{0}", "', cast(doc_id as string), '") + "')" for i, p in enumerate(SPELLINGS)) + " else '' end"
SPELLED = View("documents", {
    "document_id": "doc_id", "number": "concat('国办发〔2020〕', cast(doc_id as string))", "text": f"concat(text, '\n', {_SPELLED}, '号\n', text)",
})


@query("relation_number_contexts", ctes(s=SPELLED) + """,
ch AS (SELECT document_id, number, text, string_split(text, '') AS cs FROM s),
k AS (SELECT *, list_filter(range(1, len(cs) + 1), lambda i: NOT regexp_matches(cs[i], '[\\s\u00a0\u3000]')) AS spots, strpos(regexp_replace(translate(text, '［［[（(］]）)', '〔〔〔〔〔〕〕〕〕'), '[\\s\u00a0\u3000]+', '', 'g'), number) AS p FROM ch),
f AS (SELECT *, CASE WHEN p > 0 THEN spots[p] ELSE 0 END AS a, CASE WHEN p > 0 THEN spots[p + length(number) - 1] ELSE 0 END AS z FROM k)
SELECT document_id, CAST(a AS INTEGER) AS position, CASE WHEN a > 0 THEN substr(text, a, z - a + 1) ELSE '' END AS found,
  CASE WHEN a > 0 THEN substr(text, greatest(a - 180, 1), z + 180 - greatest(a - 180, 1) + 1) ELSE substr(text, 1, 180) END AS context FROM f""")
def relation_number_contexts(spark, sf):
    rows = SPELLED.df(spark, sf)
    return rows.select("document_id", docgraph.number_context(F.col("text"), F.col("number")).alias("_c")).select("document_id", "_c.*")
