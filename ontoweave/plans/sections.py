"""Choice of evidence sections for many requests at once, and the text that fits a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.operators.ordering import top_per_group

# Fixed values of the choice.
TITLE_HIT, OTHER_HIT = 4, 1  # a term in the title, a term elsewhere
KEYWORDS_AT_MOST = 5  # keywords of a section that count
MAX_SECTIONS, MAX_CHARS = 4, 32_000


def section_scores(requests: DataFrame, sections: DataFrame, hits: DataFrame) -> DataFrame:
    """(request_id, section_id, document_id, score) of every section that a term of the request hits.

    ``requests``: request_id, term; ``hits``: term, section_id, in_title; ``sections``: section_id, document_id,
    n_keywords. A term counts once in a section, in its title if it stands there. Repeated terms,
    hits and sections change nothing; null terms and ids hit nothing.
    """
    placed = hits.dropna(subset=["term", "section_id"]).groupBy("term", "section_id").agg(F.max(F.col("in_title").cast("int")).alias("_title"))
    worth = F.sum(F.when(F.col("_title") == 1, TITLE_HIT).otherwise(OTHER_HIT))
    scored = requests.select("request_id", "term").dropna().distinct().join(placed, "term").groupBy("request_id", "section_id").agg(worth.alias("_hits"))
    own = sections.select("section_id", "document_id", "n_keywords").dropDuplicates(["section_id"])
    score = F.col("_hits") + F.least(F.coalesce("n_keywords", F.lit(0)), F.lit(KEYWORDS_AT_MOST))
    return scored.join(own, "section_id").select("request_id", "section_id", "document_id", score.cast("bigint").alias("score"))


def choose_sections(scored: DataFrame, requests: DataFrame, max_sections: int = MAX_SECTIONS, per_document: int | None = None) -> DataFrame:
    """(request_id, section_id, pick): the best sections of each request in the order they are picked.

    With ``per_document`` a pick is passed over once its document has so many. A document's later sections never
    come before its earlier ones, so passing over is a rank within the document, and no request's list is ever gathered.
    ``requests``: request_id, source_section_id; one without any scored section takes its source section, if it has one.
    """
    order = [F.col("score").desc(), F.col("section_id")]
    open_ = scored if per_document is None else top_per_group(scored, ["request_id", "document_id"], order, per_document)
    best = top_per_group(open_, ["request_id"], order, max_sections)
    listed = best.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "section_id"))).alias("_l"))  # at most max_sections
    picks = listed.select("request_id", F.posexplode("_l").alias("pick", "_p")).select("request_id", F.col("_p.section_id").alias("section_id"), (F.col("pick") + 1).alias("pick"))
    rest = requests.filter("source_section_id is not null").join(listed.select("request_id"), "request_id", "left_anti")
    own = rest.groupBy("request_id").agg(F.min("source_section_id").alias("section_id"))
    return picks.unionByName(own.withColumn("pick", F.lit(1)))


def evidence_bundles(picks: DataFrame, sections: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(request_id, pick, section_id, header, text, used_chars): what each pick adds to the request's bundle.

    A fold over the picks of a request: the header and as much of the content as the budget leaves are taken,
    and the bundle ends at the first section whose header leaves nothing. ``sections``: section_id, path, title, content;
    ``used_chars`` is the running sum of headers and texts.
    """
    known = sections.select("section_id", "path", "title", "content").dropDuplicates(["section_id"])
    header = F.concat(
        F.lit("section_id: "), F.col("section_id").cast("string"), F.lit("\ndocument: "), F.coalesce("path", F.lit("")),
        F.lit("\ntitle: "), F.coalesce("title", F.lit("")), F.lit("\n"),
    )
    # Only the first max_chars of a content can be taken, so no more travels.
    rows = picks.join(known, "section_id").select(
        "request_id", F.struct("pick", "section_id", header.alias("header"), F.substring(F.coalesce("content", F.lit("")), 1, max_chars).alias("content")).alias("_s"))
    lists = rows.groupBy("request_id").agg(F.array_sort(F.collect_list("_s")).alias("_l"))  # at most max_sections
    empty = F.struct(F.lit(0).alias("used"), F.lit(False).alias("over"), F.array().cast("array<int>").alias("takes"))

    def step(state, section):
        left = F.lit(max_chars) - state["used"] - F.length(section["header"])
        over = state["over"] | (left <= 0)
        taken = F.least(left, F.length(section["content"]))
        return F.struct(
            F.when(over, state["used"]).otherwise(state["used"] + F.length(section["header"]) + taken).alias("used"), over.alias("over"),
            F.when(over, state["takes"]).otherwise(F.concat(state["takes"], F.array(taken))).alias("takes"),
        )

    folded = lists.withColumn("_takes", F.aggregate("_l", empty, step)["takes"])
    taken = folded.select("request_id", F.posexplode(F.arrays_zip(F.slice("_l", F.lit(1), F.size("_takes")).alias("s"), F.col("_takes").alias("n"))).alias("_i", "_z"), "_l", "_takes")
    used = F.aggregate(F.slice("_l", F.lit(1), F.col("_i") + 1), F.lit(0), lambda a, s: a + F.length(s["header"])) + F.aggregate(
        F.slice("_takes", F.lit(1), F.col("_i") + 1), F.lit(0), lambda a, n: a + n)
    return taken.select(
        "request_id", F.col("_z.s.pick").alias("pick"), F.col("_z.s.section_id").alias("section_id"), F.col("_z.s.header").alias("header"),
        F.substring(F.col("_z.s.content"), F.lit(1), F.col("_z.n")).alias("text"), used.alias("used_chars"),
    )
