"""Evidence for a question about station alarms: several searches merged, ranked and deduplicated."""

from __future__ import annotations

from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.functions import text as tx
from ontoweave.functions.numeric import computed_once
from ontoweave.operators import retrieval
from ontoweave.operators.grouping import first_wins
from ontoweave.operators.ordering import top_per_group
from ontoweave.plans.alarms import ABNORMAL_TERMS, NORMAL_TERMS, SEVERE_TERMS, SUBSYSTEMS

# --- fixed values of the domain ---------------------------------------------------------
PRIMARY_ROLE, SPEC_ROLE = "emergency_procedure", "control_protection_spec"
INTENTS = [
    ("diagnosis", ["是否异常", "是不是异常", "风险", "意味着什么", "说明什么", "判断", "研判"]),
    ("concept", ["是什么意思", "什么含义", "是什么", "解释", "概念", "A/B套", "A套", "B套", "双套"]),
    ("handling", ["怎么处理", "如何处理", "处置", "预案", "应急"]),
]
REDUNDANCY_WORDS = ["A/B套", "A套", "B套", "双套", "冗余", "值班", "备用", "active", "standby"]
TAP_WORDS = ["分接", "档位", "站用变", "降压变", "指令下发", "时间差"]
REDUNDANCY_SEARCHES = [
    ("控制保护系统 双套 冗余 值班 备用 active standby 系统切换", SPEC_ROLE),
    ("直流控制 主设备 冗余 两套系统 值班系统 备用系统 切换逻辑", SPEC_ROLE),
]
TAP_SEARCHES = [
    ("分接开关 档位 不一致 控制系统 切换 信号回路", PRIMARY_ROLE),
    ("换流变 分接开关 档位不一致 无法调节 备用控制系统", PRIMARY_ROLE),
    ("分接开关 控制系统 冗余 指令 同步 A套 B套", SPEC_ROLE),
]
HANDLING_SUFFIX = " 设备异常 故障应急 处理 复归 跳闸 闭锁"
# Searches of a question: (words of the question, its intents, searches to run); empty words or intents ask nothing.
# {query} stands for the question.
SEARCH_PLAN = [
    (REDUNDANCY_WORDS, (), REDUNDANCY_SEARCHES),
    (TAP_WORDS, (), TAP_SEARCHES),
    ((), ("diagnosis", "handling"), [("{query}" + HANDLING_SUFFIX, PRIMARY_ROLE)]),
    ((), (), [("{query}", "")]),
]
# Points of a chunk: (intents, words of the question, role, words of the chunk, whether they must be there, points, points otherwise).
ANSWER_POINTS = [
    (("concept",), (), SPEC_ROLE, (), True, 80.0, 0.0),
    (("concept",), (), "", ("冗余", "双重化", "两套系统", "值班", "备用", "Active", "Standby", "active", "standby"), True, 50.0, 0.0),
    (("concept",), (), PRIMARY_ROLE, ("控制保护主机", "冗余", "双套"), False, -60.0, 0.0),
    (("diagnosis", "handling"), (), PRIMARY_ROLE, (), True, 80.0, 0.0),
    (("diagnosis", "handling"), (), "", ("处理", "处理原则", "处理预案", "异常", "不一致", "无法调节"), True, 35.0, 0.0),
    ((), ("分接", "档位", "站用变", "降压变"), "", ("分接", "分接开关", "档位"), True, 60.0, -50.0),
    ((), ("A/B", "A套", "B套", "双套"), "", ("A套", "B套", "双套", "两套系统", "冗余", "值班", "备用", "Active", "Standby"), True, 45.0, 0.0),
]
TOC_PENALTY = 200.0
STATION_BOOST = 35.0


def _asked(query: str, intent: str, words, intents) -> bool:
    """Whether a row of a table is for this question."""
    return (not words or any(w in query for w in words)) and (not intents or intent in intents)


def question_intent(query: str) -> str:
    return next((intent for intent, words in INTENTS if _asked(query, "", words, ())), "document_answer")


def query_terms(query: str) -> list[str]:
    """Search terms of a question: aliases of the subsystems it names, state words, and its own words."""
    terms: list[str] = []
    for aliases in SUBSYSTEMS.values():
        if any(a in query for a in aliases):
            terms += aliases
    terms += [t for t in NORMAL_TERMS + ABNORMAL_TERMS + SEVERE_TERMS if t in query]
    terms += regex.findall(r"[A-Za-z0-9_.#/-]{2,}|[一-鿿]{2,}", query)
    return list(dict.fromkeys(t.strip() for t in terms if t.strip())) or ([query.strip()] if query.strip() else [])


def scenario_searches(query: str, intent: str) -> list[tuple[str, str]]:
    """(query text, document role) pairs to run for a question, the question itself last."""
    rows = [searches for words, intents, searches in SEARCH_PLAN if _asked(query, intent, words, intents)]
    return list(dict.fromkeys((text.replace("{query}", query), role) for searches in rows for text, role in searches))


def _with_hits(chunks: DataFrame, searches: list[tuple[str, str]], prefer_primary: bool) -> DataFrame:
    """Chunks with ``is_toc`` and ``_hits``: (search, score) of every search that finds them, in one pass.

    ``chunks``: chunk_id, title, heading, content, doc_role, evidence_role.
    """
    hay = F.concat_ws("\n", "title", "heading", "content")
    boosts = F.when(F.col("evidence_role").isin("handling_rule", "severe_signal", "abnormal_signal"), 8.0).otherwise(0.0)
    if prefer_primary:
        boosts = boosts + F.when(F.col("doc_role") == PRIMARY_ROLE, 100.0).otherwise(0.0)

    def one(i: int, text: str, role: str) -> Column:
        hits = retrieval.keyword_score(hay, query_terms(text))
        fits = hits > 0 if not role else (hits > 0) & (F.col("doc_role") == role)
        score = hits + boosts - F.when(F.col("is_toc"), 80.0).otherwise(0.0)
        return F.when(fits & (score > 0), F.struct(F.lit(i).alias("search"), score.alias("score")))

    toc = computed_once(chunks, is_toc=retrieval.is_toc(F.col("heading"), F.col("content")))
    return computed_once(toc, _hits=F.filter(F.array(*[one(i, t, r) for i, (t, r) in enumerate(searches)]), lambda x: x.isNotNull()))


def scored_searches(chunks: DataFrame, searches: list[tuple[str, str]], prefer_primary: bool, keep: int) -> DataFrame:
    """The best ``keep`` chunks of every search."""
    runs = _with_hits(chunks, searches, prefer_primary).select("*", F.inline("_hits")).drop("_hits")
    return top_per_group(runs, ["search"], [F.col("score").desc(), F.col("chunk_id")], keep).drop("rank")


def merged_searches(chunks: DataFrame, searches: list[tuple[str, str]], prefer_primary: bool) -> DataFrame:
    """Every chunk that some search finds, once, with its best score: no shuffle, and no search loses a row."""
    found = _with_hits(chunks, searches, prefer_primary).filter(F.size("_hits") > 0)
    return found.withColumn("score", F.array_max(F.transform("_hits", lambda h: h["score"]))).drop("_hits")


def answer_rank(query: str, intent: str) -> Column:
    """Score of a merged chunk for this kind of question."""
    text = F.concat_ws(" ", "title", "heading", "content")

    def points(role: str, words, wanted: bool, yes: float, no: float) -> Column:
        test = (F.col("doc_role") == role) if role else F.lit(True)
        if words:
            test = test & (tx.any_of(text, list(words)) == F.lit(wanted))
        return F.when(test, yes).otherwise(no)

    rows = [rest for intents, asked, *rest in ANSWER_POINTS if _asked(query, intent, asked, intents)]
    start = F.col("score") - F.when(F.col("is_toc"), TOC_PENALTY).otherwise(0.0)
    return reduce(lambda total, row: total + points(*row), rows, start)


def answer_context(chunks: DataFrame, query: str, limit: int = 5, station: str = "") -> DataFrame:
    """Evidence for a question: best chunk per (title, heading), no tables of contents."""
    intent = question_intent(query)
    merged = merged_searches(chunks, scenario_searches(query, intent), intent in ("diagnosis", "handling"))
    if station:
        merged = merged.withColumn("score", F.col("score") + F.when(F.col("title").contains(station), STATION_BOOST).otherwise(0.0))
    ranked = merged.filter(~F.col("is_toc")).withColumn("answer_score", answer_rank(query, intent))
    best = first_wins(ranked.withColumn("_o", -F.col("answer_score")), ["title", "heading"], ["_o", "chunk_id"]).drop("_o")
    return best.orderBy(F.col("answer_score").desc(), "chunk_id").limit(limit)
