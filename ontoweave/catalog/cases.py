"""Case judgement queries: every alarm chain with the facts, triggers and evidence sections behind its conclusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoweave.catalog.alarms import FEATURES, JUDGED, PARSED, case_of, flags_sql, parsed
from ontoweave.catalog.base import View, query
from ontoweave.catalog.docs import OCC
from ontoweave.plans import alarms, cases, evidence

SEARCH = "thation erhe"
SECTIONS = View("documents", {
    "chunk_id": "doc_id", "title": "concat('规程', source)", "content": "text",
    "heading": case_of("doc_id", ["分接开关档位调整", "阀冷系统 主循环泵", "直流线路低电压保护动作", "目录", "前言 一", "前言", "跳闸后的告警"]),
    "doc_role": "case when lang = 'fr' then 'emergency_procedure' when lang = 'de' then 'control_protection_spec' else 'document' end",
    "evidence_role": "case when source = 'src4' then 'handling_rule' else 'definition' end",
    "station": case_of("doc_id", ["锦屏换流站", "", "复龙换流站", "", "南桥换流站"]),
}, heavy=True)


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _tap_sql(head: str, pattern: str) -> str:
    part = lambda i: f"regexp_extract(x, '{pattern}', {i})"
    return f"min(CASE WHEN {part(1)} <> '' THEN '{head}' || {part(1)} || '档' || {part(2)} || {part(3)} || '档' END)"


WORDS = sorted({w for w, _, _ in cases.PHRASES if w})
SAYS = {w: f"says_{i}" for i, w in enumerate(WORDS)}
CASES = f""", {flags_sql()}, {FEATURES},
ex AS (SELECT chain_id, first(station_name ORDER BY sequence, start_time) AS station_name, coalesce({_tap_sql(*alarms.TAP_SHAPES[0])}, {_tap_sql(*alarms.TAP_SHAPES[1])}, '') AS tap_change,
  bool_or({" OR ".join(f"regexp_matches(x, '{p}')" for p in alarms.TAP_JUMPS)}) AS has_tap_jump,
  {", ".join(f"bool_or(contains(event_type || ' ' || summary || ' ' || raw_text, '{w}')) AS {c}" for w, c in SAYS.items())} FROM fl GROUP BY 1),
cs AS MATERIALIZED (SELECT *, {JUDGED} FROM feat JOIN ex USING (chain_id))"""


def _filled_sql(text: str) -> str:
    return "'" + text.replace("{event_count}", "' || event_count || '").replace("{station_name}", "' || station_name || '") + "'"


def _fact_sql(name: str, category: str, label: str, test: str, yes: str, no: str) -> str:
    value = {"event_count": "CAST(event_count AS VARCHAR)", "station": "station_name",
             "transformer_tap_change": f"coalesce(nullif(tap_change, ''), '{cases.TAP_UNSHOWN}')"}.get(name, f"CAST({test} AS VARCHAR)")
    basis = f"CASE WHEN {test} THEN {_filled_sql(yes)} ELSE '{no}' END"
    return f"SELECT chain_id, '{name}' AS fact_id, '{category}' AS fact_category, '{label}' AS label, {value} AS value, {basis} AS basis FROM cs" + ("" if no else f" WHERE {test}")


_POINTS = " + ".join(f"least({OCC.format(t=t, n=len(t))}, 8) * 2.5::DOUBLE" if len(t) >= 4 else f"least({OCC.format(t=t, n=len(t))}, 8)" for t in evidence.query_terms(SEARCH))
_ORDER = f"""(has_tap_change AND hit) DESC, (doc_role = '{evidence.PRIMARY_ROLE}') DESC, (station <> '' AND station = station_name) DESC, hit DESC, (evidence_role IN {_list(cases.USEFUL_ROLES)}) DESC, score DESC, chunk_id"""
_KEYS = "has_tap_change, has_valve_cooling_abnormal, has_ride_through, station_name"
_NAME = "CASE " + " ".join(f"WHEN {feature} THEN '{name}'" for name, feature, _ in cases.SCENARIOS) + " ELSE '' END"
# Every section ranked for every scenario and station that some chain has.
REFS = f""",
sl AS (SELECT *, lower(title || chr(10) || heading || chr(10) || content) AS low, title || ' ' || heading || ' ' || content AS txt FROM ({SECTIONS.sql()})),
sh AS (SELECT *, {_POINTS} AS hits FROM sl WHERE heading <> '目录'),
sc AS (SELECT *, hits + CASE WHEN evidence_role = 'handling_rule' THEN 8 ELSE 0 END + CASE WHEN doc_role = '{evidence.PRIMARY_ROLE}' THEN 100 ELSE 0 END AS score FROM sh WHERE hits > 0),
asked AS (SELECT DISTINCT {_KEYS} FROM cs),
pr AS (SELECT asked.*, sc.*, heading NOT IN {_list(cases.FRONT_HEADINGS)} AND ({" OR ".join(f"({feature} AND {_has('txt', words)})" for _, feature, words in cases.SCENARIOS)}) AS hit FROM asked, sc),
fs AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY {_KEYS}, title, heading ORDER BY {_ORDER}) = 1),
tp AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY {_ORDER}) AS rank FROM fs QUALIFY rank <= {cases.CASE_SECTIONS}),
ab AS (SELECT *, CASE WHEN hit THEN {_NAME} ELSE '' END AS scenario_match, hit AND has_tap_change AND {_has('txt', ['分接'])} AS tap_word, hit AND has_tap_change AND {_has('txt', ['档位'])} AS place_word,
  bool_or(hit) OVER (PARTITION BY {_KEYS}) AS any_hit FROM tp),
rf AS (SELECT *, title || ' ' || heading || ' ' || doc_role || ' ' || evidence_role || ' ' || scenario_match AS said FROM ab WHERE NOT (has_tap_change AND any_hit) OR hit)"""


def _backs(words: list[str]) -> str:
    # A keyword found in a section counts only as a whole keyword; of the words asked for, only one is a keyword.
    more = " OR place_word" if "档位" in words else ""
    return f"({_has('said', words)}{more})"


_BACKED = {name: f"{'tap' if name.startswith('tap_') else name}_ids" for name in alarms.TRIGGERS}
BACKING = """,
bk AS (SELECT {keys}, {cols} FROM rf GROUP BY ALL)""".format(keys=_KEYS, cols=", ".join(
    f"coalesce(array_to_string((list(chunk_id ORDER BY rank) FILTER (WHERE {_backs(words)}))[1:{cases.TRIGGER_SECTIONS}], ','), '') AS {'tap' if owner == 'tap_' else owner}_ids"
    for owner, words in cases.TRIGGER_WORDS.items()))


def _test(condition: str) -> str:
    return condition.replace("_p_", "p_")


def _trigger_sql(name: str, conditions: tuple[str, str, str]) -> str:
    states = list(zip(alarms.TRIGGER_STATES, conditions))
    pick = lambda value, rest: "CASE " + " ".join(f"WHEN {_test(c)} THEN '{value(s)}'" for s, c in states if c != "false") + f" ELSE '{rest}' END"
    basis = lambda s: cases.BASES.get((name, s), (cases.NO_BASIS, []))
    return (
        f"SELECT chain_id, '{name}' AS trigger_id, {pick(lambda s: s, 'unknown')} AS status, {pick(lambda s: basis(s)[0], cases.NO_BASIS)} AS basis, "
        f"{pick(lambda s: ','.join(basis(s)[1]), '')} AS fact_ids, coalesce({_BACKED[name]}, '') AS evidence_ids FROM cb" + (" WHERE has_tap_change" if name.startswith("tap_") else "")
    )


TRIGGERS = CASES + REFS + BACKING + f""",
cb AS (SELECT cs.*, bk.* EXCLUDE ({_KEYS}) FROM cs LEFT JOIN bk USING ({_KEYS})),
tr AS ({" UNION ALL ".join(_trigger_sql(*t) for t in alarms.TRIGGERS.items())})"""
_CALM = "exists(triggers, t -> t.trigger_id like 'tap%' and t.status = 'not_matched') and not exists(triggers, t -> t.trigger_id like 'tap%' and t.status = 'matched')"
_REASON = "CASE " + " ".join(f"WHEN {test.replace(_CALM, 'calm')} THEN replace('{text}', '{{risk_level}}', risk_level)" for text, test in cases.REASONS) + f" ELSE '{cases.NO_REASON}' END"
_PHRASES = ", ".join(f"CASE WHEN {(SAYS[w] + ' AND ') if w else ''}{test} THEN '{phrase}' END" for w, test, phrase in cases.PHRASES)


def judged(spark, sf):
    sections = evidence.merged_searches(SECTIONS.df(spark, sf), [(SEARCH, "")], True)
    return cases.judge_cases(alarms.with_flags(parsed(spark, sf)), sections)


@query("alarm_case_facts", PARSED + CASES + " " + " UNION ALL ".join(_fact_sql(*f) for f in cases.FACTS))
def alarm_case_facts(spark, sf):
    return cases.with_facts(cases.case_features(alarms.with_flags(parsed(spark, sf)))).select("chain_id", F.inline("facts"))


@query("alarm_case_triggers", PARSED + TRIGGERS + " SELECT * FROM tr")
def alarm_case_triggers(spark, sf):
    rows = judged(spark, sf).select("chain_id", F.inline("triggers"))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("fact_ids", "evidence_ids")})


@query("alarm_case_judgement", PARSED + TRIGGERS + f""",
sm AS (SELECT {_KEYS}, string_agg(CASE WHEN doc_role = '{evidence.PRIMARY_ROLE}' THEN '{cases.PRIMARY_NAME}' ELSE '{cases.OTHER_NAME}' END || '《' || title || '》“' || heading || '”', '；' ORDER BY rank) AS evidence_summary,
  string_agg(chunk_id, ',' ORDER BY rank) AS evidence_ids FROM rf GROUP BY ALL),
tm AS (SELECT chain_id, bool_or(trigger_id LIKE 'tap%' AND status = 'not_matched') AND NOT bool_or(trigger_id LIKE 'tap%' AND status = 'matched') AS calm, coalesce(string_agg(trigger_id, ',' ORDER BY trigger_id) FILTER (WHERE status = 'matched'), '') AS matched_triggers FROM tr GROUP BY 1)
SELECT chain_id, judged_type, event_nature, risk_level, coalesce(evidence_ids, '') AS evidence_ids, matched_triggers,
  coalesce(nullif(station_name, ''), '该站') || coalesce(nullif(concat_ws('，', {_PHRASES}), ''), '发生' || judged_type) || '。' AS description,
  CASE WHEN evidence_ids IS NULL THEN '{cases.WITHOUT_EVIDENCE}' ELSE '文档依据：' || evidence_summary || '。事件事实显示' END || {_REASON} AS reason FROM cs LEFT JOIN sm USING ({_KEYS}) JOIN tm USING (chain_id)""")
def alarm_case_judgement(spark, sf):
    met = F.filter("triggers", lambda t: t["status"] == "matched")
    return judged(spark, sf).select(
        "chain_id", "judged_type", "event_nature", "risk_level", "description", "reason",
        F.array_join(F.transform("refs", lambda r: r["chunk_id"].cast("string")), ",").alias("evidence_ids"),
        F.array_join(F.array_sort(F.transform(met, lambda t: t["trigger_id"])), ",").alias("matched_triggers"),
    )
