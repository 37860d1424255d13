"""Case judgement with provenance: facts of an alarm chain carry its triggers, evidence sections back them, the conclusion names both.

Everything about one chain is a function of its feature row, so facts, triggers and conclusion
are columns of that row. Only evidence comes from elsewhere: it is ranked once per scenario
and station, and chains meet it by that key.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.numeric import computed_once
from ontoweave.functions.text import any_of, stable_id
from ontoweave.operators import retrieval
from ontoweave.operators.grouping import first_wins
from ontoweave.operators.ordering import top_per_group
from ontoweave.operators.signs import first_match
from ontoweave.plans import alarms
from ontoweave.plans.evidence import PRIMARY_ROLE

# --- fixed values of the domain ---------------------------------------------------------
# Facts in their order: (id, category, label, condition, text where it holds, text where not); without the last the fact is left out where it fails.
FACTS = [
    ("event_count", "", "事件数量", "event_count > 0", "用户输入共解析出{event_count}条事件。", ""),
    ("station", "", "站点", "station_name <> ''", "事件链站点为{station_name}。", ""),
    ("transformer_tap_change", "tap_operation", "分接开关/分接头调节", "has_tap_change", "事件摘要包含分接开关操作、分接头或档位调整描述。", ""),
    ("control_response_difference", "control_response", "A/B套响应或指令下发差异", "has_control_difference", "事件摘要出现A/B套时间差、响应不一致或指令下发存在异常等线索。", ""),
    ("tap_position_inconsistency", "tap_position", "分接头/档位不一致", "has_tap_inconsistency", "事件摘要明确出现分接头不一致、不同步或档位差线索。", ""),
    ("tap_software_position_jump", "tap_signal", "档位软件/BCD码跳变", "has_tap_jump", "事件摘要出现档位BCD码或软件档位跳变线索。", ""),
    ("normal_completion", "completion", "操作完成/信号复归", "has_completion", "事件摘要包含完成、复归或消失等结果线索。", ""),
    ("protection_action", "protection_action", "保护动作", "has_protection", "事件摘要中出现保护动作相关表述。", "事件摘要中未见保护动作相关表述。"),
    ("abnormal_signal", "abnormal_signal", "异常/轻微故障信号", "has_abnormal", "事件摘要中出现异常、轻微故障或差异响应线索。", "事件摘要中未见异常、轻微故障或差异响应线索。"),
    ("negative_outcome", "negative_outcome", "失败、跳闸、闭锁、持续告警等后果", "has_negative_outcome", "事件摘要中存在失败、跳闸、闭锁、持续或未复归等后果性线索。", "事件摘要中未见失败、跳闸、闭锁、持续或未复归等后果性线索。"),
]
TAP_UNSHOWN = "存在分接开关或分接头档位调整"
# Basis of a trigger: (trigger, status) -> (text, facts that carry it). A trigger that is not listed with its status has no facts.
_TAP, _DONE, _DIFF = "transformer_tap_change", "normal_completion", "control_response_difference"
BASES = {
    ("tap_inconsistency_alarm", "matched"): ("事件摘要出现分接头/档位不一致、不同步或档位差等同类事实。", [_TAP, "tap_position_inconsistency"]),
    ("tap_inconsistency_alarm", "related_but_not_matched"): ("事件中A/B套指令或响应差异与分接调节相关，但它属于控制响应差异，不等同于分接头/档位不一致。", [_TAP, _DIFF]),
    ("tap_inconsistency_alarm", "not_matched"): ("事件仅描述分接开关操作和档位调整完成，未见不一致或档位差告警。", [_TAP, _DONE]),
    ("tap_adjustment_failed_or_unfinished", "matched"): ("事件摘要出现无法调节、失败、未完成、未复归或持续告警线索。", ["negative_outcome"]),
    ("tap_adjustment_failed_or_unfinished", "not_matched"): ("事件摘要明确出现操作完成或完成类线索，未见失败或不复归。", [_TAP, _DONE]),
    ("tap_mechanism_abnormal", "matched"): ("事件摘要出现机构异常、变形、脱扣或滑档相关线索。", [_TAP, "abnormal_signal"]),
    ("tap_mechanism_abnormal", "not_matched"): ("事件摘要未见传动机构异常、变形、脱扣或滑档描述。", [_TAP]),
    ("tap_position_difference_over_2", "matched"): ("事件摘要出现档位差超过阈值的线索。", [_TAP, "abnormal_signal"]),
    ("tap_position_difference_over_2", "related_but_not_matched"): ("事件中A/B套指令时间差与分接操作相关，但未出现相间档位差、超过2档或持续不同步等同类事实。", [_TAP, _DIFF]),
    ("tap_position_difference_over_2", "not_matched"): ("事件摘要只给出一次档位调整完成，未见档位差超过阈值或持续不同步。", [_TAP, _DONE]),
    ("tap_motor_power_trip", "matched"): ("事件摘要出现分接开关电机电源或小开关跳开线索。", [_TAP, "negative_outcome"]),
    ("tap_motor_power_trip", "not_matched"): ("事件摘要未见电机电源小开关跳开或电源异常描述。", [_TAP]),
    ("protection_action", "matched"): ("事件摘要中出现保护动作相关表述。", ["protection_action"]),
    ("protection_action", "not_matched"): ("事件摘要未见保护动作、保护出口或故障穿越表述。", ["protection_action"]),
    ("trip_lockout_or_negative_outcome", "matched"): ("事件摘要中存在跳闸、闭锁、失败、持续或未复归等后果线索。", ["negative_outcome"]),
    ("trip_lockout_or_negative_outcome", "not_matched"): ("事件摘要未见跳闸、闭锁、失败、持续或未复归等后果线索。", ["negative_outcome"]),
}
NO_BASIS = "当前事件摘要不足以确认该触发条件。"
# Words that make a chosen section back a trigger; a trigger takes its first sections.
TRIGGER_WORDS = {
    "tap_": ["分接", "档位"], "protection_action": ["保护", "故障穿越", "低电压"],
    "trip_lockout_or_negative_outcome": ["闭锁", "跳闸", "停运", "告警"],
}
TRIGGER_SECTIONS, CASE_SECTIONS = 3, 4
# Scenarios in the order of their names: (name, feature, words of a section that belongs to it).
SCENARIOS = [
    ("transformer_tap_change", "has_tap_change", ["分接头", "分接开关", "档位"]),
    ("valve_cooling_abnormal", "has_valve_cooling_abnormal", ["阀冷", "内水冷", "主循环泵"]),
    ("dc_line_fault_ride_through", "has_ride_through", ["直流线路", "低电压", "故障穿越", "再启动"]),
]
FRONT_HEADINGS = ["前言", "目录", "目 录"]
USEFUL_ROLES = ["handling_rule", "severe_signal", "abnormal_signal"]
PRIMARY_NAME, OTHER_NAME = "第五分册", "补充文档"
# Phrases of the description: (word in the events or none, condition on the chain, phrase).
PHRASES = [
    ("低电压保护", "true", "直流线路低电压保护动作并复归"),
    ("再启动", "true", "故障穿越再启动命令短时出现"),
    ("", "has_control_switch", "控保系统发生A/B套切换或差异响应"),
    ("解锁", "true", "换流器解锁过程完成"),
    ("滤波器", "true", "交流滤波器及无功设备投退"),
    ("分接", "true", "换流变/变压器分接头调节"),
    ("", "has_recorder", "多个录波启动信号短时出现后消失"),
    ("自监视", "has_abnormal", "测控自监视异常及轻微故障告警出现后复归"),
]
WITHOUT_EVIDENCE = "未检索到可直接支撑结论的正文证据，以下仅按用户给出的事件事实作保守研判："
# Reasons: the first condition that holds; {risk_level} stands for the risk.
REASONS = [
    ("保护动作、故障穿越/再启动和控保响应按时序发生，且文本中可见复归、完成或未见停运跳闸等后果；性质可判为正常响应，但因涉及直流线路保护和故障穿越，风险等级为严重。", "has_ride_through and event_nature = '正常'"),
    ("事件涉及直流线路保护、故障穿越或再启动，且存在未复归、失败、闭锁、跳闸等不利后果线索，应按严重风险异常处理。", "has_ride_through"),
    ("事件链中存在未复归、失败、持续、闭锁、跳闸或停运等后果性线索，已超出普通操作伴随信号。", "event_nature = '异常'"),
    ("事件链包含自监视异常、轻微故障、A/B套响应差异或短时告警等异常信号，但同时存在复归/消失/完成线索，暂不宜直接判为严重异常，需要核查录波、保护出口和实时量。", "event_nature = '需核查'"),
    ("本次只见分接开关/分接头档位调整并完成；第五分册中用于识别分接开关异常的触发条件，如分接头不一致、调节失败/未完成、机构异常、档位差超限或电机电源跳开，在事件摘要中均未命中，因此按正常操作研判，风险等级评为{risk_level}。", "event_nature = '正常' and has_tap_change and exists(triggers, t -> t.trigger_id like 'tap%' and t.status = 'not_matched') and not exists(triggers, t -> t.trigger_id like 'tap%' and t.status = 'matched')"),
    ("事件主要表现为操作、控制或保护逻辑中的短时信号，且有复归、消失或完成线索；未见失败、持续告警、跳闸或闭锁后果，风险等级评为{risk_level}。", "event_nature = '正常'"),
]
NO_REASON = "当前摘要缺少保护出口、实时量、录波和告警复归状态，无法可靠判断性质。"

SCENARIO_FLAGS = [feature for _, feature, _ in SCENARIOS]


def case_features(flagged: DataFrame) -> DataFrame:
    """Feature row of every chain with its judgement, station, tap change and the words its description needs: one aggregation."""
    body = F.concat_ws(" ", "event_type", "summary", "raw_text")
    whole = F.concat_ws(" ", "station_name", "device_name", body)
    order = ("sequence", "start_time", "event_id")
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct(*order, c.alias("v"))))["v"]
    words = {w for w, _, _ in PHRASES if w}
    more = [
        first(F.coalesce("station_name", F.lit(""))).alias("station_name"),
        F.coalesce(*[first(alarms.shown_tap_change(whole, *shape)) for shape in alarms.TAP_SHAPES], F.lit("")).alias("tap_change"),
        *[F.coalesce(F.bool_or(body.contains(w)), F.lit(False)).alias(f"_says_{w}") for w in sorted(words)],
    ]
    return alarms.judge(alarms.chain_features(flagged, *more))


def _filled(text: str) -> Column:
    """A fixed text whose {name} stands for a column."""
    head, _, rest = text.partition("{")
    if not rest:
        return F.lit(text)
    name, _, tail = rest.partition("}")
    return F.concat(F.lit(head), F.col(name).cast("string"), _filled(tail))


def with_facts(features: DataFrame) -> DataFrame:
    """``facts``: the observed facts of a chain in their order, as (fact_id, fact_category, label, value, basis)."""
    values = {
        "event_count": F.col("event_count").cast("string"), "station": F.col("station_name"),
        "transformer_tap_change": F.when(F.col("tap_change") != "", F.col("tap_change")).otherwise(TAP_UNSHOWN),
    }

    def fact(name: str, category: str, label: str, test: str, yes: str, no: str) -> Column:
        holds = F.expr(test)
        row = F.struct(
            F.lit(name).alias("fact_id"), F.lit(category).alias("fact_category"), F.lit(label).alias("label"),
            values.get(name, holds.cast("string")).alias("value"), F.when(holds, _filled(yes)).otherwise(no).alias("basis"),
        )
        return row if no else F.when(holds, row)

    return features.withColumn("facts", F.filter(F.array(*[fact(*f) for f in FACTS]), lambda f: f.isNotNull()))


def with_triggers(features: DataFrame) -> DataFrame:
    """``triggers``: (trigger_id, status, basis, fact_ids) of each; tap triggers only where the chain changes taps."""
    def trigger(name: str, conditions) -> Column:
        status = first_match(list(zip(alarms.TRIGGER_STATES, conditions)), "unknown")
        basis, facts = F.lit(NO_BASIS), F.array().cast("array<string>")
        for (owner, state), (text, ids) in BASES.items():
            if owner == name:
                basis = F.when(status == state, text).otherwise(basis)
                facts = F.when(status == state, F.array(*map(F.lit, ids))).otherwise(facts)
        row = F.struct(F.lit(name).alias("trigger_id"), status.alias("status"), basis.alias("basis"), facts.alias("fact_ids"))
        return F.when(F.col("has_tap_change"), row) if name.startswith("tap_") else row

    rows = F.array(*[trigger(*t) for t in alarms.TRIGGERS.items()])
    return computed_once(features, triggers=F.filter(rows, lambda t: t.isNotNull()))


def _section_order(tap: Column, same: Column) -> list[Column]:
    """Best section first: for tap changes those of the scenario, then main handbook, own station, scenario, useful role, score."""
    return [
        (~(tap & F.col("scenario_hit"))).cast("int"), (~(F.coalesce("doc_role", F.lit("")) == PRIMARY_ROLE)).cast("int"), (~same).cast("int"),
        (~F.col("scenario_hit")).cast("int"), (~F.coalesce(F.col("evidence_role").isin(USEFUL_ROLES), F.lit(False))).cast("int"),
        -F.coalesce("score", F.lit(0.0)), F.col("chunk_id"),
    ]


def case_sections(chains: DataFrame, sections: DataFrame, limit: int = CASE_SECTIONS) -> DataFrame:
    """``refs`` for every (scenario features, station_name) of ``chains``: the best sections, one per title and heading.

    ``sections``: chunk_id, title, heading, content, doc_role, evidence_role, station, score. Tables of
    contents are left out. A section of the chain's own station goes before others of its kind, so the best
    of all stations and the best of the own one hold every section that can be chosen: no section is
    paired with each station. The first of a title and heading stands for it.
    """
    keys = [*SCENARIO_FLAGS, "station_name"]
    asked = chains.select(*keys).distinct()
    scenarios = asked.select(*SCENARIO_FLAGS).distinct()
    text = F.concat_ws(" ", "title", "heading", "content")
    belongs = F.array(*[any_of(text, words) for _, _, words in SCENARIOS])
    body = computed_once(sections, _belongs=belongs, _toc=retrieval.is_toc(F.col("heading"), F.col("content")))
    body = body.filter(~F.col("_toc")).drop("_toc").withColumn("_front", F.coalesce(F.col("heading"), F.lit("")).isin(FRONT_HEADINGS))
    tap_words = SCENARIOS[0][2]
    body = body.withColumn("matched_keywords", F.filter(F.array(*[F.when(text.contains(w), w) for w in tap_words]), lambda w: w.isNotNull()))
    hit = ~F.col("_front") & F.exists(F.arrays_zip(F.array(*SCENARIO_FLAGS).alias("on"), F.col("_belongs").alias("fits")), lambda z: z["on"] & z["fits"])
    # Eight scenarios exist; a section is copied to those that some chain has.
    every = F.array(*[F.struct(*[F.lit(on).alias(c) for c, on in zip(SCENARIO_FLAGS, flags)]) for flags in product([False, True], repeat=len(SCENARIO_FLAGS))])
    copies = body.drop("content").select("*", F.inline(every)).join(scenarios, SCENARIO_FLAGS, "left_semi")
    fitted = copies.withColumn("scenario_hit", hit).drop("_belongs", "_front")
    slim = fitted.select(
        *SCENARIO_FLAGS, F.coalesce("title", F.lit("")).alias("title"), F.coalesce("heading", F.lit("")).alias("heading"), "chunk_id", "doc_role", "evidence_role",
        F.coalesce("station", F.lit("")).alias("station"), F.col("score").cast("double").alias("score"), "scenario_hit", "matched_keywords",
    )
    order = _section_order(F.col("has_tap_change"), F.lit(False))

    def best(groups: list[str]) -> DataFrame:
        heads = first_wins(slim, [*groups, "title", "heading"], order)
        return top_per_group(heads, groups, order, limit).drop("rank")

    everywhere = asked.join(best(SCENARIO_FLAGS), SCENARIO_FLAGS)
    own = best([*SCENARIO_FLAGS, "station"]).filter("station <> ''")
    own = asked.join(own.withColumn("station_name", F.col("station")), keys)
    own_first = _section_order(F.col("has_tap_change"), F.col("station") == F.col("station_name"))
    merged = first_wins(everywhere.unionByName(own.select(*everywhere.columns)), [*keys, "title", "heading"], own_first)
    chosen = top_per_group(merged, keys, own_first, limit)
    name = F.coalesce(*[F.when(F.col(feature), scenario) for scenario, feature, _ in SCENARIOS], F.lit(""))
    ref = F.struct(
        "rank", "chunk_id", "title", "heading", F.coalesce("doc_role", F.lit("")).alias("doc_role"), F.coalesce("evidence_role", F.lit("")).alias("evidence_role"),
        F.when(F.col("scenario_hit"), name).otherwise("").alias("scenario_match"),
        F.when(F.col("scenario_hit") & F.col("has_tap_change"), F.col("matched_keywords")).otherwise(F.array().cast("array<string>")).alias("matched_keywords"),
    )
    listed = chosen.groupBy(*keys).agg(F.sort_array(F.collect_list(ref)).alias("refs"))  # at most ``limit`` a key
    # A tap change is judged by the sections about it alone, if there are any.
    about = F.filter("refs", lambda r: r["scenario_match"] != "")
    return listed.withColumn("refs", F.when(F.col("has_tap_change") & (F.size(about) > 0), about).otherwise(F.col("refs")))


def _backing(trigger: Column) -> Column:
    """Sections among the chain's references that back a trigger, best first."""
    def fits(words: list[str]) -> Column:
        def test(r: Column) -> Column:
            said = F.concat_ws(" ", r["title"], r["heading"], r["doc_role"], r["evidence_role"], r["scenario_match"])
            return any_of(said, words) | F.arrays_overlap(r["matched_keywords"], F.array(*map(F.lit, words)))

        return F.slice(F.transform(F.filter("refs", test), lambda r: r["chunk_id"].cast("string")), 1, TRIGGER_SECTIONS)

    out = F.array().cast("array<string>")
    for owner, words in TRIGGER_WORDS.items():
        out = F.when(trigger["trigger_id"].startswith(owner), fits(words)).otherwise(out)
    return out


def with_conclusion(cases: DataFrame) -> DataFrame:
    """Adds evidence_ids to the triggers, and evidence_summary, description and reason."""
    shown = lambda r: F.concat(
        F.when(r["doc_role"] == PRIMARY_ROLE, PRIMARY_NAME).otherwise(OTHER_NAME), F.lit("《"), F.coalesce(F.nullif(r["title"], F.lit("")), F.lit("未命名文档")),
        F.lit("》“"), F.coalesce(F.nullif(r["heading"], F.lit("")), F.lit("未命名章节")), F.lit("”"))
    phrases = F.concat_ws("，", *[F.when((F.col(f"_says_{w}") if w else F.lit(True)) & F.expr(test), phrase) for w, test, phrase in PHRASES])
    summary = F.array_join(F.transform("refs", shown), "；")
    opening = F.when(F.size("refs") > 0, F.concat(F.lit("文档依据："), F.col("evidence_summary"), F.lit("。事件事实显示"))).otherwise(WITHOUT_EVIDENCE)
    reason = F.replace(first_match(REASONS, NO_REASON), F.lit("{risk_level}"), F.col("risk_level"))
    backed = F.transform("triggers", lambda t: t.withField("evidence_ids", _backing(t)))
    return (
        cases.withColumn("evidence_summary", summary)
        .withColumn("description", F.concat(F.coalesce(F.nullif("station_name", F.lit("")), F.lit("该站")), F.coalesce(F.nullif(phrases, F.lit("")), F.concat(F.lit("发生"), F.col("judged_type"))), F.lit("。")))
        .withColumn("reason", F.concat(opening, reason)).withColumn("triggers", backed)
    )


def judge_cases(flagged: DataFrame, sections: DataFrame, limit: int = CASE_SECTIONS) -> DataFrame:
    """One row per chain: judgement, facts, triggers with their facts and sections, refs, description and reason.

    ``flagged``: events with flags (:func:`alarms.with_flags`). Chains without any section keep an empty ``refs``.
    """
    features = with_triggers(with_facts(case_features(flagged)))
    refs = case_sections(features, sections, limit)
    none = F.filter(F.array(), lambda r: F.lit(False))
    keys = [*SCENARIO_FLAGS, "station_name"]
    joined = features.join(refs, keys, "left")
    joined = joined.withColumn("refs", F.coalesce("refs", none.cast(refs.schema["refs"].dataType)))
    return with_conclusion(joined).drop(*[c for c in joined.columns if c.startswith("_")])


def conclusions(cases: DataFrame) -> DataFrame:
    """Adds ``conclusion_id``: a hash of what was concluded and of the facts and sections behind it."""
    said = F.to_json(F.struct("judged_type", "event_nature", "risk_level", "description", "reason", "facts", "triggers", "refs"))
    return cases.withColumn("conclusion_id", F.concat(F.lit("concl_"), stable_id(said, 16)))


def stored_conclusions(cases: DataFrame) -> DataFrame:
    """Conclusions as rows of the domain object: lists as JSON."""
    lists = {"observed_facts": "facts", "trigger_match": "triggers", "evidence_refs": "refs"}
    return cases.select(
        "conclusion_id", F.col("description").alias("event_description"), F.col("judged_type").alias("event_type"), "event_nature", "risk_level", "reason",
        "evidence_summary", *[F.to_json(c).alias(name) for name, c in lists.items()],
    ).dropDuplicates(["conclusion_id"])


def case_events(flagged: DataFrame) -> DataFrame:
    """Events of each chain for a reader: ``timeline`` and the ids of its main, companion and abnormal events, in order.

    Lists all events of a chain in one row, so it is for the chains of one question.
    """
    lines = alarms.timeline(flagged).select("event_id", "line")
    kinds = {f"{kind}_events": F.when(alarms.event_test(kind), F.struct("sequence", "start_time", "event_id")) for kind in alarms.EVENT_KINDS}
    listed = flagged.join(lines, "event_id").groupBy("chain_id").agg(
        F.sort_array(F.collect_list(F.struct("sequence", "start_time", "event_id", "line"))).alias("timeline"),
        *[F.sort_array(F.collect_list(picked)).alias(name) for name, picked in kinds.items()],
    )
    return listed.select("chain_id", F.transform("timeline", lambda t: t["line"]).alias("timeline"), *[F.transform(k, lambda t: t["event_id"]).alias(k) for k in kinds])
