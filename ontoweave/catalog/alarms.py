"""Alarm chain queries: every event row becomes an alarm text that is parsed back and judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoweave.catalog.base import View, ctes, query
from ontoweave.plans import alarms

PHRASES = [
    "直流线路低电压保护动作并复归", "故障穿越再启动命令出现", "阀冷主循环泵异常告警", "换流变分接头由5档升至6档操作完成",
    "交流滤波器投入站用变分接调整", "断路器跳闸持续未复归", "未见跳闸现象", "A套与B套指令响应不一致差异", "闭锁顺序进入闭锁状态", "录波启动功率控制解锁",
]
PICK = "cast(floor(value) as bigint)"


def case_of(index: str, words: list[str]) -> str:
    return "case " + " ".join(f"when {index} % {len(words)} = {i} then '{w}'" for i, w in enumerate(words)) + " end"


FIELDS = {
    "event_id": "event_id", "kind": "event_type", "chain_id": "concat(cast(user_id as string), '-', cast(cast(ts as date) as string))",
    "t0": "substring(cast(ts as string), 1, 19)", "t1": "concat(cast(cast(ts as date) as string), ' 23:59:59')",
    "station": case_of("user_id", ["锦屏换流站", "复龙换流站", "南桥换流站", "奉贤换流站"]),
    "device": case_of("event_id", ["极1直流线路", "主循环泵P01", "换流变A相", "交流滤波器561", "测控装置"]),
    "etype": case_of("user_id", ["保护", "告警", "操作"]), "s1": case_of(PICK, PHRASES), "s2": case_of(f"({PICK} + 3)", PHRASES),
    "nature": "case when value > 50 then '异常' else '正常' end", "level": "cast(1 + event_id % 5 as int)",
}
# An event takes long to parse for its few packed bytes.
BASE = View("events", FIELDS, heavy=True, task_bytes=1 << 18)


def _strict_text(n: int, summary: str) -> str:
    return (
        f"concat('{n}. ', t0, ' 至 ', t1, '，站点：', station, '，设备：', device, '，事件类型：', etype, '，二级摘要：', {summary}, "
        "'，事件性质：', nature, '，告警等级：', cast(level as string))"
    )


LABELLED = "站点：', station, '，设备：', device, '，事件类型：', etype, '，摘要：', s1, '，事件性质：', nature, '，告警等级：', cast(level as string))"
TEXT = (
    f"case when kind = 'purchase' then concat({_strict_text(1, 's1')}, '；', {_strict_text(2, 's2')}) when kind = 'click' then {_strict_text(7, 's1')} "
    f"when kind = 'view' then concat(t0, ' 至 ', t1, '；{LABELLED} when kind = 'error' then concat('记录 ', t0, ' ', s1, '。', t1, ' ', s2) else concat(station, ' 巡视记录 ', s1) end"
)
RAW_VIEW = "concat(t0, ' 至 ', t1, ';" + LABELLED.replace("：", ":").replace("，", ",")
EXPECTED = f"""SELECT event_id AS source_id, chain_id, 1 AS sequence, t0 AS start_time, t1 AS end_time, station AS station_name, device AS device_name, etype AS event_type, s1 AS summary, nature AS event_nature_text, level AS alarm_level, '' AS raw_text, 'high' AS parse_quality FROM e WHERE kind = 'purchase'
UNION ALL SELECT event_id, chain_id, 2, t0, t1, station, device, etype, s2, nature, level, '', 'high' FROM e WHERE kind = 'purchase'
UNION ALL SELECT event_id, chain_id, 7, t0, t1, station, device, etype, s1, nature, level, '', 'high' FROM e WHERE kind = 'click'
UNION ALL SELECT event_id, chain_id, 1, t0, t1, station, device, etype, s1, nature, level, {RAW_VIEW}, 'high' FROM e WHERE kind = 'view'
UNION ALL SELECT event_id, chain_id, 1, t0, t0, station, '', '', s1 || '。', '', 2, t0 || ' ' || s1 || '。', 'low' FROM e WHERE kind = 'error'
UNION ALL SELECT event_id, chain_id, 2, t1, t1, station, '', '', s2, '', 2, t1 || ' ' || s2, 'low' FROM e WHERE kind = 'error'
UNION ALL SELECT event_id, chain_id, 1, '', '', station, '', '', station || ' 巡视记录 ' || s1, '', CASE WHEN contains(s1, '5') THEN 5 ELSE 99 END, station || ' 巡视记录 ' || s1, 'raw' FROM e WHERE kind = 'signup'"""


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(x, '{w}')" for w in words) + ")"


def flags_sql() -> str:
    lock = f"(contains(x, '闭锁') AND NOT ({_any(alarms.BENIGN_LOCK)} AND NOT {_any(alarms.TRUE_LOCK)}))"
    context = (
        f"(NOT regexp_matches(x, '{alarms.DENIED_BEFORE}') AND NOT regexp_matches(x, '{alarms.DENIED_AFTER}') AND NOT {_any(alarms.CLEARED)}"
        f" AND NOT (contains(x, '停运') AND {_any(alarms.PLANNED_STOP)}) AND NOT (contains(x, '闭锁顺序') AND NOT {_any(alarms.LOCK_ACTIONS)}))"
    )
    abnormal = _any(alarms.ABNORMAL_TERMS)
    flags = {
        "normal_completion": _any(alarms.NORMAL_TERMS), "abnormal_signal": abnormal,
        "severe_signal": f"({_any(alarms.SEVERE_TERMS)} OR {lock})", "negative_outcome": f"({_any(alarms.NEGATIVE_TERMS)} AND {context})",
        "recorder": _any(["录波"]), "protection": _any(alarms.PROTECTION_TERMS), "control_switch": _any(alarms.SWITCH_TERMS),
        "operation": _any(alarms.OPERATION_TERMS),
        "valve_cooling_abnormal": f"(contains(x, '阀冷') AND {abnormal} AND NOT {_any(alarms.COOLING_NAMES)})",
    }
    systems = ", ".join(f"CASE WHEN {_any(w)} THEN '{n}' END" for n, w in alarms.SUBSYSTEMS.items())
    cols = ", ".join(f"{v} AS {k}" for k, v in flags.items())
    return (
        "fx AS (SELECT *, concat_ws(' ', station_name, device_name, event_type, summary, raw_text) AS x FROM p), "
        f"fl AS (SELECT *, coalesce(nullif(concat_ws(',', {systems}), ''), 'unknown') AS subsystems, {cols} FROM fx)"
    )


def _seen(words: list[str], name: str) -> str:
    return f"bool_or({_any(words)}) AS {name}"


FEATURES = f"""ft AS (SELECT chain_id, min(start_time) AS window_start, max(coalesce(nullif(end_time, ''), start_time)) AS window_end, count(*) AS event_count,
  {_seen(alarms.RIDE_THROUGH, 'has_ride_through')}, {_seen(alarms.TAP_WORDS, 'tw')}, {_seen(alarms.TAP_DEVICES, 'td')}, bool_or(protection) AS has_protection, bool_or(control_switch) AS has_control_switch,
  bool_or(abnormal_signal) AS has_abnormal, bool_or(severe_signal) AS has_severe, bool_or(valve_cooling_abnormal) AS has_valve_cooling_abnormal, bool_or(negative_outcome) AS has_negative_outcome, bool_or(normal_completion) AS has_completion,
  bool_or(recorder) AS has_recorder, bool_or(operation) AS has_operation, bool_or(regexp_matches(x, '{alarms.CONTROL_DIFFERENCE}')) AS has_control_difference, bool_or(regexp_matches(x, '{alarms.TAP_INCONSISTENT}')) AS has_tap_inconsistency,
  min(CASE WHEN alarm_level = 0 THEN 99 ELSE alarm_level END) AS min_alarm_level, max(alarm_level) AS max_alarm_level,
  {", ".join(f"bool_or(regexp_matches(x, '{p}')) AS p_{k}" for k, p in alarms.TRIGGER_PATTERNS.items())} FROM fl GROUP BY 1),
sy AS (SELECT chain_id, string_agg(DISTINCT s, ',' ORDER BY s) AS subsystems FROM (SELECT chain_id, unnest(string_split(subsystems, ',')) AS s FROM fl) GROUP BY 1),
feat AS (SELECT ft.*, tw AND td AS has_tap_change, subsystems FROM ft JOIN sy USING (chain_id))"""
PARSED = ctes(e=BASE, p=EXPECTED)
OUT = ["chain_id", "sequence", "start_time", "end_time", "station_name", "device_name", "event_type", "summary", "event_nature_text", "alarm_level", "raw_text", "parse_quality"]


def parsed(spark, sf):
    rows = BASE.df(spark, sf)
    station = F.when(F.col("kind") == "error", F.col("station")).otherwise("")
    return alarms.parse_events(rows.select("chain_id", F.expr(TEXT).alias("event_text"), station.alias("station_name")))


@query("alarm_parse_events", PARSED + f" SELECT {', '.join(OUT)} FROM p")
def alarm_parse_events(spark, sf):
    return parsed(spark, sf).select(*OUT)


@query("alarm_event_flags", PARSED + f", {flags_sql()} SELECT chain_id, sequence, start_time, summary, subsystems, {', '.join(alarms.FLAGS)} FROM fl")
def alarm_event_flags(spark, sf):
    return alarms.with_flags(parsed(spark, sf)).select("chain_id", "sequence", "start_time", "summary", "subsystems", *alarms.FLAGS)


FEATURE_COLUMNS = [
    "chain_id", "window_start", "window_end", "event_count", "subsystems", "min_alarm_level", "max_alarm_level", "has_ride_through", "has_tap_change",
    "has_control_difference", "has_tap_inconsistency", "has_negative_outcome", "has_completion", "has_severe", "has_abnormal",
]


def features(spark, sf):
    return alarms.chain_features(alarms.with_flags(parsed(spark, sf)))


@query("alarm_chain_features", PARSED + f", {flags_sql()}, {FEATURES} SELECT {', '.join(FEATURE_COLUMNS)} FROM feat")
def alarm_chain_features(spark, sf):
    return features(spark, sf).select(*FEATURE_COLUMNS)


JUDGED = """CASE WHEN has_negative_outcome THEN '异常' WHEN has_ride_through AND has_completion THEN '正常' WHEN has_protection AND has_completion THEN '正常' WHEN has_abnormal THEN '需核查' WHEN has_operation OR has_completion THEN '正常' ELSE '证据不足' END AS event_nature,
  CASE WHEN has_ride_through OR has_protection THEN '严重' WHEN has_severe OR min_alarm_level <= 2 THEN '较高' WHEN has_abnormal THEN '一般' ELSE '低' END AS risk_level,
  CASE WHEN has_ride_through THEN CASE WHEN has_control_switch THEN '直流线路故障穿越及控保系统切换' ELSE '直流线路保护动作及故障穿越' END WHEN has_valve_cooling_abnormal THEN '阀冷系统异常及伴随事件' WHEN has_tap_change THEN '换流变分接开关档位调整'
    WHEN list_contains(string_split(subsystems, ','), 'ac_filter') AND list_contains(string_split(subsystems, ','), 'station_power') THEN '换流器解锁及交流滤波器/站用电联动操作'
    WHEN list_contains(string_split(subsystems, ','), 'dc_control') AND has_operation THEN '直流控制操作及伴随事件' WHEN has_recorder THEN '故障录波启动及伴随告警' WHEN has_abnormal THEN '二次设备异常告警' ELSE '站内连续运行事件' END AS judged_type"""


@query("alarm_chain_judgement", PARSED + f", {flags_sql()}, {FEATURES} SELECT chain_id, {JUDGED} FROM feat")
def alarm_chain_judgement(spark, sf):
    return alarms.judge(features(spark, sf)).select("chain_id", "event_nature", "risk_level", "judged_type")


def _trigger(name: str, matched: str, near: str | None, out: str) -> str:
    middle = f" WHEN {near} THEN 'related_but_not_matched'" if near else ""
    return f"SELECT chain_id, '{name}' AS trigger_id, CASE WHEN {matched} THEN 'matched'{middle} WHEN {out} THEN 'not_matched' ELSE 'unknown' END AS status FROM feat"


_REL, _FIN = "has_tap_change AND has_control_difference", "has_tap_change AND has_completion"


@query("alarm_chain_triggers", PARSED + f", {flags_sql()}, {FEATURES} " + " UNION ALL ".join([
    _trigger("tap_inconsistency_alarm", "has_tap_inconsistency", _REL, _FIN),
    _trigger("tap_adjustment_failed_or_unfinished", "p_tap_adjustment_failed_or_unfinished", None, _FIN),
    _trigger("tap_mechanism_abnormal", "p_tap_mechanism_abnormal", None, "has_tap_change"),
    _trigger("tap_position_difference_over_2", "p_tap_position_difference_over_2", _REL, _FIN),
    _trigger("tap_motor_power_trip", "p_tap_motor_power_trip", None, "has_tap_change"),
    _trigger("protection_action", "has_protection", None, "true"),
    _trigger("trip_lockout_or_negative_outcome", "has_negative_outcome", None, "true"),
]))
def alarm_chain_triggers(spark, sf):
    return alarms.match_triggers(features(spark, sf))


@query("alarm_select_events", PARSED + f", {flags_sql()}" + """
SELECT chain_id, sequence, summary, 'abnormal' AS selection FROM fl WHERE abnormal_signal OR severe_signal OR negative_outcome
UNION ALL SELECT chain_id, sequence, summary, 'companion' FROM fl WHERE (recorder OR normal_completion) AND NOT severe_signal
UNION ALL SELECT chain_id, sequence, summary, 'main' FROM fl WHERE operation OR protection OR severe_signal""")
def alarm_select_events(spark, sf):
    flagged = alarms.with_flags(parsed(spark, sf))
    kinds = F.array(*[F.when(alarms.event_test(k), F.lit(k)) for k in ("abnormal", "companion", "main")])
    picked = flagged.select("chain_id", "sequence", "summary", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("selection"))
    return picked


@query("alarm_timeline", PARSED + """
SELECT chain_id, sequence, start_time, sequence || '. ' || coalesce(nullif(start_time, ''), '时间未抽取') || ' 至 ' || coalesce(nullif(end_time, ''), '时间未抽取') || '，' || coalesce(nullif(device_name, ''), '设备未抽取') || '，' ||
  coalesce(nullif(event_type, ''), '事件类型未抽取') || '，告警等级' || alarm_level || '：' || summary AS line FROM p""")
def alarm_timeline(spark, sf):
    return alarms.timeline(parsed(spark, sf)).select("chain_id", "sequence", "start_time", "line")


@query("alarm_tap_changes", PARSED + r"""
SELECT chain_id, sequence, start_time, '分接头由' || regexp_extract(summary, '由([0-9]+)档', 1) || '档升至' || regexp_extract(summary, '升至([0-9]+)档', 1) || '档' AS tap_change FROM p WHERE contains(summary, '升至')""")
def alarm_tap_changes(spark, sf):
    rows = parsed(spark, sf).select("chain_id", "sequence", "start_time", alarms.tap_change(F.col("summary")).alias("tap_change"))
    return rows.filter("tap_change <> ''")
