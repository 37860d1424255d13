"""Case judgement: facts, triggers and sections of a chain, on small cases."""

from pyspark.sql import functions as F

from ontoweave.library import full_registry
from ontoweave.model import ontology_from_dict
from ontoweave.plans import alarms, cases
from ontoweave.repository import ObjectRepository

SECTION = "chunk_id string, title string, heading string, content string, doc_role string, evidence_role string, station string, score double"
TAP = "1. 2024-01-01 10:00:00 至 2024-01-01 10:01:00，站点：锦屏换流站，设备：换流变A相，事件类型：操作，二级摘要：换流变分接头由5档升至6档操作完成，事件性质：正常，告警等级：4"


def _flagged(spark, *texts):
    rows = spark.createDataFrame([(f"c{i}", t, "") for i, t in enumerate(texts)], "chain_id string, event_text string, station_name string")
    return alarms.with_flags(alarms.parse_events(rows))


def _sections(spark, *rows):
    return spark.createDataFrame(list(rows), SECTION)


def test_tap_case(spark):
    found = _sections(
        spark, ("k1", "手册", "分接开关处理", "x", cases.PRIMARY_ROLE, "handling_rule", "", 5.0), ("k2", "手册", "分接开关处理", "y", cases.PRIMARY_ROLE, "handling_rule", "", 4.0),
        ("k3", "手册", "目录", "分接", cases.PRIMARY_ROLE, "handling_rule", "", 99.0), ("k4", "规范", "概述", "档位", "document", None, "锦屏换流站", 1.0),
        ("k5", "规范", "阀冷", "阀冷", "document", "definition", None, None), ("k6", None, None, None, None, None, None, None),
    )
    row = cases.judge_cases(_flagged(spark, TAP), found).first()
    assert (row["judged_type"], row["event_nature"], row["risk_level"]) == ("换流变分接开关档位调整", "正常", "低")
    assert [r["chunk_id"] for r in row["refs"]] == ["k1", "k4"]  # one of a heading, no contents, only what is about taps
    facts = {f["fact_id"]: f for f in row["facts"]}
    assert facts["transformer_tap_change"]["value"] == "分接头由5档升至6档" and facts["station"]["basis"] == "事件链站点为锦屏换流站。"
    assert list(facts) == ["event_count", "station", "transformer_tap_change", "normal_completion", "protection_action", "abnormal_signal", "negative_outcome"]
    triggers = {t["trigger_id"]: t for t in row["triggers"]}
    assert len(triggers) == len(alarms.TRIGGERS) and {t["status"] for t in triggers.values()} == {"not_matched"}
    assert triggers["tap_mechanism_abnormal"]["evidence_ids"] == ["k1", "k4"] and triggers["protection_action"]["evidence_ids"] == []
    assert all(set(t["fact_ids"]) <= set(facts) for t in triggers.values())
    assert "均未命中" in row["reason"] and row["reason"].startswith("文档依据：第五分册《手册》“分接开关处理”；补充文档《规范》“概述”。")


def test_case_without_evidence_or_events(spark):
    row = cases.judge_cases(_flagged(spark, "断路器跳闸"), _sections(spark)).first()
    assert row["refs"] == [] and row["reason"].startswith(cases.WITHOUT_EVIDENCE) and row["event_nature"] == "异常"
    assert row["description"] == "该站发生站内连续运行事件。" and [t["trigger_id"] for t in row["triggers"]] == ["protection_action", "trip_lockout_or_negative_outcome"]
    assert cases.judge_cases(_flagged(spark, "").filter("false"), _sections(spark)).count() == 0


def test_own_station_is_chosen_among_many(spark):
    rows = [(f"a{i:03d}", "手册", f"h{i}", "x", "document", "definition", "", 50.0 + i) for i in range(40)]
    rows += [(f"b{i:03d}", "手册", f"s{i}", "x", "document", "definition", f"甲{i}站", 1.0) for i in range(40)]
    texts = [TAP.replace("锦屏换流站", f"甲{i}站").replace("换流变分接头由5档升至6档操作完成", "阀冷巡视完成") for i in (3, 17, 99)]
    refs = {r["station_name"]: [x["chunk_id"] for x in r["refs"]] for r in cases.judge_cases(_flagged(spark, *texts), _sections(spark, *rows)).collect()}
    general = ["a039", "a038", "a037", "a036"]
    assert refs == {"甲3站": ["b003", *general[:3]], "甲17站": ["b017", *general[:3]], "甲99站": general}


def test_registered_case_functions(spark):
    memory = {"type": "runtime_memory"}
    shape = lambda text: {"source": memory, "properties": [{"name": f.split()[0], "type": f.split()[1], "required": i == 0} for i, f in enumerate(text.split(", "))]}
    repo = ObjectRepository(spark, ontology_from_dict({"objects": {
        "EvidenceChunk": shape("chunk_id str, title str, heading str, content str, doc_role str, evidence_role str"), "StationEvent": shape("event_id str, summary str, alarm_level int"),
        "EventConclusion": shape("conclusion_id str, event_description str, event_type str, event_nature str, risk_level str, reason str, observed_facts str, trigger_match str"),
    }}))
    repo.provide("EvidenceChunk", spark.createDataFrame([("k1", "手册", "分接开关 处理", "分接开关 档位", cases.PRIMARY_ROLE, "handling_rule")], repo.object("EvidenceChunk").schema))
    reg = full_registry(repo)
    case = reg.call("build_substation_case_context", event_text=TAP).first()
    assert case["timeline"][0].startswith("1. 2024-01-01 10:00:00") and case["abnormal_events"] == [] and case["main_events"] == case["companion_events"] and len(case["main_events"]) == 1
    assert [r["chunk_id"] for r in case["refs"]] == ["k1"] and repo.df("StationEvent").count() == 1
    first = reg.call("format_substation_conclusion", event_text=TAP).first()
    again = reg.call("format_substation_conclusion", event_text=TAP).first()
    assert first["conclusion_id"] == again["conclusion_id"] == reg.call("judge_substation_case", event_text=TAP).first()["conclusion_id"]
    assert repo.df("EventConclusion").select("event_nature", F.get_json_object("observed_facts", "$[0].fact_id")).collect() == [("正常", "event_count")]
