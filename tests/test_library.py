import pytest

from ontoweave.library import full_registry, remove_documents
from ontoweave.model import ontology_from_dict
from ontoweave.repository import ObjectRepository


def _objects(**shapes):
    memory = {"type": "runtime_memory"}
    return {n: {"source": memory, "properties": [{"name": f.split()[0], "type": f.split()[1], "required": i == 0} for i, f in enumerate(s.split(", "))]} for n, s in shapes.items()}


def _rows(spark, repo, name, *rows):
    repo.provide(name, spark.createDataFrame(list(rows), repo.object(name).schema))


def test_grid_functions(spark):
    repo = ObjectRepository(spark, ontology_from_dict({"objects": _objects(
        AccessRequest="request_id str, lng float, lat float, load_level str, importance_level str, source_structure str, preferred_point_types str, capacity_kva float",
        ExpandRequest="request_id str, lng float, lat float, load_level str, importance_level str, target_source_structure str, capacity_kva float, original_point_id str",
        AccessPoint="point_id str, point_type str, feeder_id str, lng float, lat float, spare_intervals int",
        Feeder="feeder_id str, busbar_id str, substation_id str, transformer_id str, max_load_rate float, openable_capacity_kva float, connected_users int, loss_rate float",
        MainTransformer="transformer_id str, substation_id str, rated_capacity_kva float, load_rate float, openable_capacity_kva float, spare_intervals int",
        Substation="substation_id str, lng float, lat float", FeederTieSwitch="switch_id str, source_feeder_id str, target_feeder_id str",
        TransformerTieSwitch="switch_id str, source_transformer_id str, target_transformer_id str",
        SourceRequirement="requirement_id str, load_level str, importance_level str, source_structure str",
        FeederLoadTransfer="transfer_id str, request_id str, source_feeder_id str, target_feeder_id str, transfer_capacity_kva float, source_load_rate_after float",
        TransformerLoadTransfer="transfer_id str, request_id str, source_transformer_id str, target_transformer_id str, transfer_capacity_kva float, source_load_rate_after float",
        AccessPlan="plan_id str, request_id str, source_structure str, operation_mode str, point_ids str, total_distance_m float",
    ), "functions": {"dispatch_something": {}}}))
    _rows(spark, repo, "AccessRequest", ("R1", 100.0, 30.0, "L", "I", "双回路", "", 800.0))
    _rows(spark, repo, "ExpandRequest", ("R2", 100.0, 30.0, "L", "I", "单电源", 800.0, "P2"))
    _rows(spark, repo, "AccessPoint", ("P1", "环网柜", "F1", 100.001, 30.0, 3), ("P2", "环网柜", "F2", 100.002, 30.0, 1), ("P3", "架空线", "F1", 100.003, 30.0, 0))
    _rows(spark, repo, "Feeder", ("F1", "B1", "S1", "T1", 0.5, 3000.0, 10, 0.03), ("F2", "B2", "S1", "T1", 0.8, 3000.0, 10, 0.03))
    _rows(spark, repo, "MainTransformer", ("T1", "S1", 20000.0, 0.5, 9000.0, 1), ("T2", "S1", 20000.0, 0.75, 9000.0, 1))
    _rows(spark, repo, "Substation", ("S1", 100.01, 30.0))
    _rows(spark, repo, "FeederTieSwitch", ("W1", "F2", "F1"))
    _rows(spark, repo, "TransformerTieSwitch", ("X1", "T1", "T2"))
    _rows(spark, repo, "SourceRequirement", ("Q1", "L", "I", "双电源"))
    reg = full_registry(repo)
    assert reg.call("get_request", request_id="R2").first()["request_type"] == "ExpandRequest"
    assert reg.call("validate_source_requirement", request_id="R1").first()["passed"] == 0
    assert {r["point_id"] for r in reg.call("search_sources", request_id="R1").collect()} == {"P1", "P2", "P3"}
    screened = {r["point_id"]: r["reasons"] for r in reg.call("filter_sources", request_id="R1", point_ids="P1,P2", per_path_capacity_kva=800).collect()}
    assert screened == {"P1": "", "P2": "F1,F3"}
    assert reg.call("compose_plans", request_id="R1", source_structure="双回路").count() == 6
    final = reg.call("finalize_plans", request_id="R1").collect()
    assert len(final) == 3 and all(r["point_ids"] == "P1,P2" for r in final)
    moved = reg.call("transfer_feeder_load", request_id="R1", source_feeder_id="F2", required_capacity_kva=100.0).first()
    assert moved["target"] == "F1" and moved["target_load_rate_after"] == round((0.5 * 3000 + 100) / 3100, 3)
    assert reg.call("transfer_transformer_load", request_id="R1", source_transformer_id="T1", required_capacity_kva=2000.0).first()["remedy"] == "考虑 new_feeder"
    assert reg.call("new_feeder", request_id="R1").first()["transformer_id"] == "T1"
    assert [r["point_id"] for r in reg.call("search_supplementary_sources", request_id="R2").orderBy("point_id").collect()] == ["P1", "P3"]
    before = reg.call("verify_transfer_result", request_id="R2").first()
    reg.call("transfer_feeder_load", request_id="R2", source_feeder_id="F2", required_capacity_kva=100.0)
    after = reg.call("verify_transfer_result", request_id="R2").first()
    assert (before["feeder_openable_after"], after["feeder_openable_after"]) == (3000.0, 3100.0) and after["next_action"] == "补充电源点/回路"
    assert reg.call("get_feeder_tie_switches", source_feeder_id="F1").count() == 1
    assert reg.call("dispatch_something").first()["status"] == "not_implemented"


def test_emergency_functions(spark):
    repo = ObjectRepository(spark, ontology_from_dict({"objects": _objects(
        DisasterEvent="event_id str, lng float, lat float", AccidentEvent="event_id str, lng float, lat float, casualty_info str",
        RoadSegment="segment_id str, road_name str, lng float, lat float", Bridge="bridge_id str, name str, lng float, lat float", Tunnel="tunnel_id str, name str, lng float, lat float",
        EmergencyDepot="depot_id str, lng float, lat float", RescueTeam="team_id str, available int, lng float, lat float", DroneBase="base_id str, name str, lng float, lat float",
        Drone="drone_id str, status str, base_id str", DroneOperator="operator_id str, available int", AirspaceRule="rule_id str, airspace_type str",
    )}))
    _rows(spark, repo, "DisasterEvent", ("D1", 100.0, 30.0))
    _rows(spark, repo, "AccidentEvent", ("A1", 100.0, 30.0, "none"))
    _rows(spark, repo, "RoadSegment", ("r1", "G1", 100.01, 30.0), ("r2", "G2", 101.0, 30.0))
    _rows(spark, repo, "Bridge", ("b1", "bridge", 100.02, 30.0))
    _rows(spark, repo, "DroneBase", ("base", "Base", 100.1, 30.0))
    _rows(spark, repo, "Drone", ("d1", "可用", "base"), ("d2", "维护中", "base"))
    _rows(spark, repo, "AirspaceRule", ("x", "urban"), ("y", "rural"))
    reg = full_registry(repo)
    assert reg.call("get_event", event_id="A1").first()["event_type"] == "AccidentEvent"
    assert {r["facility_id"] for r in reg.call("get_affected_facilities", event_id="D1").collect()} == {"r1", "b1"}
    assert [r["drone_id"] for r in reg.call("get_drones_in_range", lng=100.0, lat=30.0).collect()] == ["d1"]
    assert reg.call("lookup_airspace_rule", airspace_type="urban").count() == 1
    with pytest.raises(KeyError):
        reg.call("unknown")


def test_removed_documents_leave_every_table(spark):
    tables = {
        "documents": spark.createDataFrame([("a",), ("b",)], "document_id string"),
        "relations": spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source_document_id string, target_document_id string"),
    }
    left = remove_documents(tables, spark.createDataFrame([("b",)], "document_id string"))
    assert left["documents"].count() == 1 and [tuple(r) for r in left["relations"].collect()] == [("c", "d")]


def test_launch_functions(spark):
    repo = ObjectRepository(spark, ontology_from_dict({"objects": _objects(
        LaunchMission="mission_id str, safety_interlock str", FlowEdge="edge_id str, from_node str, to_node str, phase str",
        FlowNode="node_id str, mission_id str, node_name str, status str, command str, preconditions_met str, error_message str",
        NodeDefinition="node_name str, phase str, subsystem_type str, command str", SubsystemConfig="subsystem_id str, subsystem_type str, name str",
        ServiceReservation="reservation_id str, mission_id str, subsystem_type str, status str", SafetyInterlockEvent="event_id str, mission_id str, trigger_type str, status str",
        EmergencyAction="action_id str, mission_id str, action_type str, target_subsystem str, trigger_reason str",
    ), "functions": {}}))
    _rows(spark, repo, "LaunchMission", ("M1", "正常"), ("M2", "触发"))
    _rows(spark, repo, "FlowEdge", ("E1", "开始", "同步触发", "p"), ("E2", "同步触发", "泵浦触发准备", "p"), ("E3", "缺", "开关触发准备", "p"))
    _rows(spark, repo, "NodeDefinition", *[(n, "p", "S", f"run {n}") for n in ("同步触发", "泵浦触发准备", "开关触发准备")])
    _rows(spark, repo, "SubsystemConfig", ("S1", "泵浦", "S2"), ("S2", "同步", "x"))
    reg = full_registry(repo)
    assert reg.call("get_subsystem", subsystem_id="S2").first()["subsystem_type"] == "同步" and reg.call("get_subsystem", subsystem_id="泵浦").first()["subsystem_id"] == "S1"
    assert reg.call("get_node_status", mission_id="M1", node_name="同步触发").first()["status"] == "not_started"
    early = reg.call("execute_node", mission_id="M1", node_name="泵浦触发准备").first()
    assert (early["status"], early["preconditions_met"]) == ("failed", "未满足: 同步触发")
    states = {r["node_name"]: r["status"] for r in reg.call("trigger_sync", mission_id="M1").collect()}
    assert states == {"同步触发": "completed", "泵浦触发准备": "completed", "开关触发准备": "failed"}
    assert reg.call("get_node_status", mission_id="M1", node_name="泵浦触发准备").first()["status"] == "completed" and repo.count("FlowNode") == 4
    assert reg.call("execute_parallel_nodes", mission_id="M2", node_names="同步触发").first()["status"] == "blocked" and repo.count("FlowNode") == 4
    assert reg.call("reserve_subsystems", mission_id="M1", subsystem_types="泵浦, 同步").count() == 2 == repo.count("ServiceReservation")
    assert reg.call("check_interlock", mission_id="M2").first()["interlock_status"] == "触发"
    assert reg.call("trigger_interlock", mission_id="M1", trigger_type="人工").count() == 1 == repo.count("SafetyInterlockEvent")
    assert reg.call("emergency_action", mission_id="M1", action_type="能量泄放").first()["target_subsystem"] == "泵浦分系统" and repo.count("EmergencyAction") == 1


def test_scheme_functions(spark):
    checks = "feeder_available_capacity_ok bool, feeder_load_rate_ok bool, transformer_available_capacity_ok bool, transformer_load_rate_ok bool"
    repo = ObjectRepository(spark, ontology_from_dict({"objects": _objects(
        HighVoltageConnectionRequest="request_id str, business_type str, supply_voltage_kv float, approved_contract_capacity_kva float, total_receiving_transformer_capacity_kva float, "
        "user_importance_level str, load_level str, requested_power_source_count int, requested_operation_mode str, receiving_point_coordinate str",
        ExpansionOriginalSupplyInfo="original_supply_info_id str, request_id str, original_access_point_id str, original_feeder_id str, original_transformer_id str, incremental_capacity_kva float",
        ConnectionReasoningConfig="config_id str, request_id str, allowed_source_device_types list[str], enable_new_substation_outgoing_line bool, pms_preselected_source_type str",
        PowerAccessPoint="access_point_id str, device_type str, coordinate str, distance_to_receiving_point_m float, feeder_id str, busbar_id str, substation_id str, incoming_source_id str, available_bay_count int, is_available bool",
        Feeder="feeder_id str, substation_id str, historical_max_load_rate float, current_load_rate float, available_capacity_kva float, connected_user_count int, line_loss_rate_after_connection float",
        SubstationTransformer="transformer_id str, substation_id str, available_capacity_kva float, current_load_rate float",
        Substation="substation_id str, coordinate str", SubstationOutgoingBay="outgoing_bay_id str, substation_id str, transformer_id str, is_available bool",
        FeederTieSwitch="switch_id str, source_feeder_id str, target_feeder_id str", ConnectionScopeRule="rule_id str, allowed_business_types list[str], required_supply_voltage_kv float, max_total_receiving_transformer_capacity_kva float",
        PowerSupplyModeRule="rule_id str, user_importance_level str, load_level str, required_supply_mode str, minimum_route_count int, minimum_source_count int, source_independence_requirement str",
        ExistingAccessPointConstraintRule="rule_id str, max_feeder_historical_load_rate float", NewSubstationOutgoingLineTriggerRule="rule_id str, single_route_capacity_threshold_kva float",
        NewSubstationOutgoingLineFeasibilityRule="rule_id str, search_radius_km float", RedlineBoundaryDeviceRule="rule_id str, boundary_device_type str",
        SchemeScoringRule="rule_id str, distance_weight float, max_output_count int",
        ScopeValidationResult="validation_id str, request_id str, is_in_scope bool, failed_reasons list[str]",
        SupplyModeDecision="decision_id str, request_id str, required_supply_mode str, minimum_route_count int, minimum_source_count int, required_different_substations bool, required_different_busbars bool",
        PowerSourceSearchBatch="search_batch_id str, request_id str, stopped_radius_m float, found_access_point_ids list[str], distinct_feeder_count int, satisfies_required_line_count bool",
        AccessPointCapacityCheck="check_id str, request_id str, access_point_id str, single_route_capacity_kva float, is_directly_usable bool, requires_load_transfer bool, failed_constraints list[str], " + checks,
        OriginalSupplyCapacityCheck="check_id str, request_id str, original_supply_info_id str, is_original_supply_usable bool, requires_load_transfer bool, failed_constraints list[str], " + checks,
        LoadTransferPlan="transfer_plan_id str, request_id str, overloaded_object_type str, overloaded_feeder_id str, overloaded_transformer_id str, receiver_feeder_id str, receiver_transformer_id str, is_feasible bool, infeasible_reason str",
        NewSubstationOutgoingLineDecision="decision_id str, request_id str, is_triggered bool, trigger_reasons list[str], selected_substation_id str, is_feasible bool, no_solution_reason str",
        CandidateConnectionScheme="scheme_id str, request_id str, scheme_source_type str, operation_mode str, selected_access_point_ids list[str], route_count int, power_source_count int, total_supply_distance_m float",
        SchemeScore="score_id str, request_id str, scheme_id str, total_score float, rank int", RankedConnectionSchemeSet="result_id str, request_id str, scheme_ids list[str], generation_status str, no_solution_reason str",
        NoAvailableConnectionSchemeConclusion="conclusion_id str, request_id str, failed_constraints list[str], explanation str",
    ), "functions": {}}))
    _rows(spark, repo, "HighVoltageConnectionRequest", ("R1", "增容", 10.0, 900.0, 0.0, "一级", "一级负荷", 1, "", "100.0,30.0"), ("R2", "销户", 35.0, 900.0, 0.0, "x", "x", 1, "", ""))
    _rows(spark, repo, "ExpansionOriginalSupplyInfo", ("O1", "R1", "P4", "F4", "T1", 300.0))
    _rows(spark, repo, "ConnectionReasoningConfig", ("C1", "", ["环网柜"], True, ""))
    _rows(spark, repo, "PowerAccessPoint", *[
        (f"P{i}", "环网柜", f"{100.0 + i / 1000},30.0", 96.0 * i, f"F{i}", f"B{i}", f"S{i % 2}", "T1", 3, i != 4) for i in range(1, 5)
    ], ("P9", "架空线", "100.0001,30.0", 10.0, "F9", "B9", "S9", "T1", 3, True))
    _rows(spark, repo, "Feeder", *[(f"F{i}", "S", 0.5, 0.95 if i == 4 else 0.5, 3000.0, 10, 0.03) for i in range(1, 5)])
    _rows(spark, repo, "SubstationTransformer", ("T1", "S0", 9000.0, 0.5), ("T2", "S0", 9000.0, 0.9))
    _rows(spark, repo, "Substation", ("S0", "100.01,30.0"))
    _rows(spark, repo, "SubstationOutgoingBay", ("Y1", "S0", "T1", True))
    _rows(spark, repo, "FeederTieSwitch", ("W1", "F4", "F1"))
    _rows(spark, repo, "PowerSupplyModeRule", ("M1", "一级", "一级负荷", "双电源", 2, 2, "different_substation"))
    _rows(spark, repo, "NewSubstationOutgoingLineTriggerRule", ("N1", 400.0))
    reg = full_registry(repo)
    one = lambda name, **kw: reg.call(name, request_id="R1", **kw)
    assert one("validate_connection_scope").first()["is_in_scope"] and reg.call("validate_connection_scope", request_id="R2").first()["failed_reasons"] == ["business_type", "voltage"]
    assert one("apply_reasoning_config_constraints").first()["allowed_source_device_types"] == "环网柜"
    assert one("decide_supply_mode").first()["minimum_route_count"] == 2 and one("decide_supply_mode").count() == 1
    assert [r["access_point_id"] for r in one("search_power_access_points").collect()] == ["P1", "P2"]  # two feeders are enough
    assert [r["access_point_id"] for r in one("search_power_access_points", required_distinct_feeder_count=3).collect()] == ["P1", "P2", "P3"]
    checked = one("check_access_point_capacity").collect()
    assert len(checked) == 3 and all(r["is_directly_usable"] and r["single_route_capacity_kva"] == 450.0 for r in checked)
    assert not one("check_original_supply_capacity").first()["is_original_supply_usable"]
    plan = one("generate_load_transfer_plan", overloaded_object_type="Feeder", overloaded_object_id="F4").first()
    assert plan["is_feasible"] and plan["receiver_feeder_id"] == "F1" and plan["switches_used"] == ["W1"]
    assert one("generate_load_transfer_plan", overloaded_object_type="SubstationTransformer", overloaded_object_id="T1").first()["infeasible_reason"] != ""
    assert repo.count("LoadTransferPlan") == 2
    assert one("evaluate_new_substation_outgoing_line").first()["selected_substation_id"] == "S0"
    made = {",".join(r["selected_access_point_ids"]) for r in one("generate_candidate_connection_schemes").collect()}
    assert made == {"P1,P2", "P2,P3", "P1,P4", "P3,P4", ""}
    best = one("score_and_rank_schemes").collect()
    assert [r["rank"] for r in best] == [1, 2, 3] and repo.query("RankedConnectionSchemeSet", {"request_id": "R1"}).first()["generation_status"] == "成功"
    assert reg.call("score_and_rank_schemes", request_id="R2").count() == 0
    assert one("generate_no_available_scheme_conclusion").first()["failed_constraints"] == ["feeder_load_rate_ok"]


def test_coordinates(spark):
    from pyspark.sql import functions as F

    from ontoweave.operators.geo import lng_lat, lng_lat_of_map

    rows = spark.createDataFrame([("100.5, 30.25", {"lng": "1", "lat": "2"}), ("x,3", {"lng": "y"}), ("7", {}), (None, None)], "t string, m map<string,string>")
    texts = [tuple(r) for r in rows.select(*[c.alias(n) for c, n in zip(lng_lat(F.col("t")), "ab")]).collect()]
    assert texts == [(100.5, 30.25), (0.0, 3.0), (0.0, 0.0), (0.0, 0.0)]
    assert rows.withColumn("m", F.transform_values("m", lambda k, v: v.try_cast("double"))).select(*[c.alias(n) for c, n in zip(lng_lat_of_map(F.col("m")), "ab")]).first() == (1.0, 2.0)


def test_document_functions(spark):
    repo = ObjectRepository(spark, ontology_from_dict({"objects": _objects(
        Document="document_id str, title str, path str, category str, agency str, doc_type str",
        DocumentChunk="chunk_id str, document_id str, title str, path str, category str, heading str, content str",
        DocumentRelation="relation_id str, source_document_id str, target_document_id str, relation_type str, confidence float",
    ), "functions": {}}))
    _rows(spark, repo, "Document", *[(d, f"title {d}", f"p/{d}", "c", "g", "t") for d in "abcd"])
    _rows(spark, repo, "DocumentChunk", *[(f"a#{i}", "a", "title a", "p/a", "c", "", f"part {i} of water rules") for i in (1, 2, 10)], ("b#1", "b", "title b", "p/b", "c", "", "nothing here"))
    _rows(spark, repo, "DocumentRelation", ("1", "a", "b", "cites", 0.9), ("2", "c", "b", "cites", 0.8), ("3", "c", "d", "amends", 0.7))
    reg = full_registry(repo)
    assert {r["chunk_id"] for r in reg.call("search_documents", query="water rules").collect()} == {"a#1", "a#2", "a#10"}
    assert [r["chunk_id"] for r in reg.call("read_document", document_id="a").collect()] == ["a#1", "a#2", "a#10"]
    assert [r["chunk_id"] for r in reg.call("read_document", document_id="a", max_chars=45).collect()] == ["a#1", "a#2"]
    found = reg.call("find_document_relation_paths", start_document_id="a", end_document_id="d").collect()
    assert [(r["path"], r["directions"]) for r in found] == [(["a", "b", "c", "d"], ["outgoing", "incoming", "outgoing"])]
    assert reg.call("find_document_relation_paths", start_document_id="a", end_document_id="d", direction="outgoing").count() == 0
    assert [r["node"] for r in reg.call("analyze_document_graph", top_n=2).collect()] == ["b", "c"]


def _document_store(spark):
    repo = ObjectRepository(spark, ontology_from_dict({"objects": _objects(
        Document="document_id str, title str, path str, category str, agency str, doc_type str",
        DocumentChunk="chunk_id str, document_id str, title str, path str, category str, heading str, content str",
        DocumentRelation="relation_id str, source_document_id str, target_document_id str, relation_type str, confidence float",
    ), "functions": {}}))
    titles = {"a": "river water supply plan 2021年", "b": "river water supply report 2022年", "c": "road works", "d": "appendix"}
    _rows(spark, repo, "Document", *[(d, t, f"p/{d}", "c", "g", "t") for d, t in titles.items()])
    body = {"a": ["reservoir levels of the river", "pumping station schedule"], "b": ["reservoir levels fell", "pumping stopped"], "c": ["asphalt only"], "d": ["tables"]}
    _rows(spark, repo, "DocumentChunk", *[(f"{d}#{i}", d, titles[d], f"p/{d}", "c", "", t) for d, ts in body.items() for i, t in enumerate(ts)])
    _rows(spark, repo, "DocumentRelation", ("1", "a", "d", "based_on", 0.9))
    return repo


def test_search_reranks_and_finds_related_documents(spark):
    reg = full_registry(_document_store(spark))
    found = reg.call("search_documents", query="reservoir levels river", rerank=True).collect()
    assert [r["document_id"] for r in found] == ["a", "b"] and found[0]["related_score"] > found[1]["related_score"] and found[0]["best_chunk_id"] == "a#0"
    related = reg.call("find_related_documents", seed_path="p/a").collect()
    assert [r["document_id"] for r in related] == ["b"]
    with pytest.raises(ValueError):
        reg.call("find_related_documents")
    with pytest.raises(ValueError):
        reg.call("find_related_documents", seed_path="p/none")


def test_semantic_hits_join_the_lexical_ones(spark):
    from ontoweave.operators.retrieval import merge_semantic

    chunks = spark.createDataFrame([("1", "A", "x"), ("2", "B", "y"), ("3", "C", "z")], "chunk_id string, document_id string, content string")
    lexical = chunks.filter("chunk_id < '3'").selectExpr("*", "10.0D as score", "'full_text' as recall_sources")
    similar = spark.createDataFrame([("2", 0.5), ("2", 0.25), ("3", 0.9), ("9", 1.0), (None, 1.0), ("1", -0.5)], "chunk_id string, similarity double")
    got = {r["chunk_id"]: (r["document_id"], r["score"], r["recall_sources"]) for r in merge_semantic(lexical, chunks, similar).collect()}
    assert got == {"1": ("A", 10.0, "full_text,semantic"), "2": ("B", 19.0, "full_text,semantic"), "3": ("C", 16.2, "semantic")}


def test_answer_context_is_prepared(spark):
    reg = full_registry(_document_store(spark))
    rows = {r["document_id"]: r for r in reg.call("prepare_answer_context", query="reservoir levels river").collect()}
    assert set(rows) == {"a", "b", "d"} and rows["d"]["reason"] == "relation:based_on" and rows["a"]["included_chunk_ids"] == ["a#0", "a#1"]
    asked = reg.call("prepare_answer_context", query="reservoir levels river 2022年").collect()
    assert asked[0]["document_id"] == "b" and asked[0]["matches_year"]
    alone = reg.call("prepare_answer_context", query="reservoir levels river", include_relations=False, max_chars_per_doc=30).collect()
    assert {r["document_id"]: (r["included_chunk_ids"], r["truncated"]) for r in alone} == {"a": (["a#0"], True), "b": (["b#0"], True)}
    with pytest.raises(ValueError):
        reg.call("prepare_answer_context", query=" ")
