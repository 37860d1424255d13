"""Registered functions of the connection scheme domain: one request at a time, results kept per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.operators.geo import lng_lat
from ontoweave.plans import grid, schemes
from ontoweave.registry import FunctionRegistry
from ontoweave.repository import ObjectRepository
from ontoweave.session import cut_lineage
from ontoweave.sources.files import read_json

DEFAULT_RADII = "200,500,800,1000"
TIE_SCHEMA = "switch_id string, source_feeder_id string, target_feeder_id string"
# Fixed values of the domain.
REVIEW_ACTIONS = ["复核用户受电点坐标和容量资料", "人工校核周边线路可开放容量", "评估新建线路、主变扩容或新增间隔"]
NO_SCHEME = "未形成满足全部约束的候选接入方案"


def _names(value: str | None) -> list[str]:
    return [v.strip() for v in (value or "").split(",") if v.strip()]


def _own(repo: ObjectRepository, name: str, request_id: str) -> DataFrame:
    return repo.query(name, {"request_id": request_id})


def _keep(repo: ObjectRepository, name: str, request_id: str, prefix: str, rows: DataFrame, *parts: str) -> DataFrame:
    """Store a request's rows in place of its earlier ones; ids are the request and the parts that tell rows apart."""
    key = repo.object(name).id_field
    staged = cut_lineage(rows.withColumn(key, F.concat_ws("-", F.lit(prefix), "request_id", *parts)))
    others = repo.df(name).filter(F.col("request_id") != request_id)
    repo.replace_all(name, others.unionByName(repo._complete(repo.object(name), staged)))
    return staged


def _rule(repo: ObjectRepository, name: str, rule_id: str = "") -> dict:
    """The asked rule, else the first one; rule objects are small."""
    found = repo.query_by_id(name, rule_id).first() if rule_id else None
    row = found or repo.df(name).orderBy("rule_id").first()
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None} if row else {}


def _request(repo: ObjectRepository, request_id: str) -> DataFrame:
    row = repo.query_by_id("HighVoltageConnectionRequest", request_id)
    if row.isEmpty():
        raise ValueError(f"unknown request {request_id!r}")
    lng, lat = lng_lat(F.col("receiving_point_coordinate"))
    total = F.coalesce(F.nullif("total_receiving_transformer_capacity_kva", F.lit(0.0)), "approved_contract_capacity_kva", F.lit(0.0))
    return row.withColumns({"lng": lng, "lat": lat, "capacity_kva": total, "requested_supply_mode": F.col("requested_operation_mode")})


def _configured(repo: ObjectRepository, request_id: str, config_id: str = "") -> DataFrame:
    configs = repo.df("ConnectionReasoningConfig").select(
        "config_id", F.coalesce("request_id", F.lit("")).alias("request_id"), F.array_join("allowed_source_device_types", ",").alias("allowed_types"),
        F.col("enable_new_substation_outgoing_line").alias("enable_new_line"), F.col("pms_preselected_source_type").alias("preselected_type"),
    )
    if config_id:
        configs = configs.filter(F.col("config_id") == config_id).withColumn("request_id", F.lit(request_id))
    return schemes.reasoning_config(_request(repo, request_id), configs)


def _sized(repo: ObjectRepository, request_id: str, explicit: float = 0) -> DataFrame:
    request = _request(repo, request_id)
    if explicit:
        return request.select("request_id", F.lit(float(explicit)).alias("single_route_capacity_kva"))
    return schemes.single_route_capacity(request, _own(repo, "SupplyModeDecision", request_id))


def _points(repo: ObjectRepository) -> DataFrame:
    return repo.df("PowerAccessPoint").select(
        "access_point_id", F.coalesce("distance_to_receiving_point_m", F.lit(0.0)).alias("distance_m"), "feeder_id", "substation_id", "busbar_id",
        F.col("incoming_source_id").alias("transformer_id"), F.col("available_bay_count").cast("double").alias("available_bay_count"),
    )


def _feeders(repo: ObjectRepository) -> DataFrame:
    return repo.df("Feeder").select(
        "feeder_id", F.col("available_capacity_kva").alias("feeder_available_kva"), "historical_max_load_rate", "current_load_rate", "connected_user_count",
        F.col("line_loss_rate_after_connection").alias("line_loss_rate"),
    )


def _transformers(repo: ObjectRepository) -> DataFrame:
    return repo.df("SubstationTransformer").select(
        "transformer_id", "substation_id", F.col("available_capacity_kva").alias("transformer_available_kva"), F.col("current_load_rate").alias("transformer_load_rate"),
    )


def _ties(repo: ObjectRepository) -> DataFrame:
    """Tie switches of the ``FeederTieSwitch`` object, else of the domain's data file."""
    rows = repo.df("FeederTieSwitch") if "FeederTieSwitch" in repo.ontology.objects else read_json(
        repo.spark, repo._location("data/_feeder_tie_switch.json"), repo.spark.createDataFrame([], TIE_SCHEMA).schema)
    return grid.ties(rows, "source_feeder_id", "target_feeder_id")


def _capacity_rule(repo: ObjectRepository, rule_id: str) -> schemes.CapacityRule:
    rule, base = _rule(repo, "ExistingAccessPointConstraintRule", rule_id), schemes.CapacityRule()
    return schemes.CapacityRule(
        rule.get("max_feeder_historical_load_rate", base.max_load_rate), rule.get("min_spare_bay_count", base.min_spare_bays),
        rule.get("max_connected_user_count", base.max_users), rule.get("max_line_loss_rate_after_connection", base.max_line_loss),
    )


def _transfers(repo: ObjectRepository, request_id: str) -> DataFrame:
    """Stored transfer plans as (request_id, source, is_feasible)."""
    source = F.coalesce(F.nullif("overloaded_feeder_id", F.lit("")), "overloaded_transformer_id")
    whole = F.col("overloaded_object_type") == "Feeder"
    return _own(repo, "LoadTransferPlan", request_id).select(
        "request_id", F.when(whole, source).otherwise(F.col("overloaded_transformer_id")).alias("source"), "transfer_plan_id", "is_feasible"
    )


def _checked(repo: ObjectRepository, request_id: str) -> DataFrame:
    return _own(repo, "AccessPointCapacityCheck", request_id).select(
        "request_id", "check_id", "access_point_id", "single_route_capacity_kva", "is_directly_usable", "requires_load_transfer",
        F.array_join("failed_constraints", ",").alias("failed_constraints"),
    ).join(_points(repo), "access_point_id")


def validate_scope(repo, request_id, rule_id="", **_):
    rule, base = _rule(repo, "ConnectionScopeRule", rule_id), schemes.ScopeRule()
    checked = schemes.validate_scope(_request(repo, request_id), schemes.ScopeRule(
        rule.get("allowed_business_types") or base.business_types, rule.get("required_supply_voltage_kv") or base.voltage_kv,
        rule.get("max_total_receiving_transformer_capacity_kva") or base.max_capacity_kva,
    ))
    reasons = F.filter(F.split("failed_reasons", ","), lambda x: x != "")
    return _keep(repo, "ScopeValidationResult", request_id, "SCOPE", checked.select(
        "request_id", "is_in_scope", reasons.alias("failed_reasons"), F.col("business_type").alias("checked_business_type"),
        F.col("supply_voltage_kv").alias("checked_supply_voltage_kv"), F.col("capacity_kva").alias("checked_total_capacity_kva"),
    ))


def reasoning_config(repo, request_id, config_id="", **_):
    return _configured(repo, request_id, config_id).select("request_id", "business_type", "allowed_source_device_types", "enable_new_line")


def decide_supply_mode(repo, request_id, rule_id="", **_):
    rules = repo.query("PowerSupplyModeRule", {"rule_id": rule_id} if rule_id else None).withColumnRenamed("source_independence_requirement", "independence")
    return _keep(repo, "SupplyModeDecision", request_id, "MODE", schemes.decide_supply_mode(_request(repo, request_id), rules))


def search_points(repo, request_id, center_coordinate="", allowed_source_device_types="", radius_sequence_m=DEFAULT_RADII, required_distinct_feeder_count=0, **_):
    """Points inside the stopping ring, nearest first; the batch with their ids is stored."""
    request = _configured(repo, request_id)
    if center_coordinate:
        lng, lat = lng_lat(F.lit(center_coordinate))
        request = request.withColumns({"lng": lng, "lat": lat})
    allowed = ",".join(_names(allowed_source_device_types))
    request = request.withColumn("preferred_point_types", F.lit(allowed) if allowed else F.col("allowed_source_device_types"))
    decision = _own(repo, "SupplyModeDecision", request_id).first()
    required = int(required_distinct_feeder_count or (decision and decision["minimum_route_count"]) or 1)
    lng, lat = lng_lat(F.col("coordinate"))
    points = repo.df("PowerAccessPoint").filter("is_available").select(
        "access_point_id", F.col("device_type").alias("point_type"), "feeder_id", lng.alias("lng"), lat.alias("lat"))
    radii = [float(r) for r in _names(radius_sequence_m or DEFAULT_RADII)]
    found, summary = grid.search_sources(request, points, radii, F.lit(required))
    found = cut_lineage(found)
    ids = found.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("distance_m", "access_point_id"))).alias("_f"))
    batch = request.select("request_id").join(summary, "request_id", "left").join(ids, "request_id", "left")
    _keep(repo, "PowerSourceSearchBatch", request_id, "SEARCH", batch.select(
        "request_id", F.lit(center_coordinate or "").alias("center_coordinate"), F.lit(radii).alias("radius_sequence_m"),
        F.coalesce("stopped_radius", F.lit(radii[-1])).alias("stopped_radius_m"),
        F.coalesce(F.transform("_f", lambda x: x["access_point_id"]), F.array().cast("array<string>")).alias("found_access_point_ids"),
        F.coalesce("distinct_groups", F.lit(0)).alias("distinct_feeder_count"), F.coalesce("satisfied", F.lit(False)).alias("satisfies_required_line_count"),
    ))
    return found.orderBy("distance_m", "access_point_id")


def check_points(repo, request_id, access_point_ids="", single_route_capacity_kva=0, rule_id="", **_):
    wanted = _names(access_point_ids)
    asked = repo.spark.createDataFrame([(request_id, p) for p in wanted], "request_id string, access_point_id string") if wanted else \
        _own(repo, "PowerSourceSearchBatch", request_id).select("request_id", F.explode("found_access_point_ids").alias("access_point_id"))
    points = asked.join(_points(repo), "access_point_id").join(_sized(repo, request_id, single_route_capacity_kva), "request_id")
    checks = schemes.check_capacity(points, _feeders(repo), _transformers(repo).drop("substation_id"), _capacity_rule(repo, rule_id))
    listed = checks.withColumn("failed_constraints", F.filter(F.split("failed_constraints", ","), lambda x: x != ""))
    return _keep(repo, "AccessPointCapacityCheck", request_id, "APCHK", listed, "access_point_id")


def check_original(repo, request_id, rule_id="", **_):
    """Original supplies of an expansion against its additional capacity; no rows without one."""
    whole = _request(repo, request_id).select("request_id", "capacity_kva")
    points = _own(repo, "ExpansionOriginalSupplyInfo", request_id).join(whole, "request_id").select(
        "request_id", "original_supply_info_id", F.col("original_access_point_id").alias("access_point_id"), F.col("original_feeder_id").alias("feeder_id"),
        F.col("original_transformer_id").alias("transformer_id"), F.lit(None).cast("double").alias("available_bay_count"),
        F.coalesce(F.nullif("incremental_capacity_kva", F.lit(0.0)), "capacity_kva").alias("single_route_capacity_kva"),
    )
    checks = schemes.check_capacity(points, _feeders(repo), _transformers(repo).drop("substation_id"), _capacity_rule(repo, rule_id), check_bays=False)
    named = checks.withColumn("failed_constraints", F.filter(F.split("failed_constraints", ","), lambda x: x != "")).withColumnsRenamed({
        "feeder_id": "original_feeder_id", "transformer_id": "original_transformer_id", "single_route_capacity_kva": "incremental_capacity_kva",
        "is_directly_usable": "is_original_supply_usable",
    })
    return _keep(repo, "OriginalSupplyCapacityCheck", request_id, "ORIG", named, "original_supply_info_id")


def plan_transfer(repo, request_id, overloaded_object_type="", overloaded_object_id="", single_route_capacity_kva=0, **_):
    """Transfer plans of the named unit, else of the unit behind the first check that needs one; one infeasible row if none."""
    kind, unit = overloaded_object_type, overloaded_object_id
    if not kind or not unit:
        held = F.col("failed_constraints").contains("transformer_")
        pressed = _checked(repo, request_id).orderBy(F.col("requires_load_transfer").desc(), "access_point_id").select(
            F.when(held, "SubstationTransformer").otherwise("Feeder").alias("kind"), F.when(held, F.col("transformer_id")).otherwise(F.col("feeder_id")).alias("unit")
        ).first()
        kind, unit = (pressed["kind"], pressed["unit"] or "") if pressed else (kind, unit)
    feeder = kind == "Feeder"
    need = _sized(repo, request_id, single_route_capacity_kva).withColumn("source", F.lit(unit or "").cast("string"))
    plans = schemes.feeder_transfer_plans(need, _ties(repo), _feeders(repo)) if feeder else \
        schemes.transformer_transfer_plans(need, _transformers(repo)).withColumn("switch_id", F.lit(None).cast("string"))
    grouped = plans.groupBy("request_id", "source", "target").agg(
        F.max("post_transfer_load_rate").alias("rate"), F.bool_or("is_feasible").alias("is_feasible"), F.sort_array(F.collect_set("switch_id")).alias("switches_used"))
    rows = need.withColumnRenamed("single_route_capacity_kva", "transfer_capacity_kva").join(grouped, ["request_id", "source"], "left")
    ok, rate = F.coalesce("is_feasible", F.lit(False)), F.coalesce("rate", F.lit(0.0))
    side = lambda wanted, c: F.when(F.lit(wanted), F.coalesce(c, F.lit(""))).otherwise("")
    staged = rows.select(
        "request_id", "transfer_capacity_kva", F.lit(kind or "").alias("overloaded_object_type"),
        side(feeder, "source").alias("overloaded_feeder_id"), side(not feeder, "source").alias("overloaded_transformer_id"),
        side(feeder, "target").alias("receiver_feeder_id"), side(not feeder, "target").alias("receiver_transformer_id"),
        F.coalesce("switches_used", F.array().cast("array<string>")).alias("switches_used"),
        F.when(F.lit(feeder), rate).otherwise(0.0).alias("post_transfer_feeder_load_rate"),
        F.when(F.lit(feeder), 0.0).otherwise(rate).alias("post_transfer_transformer_load_rate"), ok.alias("is_feasible"),
        F.when(ok, "").when(F.col("target").isNull(), "未找到可行划接对象")
        .otherwise("接收馈线划接后负载率超过80%" if feeder else "接收主变容量或负载率不满足要求").alias("infeasible_reason"),
    )
    # Plans of the request's other units stay.
    key = "overloaded_feeder_id" if feeder else "overloaded_transformer_id"
    fresh = cut_lineage(staged.withColumn("transfer_plan_id", F.concat_ws("-", F.lit("TRF"), "request_id", key, "receiver_feeder_id", "receiver_transformer_id")))
    others = repo.df("LoadTransferPlan").filter(~((F.col("request_id") == request_id) & (F.col(key) == (unit or ""))))
    repo.replace_all("LoadTransferPlan", others.unionByName(repo._complete(repo.object("LoadTransferPlan"), fresh)))
    return fresh


def evaluate_new_line(repo, request_id, single_route_capacity_kva=0, trigger_rule_id="", feasibility_rule_id="", **_):
    trigger, feasible = _rule(repo, "NewSubstationOutgoingLineTriggerRule", trigger_rule_id), _rule(repo, "NewSubstationOutgoingLineFeasibilityRule", feasibility_rule_id)
    radius = float(feasible.get("search_radius_km") or 15.0)
    request = _configured(repo, request_id).join(_sized(repo, request_id, single_route_capacity_kva), "request_id").withColumn("force_new_line", F.lit(False))
    lng, lat = lng_lat(F.col("coordinate"))
    decided = schemes.decide_new_line(
        request, _checked(repo, request_id), _transfers(repo, request_id), repo.df("Substation").select("substation_id", lng.alias("lng"), lat.alias("lat")),
        repo.df("SubstationOutgoingBay"), _transformers(repo).drop("substation_id"), float(trigger.get("single_route_capacity_threshold_kva") or 10000.0), radius,
    )
    missing = F.col("is_triggered") & ~F.col("is_feasible")
    return _keep(repo, "NewSubstationOutgoingLineDecision", request_id, "NEWLINE", decided.withColumns({
        "trigger_reasons": F.filter(F.split("trigger_reasons", ","), lambda x: x != ""), "search_radius_km": F.lit(radius),
        "no_solution_reason": F.when(missing, "15公里范围内未找到满足间隔、容量和负载率要求的变电站出线").otherwise(""),
    }))


def _scoring(repo: ObjectRepository, rule_id: str = "") -> schemes.ScoringRule:
    rule, base = _rule(repo, "SchemeScoringRule", rule_id), schemes.ScoringRule()
    return schemes.ScoringRule(
        rule.get("distance_weight", base.distance_weight), rule.get("available_capacity_weight", base.capacity_weight),
        rule.get("reliability_weight", base.reliability_weight), {int(k): v for k, v in (rule.get("source_count_reliability_scores") or {}).items()},
        rule.get("operation_mode_reliability_scores") or {}, int(rule.get("max_output_count") or base.max_output),
    )


def generate_schemes(repo, request_id, source_check_ids="", load_transfer_plan_ids="", new_outgoing_line_decision_id="", redline_rule_id="", **_):
    """Candidate schemes of a request, without combinations that no ranking of the scoring rule's length can keep."""
    decisions, transfers, checks = _own(repo, "SupplyModeDecision", request_id), _transfers(repo, request_id), _checked(repo, request_id)
    if source_check_ids:
        checks = checks.filter(F.col("check_id").isin(_names(source_check_ids)))
    if load_transfer_plan_ids:
        transfers = transfers.filter(F.col("transfer_plan_id").isin(_names(load_transfer_plan_ids)))
    originals = _own(repo, "ExpansionOriginalSupplyInfo", request_id).select("request_id", F.col("original_access_point_id").alias("access_point_id")).join(
        _points(repo), "access_point_id").join(_sized(repo, request_id), "request_id")
    pool = schemes.usable_points(schemes.with_original_supplies(checks, originals, transfers), transfers)
    combos = schemes.candidate_schemes(pool, decisions, _scoring(repo).max_output).drop("_order")
    lines = _own(repo, "NewSubstationOutgoingLineDecision", request_id).filter("is_triggered and is_feasible")
    if new_outgoing_line_decision_id:
        lines = lines.filter(F.col("decision_id") == new_outgoing_line_decision_id)
    fresh = lines.join(decisions.select("request_id", "minimum_route_count"), "request_id", "left").select(
        "request_id", F.lit(schemes.NEW_LINE).alias("scheme_source_type"), F.lit(schemes.NEW_LINE_MODE).alias("operation_mode"), F.lit("").alias("point_ids"),
        F.coalesce("minimum_route_count", F.lit(1)).alias("route_count"), F.lit(0.0).alias("total_supply_distance_m"),
    )
    redline = _rule(repo, "RedlineBoundaryDeviceRule", redline_rule_id).get("boundary_device_type", "")
    rows = combos.unionByName(fresh).join(_sized(repo, request_id), "request_id").join(
        decisions.select("request_id", F.col("decision_id").alias("source_decision_id"), F.col("required_supply_mode").alias("supply_mode")), "request_id", "left"
    ).withColumns({
        "selected_access_point_ids": F.filter(F.split("point_ids", ","), lambda x: x != ""), "power_source_count": F.col("route_count"),
        "redline_boundary_device_type": F.lit(redline),
    })
    return _keep(repo, "CandidateConnectionScheme", request_id, "SCHEME", rows, "scheme_source_type", "point_ids")


def rank(repo, request_id, scheme_ids="", rule_id="", **_):
    """The best schemes with their scores, ranked; the ranked set is stored, also an empty one."""
    rule = _scoring(repo, rule_id)
    found = _own(repo, "CandidateConnectionScheme", request_id)
    if scheme_ids:
        found = found.filter(F.col("scheme_id").isin(_names(scheme_ids)))
    scored = schemes.score_schemes(found.withColumnRenamed("route_count", "_n").withColumn("route_count", F.col("power_source_count")), rule)
    ranked = schemes.top_per_group(scored, ["request_id"], [F.col("total_score").desc(), F.col("total_supply_distance_m"), F.col("scheme_id")], rule.max_output)
    kept = _keep(repo, "SchemeScore", request_id, "SCORE", ranked.select(
        "request_id", "scheme_id", "operation_mode", "distance_score", "available_capacity_score", "reliability_score", "total_score", "rank",
        F.lit("综合得分排序保留").alias("retained_reason")), "scheme_id")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "scheme_id"))), lambda x: x["scheme_id"])
    modes = kept.groupBy("request_id", "operation_mode").agg(F.min_by("scheme_id", "rank").alias("scheme_id")).groupBy("request_id").agg(
        F.map_from_entries(F.collect_list(F.struct("operation_mode", "scheme_id"))).alias("best_scheme_per_operation_mode"))
    sets = _request(repo, request_id).select("request_id").join(kept.groupBy("request_id").agg(ordered.alias("scheme_ids")), "request_id", "left").join(modes, "request_id", "left")
    none = F.col("scheme_ids").isNull()
    _keep(repo, "RankedConnectionSchemeSet", request_id, "RANK", sets.withColumns({
        "max_scheme_count": F.lit(rule.max_output), "sorted_by_score": F.lit(True), "generation_status": F.when(none, "失败").otherwise("成功"),
        "no_solution_reason": F.when(none, "没有候选方案可评分").otherwise(""),
    }))
    return kept.orderBy("rank")


def conclude(repo, request_id, failed_stage="", searched_radius_m=1000, searched_substation_radius_km=15.0, **_):
    failed = [_own(repo, n, request_id).select("request_id", F.explode("failed_constraints").alias("c")) for n in ("AccessPointCapacityCheck", "OriginalSupplyCapacityCheck")]
    lines = _own(repo, "NewSubstationOutgoingLineDecision", request_id).filter("no_solution_reason <> ''").select("request_id", F.col("no_solution_reason").alias("c"))
    counted = failed[0].unionByName(failed[1]).unionByName(lines).groupBy("request_id").agg(F.sort_array(F.collect_list("c")).alias("failed_constraints"))
    rows = _request(repo, request_id).select("request_id").join(counted, "request_id", "left")
    return _keep(repo, "NoAvailableConnectionSchemeConclusion", request_id, "NOSOL", rows.withColumns({
        "failed_stage": F.lit(failed_stage or "方案组合/评分排序"), "searched_radius_m": F.lit(float(searched_radius_m)),
        "searched_substation_radius_km": F.lit(float(searched_substation_radius_km)),
        "explanation": F.coalesce(F.array_join("failed_constraints", "；"), F.lit(NO_SCHEME)), "recommended_manual_review_actions": F.lit(REVIEW_ACTIONS),
    }))


def register_schemes(registry: FunctionRegistry) -> None:
    functions = {
        "validate_connection_scope": validate_scope, "apply_reasoning_config_constraints": reasoning_config, "decide_supply_mode": decide_supply_mode,
        "search_power_access_points": search_points, "check_access_point_capacity": check_points, "check_original_supply_capacity": check_original,
        "generate_load_transfer_plan": plan_transfer, "evaluate_new_substation_outgoing_line": evaluate_new_line,
        "generate_candidate_connection_schemes": generate_schemes, "score_and_rank_schemes": rank, "generate_no_available_scheme_conclusion": conclude,
    }
    for name, fn in functions.items():
        registry.register(name, fn)
