"""Connection schemes: scope and mode decisions, capacity checks, transfers, ranked combinations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoweave.functions.numeric import with_rounded
from ontoweave.operators.grouping import first_wins
from ontoweave.operators.ordering import top_per_group
from ontoweave.plans.grid import access_points_in_range
from ontoweave.session import cut_lineage

# Fixed values of the domain.
CHECKS = [
    "feeder_available_capacity_ok", "feeder_load_rate_ok", "spare_bay_ok", "connected_user_count_ok",
    "line_loss_rate_ok", "transformer_available_capacity_ok", "transformer_load_rate_ok",
]
TRANSFER_CHECKS = [
    "feeder_available_capacity_ok", "feeder_load_rate_ok", "transformer_available_capacity_ok", "transformer_load_rate_ok",
]
EXISTING, NEW_LINE = "existing_access_point", "new_substation_outgoing_line"
NEW_LINE_MODE = "新出线"
STRONG_MODES = ["双回路", "双电源", "多电源(3路含应急)"]


@dataclass
class ScopeRule:
    business_types: list[str] = field(default_factory=lambda: ["新装", "增容", "临时"])
    voltage_kv: float = 10.0
    max_capacity_kva: float = 20000.0


@dataclass
class CapacityRule:
    max_load_rate: float = 0.8
    min_spare_bays: int = 2
    max_users: int = 50
    max_line_loss: float = 0.07


@dataclass
class ScoringRule:
    distance_weight: float = 0.35
    capacity_weight: float = 0.35
    reliability_weight: float = 0.30
    source_count_scores: dict[int, float] = field(default_factory=dict)
    mode_scores: dict[str, float] = field(default_factory=dict)
    max_output: int = 3


def validate_scope(requests: DataFrame, rule: ScopeRule = ScopeRule()) -> DataFrame:
    reasons = F.concat_ws(
        ",",
        F.when(~F.coalesce(F.col("business_type").isin(rule.business_types), F.lit(False)), "business_type"),
        F.when(~F.coalesce(F.col("supply_voltage_kv") == rule.voltage_kv, F.lit(False)), "voltage"),
        F.when(F.col("capacity_kva") > rule.max_capacity_kva, "capacity"),
    )
    return requests.withColumn("failed_reasons", reasons).withColumn("is_in_scope", F.col("failed_reasons") == "")


def reasoning_config(requests: DataFrame, configs: DataFrame) -> DataFrame:
    """The request's own config, else the default one (empty request id)."""
    own = configs.filter("request_id <> ''").groupBy("request_id").agg(
        F.max_by(F.struct("allowed_types", "enable_new_line", "preselected_type"), "config_id").alias("_own")
    )
    default = configs.filter("request_id = ''").agg(
        F.max_by(F.struct("allowed_types", "enable_new_line", "preselected_type"), "config_id")
    ).scalar()
    picked = requests.join(own, "request_id", "left").withColumn("_c", F.coalesce(F.col("_own"), default))
    pre = F.coalesce("_c.preselected_type", F.lit(""))
    return picked.select(
        *requests.columns,
        F.when(pre != "", pre).otherwise(F.coalesce("_c.allowed_types", F.lit(""))).alias("allowed_source_device_types"),
        F.coalesce("_c.enable_new_line", F.lit(False)).alias("enable_new_line"),
    )


def decide_supply_mode(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule by importance and load level; a stronger request raises routes and mode."""
    rule = first_wins(
        rules.select("user_importance_level", "load_level", "required_supply_mode", "minimum_route_count",
                     "minimum_source_count", "independence", "rule_id"),
        ["user_importance_level", "load_level"], ["rule_id"],
    ).withColumnsRenamed({"required_supply_mode": "_mode", "minimum_route_count": "_routes", "minimum_source_count": "_sources"})
    j = requests.join(rule.drop("rule_id"), ["user_importance_level", "load_level"], "left")
    asked = F.coalesce("requested_supply_mode", F.lit(""))
    required = F.coalesce("_mode", F.nullif(asked, F.lit("")), F.lit("单电源"))
    routes = F.coalesce(F.nullif("_routes", F.lit(0)), F.when(required == "单电源", 1).otherwise(2))
    sources = F.coalesce(F.nullif("_sources", F.lit(0)), routes)
    more = F.coalesce("requested_power_source_count", F.lit(0)) > sources
    staged = j.withColumns({"_required": required, "_r": routes, "_s": sources, "_more": more})
    final_sources = F.when(F.col("_more"), F.col("requested_power_source_count")).otherwise(F.col("_s"))
    mode = F.when(asked.isin(STRONG_MODES), asked).otherwise(F.col("_required"))
    independence = F.coalesce("independence", F.lit(""))
    return staged.select(
        "request_id", mode.alias("required_supply_mode"),
        F.when(F.col("_more"), F.greatest("_r", final_sources)).otherwise(F.col("_r")).cast("int").alias("minimum_route_count"),
        final_sources.cast("int").alias("minimum_source_count"),
        ((independence == "different_substation") | (mode == "双电源")).alias("required_different_substations"),
        (independence.isin("different_busbar", "different_substation") | mode.isin("双回路", "双电源"))
        .alias("required_different_busbars"),
    )


def single_route_capacity(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    j = requests.select("request_id", "capacity_kva").join(
        decisions.select("request_id", "minimum_route_count"), "request_id", "left"
    )
    routes = F.coalesce(F.nullif("minimum_route_count", F.lit(0)), F.lit(1))
    return with_rounded(j, 2, single_route_capacity_kva=F.col("capacity_kva") / routes).select(
        "request_id", "single_route_capacity_kva"
    )


def _check_columns(rule: CapacityRule, check_bays: bool) -> dict[str, Column]:
    need = F.col("single_route_capacity_kva")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return {
        "feeder_available_capacity_ok": zero("feeder_available_kva") >= need,
        "feeder_load_rate_ok": (zero("historical_max_load_rate") <= rule.max_load_rate)
        & (zero("current_load_rate") <= rule.max_load_rate),
        "spare_bay_ok": zero("available_bay_count") >= rule.min_spare_bays if check_bays else F.lit(True),
        "connected_user_count_ok": zero("connected_user_count") <= rule.max_users,
        "line_loss_rate_ok": zero("line_loss_rate") <= rule.max_line_loss,
        "transformer_available_capacity_ok": zero("transformer_available_kva") >= need,
        "transformer_load_rate_ok": zero("transformer_load_rate") <= rule.max_load_rate,
    }


def check_capacity(
    points: DataFrame, feeders: DataFrame, transformers: DataFrame, rule: CapacityRule = CapacityRule(),
    check_bays: bool = True,
) -> DataFrame:
    """Seven checks per point of a request (original supplies skip the bay check).

    ``points``: request_id, access_point_id, feeder_id, transformer_id,
    single_route_capacity_kva and, for access points, available_bay_count.
    """
    return judge_capacity(with_measures(points, feeders, transformers), points.columns, rule, check_bays)


def with_measures(points: DataFrame, feeders: DataFrame, transformers: DataFrame) -> DataFrame:
    """Points and what their feeder and transformer measure, as the checks read it."""
    return points.join(feeders, "feeder_id", "left").join(transformers, "transformer_id", "left")


def judge_capacity(
    measured: DataFrame, columns: list[str], rule: CapacityRule = CapacityRule(), check_bays: bool = True
) -> DataFrame:
    """``columns`` of points that carry their measures (:func:`with_measures`) and the seven checks."""
    staged = measured.withColumns(_check_columns(rule, check_bays))
    failed = F.concat_ws(",", *[F.when(~F.col(c), F.lit(c)) for c in CHECKS])
    movable = ~(F.col(TRANSFER_CHECKS[0]) & F.col(TRANSFER_CHECKS[1]) & F.col(TRANSFER_CHECKS[2]) & F.col(TRANSFER_CHECKS[3]))
    return staged.select(
        *columns, *CHECKS, failed.alias("failed_constraints"), (failed == "").alias("is_directly_usable"),
        movable.alias("requires_load_transfer"),
    )


def feeder_transfer_plans(overloads: DataFrame, tie_rows: DataFrame, feeders: DataFrame, tasks: int | None = None) -> DataFrame:
    """Tie neighbours with room for an overloaded feeder; feasible when they stay at or below 80%.

    ``tasks`` in this module: into how many tasks the rows of pairs are dealt; without it Spark merges them by bytes.
    """
    receiver = feeders.select(
        F.col("feeder_id").alias("target"), F.col("feeder_available_kva").alias("_room"), F.col("current_load_rate").alias("_rate")
    )
    need = F.col("single_route_capacity_kva")
    ways = tie_rows.join(receiver, "target")  # overloads are many: they meet ties and receivers in one join
    if tasks:
        ways = ways.repartition(tasks, "source")
    tried = overloads.join(ways, "source").filter(F.col("_room") >= need)
    post = F.least(F.lit(0.99), F.col("_rate") + need / 50000)
    staged = with_rounded(tried.withColumn("_post", post), 3, post_transfer_load_rate=F.col("_post"))
    return staged.select(
        "request_id", "source", "target", "switch_id", "post_transfer_load_rate", (F.col("_post") <= 0.8).alias("is_feasible")
    )


def transformer_transfer_plans(overloads: DataFrame, transformers: DataFrame) -> DataFrame:
    """Sister transformers of the same substation as receivers."""
    home = transformers.select(F.col("transformer_id").alias("source"), "substation_id")
    sister = transformers.select(
        F.col("transformer_id").alias("target"), "substation_id", F.col("transformer_available_kva").alias("_room"),
        F.col("transformer_load_rate").alias("_rate"),
    )
    need = F.col("single_route_capacity_kva")
    tried = overloads.join(home, "source").join(sister, "substation_id").filter("target <> source")
    staged = with_rounded(
        tried.withColumn("_post", F.least(F.lit(0.99), F.col("_rate") + need / 50000)), 3,
        post_transfer_load_rate=F.col("_post"),
    )
    return staged.select(
        "request_id", "source", "target", "post_transfer_load_rate",
        ((F.col("_room") >= need) & (F.col("_post") <= 0.8)).alias("is_feasible"),
    )


def decide_new_line(
    requests: DataFrame, checks: DataFrame, transfers: DataFrame, substations: DataFrame, bays: DataFrame,
    transformers: DataFrame, threshold_kva: float = 10000.0, radius_km: float = 15.0,
) -> DataFrame:
    """Trigger (enabled and any reason) and nearest substation with a free, strong enough bay.

    ``requests``: request_id, lng, lat, single_route_capacity_kva, enable_new_line, force_new_line.
    """
    usable = checks.groupBy("request_id").agg(F.bool_or("is_directly_usable").alias("_usable"))
    moved = transfers.groupBy("request_id").agg(F.bool_or("is_feasible").alias("_moved"))
    j = requests.join(usable, "request_id", "left").join(moved, "request_id", "left")
    reasons = F.concat_ws(
        ",",
        F.when(F.col("single_route_capacity_kva") >= threshold_kva, "capacity"),
        F.when(F.col("_usable") == F.lit(False), "no_usable_point"),
        F.when(F.col("_moved") == F.lit(False), "no_feasible_transfer"),
        F.when(F.col("force_new_line"), "forced"),
    )
    triggered = j.withColumn("trigger_reasons", reasons).withColumn(
        "is_triggered", F.col("enable_new_line") & (F.col("trigger_reasons") != "")
    )
    free = bays.filter("is_available").join(
        transformers.filter(F.col("transformer_load_rate") <= 0.8).select("transformer_id", "transformer_available_kva"),
        "transformer_id",
    ).select("substation_id", "outgoing_bay_id", "transformer_id", "transformer_available_kva")
    near = access_points_in_range(
        triggered.filter("is_triggered").select("request_id", "lng", "lat", "single_route_capacity_kva"),
        substations.select("substation_id", "lng", "lat"), radius_km * 1000,
    ).drop("lng", "lat", "_d")
    best = near.join(free, "substation_id").filter(
        F.col("transformer_available_kva") >= F.col("single_route_capacity_kva")
    ).groupBy("request_id").agg(F.min(F.struct("distance_m", "substation_id", "outgoing_bay_id", "transformer_id")).alias("_b"))
    return triggered.join(best, "request_id", "left").select(
        "request_id", "is_triggered", "trigger_reasons", F.col("_b.substation_id").alias("selected_substation_id"),
        F.col("_b.transformer_id").alias("selected_transformer_id"), F.col("_b.outgoing_bay_id").alias("selected_outgoing_bay_id"),
        F.col("_b").isNotNull().alias("is_feasible"),
    )


def _relieved(points: DataFrame, transfers: DataFrame, tasks: int | None = None) -> DataFrame:
    """``points`` with ``_relieved``: a feasible transfer takes load off their feeder or transformer."""
    sources = transfers.filter("is_feasible").select("request_id", F.col("source").alias("_unit"))
    if tasks:
        sources = sources.repartition(tasks, "request_id", "_unit")
    moved = sources.groupBy("request_id", "_unit").agg(F.lit(True).alias("_hit"))
    for unit in ("feeder_id", "transformer_id"):
        if tasks:
            points = points.repartition(tasks, "request_id", unit)
        points = points.join(moved.withColumnsRenamed({"_unit": unit, "_hit": f"_by_{unit}"}), ["request_id", unit], "left")
    hit = F.coalesce("_by_feeder_id", "_by_transformer_id", F.lit(False))
    return points.withColumn("_relieved", hit).drop("_by_feeder_id", "_by_transformer_id")


def usable_points(checks: DataFrame, transfers: DataFrame, tasks: int | None = None) -> DataFrame:
    """Directly usable points, plus those whose feeder or transformer has a feasible transfer."""
    hopeful = checks.filter("is_directly_usable or requires_load_transfer")
    found = _relieved(hopeful, transfers, tasks).filter("is_directly_usable or (requires_load_transfer and _relieved)")
    return found.select(*checks.columns)


def with_original_supplies(checks: DataFrame, originals: DataFrame, transfers: DataFrame) -> DataFrame:
    """Checked points and the original supply points of expansions that a feasible transfer relieves.

    ``originals``: the point columns of ``checks`` (request_id, access_point_id, distance_m, feeder_id,
    substation_id, busbar_id, transformer_id, single_route_capacity_kva), one row per original point.
    A point that was checked anyway stays as it was checked.
    """
    return checks.unionByName(relieved_originals(checks, originals, transfers), allowMissingColumns=True)


def relieved_originals(checks: DataFrame, originals: DataFrame, transfers: DataFrame) -> DataFrame:
    """The rows that :func:`with_original_supplies` adds."""
    point = ["request_id", "access_point_id"]
    known = checks.select(*point).join(originals.select(*point), point, "left_semi")  # the checks are many, the originals few
    fresh = originals.join(known, point, "left_anti")
    added = _relieved(fresh, transfers).filter("_relieved").dropDuplicates(["request_id", "access_point_id"]).withColumns({
        "failed_constraints": F.lit("original_source_requires_transfer"), "is_directly_usable": F.lit(False), "requires_load_transfer": F.lit(True),
    })
    return added.select(*[c for c in added.columns if c in checks.columns])


def candidate_schemes(
    usable: DataFrame, decisions: DataFrame, keep: int, max_routes: int | None = None, tasks: int | None = None
) -> DataFrame:
    """Independent point combinations per request, without the ones no ranking can keep.

    ``max_routes`` is the largest route count among the decisions; without it that is asked from them (one row).

    Points of one scheme must lie at different sites: substations, busbars or,
    without a demand, just different points. The score falls with the total
    distance and ties go to the nearer points, so a point behind ``keep``
    points of its own site can always be swapped for each of those, and a site
    behind ``keep + routes - 1`` sites has ``keep`` free better ones. Dropping
    both loses none of the best ``keep`` schemes and bounds the combinations
    per request by a constant.
    """
    if max_routes is None:
        max_routes = decisions.agg(F.max("minimum_route_count")).first()[0] or 1
    site = F.when(F.col("required_different_substations"), F.concat(F.lit("s"), "substation_id")).when(
        F.col("required_different_busbars"), F.concat(F.lit("b"), F.concat_ws("/", "substation_id", "busbar_id"))
    ).otherwise(F.concat(F.lit("p"), "access_point_id"))
    placed = usable.join(decisions, "request_id").select(
        "request_id", "minimum_route_count", "required_supply_mode", site.alias("site"),
        F.struct("distance_m", "access_point_id").alias("place"),
    )
    if tasks:
        placed = placed.repartition(tasks, "request_id")
    near = top_per_group(placed, ["request_id", "site"], [F.col("place")], keep).drop("rank")
    by_site = Window.partitionBy("request_id", "site")
    sites = near.withColumns({"_best": F.min("place").over(by_site), "_routes": F.max("minimum_route_count").over(by_site)}).withColumn(
        "_nth", F.dense_rank().over(Window.partitionBy("request_id").orderBy("_best", "site"))
    ).filter(F.col("_nth") <= keep + max_routes - 1)
    kept = sites.filter((F.col("_nth") <= keep + F.col("_routes") - 1) & F.col("site").isNotNull())
    pool = cut_lineage(kept.drop("_best", "_routes", "_nth"))  # each level reads it
    heads = pool.select(
        "request_id", "minimum_route_count", "required_supply_mode", F.array("place").alias("places"), F.array("site").alias("sites")
    )
    levels = [heads]
    extra = pool.select("request_id", F.col("place").alias("_place"), F.col("site").alias("_site"))
    for _ in range(max_routes - 1):
        # At most keep * (keep + routes - 1) points per request are left here.
        grown = levels[-1].filter(F.col("minimum_route_count") > F.size("places")).join(extra, "request_id").filter(
            (F.col("_place") > F.element_at("places", -1)) & ~F.array_contains("sites", F.col("_site"))
        )
        levels.append(cut_lineage(grown.select(
            "request_id", "minimum_route_count", "required_supply_mode",
            F.concat("places", F.array("_place")).alias("places"), F.concat("sites", F.array("_site")).alias("sites"),
        )))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    done = whole.filter(F.col("minimum_route_count") == F.size("places"))
    return done.select(
        "request_id", F.lit(EXISTING).alias("scheme_source_type"), F.col("required_supply_mode").alias("operation_mode"),
        F.array_join(F.transform("places", lambda p: p["access_point_id"].cast("string")), ",").alias("point_ids"),
        F.size("places").alias("route_count"),
        F.aggregate("places", F.lit(0.0), lambda acc, p: acc + p["distance_m"]).alias("total_supply_distance_m"),
        F.col("places").alias("_order"),
    )


def score_schemes(schemes: DataFrame, rule: ScoringRule) -> DataFrame:
    def mapped(col: Column, table: dict, default: float) -> Column:
        chain = None
        for key, value in table.items():
            chain = (F.when if chain is None else chain.when)(col == key, float(value))
        return F.lit(float(default)) if chain is None else chain.otherwise(float(default))

    scored = schemes.withColumns({
        "_d": F.greatest(F.lit(0.0), 100 - F.col("total_supply_distance_m") / 20),
        "_c": F.when(F.col("scheme_source_type") == NEW_LINE, 80.0).otherwise(70.0),
        "_r": (mapped(F.col("route_count"), rule.source_count_scores, 60) + mapped(F.col("operation_mode"), rule.mode_scores, 75)) / 2,
    })
    total = F.col("_d") * rule.distance_weight + F.col("_c") * rule.capacity_weight + F.col("_r") * rule.reliability_weight
    return with_rounded(
        scored, 2, distance_score=F.col("_d"), reliability_score=F.col("_r"), total_score=total
    ).withColumn("available_capacity_score", F.col("_c")).drop("_d", "_c", "_r")


def rank_schemes(
    usable: DataFrame, decisions: DataFrame, new_lines: DataFrame | None, rule: ScoringRule, tasks: int | None = None
) -> DataFrame:
    """The best schemes per request, ranked; a feasible new line competes with the combinations."""
    combos = candidate_schemes(usable, decisions, rule.max_output, tasks=tasks)
    if new_lines is not None:
        fresh = new_lines.filter("is_triggered and is_feasible").join(
            decisions.select("request_id", "minimum_route_count"), "request_id", "left"
        )
        combos = combos.unionByName(fresh.select(
            "request_id", F.lit(NEW_LINE).alias("scheme_source_type"), F.lit(NEW_LINE_MODE).alias("operation_mode"),
            F.lit("").alias("point_ids"), F.coalesce("minimum_route_count", F.lit(1)).alias("route_count"),
            F.lit(0.0).alias("total_supply_distance_m"), F.lit(None).cast(combos.schema["_order"].dataType).alias("_order"),
        ))
    scored = score_schemes(combos, rule)
    order = [F.col("total_score").desc(), F.col("_order").asc_nulls_last()]
    return top_per_group(scored, ["request_id"], order, rule.max_output).drop("_order")


def no_scheme_conclusions(requests: DataFrame, ranked: DataFrame, checks: DataFrame) -> DataFrame:
    """Requests without any scheme and how often each constraint failed for them."""
    lost = requests.select("request_id").join(ranked.select("request_id"), "request_id", "left_anti")
    failed = checks.filter("failed_constraints <> ''").select(
        "request_id", F.explode(F.split("failed_constraints", ",")).alias("failed_constraint")
    )
    return (
        lost.join(failed, "request_id", "left")
        .groupBy("request_id", "failed_constraint").agg(F.count("failed_constraint").alias("failures"))
        .withColumn("failed_constraint", F.coalesce("failed_constraint", F.lit("未形成满足全部约束的候选接入方案")))
    )
