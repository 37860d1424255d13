"""High-voltage grid access: source search, screening, plan composition and scoring, load transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.numeric import with_rounded
from ontoweave.operators.geo import EARTH_M, expand_rings, nearest_groups, radius_join, search_rings
from ontoweave.operators.grouping import first_wins, last_wins
from ontoweave.operators.ordering import top_per_group

# Fixed values of the domain.
RADII_M = [200, 500, 800, 1000, 1500, 2000]
TARGET_FEEDERS = 5
BAY_TYPES = ["环网柜", "开关站"]
SINGLE, DUAL_LOOP, DUAL_SOURCE = "单电源", "双回路", "双电源"
PLAN_MODES = ["同时供电互为备用", "同时供电", "一主一备"]
SOURCE_SCORES = {"双电源": 100, "双回路": 90, "单电源": 80}
MODE_SCORES = {"同时供电互为备用": 100, "同时供电": 90, "一主一备": 80, "一路主供": 70, "单电源供电": 70}
MAX_SINGLE_PLANS = 5
MIN_DUAL_PLANS = 15
MAX_FINAL_PLANS = 10


def centres(requests: DataFrame) -> DataFrame:
    return requests.withColumnsRenamed({"lng": "center_lng", "lat": "center_lat"})


def validate_source_requirement(requests: DataFrame, requirements: DataFrame) -> DataFrame:
    """Declared against required source structure; an empty declaration passes."""
    rule = first_wins(
        requirements.select("load_level", "importance_level", "source_structure", "requirement_id"),
        ["load_level", "importance_level"], ["requirement_id"],
    ).withColumnRenamed("source_structure", "required_source_structure").drop("requirement_id")
    declared = F.coalesce(
        *[F.when(F.col(c) != "", F.col(c)) for c in ("target_source_structure", "source_structure", "original_source_structure")],
        F.lit(""),
    )
    joined = requests.withColumn("declared_source_structure", declared).join(
        rule, ["load_level", "importance_level"], "left"
    )
    wanted, told = F.col("required_source_structure"), F.col("declared_source_structure")
    passed = (told == "") | (told == wanted)
    return joined.select(
        "request_id", "load_level", "importance_level", "declared_source_structure", "required_source_structure",
        F.when(wanted.isNull(), None).otherwise(passed.cast("int")).alias("passed"),
        F.when(wanted.isNull(), "no_rule").when(passed, "").otherwise(
            F.concat(F.lit("需按"), wanted, F.lit("补充电源点/回路"))
        ).alias("next_action"),
    )


def access_points_in_range(requests: DataFrame, points: DataFrame, radius_m: float, counted: bool = False) -> DataFrame:
    met = radius_join(centres(requests), points, radius_m, EARTH_M, "_d", counted)
    return with_rounded(met, 1, distance_m=F.col("_d")).drop("center_lng", "center_lat")


def search_sources(requests: DataFrame, points: DataFrame, radii: list[float] = RADII_M,
                   required: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Ring search per request; ``preferred_point_types`` (comma list) narrows the point types.

    A number of feeders wanted that depends on the rows (``required``) needs all pairs of the last ring.
    """
    asked = requests.select("request_id", "lng", "lat", "preferred_point_types")
    preferred = F.coalesce("preferred_point_types", F.lit(""))
    allowed = (preferred == "") | F.array_contains(F.split(preferred, r"\s*,\s*"), F.col("point_type"))
    if required is None:
        met, summary = search_rings(centres(asked), points, "request_id", "feeder_id", radii, TARGET_FEEDERS, allowed=allowed)
        found = with_rounded(met, 1, distance_m=F.col("_d")).drop("center_lng", "center_lat")
    else:
        near = access_points_in_range(asked, points, float(radii[-1])).filter(allowed)
        found, summary = expand_rings(near, "request_id", "feeder_id", "_d", radii, required)
    return found.drop("_d", "preferred_point_types"), summary


def _bays_ok(points_column: str = "spare_intervals") -> Column:
    return ~F.col("point_type").isin(BAY_TYPES) | (F.col(points_column) >= 2)


def _attach(points: DataFrame, feeders: DataFrame, transformers: DataFrame) -> DataFrame:
    f = feeders.select(
        "feeder_id", F.col("busbar_id"), F.col("substation_id"), "transformer_id", "max_load_rate",
        F.col("openable_capacity_kva").alias("feeder_openable_kva"), "connected_users", "loss_rate",
    )
    t = transformers.select(
        "transformer_id", F.col("openable_capacity_kva").alias("transformer_openable_kva"),
        F.col("load_rate").alias("transformer_load_rate"), F.lit(True).alias("has_transformer"),
    )
    return points.join(f, "feeder_id", "left").join(t, "transformer_id", "left")


def filter_sources(points: DataFrame, feeders: DataFrame, transformers: DataFrame) -> DataFrame:
    """Seven limits (F1-F7) per candidate point; ``per_path_capacity_kva`` is a column of ``points``."""
    j = _attach(points, feeders, transformers)
    need = F.col("per_path_capacity_kva")
    absent = F.col("has_transformer").isNull()
    checks = {
        "F1": F.col("max_load_rate") < 0.8,
        "F2": F.col("feeder_openable_kva") > need,
        "F3": _bays_ok(),
        "F4": F.col("connected_users") <= 50,
        "F5": F.col("loss_rate") <= 0.07,
        "F6": absent | (F.col("transformer_openable_kva") > need),
        "F7": absent | (F.col("transformer_load_rate") < 0.8),
    }
    staged = j.withColumns({f"_{k}": F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    failed = F.concat_ws(",", *[F.when(~F.col(f"_{k}"), F.lit(k)) for k in checks])
    no_feeder = F.col("max_load_rate").isNull()
    feeder_problem = ~(F.col("_F1") & F.col("_F2") & F.col("_F4") & F.col("_F5"))
    transformer_problem = ~(F.col("_F6") & F.col("_F7"))
    return staged.select(
        *points.columns,
        F.when(no_feeder, "馈线信息缺失").otherwise(failed).alias("reasons"),
        (~no_feeder & (failed == "")).alias("passed"),
        F.when(no_feeder, "")
        .when(feeder_problem, "馈线问题→考虑 transfer_feeder_load")
        .when(transformer_problem, "主变问题→考虑 transfer_transformer_load")
        .otherwise("").alias("remedy"),
    )


def supplementary_sources(
    requests: DataFrame, points: DataFrame, feeders: DataFrame, transformers: DataFrame, radius_m: float = 2000.0
) -> DataFrame:
    """Second sources for expansion requests: near enough, independent of the original feeder, with room.

    ``requests``: request_id, lng, lat, capacity_kva, original_point_id,
    required_source_structure, declared_source_structure.
    """
    needed = requests.filter(
        (F.col("required_source_structure") != F.col("declared_source_structure"))
        & (F.col("required_source_structure") != SINGLE)
    )
    origin = needed.join(
        points.select(F.col("point_id").alias("original_point_id"), F.col("feeder_id").alias("_f0")), "original_point_id"
    ).join(
        feeders.select(F.col("feeder_id").alias("_f0"), F.col("busbar_id").alias("_b0"), F.col("substation_id").alias("_s0")),
        "_f0",
    )
    near = access_points_in_range(origin, points, radius_m).filter("point_id <> original_point_id")
    j = _attach(near, feeders, transformers)
    other_bus = F.col("busbar_id") != F.col("_b0")
    independent = F.when(F.col("required_source_structure") == DUAL_LOOP, other_bus).when(
        F.col("required_source_structure") == DUAL_SOURCE, other_bus | (F.col("substation_id") != F.col("_s0"))
    ).otherwise(False)
    absent = F.col("has_transformer").isNull()
    roomy = (
        (F.col("max_load_rate") < 0.8) & (F.col("feeder_openable_kva") >= F.col("capacity_kva")) & _bays_ok()
        & (absent | ((F.col("transformer_openable_kva") >= F.col("capacity_kva")) & (F.col("transformer_load_rate") < 0.8)))
    )
    return j.filter((F.col("feeder_id") != F.col("_f0")) & independent & roomy).select(
        "request_id", "point_id", "feeder_id", "busbar_id", "substation_id", "transformer_id", "distance_m",
        F.col("feeder_openable_kva").alias("openable_capacity_kva"),
        F.coalesce("transformer_openable_kva", F.lit(0)).alias("transformer_openable_capacity_kva"),
    )


def point_rooms(points: DataFrame, feeders: DataFrame) -> DataFrame:
    """(point_id, room): what the feeders of a point add to the capacity score of its plans, and how many they are."""
    held = points.select("point_id", "feeder_id").join(feeders.select("feeder_id", "openable_capacity_kva"), "feeder_id")
    share = F.least(F.lit(100.0), F.col("openable_capacity_kva") / 100)
    return held.groupBy("point_id").agg(F.struct(F.sum(share).alias("total"), F.count("*").alias("n")).alias("room"))


def with_feeders(points: DataFrame, feeders: DataFrame) -> DataFrame:
    """Points with site and room, so that candidates found from them are composed and scored without another join.

    A point with several feeder rows is one row for each, one without any has no site.
    """
    sites = feeders.select("feeder_id", F.struct("substation_id", "busbar_id").alias("site"))
    return points.join(sites, "feeder_id", "left").join(point_rooms(points, feeders), "point_id", "left")


def _added(*rooms: str) -> Column:
    """The rooms of a plan's points as one."""
    sums = {c: sum((F.coalesce(F.col(f"{r}.{c}"), F.lit(0).cast(t)) for r in rooms[1:]), F.coalesce(F.col(f"{rooms[0]}.{c}"), F.lit(0).cast(t)))
            for c, t in (("total", "double"), ("n", "bigint"))}
    return F.struct(*[v.alias(c) for c, v in sums.items()]).alias("room")


def compose_single(candidates: DataFrame) -> DataFrame:
    """Nearest point of each feeder, the five nearest feeders per request; plans carry the ``room`` of candidates that have one."""
    carried = [c for c in ("room",) if c in candidates.columns]
    nearest = first_wins(
        candidates.select("request_id", "feeder_id", "point_id", "distance_m", *carried),
        ["request_id", "feeder_id"], ["distance_m", "point_id"],
    )
    kept = top_per_group(nearest, ["request_id"], [F.col("distance_m"), F.col("point_id")], MAX_SINGLE_PLANS)
    return kept.select(
        F.concat_ws("-", "request_id", "point_id").alias("plan_id"), "request_id",
        F.lit(SINGLE).alias("source_structure"), F.lit("单电源供电").alias("operation_mode"),
        F.col("point_id").alias("point_ids"), F.col("distance_m").alias("total_distance_m"), *[_added(c) for c in carried],
    )


def compose_single_anywhere(requests: DataFrame, points: DataFrame) -> DataFrame:
    """``compose_single`` from all points: the five nearest feeders of a request, however far they are."""
    asked = centres(requests.select("request_id", "lng", "lat"))
    return compose_single(nearest_groups(asked, points, "request_id", "feeder_id", "point_id", MAX_SINGLE_PLANS))


def compose_dual(candidates: DataFrame, feeders: DataFrame, structure: str) -> DataFrame:
    """Independent point pairs in three operation modes.

    Points are taken nearest first and paired with every later independent
    point; no further first point is taken once a request has 15 plans. A first
    point without partners has only points of its own site behind it, so all
    later ones lack partners too. Every first point that counts thus adds a
    pair, and the five nearest points suffice: 5 x n pairs, never n x n.
    Candidates of ``with_feeders`` bring their sites, and plans carry their room.
    """
    if "site" in candidates.columns:
        known = candidates.filter(F.col("site").isNotNull())
    else:
        known = candidates.join(feeders.select("feeder_id", F.struct("substation_id", "busbar_id").alias("site")), "feeder_id")
    carried = [c for c in ("room",) if c in candidates.columns]
    site = F.col("site.busbar_id") if structure == DUAL_LOOP else F.col("site")
    sited = known.select("request_id", F.struct("distance_m", "point_id").alias("place"), site.alias("site"), *carried)
    need = -(-MIN_DUAL_PLANS // len(PLAN_MODES))
    heads = top_per_group(sited, ["request_id"], [F.col("place")], need).select(
        "request_id", F.col("place").alias("first"), F.col("site").alias("first_site"), "rank", *[F.col(c).alias(f"first_{c}") for c in carried]
    )
    # Heads, counts and bounds are few rows a request: they are hashed, so that the many pairs and plans are neither sorted nor sent.
    pairs = sited.join(heads.hint("shuffle_hash"), "request_id").filter(
        (F.col("place") > F.col("first")) & (F.col("site") != F.col("first_site"))
    )
    taken = (
        pairs.groupBy("request_id").agg(
            *[F.count(F.when(F.col("rank") < r, 1)).alias(f"_before_{r}") for r in range(1, need + 1)]
        )
    )
    before = F.element_at(F.array(*[F.col(f"_before_{r}") for r in range(1, need + 1)]), F.col("rank"))
    kept = pairs.join(taken.hint("shuffle_hash"), "request_id").filter(before * len(PLAN_MODES) < MIN_DUAL_PLANS)
    spread = kept.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in PLAN_MODES])))
    staged = with_rounded(spread, 1, total_distance_m=F.col("first.distance_m") + F.col("place.distance_m"))
    return staged.select(
        F.concat_ws("-", "request_id", F.lit(structure), "first.point_id", "place.point_id", "mode").alias("plan_id"), "request_id",
        F.lit(structure).alias("source_structure"),
        F.concat(F.lit("两路电源"), "mode", F.lit(f"({structure})")).alias("operation_mode"),
        F.concat_ws(",", "first.point_id", "place.point_id").alias("point_ids"), "total_distance_m", *[_added(f"first_{c}", c) for c in carried],
    )


def _mapped(col: Column, table: dict[str, int], default: int, inside: bool) -> Column:
    chain = None
    for name, value in table.items():
        test = col.contains(name) if inside else col == name
        chain = (F.when if chain is None else chain.when)(test, float(value))
    return chain.otherwise(float(default))


def distance_bounds(plans: DataFrame) -> DataFrame:
    """Shortest and longest plan of every request."""
    return plans.groupBy("request_id").agg(F.min("total_distance_m").alias("_lo"), F.max("total_distance_m").alias("_hi"))


def score_plans(plans: DataFrame, points: DataFrame, feeders: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """40% distance (min-max per request), 30% capacity, 30% reliability.

    Plans that carry their ``room`` are scored with it; of others it is joined by the points they name.
    ``bounds`` are given where ``plans`` are a part of the plans of their requests.
    """
    # One bounds row per request, joined back: no window holds all plans of a request.
    bounds = distance_bounds(plans) if bounds is None else bounds
    j = plans.join(bounds.hint("shuffle_hash"), "request_id")
    if "room" not in plans.columns:
        rooms = (
            plans.select("plan_id", F.explode(F.split("point_ids", ",")).alias("point_id"))
            .join(point_rooms(points, feeders), "point_id")
            .groupBy("plan_id").agg(F.struct(F.sum("room.total").alias("total"), F.sum("room.n").alias("n")).alias("room"))
        )
        j = j.join(rooms, "plan_id", "left")
    share = F.when(
        F.col("_hi") > F.col("_lo"), 100 * (1 - (F.col("total_distance_m") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    ).otherwise(100.0)
    source = _mapped(F.col("source_structure"), SOURCE_SCORES, 80, inside=False)
    mode = _mapped(F.col("operation_mode"), MODE_SCORES, 70, inside=True)
    capacity = F.when(F.col("room.n") > 0, F.col("room.total") / F.col("room.n"))
    parts = with_rounded(
        j, 1, distance_score=share, capacity_score=F.coalesce(capacity, F.lit(50.0)),
        reliability_score=source * 0.5 + mode * 0.5,
    )
    total = F.col("distance_score") * 0.4 + F.col("capacity_score") * 0.3 + F.col("reliability_score") * 0.3
    return with_rounded(parts, 1, total_score=total).drop("_lo", "_hi", "room")


def finalize_plans(scored: DataFrame) -> DataFrame:
    """Best plan per operation mode, at most ten per request."""
    best = first_wins(
        scored.withColumn("_order", -F.col("total_score")), ["request_id", "operation_mode"], ["_order", "plan_id"]
    )
    return top_per_group(best, ["request_id"], [F.col("_order"), F.col("plan_id")], MAX_FINAL_PLANS).drop("_order")


def ties(switches: DataFrame, left: str, right: str) -> DataFrame:
    """Tie switches seen from both ends: (source, target, switch_id)."""
    return switches.select(F.col(left).alias("source"), F.col(right).alias("target"), "switch_id").unionByName(
        switches.select(F.col(right).alias("source"), F.col(left).alias("target"), "switch_id")
    )


def transfer_load(needs: DataFrame, tie_rows: DataFrame, units: DataFrame, feeder_rule: bool) -> DataFrame:
    """First tie neighbour (by switch) that can take the load and stays at or below 80%.

    ``needs``: request_id, source, need. ``units``: unit_id, load_rate,
    openable, rated. Feeders weigh the load into the open capacity,
    transformers relate it to the rated capacity.
    """
    need = F.col("need")

    def after(sign: int, rate: str, openable: str, rated: str) -> Column:
        if feeder_rule:
            whole = F.greatest(F.col(openable) + need, F.lit(1.0))
            if sign > 0:
                return (F.col(rate) * F.col(openable) + need) / whole
            return F.col(rate) - need / whole
        return F.col(rate) + sign * (need / F.greatest(F.col(rated), F.lit(1.0)))

    source = units.select(
        F.col("unit_id").alias("source"), F.col("load_rate").alias("_r0"), F.col("openable").alias("_o0"),
        F.col("rated").alias("_k0"),
    )
    target = units.select(
        F.col("unit_id").alias("target"), F.col("load_rate").alias("_r1"), F.col("openable").alias("_o1"),
        F.col("rated").alias("_k1"),
    )
    tried = needs.join(tie_rows, "source").join(target, "target").withColumn("_after", after(1, "_r1", "_o1", "_k1"))
    fitting = tried.filter((F.col("_o1") >= need) & (F.col("_after") <= 0.8))
    best = first_wins(
        fitting.select("request_id", "source", "target", "switch_id", "_after"),
        ["request_id", "source"], ["switch_id", "target"],
    )
    j = needs.join(source, "source").join(best, ["request_id", "source"], "left")
    staged = with_rounded(j, 3, source_load_rate_after=after(-1, "_r0", "_o0", "_k0"), target_load_rate_after=F.col("_after"))
    found = F.col("target").isNotNull()
    return staged.select(
        "request_id", "source", "target", "switch_id", F.col("need").alias("transfer_capacity_kva"),
        F.when(found, F.col("source_load_rate_after")).alias("source_load_rate_after"), "target_load_rate_after",
        F.when(found, "").otherwise("考虑 new_feeder").alias("remedy"),
    )


def verify_transfer(
    requests: DataFrame, points: DataFrame, feeders: DataFrame, transformers: DataFrame,
    feeder_transfers: DataFrame, transformer_transfers: DataFrame, source_checks: DataFrame,
) -> DataFrame:
    """Recheck an expansion request after its latest transfers."""
    latest_f = last_wins(
        feeder_transfers.select("request_id", F.col("source").alias("_ft"), F.col("transfer_capacity_kva").alias("_fk"), "switch_id"),
        ["request_id"], ["switch_id"],
    ).drop("switch_id")
    latest_t = last_wins(
        transformer_transfers.select(
            "request_id", F.col("source").alias("_tt"), F.col("transfer_capacity_kva").alias("_tk"),
            F.col("source_load_rate_after").alias("_tr"), "switch_id",
        ),
        ["request_id"], ["switch_id"],
    ).drop("switch_id")
    j = (
        requests.select("request_id", F.col("original_point_id").alias("point_id"), "capacity_kva")
        .join(points.select("point_id", "feeder_id"), "point_id")
        .join(feeders.select("feeder_id", "transformer_id", F.col("openable_capacity_kva").alias("_fo")), "feeder_id")
        .join(
            transformers.select("transformer_id", F.col("openable_capacity_kva").alias("_to"), F.col("load_rate").alias("_tl")),
            "transformer_id", "left",
        )
        .join(latest_f, "request_id", "left").join(latest_t, "request_id", "left")
        .join(source_checks.select("request_id", F.col("passed").alias("_passed")), "request_id", "left")
    )
    moved = F.col("_tt") == F.col("transformer_id")
    staged = j.withColumns({
        "feeder_openable_after": F.col("_fo") + F.when(F.col("_ft") == F.col("feeder_id"), F.col("_fk")).otherwise(0.0),
        "transformer_openable_after": F.coalesce("_to", F.lit(0.0)) + F.when(moved, F.col("_tk")).otherwise(0.0),
        "transformer_load_after": F.when(moved, F.col("_tr")).otherwise(F.coalesce("_tl", F.lit(1.0))),
    })
    need = F.col("capacity_kva")
    feeder_ok = F.col("feeder_openable_after") >= need
    transformer_ok = (F.col("transformer_openable_after") >= need) & (F.col("transformer_load_after") < 0.8)
    source_ok = F.coalesce(F.col("_passed"), F.lit(0)) == 1
    return staged.select(
        "request_id", "point_id", "feeder_id", "transformer_id", "feeder_openable_after", "transformer_openable_after",
        feeder_ok.cast("int").alias("feeder_resolved"), transformer_ok.cast("int").alias("transformer_resolved"),
        source_ok.cast("int").alias("source_requirement_passed"),
        (feeder_ok & transformer_ok & source_ok).cast("int").alias("passed"),
        F.when(feeder_ok & transformer_ok & source_ok, "可形成增容方案")
        .when(~source_ok, "补充电源点/回路").otherwise("考虑变电站新出线").alias("next_action"),
    )


def new_feeder(requests: DataFrame, substations: DataFrame, transformers: DataFrame, radius_m: float = 15000.0) -> DataFrame:
    """Nearest substation transformer with a spare bay, load below 80% and room; none gives a verdict."""
    able = transformers.filter((F.col("spare_intervals") > 0) & (F.col("load_rate") < 0.8)).select(
        "transformer_id", "substation_id", "openable_capacity_kva"
    )
    # Transformers go to their substations first: pairs are tested and counted where they meet and never shuffled.
    sites = substations.select("substation_id", "lng", "lat").join(able, "substation_id")
    met = radius_join(centres(requests.select("request_id", "lng", "lat", "capacity_kva")), sites, radius_m, EARTH_M, "_d").filter(
        F.col("openable_capacity_kva") > F.col("capacity_kva")
    )
    fitting = with_rounded(met, 1, distance_m=F.col("_d"))
    best = fitting.groupBy("request_id").agg(
        F.min(F.struct("distance_m", "substation_id", "transformer_id")).alias("_b"), F.count("*").alias("candidates")
    )
    return requests.select("request_id").join(best, "request_id", "left").select(
        "request_id", "_b.substation_id", "_b.transformer_id", "_b.distance_m",
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.when(F.col("_b").isNull(), "no_solution").otherwise("suggested").alias("verdict"),
    )

