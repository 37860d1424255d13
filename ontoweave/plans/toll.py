"""Toll road network: edges, fee parameters, cheapest path, path validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoweave.functions.numeric import half_up_hundreds, lenient_int
from ontoweave.operators.graph import shortest_paths
from ontoweave.operators.grouping import first_wins, last_wins
from ontoweave.session import cut_lineage

UNIT, STATION = 0, 1
IN_USE = 2
EDGE_KEY = ["en_road_node_id", "en_road_node_type", "ex_road_node_id", "ex_road_node_type"]


def _as_int(df: DataFrame, column: str) -> Column:
    return lenient_int(F.col(column), is_text=df.schema[column].dataType.simpleString() == "string")


def _edge(en: Column, en_type: int, ex: Column, ex_type: int, miles: Column, charge: Column, source: str) -> list[Column]:
    return [
        F.coalesce(en, F.lit("")).alias("en_road_node_id"), F.lit(en_type).alias("en_road_node_type"),
        F.coalesce(ex, F.lit("")).alias("ex_road_node_id"), F.lit(ex_type).alias("ex_road_node_type"),
        miles.alias("miles"), charge.alias("charge_miles"), F.lit(source).alias("source"),
    ]


def build_graph(units: DataFrame, stations: DataFrame, rules: DataFrame, check_exit_status: bool = False) -> DataFrame:
    """Road edges of three sources (E1 unit-unit, E2 station-unit, E3 unit-station), corrected by rules.

    A type-1 rule blocks an edge (E4); types 2 and 3 force a zero-length edge
    where no valid one is left (E5). Rules on the same edge act in file order,
    so only the last one and whether a block came before matter. A forced edge
    replaces a blocked one.
    """
    u = units.select(
        "toll_interval_id", "start_org_id", "end_org_id", "opposite_id",
        _as_int(units, "start_org_type").alias("start_type"), _as_int(units, "end_org_type").alias("end_type"),
        _as_int(units, "actual_length").alias("miles"), _as_int(units, "charge_length").alias("charge"),
    )
    s = stations.select(F.col("station_id"), _as_int(stations, "use_status").alias("use_status"))
    a, b = u.alias("a"), u.alias("b")
    e1 = a.join(
        b,
        (F.col("a.end_org_id") == F.col("b.start_org_id"))
        & (F.col("a.end_type") == F.col("b.start_type"))
        & (F.col("a.toll_interval_id") != F.col("b.toll_interval_id"))
        & ((F.coalesce(F.col("a.opposite_id"), F.lit("")) == "") | (F.col("b.toll_interval_id") != F.col("a.opposite_id")))
        & (F.col("a.end_org_id") != ""),
    ).select(*_edge(F.col("a.toll_interval_id"), UNIT, F.col("b.toll_interval_id"), UNIT,
                    F.col("a.miles"), F.col("a.charge"), "E1"))
    zero = F.lit(0).cast("bigint")
    e2 = (
        u.filter(F.col("start_type") == STATION)
        .join(s.filter(F.col("use_status") == IN_USE), F.col("start_org_id") == F.col("station_id"))
        .select(*_edge(F.col("station_id"), STATION, F.col("toll_interval_id"), UNIT, zero, zero, "E2"))
    )
    exits = s.filter(F.col("use_status") == IN_USE) if check_exit_status else s
    e3 = (
        u.filter(F.col("end_type") == STATION)
        .join(exits, F.col("end_org_id") == F.col("station_id"))
        .select(*_edge(F.col("toll_interval_id"), UNIT, F.col("station_id"), STATION,
                       F.col("miles"), F.col("charge"), "E3"))
    )
    base = first_wins(e1.unionByName(e2).unionByName(e3), EDGE_KEY, ["source", "miles", "charge_miles"])
    return _with_rules(base, rules)


def _with_rules(base: DataFrame, rules: DataFrame) -> DataFrame:
    kind = _as_int(rules, "contiguity_type")
    acts = (
        rules.select(
            "en_road_node_id", _as_int(rules, "en_road_node_type").cast("int").alias("en_road_node_type"),
            "ex_road_node_id", _as_int(rules, "ex_road_node_type").cast("int").alias("ex_road_node_type"),
            kind.alias("kind"), "ordinal",
        )
        .filter(F.col("kind").isin(1, 2, 3))
        .groupBy(*EDGE_KEY)
        .agg(
            F.bool_or(F.col("kind") == 1).alias("blocked"), F.bool_or(F.col("kind") != 1).alias("forced"),
            (F.max_by("kind", "ordinal") == 1).alias("ends_blocked"),
        )
    )
    joined = base.join(acts, EDGE_KEY, "full_outer")
    known = F.col("source").isNotNull()
    blocked, forced = F.coalesce("blocked", F.lit(False)), F.coalesce("forced", F.lit(False))
    ends_blocked = F.coalesce("ends_blocked", F.lit(False))
    # The original row survives unless a force rule had to rebuild the edge.
    rebuilt = forced & (~known | (blocked & ~ends_blocked))
    return joined.filter(known | forced).select(
        F.concat(F.lit("E"), F.substring(F.sha1(F.concat_ws("|", *EDGE_KEY)), 1, 12)).alias("edge_id"),
        *EDGE_KEY,
        F.when(rebuilt, 0).otherwise(F.coalesce("miles", F.lit(0))).cast("bigint").alias("miles"),
        F.when(rebuilt, 0).otherwise(F.coalesce("charge_miles", F.lit(0))).cast("bigint").alias("charge_miles"),
        F.when(ends_blocked, 1).otherwise(0).alias("invalid"),
        F.when(ends_blocked, "E4").when(rebuilt, "E5").otherwise("").alias("rule_id"),
    )


def compute_fees(units: DataFrame, rates: DataFrame, discounts: DataFrame, vehicle_types: list[int]) -> DataFrame:
    """Fee parameters per unit and vehicle class; combinations without a rate keep null fees."""
    u = units.select(
        "toll_interval_id", "rate_code", _as_int(units, "charge_length").alias("charge_length")
    ).withColumn("vehicle_type", F.explode(F.array(*[F.lit(int(v)) for v in vehicle_types])))
    rate = last_wins(
        rates.select("rate_code", _as_int(rates, "vehicle_type").cast("int").alias("vehicle_type"), "vc_rate", "ordinal"),
        ["rate_code", "vehicle_type"], ["ordinal"],
    ).drop("ordinal")
    full_day = first_wins(
        discounts.filter((_as_int(discounts, "start_hour") == 0) & (_as_int(discounts, "end_hour") == 24)).select(
            "toll_interval_id", F.col("vehicle_type").cast("int").alias("vehicle_type"),
            _as_int(discounts, "cpc_discount").alias("cpc"), _as_int(discounts, "etc_discount").alias("etc"), "ordinal",
        ),
        ["toll_interval_id", "vehicle_type"], ["ordinal"],
    ).drop("ordinal")
    code = lenient_int(F.col("rate_code"))
    rate_value = F.coalesce(F.col("vc_rate").try_cast("double"), F.lit(0.0))
    fee = F.when(F.col("_hit").isNull(), None).when(
        code < 50, F.rint(rate_value * F.col("charge_length"))
    ).otherwise(F.rint(rate_value)).cast("bigint")
    priced = (
        u.join(rate.withColumn("_hit", F.lit(1)), ["rate_code", "vehicle_type"], "left")
        .withColumn("fee", fee)
        .join(full_day, ["toll_interval_id", "vehicle_type"], "left")
    )
    reduced = F.col("cpc").isNotNull()
    return priced.select(
        F.concat_ws(":", "toll_interval_id", "vehicle_type").alias("param_id"),
        "toll_interval_id", "vehicle_type", "fee",
        F.when(reduced, F.rint(F.col("fee") * (1000 - F.col("cpc")) / 1000).cast("bigint"))
        .otherwise(F.col("fee")).alias("mfee"),
        F.when(reduced, F.rint(F.col("fee") * (1000 - F.col("etc")) / 1000))
        .otherwise(F.rint(F.col("fee") * F.lit(0.95))).cast("bigint").alias("efee"),
        F.when(F.col("fee").isNull(), "missing_rate").when(reduced, "discount").otherwise("default").alias("rate_source"),
    )


def _node(node_id: str, node_type: str) -> Column:
    return F.concat_ws("|", node_id, node_type)


def network(edges: DataFrame, params: DataFrame, vehicle_type: int) -> DataFrame:
    """Valid edges with what leaving their start costs: a unit its fees, a station nothing."""
    fees = params.filter((F.col("vehicle_type") == vehicle_type) & F.col("mfee").isNotNull()).select(
        F.col("toll_interval_id").alias("_unit"), "mfee", "efee"
    )
    left = edges.filter("invalid = 0").withColumn(
        "_unit", F.when(F.col("en_road_node_type") == UNIT, F.col("en_road_node_id"))
    )
    return left.join(fees, "_unit", "left").select(
        _node("en_road_node_id", "en_road_node_type").alias("src"),
        _node("ex_road_node_id", "ex_road_node_type").alias("dst"), F.col("_unit").alias("unit"),
        F.coalesce("mfee", F.lit(0)).cast("bigint").alias("weight"), F.coalesce("efee", F.lit(0)).cast("bigint").alias("efee"),
        "charge_miles",
    )


def find_paths(
    edges: DataFrame, params: DataFrame, entries: DataFrame, exits: DataFrame, vehicle_type: int = 1
) -> DataFrame:
    """Cheapest station-to-station paths with fee totals.

    ``entries`` and ``exits`` carry station_id; all pairs that are connected are returned.
    """
    net = cut_lineage(network(edges, params, vehicle_type))
    starts = entries.select(F.concat(F.col("station_id"), F.lit("|1")).alias("src")).distinct()
    ends = exits.select(F.concat(F.col("station_id"), F.lit("|1")).alias("dst")).distinct()
    reached = shortest_paths(net.select("src", "dst", "weight"), starts).filter(F.size("path") > 1)
    wanted = reached.join(ends, "dst", "left_semi")
    hops = wanted.select(
        F.col("src").alias("entry"), F.col("dst").alias("exit"), "path", F.posexplode("path").alias("pos", "src")
    ).withColumn("dst", F.get("path", F.col("pos") + 1))
    parts = hops.join(net.filter("unit is not null"), ["src", "dst"]).groupBy("entry", "exit").agg(
        F.array_sort(F.collect_list(F.struct(
            "pos", "unit", F.col("weight").alias("m"), F.col("efee").alias("e"),
        ))).alias("_steps"),
        F.sum("weight").alias("_m"), F.sum("efee").alias("_e"), F.sum("charge_miles").alias("total_mileage"),
    )
    station = lambda c: F.substring_index(c, "|", 1)
    return parts.select(
        F.concat_ws(":", station("entry"), station("exit"), F.lit(vehicle_type)).alias("path_id"),
        station("entry").alias("en_station_id"), station("exit").alias("ex_station_id"),
        F.lit(vehicle_type).alias("vehicle_type"),
        _listed("unit").alias("toll_intervals"), _listed("m").alias("chargefee_group"),
        _listed("e").alias("chargefee95_group"),
        half_up_hundreds(F.col("_m")).alias("total_fee"), discounted_total(F.col("_m"), F.col("_e")).alias("total_fee95"),
        F.col("total_mileage").cast("bigint").alias("total_mileage"),
    )


def _listed(field: str) -> Column:
    return F.array_join(F.transform("_steps", lambda s: s[field].cast("string")), ",")


def discounted_total(mtc: Column, etc: Column) -> Column:
    """ETC total: the smaller of the ETC sum and 95% of the whole-hundred MTC sum, rounded to hundreds."""
    capped = F.least(etc.cast("double"), F.floor(mtc / 100) * 100 * F.lit(0.95))
    return half_up_hundreds(capped.cast("bigint"))


def _items(column: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def validate_paths(paths: DataFrame, edges: DataFrame, units: DataFrame) -> DataFrame:
    """All rule violations (V1-V5) of all paths; a path without rows here is valid.

    Sequences live in one row each, so only V1 (edge lookup) and V5 (gantry
    lookup) shuffle, and on keys finer than a path.
    """
    p = paths.select(
        "path_id", "total_fee", "total_fee95", _items("toll_intervals").alias("units"),
        F.transform(_items("chargefee_group"), lambda x: lenient_int(x)).alias("m"),
        F.transform(_items("chargefee95_group"), lambda x: lenient_int(x)).alias("e"),
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    sums = p.withColumns({"_m": total("m"), "_e": total("e")})
    expected, expected95 = half_up_hundreds(F.col("_m")), discounted_total(F.col("_m"), F.col("_e"))
    sizes = [F.size("units"), F.size("m"), F.size("e")]
    local = sums.select("path_id", F.explode(F.filter(F.array(
        F.when(F.col("total_fee") != expected, F.struct(
            F.lit("V2").alias("rule_id"), F.lit(0).alias("position"),
            F.concat(F.lit("recorded="), F.col("total_fee"), F.lit(" expected="), expected).alias("message"))),
        F.when(F.col("total_fee95") != expected95, F.struct(
            F.lit("V3").alias("rule_id"), F.lit(0).alias("position"),
            F.concat(F.lit("recorded="), F.col("total_fee95"), F.lit(" expected="), expected95).alias("message"))),
        F.when((sizes[0] != sizes[1]) | (sizes[0] != sizes[2]), F.struct(
            F.lit("V4").alias("rule_id"), F.lit(0).alias("position"),
            F.concat_ws("/", *[s.cast("string") for s in sizes]).alias("message"))),
    ), lambda x: x.isNotNull())).alias("v")).select("path_id", "v.*")
    steps = p.select("path_id", "units", F.posexplode("units").alias("position", "unit"))
    pairs = steps.withColumn("next_unit", F.get("units", F.col("position") + 1)).filter(F.col("next_unit").isNotNull())
    valid = edges.filter(f"invalid = 0 and en_road_node_type = {UNIT} and ex_road_node_type = {UNIT}").select(
        F.col("en_road_node_id").alias("unit"), F.col("ex_road_node_id").alias("next_unit")
    )
    broken = pairs.join(valid, ["unit", "next_unit"], "left_anti").select(
        "path_id", F.lit("V1").alias("rule_id"), "position", F.concat_ws("->", "unit", "next_unit").alias("message")
    )
    gantries = units.filter(F.coalesce("gantry_id", F.lit("")) != "").select(
        F.col("toll_interval_id").alias("unit"), "gantry_id"
    )
    # A path is one row of bounded length, so this window never sees more than one path's units.
    order = Window.partitionBy("path_id", "gantry_id").orderBy("position")
    split = (
        steps.select("path_id", "position", "unit").join(gantries, "unit")
        .withColumn("gap", F.col("position") - F.lag("position").over(order))
        .groupBy("path_id", "gantry_id").agg(F.max("gap").alias("gap"), F.min("position").alias("position"))
        .filter(F.col("gap") > 1)
        .select("path_id", F.lit("V5").alias("rule_id"), "position", F.col("gantry_id").alias("message"))
    )
    return broken.unionByName(local).unionByName(split)
