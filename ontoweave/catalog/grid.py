"""Grid access queries: requests at suppliers, access points at customers, feeders at parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.catalog.base import View, ctes, query, sql_haversine, sql_round
from ontoweave.functions.numeric import haversine, with_rounded
from ontoweave.operators.geo import EARTH_M
from ontoweave.plans import grid, schemes
from ontoweave.session import cut_lineage, stored, stored_by, tasks_for

# --- domain objects over the given tables ------------------------------------------------
REQUESTS = View("supplier", {
    "request_id": "s_suppkey", "lng": "1e2 + cast(s_suppkey % 4000 as double) * 15e-3",
    "lat": "3e1 + cast((s_suppkey * 61) % 100 as double) * 1e-3",
    "preferred_point_types": "case when s_nationkey < 8 then '环网柜,开关站' else '' end",
    "capacity_kva": "cast(300 + (s_suppkey * 71) % 3000 as double)", "original_point_id": "s_suppkey * 15 + 2",
    "load_level": "case when s_nationkey < 10 then '一级负荷' when s_nationkey < 18 then '二级负荷' else '三级负荷' end",
    "importance_level": "case when s_acctbal < 2000 then '一级' when s_acctbal < 6000 then '二级' else '普通' end",
    "target_source_structure": "case when s_nationkey % 3 = 0 then '单电源' else '' end",
    "source_structure": "case when s_nationkey % 3 = 1 then '双回路' else '' end", "original_source_structure": "''",
})
REQUIREMENTS = View("nation", {
    "requirement_id": "n_nationkey",
    "load_level": "case when n_nationkey % 3 = 0 then '一级负荷' when n_nationkey % 3 = 1 then '二级负荷' else '四级负荷' end",
    "importance_level": "case when n_regionkey = 0 then '一级' when n_regionkey < 3 then '二级' else '普通' end",
    "source_structure": "case when n_nationkey % 3 = 0 then '双电源' else '双回路' end",
})
POINTS = View("customer", {
    "point_id": "c_custkey", "lng": "1e2 + cast(c_custkey % 60000 as double) * 1e-3",
    "lat": "3e1 + cast((c_custkey * 37) % 100 as double) * 1e-3",
    "point_type": "case when c_nationkey % 4 = 0 then '环网柜' when c_nationkey % 4 = 1 then '开关站' when c_nationkey % 4 = 2 then '架空线' else '分支箱' end",
    "feeder_id": "cast(floor(c_custkey / 2) as bigint)", "spare_intervals": "c_nationkey % 5",
    "is_available": "c_acctbal > -500",
})
FEEDERS = View("part", {
    "feeder_id": "p_partkey", "busbar_id": "cast(floor(p_partkey / 3) as bigint)", "substation_id": "cast(floor(p_partkey / 9) as bigint)",
    "transformer_id": "cast(floor(p_partkey / 6) as bigint)", "max_load_rate": "cast((p_partkey * 7) % 100 as double) / 100",
    "openable_capacity_kva": "cast((p_partkey * 131) % 9000 as double)", "connected_users": "p_size * 2",
    "loss_rate": "cast(p_partkey % 10 as double) / 100",
})
TRANSFORMERS = View("supplier", {
    "transformer_id": "s_suppkey", "substation_id": "cast(floor(s_suppkey / 2) as bigint)",
    "openable_capacity_kva": "cast((s_suppkey * 997) % 20000 as double)",
    "load_rate": "cast((s_suppkey * 13) % 100 as double) / 100", "spare_intervals": "s_nationkey % 4",
    "rated_capacity_kva": "cast(20000 + 1000 * (s_suppkey % 10) as double)",
})
SUBSTATIONS = View("supplier", {
    "substation_id": "s_suppkey", "lng": "1e2 + cast(s_suppkey % 4000 as double) * 15e-3 + 4e-3", "lat": "30.05e0 + cast((s_suppkey * 29) % 40 as double) * 1e-3",
})
SWITCHES = View("part", {
    "switch_id": "p_partkey", "source_feeder_id": "p_partkey", "target_feeder_id": "cast(floor(p_partkey / 2) as bigint) + p_size % 3",
})
TRANSFORMER_SWITCHES = View("supplier", {
    "switch_id": "s_suppkey", "source_transformer_id": "s_suppkey", "target_transformer_id": "cast(floor(s_suppkey / 2) as bigint)",
})
NEEDS = View("customer", {
    "request_id": "c_custkey", "source": "cast(floor(c_custkey / 2) as bigint)", "need": "cast(100 + (c_custkey * 17) % 3000 as double)",
})
EARTH = "6371000"


def _objects(spark, sf):
    return {n: v.df(spark, sf) for n, v in {
        "requests": REQUESTS, "points": POINTS, "feeders": FEEDERS, "transformers": TRANSFORMERS, "substations": SUBSTATIONS,
    }.items()}


@query("grid_source_requirement", ctes(q=REQUESTS, r=REQUIREMENTS) + """,
d AS (SELECT *, coalesce(nullif(target_source_structure, ''), nullif(source_structure, ''), '') AS told FROM q),
w AS (SELECT load_level, importance_level, arg_min(source_structure, requirement_id) AS want FROM r GROUP BY ALL)
SELECT request_id, load_level, importance_level, told AS declared_source_structure, want AS required_source_structure,
  CASE WHEN want IS NULL THEN NULL ELSE CAST(told = '' OR told = want AS INTEGER) END AS passed,
  CASE WHEN want IS NULL THEN 'no_rule' WHEN told = '' OR told = want THEN '' ELSE '需按' || want || '补充电源点/回路' END AS next_action
FROM d LEFT JOIN w USING (load_level, importance_level)""")
def grid_source_requirement(spark, sf):
    return grid.validate_source_requirement(REQUESTS.df(spark, sf), REQUIREMENTS.df(spark, sf))


NEAR = f"""near AS (SELECT q.request_id, q.preferred_point_types, p.*, d, {sql_round('d', 1)} AS distance_m FROM (
  SELECT q.request_id AS rid, p.point_id AS pid, {sql_haversine('q.lng', 'q.lat', 'p.lng', 'p.lat', EARTH)} AS d FROM q JOIN p ON abs(q.lat - p.lat) < 0.05 AND abs(q.lng - p.lng) < 0.05) x
  JOIN q ON q.request_id = rid JOIN p ON p.point_id = pid WHERE d <= 2000)"""
RING = "CASE WHEN d <= 200 THEN 200 WHEN d <= 500 THEN 500 WHEN d <= 800 THEN 800 WHEN d <= 1000 THEN 1000 WHEN d <= 1500 THEN 1500 ELSE 2000 END"
FOUND = f"""ringed AS (SELECT *, {RING} AS ring FROM near WHERE preferred_point_types = '' OR list_contains(string_split(preferred_point_types, ','), point_type)),
cum AS (SELECT r.request_id, v.ring, count(DISTINCT feeder_id) AS n FROM ringed r JOIN (SELECT unnest([200, 500, 800, 1000, 1500, 2000]) AS ring) v ON r.ring <= v.ring GROUP BY ALL),
stop AS (SELECT request_id, coalesce(min(CASE WHEN n >= 5 THEN ring END), 2000) AS stop, max(n) AS total FROM cum GROUP BY 1)"""


@query("grid_search_sources", ctes(q=REQUESTS, p=POINTS) + f", {NEAR}, {FOUND}" + """
SELECT r.request_id, point_id, feeder_id, point_type, distance_m FROM ringed r JOIN stop s ON s.request_id = r.request_id WHERE ring <= stop""")
def grid_search_sources(spark, sf):
    o = _objects(spark, sf)
    found, _ = grid.search_sources(o["requests"], o["points"])
    return found.select("request_id", "point_id", "feeder_id", "point_type", "distance_m")


@query("grid_search_summary", ctes(q=REQUESTS, p=POINTS) + f", {NEAR}, {FOUND}" + """
SELECT s.request_id, CAST(stop AS DOUBLE) AS stopped_radius, n AS distinct_groups, total >= 5 AS satisfied FROM stop s JOIN cum c ON c.request_id = s.request_id AND c.ring = stop""")
def grid_search_summary(spark, sf):
    o = _objects(spark, sf)
    return grid.search_sources(o["requests"], o["points"])[1]


@query("grid_filter_sources", ctes(p=POINTS, f=FEEDERS, t=TRANSFORMERS) + """,
j AS (SELECT p.point_id, p.feeder_id, CAST(500 + (point_id * 11) % 6000 AS DOUBLE) AS need, max_load_rate, f.openable_capacity_kva AS fo, point_type, p.spare_intervals AS sp, connected_users, loss_rate,
  t.openable_capacity_kva AS tk, t.load_rate AS tl FROM p LEFT JOIN f USING (feeder_id) LEFT JOIN t ON t.transformer_id = f.transformer_id),
c AS (SELECT *, max_load_rate < 0.8 AS f1, fo > need AS f2, point_type NOT IN ('环网柜', '开关站') OR sp >= 2 AS f3, connected_users <= 50 AS f4, loss_rate <= 0.07 AS f5,
  coalesce(tk > need, true) AS f6, coalesce(tl < 0.8, true) AS f7 FROM j),
r AS (SELECT *, concat_ws(',', CASE WHEN NOT f1 THEN 'F1' END, CASE WHEN NOT f2 THEN 'F2' END, CASE WHEN NOT f3 THEN 'F3' END, CASE WHEN NOT f4 THEN 'F4' END,
  CASE WHEN NOT f5 THEN 'F5' END, CASE WHEN NOT f6 THEN 'F6' END, CASE WHEN NOT f7 THEN 'F7' END) AS failed FROM c)
SELECT point_id, feeder_id, need AS per_path_capacity_kva, CASE WHEN max_load_rate IS NULL THEN '馈线信息缺失' ELSE failed END AS reasons, max_load_rate IS NOT NULL AND failed = '' AS passed,
  CASE WHEN max_load_rate IS NULL THEN '' WHEN NOT (f1 AND f2 AND f4 AND f5) THEN '馈线问题→考虑 transfer_feeder_load' WHEN NOT (f6 AND f7) THEN '主变问题→考虑 transfer_transformer_load' ELSE '' END AS remedy FROM r""")
def grid_filter_sources(spark, sf):
    o = _objects(spark, sf)
    need = (F.lit(500) + (F.col("point_id") * 11) % 6000).cast("double")
    out = grid.filter_sources(o["points"].withColumn("per_path_capacity_kva", need), o["feeders"], o["transformers"])
    return out.select("point_id", "feeder_id", "per_path_capacity_kva", "reasons", "passed", "remedy")


@query("grid_supplementary_sources", ctes(q=REQUESTS, p=POINTS, f=FEEDERS, t=TRANSFORMERS) + f", {NEAR}" + """,
x AS (SELECT q.request_id, capacity_kva, original_point_id, CASE WHEN capacity_kva > 1500 THEN '双电源' WHEN capacity_kva > 800 THEN '双回路' ELSE '单电源' END AS required,
  p.feeder_id AS f0, f.busbar_id AS b0, f.substation_id AS s0 FROM q JOIN p ON p.point_id = original_point_id JOIN f ON f.feeder_id = p.feeder_id)
SELECT x.request_id, n.point_id, n.feeder_id, f.busbar_id, f.substation_id, f.transformer_id, n.distance_m, f.openable_capacity_kva, coalesce(t.openable_capacity_kva, 0) AS transformer_openable_capacity_kva
FROM x JOIN near n ON n.request_id = x.request_id JOIN f ON f.feeder_id = n.feeder_id LEFT JOIN t ON t.transformer_id = f.transformer_id
WHERE required <> '单电源' AND n.point_id <> original_point_id AND n.feeder_id <> f0
  AND (f.busbar_id <> b0 OR (required = '双电源' AND f.substation_id <> s0))
  AND max_load_rate < 0.8 AND f.openable_capacity_kva >= capacity_kva AND (point_type NOT IN ('环网柜', '开关站') OR n.spare_intervals >= 2)
  AND (t.transformer_id IS NULL OR (t.openable_capacity_kva >= capacity_kva AND t.load_rate < 0.8))""")
def grid_supplementary_sources(spark, sf):
    o = _objects(spark, sf)
    required = F.when(F.col("capacity_kva") > 1500, "双电源").when(F.col("capacity_kva") > 800, "双回路").otherwise("单电源")
    r = o["requests"].select("request_id", "lng", "lat", "capacity_kva", "original_point_id").withColumns(
        {"required_source_structure": required, "declared_source_structure": F.lit("")}
    )
    return grid.supplementary_sources(r, o["points"], o["feeders"], o["transformers"])


def _candidates(o):
    # Found points are stored by request with their sites and rooms; the three compositions and their scores read them from there without a shuffle.
    near = grid.access_points_in_range(o["requests"].select("request_id", "lng", "lat"), grid.with_feeders(o["points"], o["feeders"]), 2000.0)
    return stored_by(near.select("request_id", "point_id", "feeder_id", "distance_m", "site", "room"), "request_id", "candidates")


SINGLE = """single AS (SELECT request_id, point_id, distance_m FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance_m, point_id) AS k FROM (
  SELECT request_id, feeder_id, point_id, distance_m FROM near QUALIFY row_number() OVER (PARTITION BY request_id, feeder_id ORDER BY distance_m, point_id) = 1)) WHERE k <= 5)"""


def _dual(name: str, structure: str, site: str) -> str:
    """All pairs, counted per first point in order: the slow but plain statement of the rule."""
    return f"""pt_{name} AS (SELECT request_id, point_id, distance_m, {site} AS site, row_number() OVER (PARTITION BY request_id ORDER BY distance_m, point_id) AS k FROM near JOIN f USING (feeder_id)),
pr_{name} AS (SELECT a.request_id, a.k, a.point_id AS p1, b.point_id AS p2, a.distance_m AS d1, b.distance_m AS d2 FROM pt_{name} a JOIN pt_{name} b ON a.request_id = b.request_id AND a.k < b.k AND a.site <> b.site),
ct_{name} AS (SELECT request_id, k, SUM(count(*)) OVER (PARTITION BY request_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pr_{name} GROUP BY request_id, k),
dual_{name} AS (SELECT concat_ws('-', p.request_id, '{structure}', p1, p2, m) AS plan_id, p.request_id, '{structure}' AS source_structure, '两路电源' || m || '({structure})' AS operation_mode, p1 || ',' || p2 AS point_ids,
  {sql_round('d1 + d2', 1)} AS total_distance_m FROM pr_{name} p JOIN ct_{name} c ON c.request_id = p.request_id AND c.k = p.k, (SELECT unnest(['同时供电互为备用', '同时供电', '一主一备']) AS m) WHERE coalesce(before, 0) * 3 < 15)"""


DUAL_LOOP = _dual("loop", "双回路", "busbar_id")
DUAL_SOURCE = _dual("source", "双电源", "{'s': substation_id, 'b': busbar_id}")
PLANS = """plans AS (SELECT concat_ws('-', request_id, point_id) AS plan_id, request_id, '单电源' AS source_structure, '单电源供电' AS operation_mode, CAST(point_id AS VARCHAR) AS point_ids, distance_m AS total_distance_m FROM single
UNION ALL SELECT * FROM dual_loop UNION ALL SELECT * FROM dual_source)"""
PLAN_CTES = ctes(q=REQUESTS, p=POINTS, f=FEEDERS) + ",\n".join(["", NEAR, SINGLE, DUAL_LOOP, DUAL_SOURCE, PLANS])


def _plan_parts(spark, sf, o):
    c = _candidates(o)
    single = grid.compose_single(c).withColumn("point_ids", F.col("point_ids").cast("string"))
    return [single, grid.compose_dual(c, o["feeders"], "双回路"), grid.compose_dual(c, o["feeders"], "双电源")]


def _plans(spark, sf):
    return reduce(DataFrame.unionByName, _plan_parts(spark, sf, _objects(spark, sf))).drop("room")


def _scored(spark, sf):
    # Each kind of plan is scored where it is composed, by request; only the bounds of all kinds meet.
    o = _objects(spark, sf)
    parts = _plan_parts(spark, sf, o)
    bounds = grid.distance_bounds(reduce(DataFrame.unionByName, parts))
    return reduce(DataFrame.unionByName, [grid.score_plans(p, o["points"], o["feeders"], bounds) for p in parts])


@query("grid_compose_plans", PLAN_CTES + " SELECT * FROM plans")
def grid_compose_plans(spark, sf):
    return _plans(spark, sf)


ANYWHERE = f"""alld AS (SELECT request_id, feeder_id, point_id, {sql_round('d', 1)} AS distance_m FROM (
  SELECT request_id, feeder_id, point_id, {sql_haversine('q.lng', 'q.lat', 'p.lng', 'p.lat', EARTH)} AS d FROM q, p)),
nf AS (SELECT * FROM alld QUALIFY row_number() OVER (PARTITION BY request_id, feeder_id ORDER BY distance_m, point_id) = 1)"""


@query("grid_single_plans_anywhere", ctes(q=REQUESTS, p=POINTS) + f""", {ANYWHERE}
SELECT concat_ws('-', request_id, point_id) AS plan_id, request_id, '单电源' AS source_structure, '单电源供电' AS operation_mode, point_id AS point_ids, distance_m AS total_distance_m
FROM nf QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY distance_m, point_id) <= 5""")
def grid_single_plans_anywhere(spark, sf):
    o = _objects(spark, sf)
    return grid.compose_single_anywhere(o["requests"], o["points"])


SCORES = f"""bounds AS (SELECT request_id, min(total_distance_m) AS lo, max(total_distance_m) AS hi FROM plans GROUP BY 1),
room AS (SELECT plan_id, sum(least(100::DOUBLE, openable_capacity_kva / 100)) / count(*) AS c FROM (SELECT plan_id, CAST(unnest(string_split(point_ids, ',')) AS BIGINT) AS point_id FROM plans) JOIN p USING (point_id) JOIN f USING (feeder_id) GROUP BY 1),
s1 AS (SELECT plans.*, {sql_round('CASE WHEN hi > lo THEN 100 * (1 - (total_distance_m - lo) / (hi - lo)) ELSE 100 END', 1)} AS distance_score, {sql_round('coalesce(c, 50)', 1)} AS capacity_score,
  CASE source_structure WHEN '双电源' THEN 100 WHEN '双回路' THEN 90 ELSE 80 END AS sd, CASE WHEN contains(operation_mode, '同时供电互为备用') THEN 100 WHEN contains(operation_mode, '同时供电') THEN 90
    WHEN contains(operation_mode, '一主一备') THEN 80 ELSE 70 END AS md FROM plans JOIN bounds USING (request_id) LEFT JOIN room USING (plan_id)),
s2 AS (SELECT *, {sql_round('sd * 0.5::DOUBLE + md * 0.5::DOUBLE', 1)} AS reliability_score FROM s1),
scored AS (SELECT request_id, plan_id, source_structure, operation_mode, point_ids, total_distance_m, distance_score, capacity_score, reliability_score,
  {sql_round('distance_score * 0.4::DOUBLE + capacity_score * 0.3::DOUBLE + reliability_score * 0.3::DOUBLE', 1)} AS total_score FROM s2)"""


@query("grid_score_plans", PLAN_CTES + f", {SCORES} SELECT * FROM scored")
def grid_score_plans(spark, sf):
    return _scored(spark, sf)


@query("grid_finalize_plans", PLAN_CTES + f", {SCORES}" + """,
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY request_id, operation_mode ORDER BY total_score DESC, plan_id) = 1)
SELECT request_id, plan_id, operation_mode, total_score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY total_score DESC, plan_id) AS k FROM best) WHERE k <= 10""")
def grid_finalize_plans(spark, sf):
    return grid.finalize_plans(_scored(spark, sf)).select("request_id", "plan_id", "operation_mode", "total_score", "rank")


def _transfer_sql(after: str, before: str) -> str:
    return f""",
tie AS (SELECT a AS source, b AS target, switch_id FROM sw UNION ALL SELECT b, a, switch_id FROM sw),
tried AS (SELECT n.request_id, n.source, n.need, tie.target, switch_id, {after.format(r='u.load_rate', o='u.openable', k='u.rated')} AS a, u.openable FROM n JOIN tie ON tie.source = n.source JOIN u ON u.unit_id = tie.target),
best AS (SELECT * FROM tried WHERE openable >= need AND a <= 0.8 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY switch_id, target) = 1)
SELECT n.request_id, n.source, b.target, b.switch_id, n.need AS transfer_capacity_kva, CASE WHEN b.target IS NOT NULL THEN {sql_round(before.format(r='u.load_rate', o='u.openable', k='u.rated'), 3)} END AS source_load_rate_after,
  {sql_round('b.a', 3)} AS target_load_rate_after, CASE WHEN b.target IS NULL THEN '考虑 new_feeder' ELSE '' END AS remedy
FROM n JOIN u ON u.unit_id = n.source LEFT JOIN best b ON b.request_id = n.request_id"""


FEEDER_AFTER = "({r} * {o} + n.need) / greatest({o} + n.need, 1)"
FEEDER_BEFORE = "{r} - n.need / greatest({o} + n.need, 1)"


def _feeder_units(o):
    return o["feeders"].select(
        F.col("feeder_id").alias("unit_id"), F.col("max_load_rate").alias("load_rate"), F.col("openable_capacity_kva").alias("openable"),
        F.lit(1.0).alias("rated"),
    )


def _transformer_units(o):
    return o["transformers"].select(
        F.col("transformer_id").alias("unit_id"), "load_rate", F.col("openable_capacity_kva").alias("openable"),
        F.col("rated_capacity_kva").alias("rated"),
    )


@query("grid_transfer_feeder_load", ctes(
    n=NEEDS, f=FEEDERS, s=SWITCHES, u="SELECT feeder_id AS unit_id, max_load_rate AS load_rate, openable_capacity_kva AS openable, 1 AS rated FROM f",
    sw="SELECT source_feeder_id AS a, target_feeder_id AS b, switch_id FROM s",
) + _transfer_sql(FEEDER_AFTER, FEEDER_BEFORE))
def grid_transfer_feeder_load(spark, sf):
    ties = grid.ties(SWITCHES.df(spark, sf), "source_feeder_id", "target_feeder_id")
    return grid.transfer_load(NEEDS.df(spark, sf), ties, _feeder_units(_objects(spark, sf)), feeder_rule=True)


@query("grid_transfer_transformer_load", ctes(
    n0=NEEDS, n="SELECT request_id, CAST(floor(request_id / 15) AS BIGINT) AS source, need FROM n0", t=TRANSFORMERS, s=TRANSFORMER_SWITCHES,
    u="SELECT transformer_id AS unit_id, load_rate, openable_capacity_kva AS openable, rated_capacity_kva AS rated FROM t",
    sw="SELECT source_transformer_id AS a, target_transformer_id AS b, switch_id FROM s",
) + _transfer_sql("{r} + n.need / greatest({k}, 1)", "{r} - n.need / greatest({k}, 1)"))
def grid_transfer_transformer_load(spark, sf):
    ties = grid.ties(TRANSFORMER_SWITCHES.df(spark, sf), "source_transformer_id", "target_transformer_id")
    needs = NEEDS.df(spark, sf).withColumn("source", F.floor(F.col("request_id") / 15))
    return grid.transfer_load(needs, ties, _transformer_units(_objects(spark, sf)), feeder_rule=False)


MOVES = View("orders", {
    "request_id": "o_custkey", "source": "cast(floor((o_custkey * 15 + 2) / 2) as bigint)", "transfer_capacity_kva": "cast(o_orderkey % 3000 as double)",
    "source_load_rate_after": "cast(o_orderkey % 100 as double) / 100", "switch_id": "o_orderkey",
})
TRANSFORMER_MOVES = View("lineitem", {
    "request_id": "l_suppkey", "source": "cast(floor(floor((l_suppkey * 15 + 2) / 2) / 6) as bigint)", "transfer_capacity_kva": "cast(l_partkey % 9000 as double)",
    "source_load_rate_after": "cast(l_partkey % 100 as double) / 100", "switch_id": "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber",
})


@query("grid_verify_transfer", ctes(q=REQUESTS, p=POINTS, f=FEEDERS, t=TRANSFORMERS, r=REQUIREMENTS, m=MOVES, k=TRANSFORMER_MOVES) + """,
told AS (SELECT *, coalesce(nullif(target_source_structure, ''), nullif(source_structure, ''), '') AS told FROM q),
want AS (SELECT load_level, importance_level, arg_min(source_structure, requirement_id) AS want FROM r GROUP BY ALL),
lf AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY switch_id DESC) = 1),
lt AS (SELECT request_id, source, transfer_capacity_kva, source_load_rate_after FROM k QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY switch_id DESC, source DESC, transfer_capacity_kva DESC) = 1),
j AS (SELECT told.request_id, p.point_id, f.feeder_id, f.transformer_id, capacity_kva,
  f.openable_capacity_kva + CASE WHEN lf.source = f.feeder_id THEN lf.transfer_capacity_kva ELSE 0 END AS fa,
  coalesce(t.openable_capacity_kva, 0) + CASE WHEN lt.source = f.transformer_id THEN lt.transfer_capacity_kva ELSE 0 END AS ta,
  CASE WHEN lt.source = f.transformer_id THEN lt.source_load_rate_after ELSE coalesce(t.load_rate, 1) END AS tl, coalesce(want IS NOT NULL AND (told = '' OR told = want), false) AS ok
  FROM told LEFT JOIN want USING (load_level, importance_level) JOIN p ON p.point_id = original_point_id JOIN f ON f.feeder_id = p.feeder_id LEFT JOIN t ON t.transformer_id = f.transformer_id
  LEFT JOIN lf ON lf.request_id = told.request_id LEFT JOIN lt ON lt.request_id = told.request_id)
SELECT request_id, point_id, feeder_id, transformer_id, fa AS feeder_openable_after, ta AS transformer_openable_after, CAST(fa >= capacity_kva AS INTEGER) AS feeder_resolved,
  CAST(ta >= capacity_kva AND tl < 0.8 AS INTEGER) AS transformer_resolved, CAST(ok AS INTEGER) AS source_requirement_passed, CAST(fa >= capacity_kva AND ta >= capacity_kva AND tl < 0.8 AND ok AS INTEGER) AS passed,
  CASE WHEN fa >= capacity_kva AND ta >= capacity_kva AND tl < 0.8 AND ok THEN '可形成增容方案' WHEN NOT ok THEN '补充电源点/回路' ELSE '考虑变电站新出线' END AS next_action FROM j""")
def grid_verify_transfer(spark, sf):
    o = _objects(spark, sf)
    checks = grid.validate_source_requirement(o["requests"], REQUIREMENTS.df(spark, sf))
    return grid.verify_transfer(
        o["requests"], o["points"], o["feeders"], o["transformers"], MOVES.df(spark, sf), TRANSFORMER_MOVES.df(spark, sf), checks
    )


@query("grid_new_feeder", ctes(q=REQUESTS, b=SUBSTATIONS, t=TRANSFORMERS) + f""",
d AS (SELECT q.request_id, capacity_kva, substation_id, {sql_haversine('q.lng', 'q.lat', 'b.lng', 'b.lat', EARTH)} AS d FROM q JOIN b ON abs(q.lng - b.lng) < 0.5),
c AS (SELECT request_id, d.substation_id, transformer_id, {sql_round('d', 1)} AS distance_m FROM d JOIN t ON t.substation_id = d.substation_id
  WHERE d <= 15000 AND spare_intervals > 0 AND load_rate < 0.8 AND openable_capacity_kva > capacity_kva),
n AS (SELECT request_id, count(*) AS candidates, min({{'d': distance_m, 's': substation_id, 't': transformer_id}}) AS m FROM c GROUP BY 1)
SELECT q.request_id, m.s AS substation_id, m.t AS transformer_id, m.d AS distance_m, coalesce(candidates, 0) AS candidates, CASE WHEN m IS NULL THEN 'no_solution' ELSE 'suggested' END AS verdict
FROM q LEFT JOIN n USING (request_id)""")
def grid_new_feeder(spark, sf):
    o = _objects(spark, sf)
    return grid.new_feeder(o["requests"], o["substations"], o["transformers"])


# --- connection schemes ------------------------------------------------------------------

SCHEME_REQUESTS = View("supplier", {
    "request_id": "s_suppkey", "lng": "1e2 + cast(s_suppkey % 4000 as double) * 15e-3", "lat": "3e1 + cast((s_suppkey * 61) % 100 as double) * 1e-3",
    "business_type": "case when s_nationkey = 5 then '销户' when s_nationkey < 9 then '增容' else '新装' end",
    "supply_voltage_kv": "case when s_nationkey = 6 then 35e0 else 1e1 end", "capacity_kva": "cast(200 + (s_suppkey * 271) % 21000 as double)",
    "user_importance_level": "case when s_acctbal < 2000 then '一级' when s_acctbal < 6000 then '二级' else '普通' end",
    "load_level": "case when s_nationkey < 10 then '一级负荷' when s_nationkey < 18 then '二级负荷' else '三级负荷' end",
    "requested_supply_mode": "case when s_nationkey = 20 then '双电源' when s_nationkey = 21 then '双回路' else '' end",
    "requested_power_source_count": "case when s_nationkey = 12 then 3 when s_nationkey = 13 then 4 else 1 end", "enable_new_line": "s_nationkey > 4",
    "force_new_line": "s_nationkey = 7",
})
MODE_RULES = View("nation", {
    "rule_id": "n_nationkey", "user_importance_level": "case when n_regionkey = 0 then '一级' when n_regionkey < 3 then '二级' else '普通' end",
    "load_level": "case when n_nationkey % 3 = 0 then '一级负荷' when n_nationkey % 3 = 1 then '二级负荷' else '四级负荷' end",
    "required_supply_mode": "case when n_regionkey = 0 then '双电源' when n_regionkey < 3 then '双回路' else '单电源' end",
    "minimum_route_count": "case when n_regionkey < 3 then 2 else 0 end", "minimum_source_count": "case when n_regionkey < 2 then 2 else 0 end",
    "independence": "case when n_regionkey = 0 then 'different_substation' when n_regionkey = 1 then 'different_busbar' else '' end",
})
SCHEME_FEEDERS = View("part", {
    "feeder_id": "p_partkey", "feeder_available_kva": "cast((p_partkey * 131) % 9000 as double)",
    "historical_max_load_rate": "cast((p_partkey * 7) % 100 as double) / 100", "current_load_rate": "cast((p_partkey * 3) % 90 as double) / 100",
    "connected_user_count": "cast(p_size * 2 as double)", "line_loss_rate": "cast(p_partkey % 10 as double) / 100",
    "feeder_substation_id": "cast(floor(p_partkey / 9) as bigint)", "feeder_busbar_id": "cast(floor(p_partkey / 3) as bigint)",
    "feeder_transformer_id": "cast(floor(p_partkey / 20) as bigint)",
})
SCHEME_TRANSFORMERS = View("supplier", {
    "transformer_id": "s_suppkey", "transformer_substation_id": "cast(floor(s_suppkey / 3) as bigint)",
    "transformer_available_kva": "cast((s_suppkey * 997) % 20000 as double)", "transformer_load_rate": "cast((s_suppkey * 13) % 100 as double) / 100",
})
BAYS = View("supplier", {
    "outgoing_bay_id": "s_suppkey", "substation_id": "cast(floor(s_suppkey / 2) as bigint)", "transformer_id": "s_suppkey", "is_available": "s_acctbal > 0",
})
CONFIGS = View("supplier", {
    "config_id": "s_suppkey", "request_id": "case when s_nationkey = 24 then '' else cast(cast(floor(s_suppkey / 2) as bigint) as string) end",
    "allowed_types": "case when s_nationkey < 12 then '环网柜' else '开关站,环网柜' end", "enable_new_line": "s_acctbal > 5000",
    "preselected_type": "case when s_nationkey = 3 then '架空线' else '' end",
})
RULE = schemes.ScoringRule(source_count_scores={1: 60.0, 2: 85.0, 3: 95.0}, mode_scores={"双电源": 95.0, "双回路": 85.0, "单电源": 65.0})
STRONG = "('双回路', '双电源', '多电源(3路含应急)')"
DECISIONS = f"""mr AS (SELECT user_importance_level, load_level, arg_min(required_supply_mode, rule_id) AS rm, arg_min(minimum_route_count, rule_id) AS rr, arg_min(minimum_source_count, rule_id) AS rs, arg_min(independence, rule_id) AS ind FROM r GROUP BY ALL),
d1 AS (SELECT q.*, coalesce(ind, '') AS ind, coalesce(rm, nullif(requested_supply_mode, ''), '单电源') AS req, rr, rs FROM q LEFT JOIN mr USING (user_importance_level, load_level)),
d2 AS (SELECT *, coalesce(nullif(rr, 0), CASE WHEN req = '单电源' THEN 1 ELSE 2 END) AS routes FROM d1),
d3 AS (SELECT *, coalesce(nullif(rs, 0), routes) AS sources FROM d2),
d4 AS (SELECT *, CASE WHEN requested_power_source_count > sources THEN requested_power_source_count ELSE sources END AS fs,
  CASE WHEN requested_supply_mode IN {STRONG} THEN requested_supply_mode ELSE req END AS mode FROM d3),
dec AS (SELECT request_id, mode AS required_supply_mode, CAST(CASE WHEN requested_power_source_count > sources THEN greatest(routes, fs) ELSE routes END AS INTEGER) AS minimum_route_count, CAST(fs AS INTEGER) AS minimum_source_count,
  ind = 'different_substation' OR mode = '双电源' AS required_different_substations, ind IN ('different_busbar', 'different_substation') OR mode IN ('双回路', '双电源') AS required_different_busbars FROM d4)"""


@query("scheme_scope", ctes(q=SCHEME_REQUESTS) + """
SELECT request_id, concat_ws(',', CASE WHEN business_type NOT IN ('新装', '增容', '临时') THEN 'business_type' END, CASE WHEN supply_voltage_kv <> 10 THEN 'voltage' END, CASE WHEN capacity_kva > 20000 THEN 'capacity' END) AS failed_reasons,
  business_type IN ('新装', '增容', '临时') AND supply_voltage_kv = 10 AND capacity_kva <= 20000 AS is_in_scope FROM q""")
def scheme_scope(spark, sf):
    return schemes.validate_scope(SCHEME_REQUESTS.df(spark, sf)).select("request_id", "failed_reasons", "is_in_scope")


@query("scheme_reasoning_config", ctes(q=SCHEME_REQUESTS, c=CONFIGS) + """,
own AS (SELECT * FROM c WHERE request_id <> '' QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY config_id DESC) = 1),
dft AS (SELECT * FROM c WHERE request_id = '' ORDER BY config_id DESC LIMIT 1),
j AS (SELECT q.request_id, coalesce(own.allowed_types, dft.allowed_types) AS a, coalesce(own.enable_new_line, dft.enable_new_line) AS e, coalesce(own.preselected_type, dft.preselected_type) AS p
  FROM q LEFT JOIN own ON own.request_id = CAST(q.request_id AS VARCHAR) LEFT JOIN dft ON true)
SELECT CAST(request_id AS VARCHAR) AS request_id, CASE WHEN coalesce(p, '') <> '' THEN p ELSE coalesce(a, '') END AS allowed_source_device_types, coalesce(e, false) AS enable_new_line FROM j""")
def scheme_reasoning_config(spark, sf):
    requests = SCHEME_REQUESTS.df(spark, sf).select(F.col("request_id").cast("string").alias("request_id"))
    return schemes.reasoning_config(requests, CONFIGS.df(spark, sf))


@query("scheme_supply_mode", ctes(q=SCHEME_REQUESTS, r=MODE_RULES) + f", {DECISIONS} SELECT * FROM dec")
def scheme_supply_mode(spark, sf):
    return schemes.decide_supply_mode(SCHEME_REQUESTS.df(spark, sf), MODE_RULES.df(spark, sf))


# Checked points of a request: every available point within 2 km, sized for one route.
CHECKED = f"""cap AS (SELECT q.request_id, {sql_round('capacity_kva / 8 / coalesce(nullif(minimum_route_count, 0), 1)', 2)} AS need FROM q JOIN dec USING (request_id)),
near AS (SELECT rid AS request_id, pid AS access_point_id, {sql_round('d', 1)} AS distance_m FROM (SELECT q.request_id AS rid, p.point_id AS pid, {sql_haversine('q.lng', 'q.lat', 'p.lng', 'p.lat', EARTH)} AS d
  FROM q JOIN p ON abs(q.lat - p.lat) < 0.05 AND abs(q.lng - p.lng) < 0.05 WHERE is_available) WHERE d <= 2000),
ch AS (SELECT n.request_id, n.access_point_id, n.distance_m, p.feeder_id, f.feeder_substation_id AS substation_id, f.feeder_busbar_id AS busbar_id, f.feeder_transformer_id AS transformer_id, cap.need AS single_route_capacity_kva,
  coalesce(feeder_available_kva, 0) >= need AS c1, coalesce(historical_max_load_rate, 0) <= 0.8 AND coalesce(current_load_rate, 0) <= 0.8 AS c2, spare_intervals >= 2 AS c3, coalesce(connected_user_count, 0) <= 50 AS c4,
  coalesce(line_loss_rate, 0) <= 0.07 AS c5, coalesce(transformer_available_kva, 0) >= need AS c6, coalesce(transformer_load_rate, 0) <= 0.8 AS c7
  FROM near n JOIN cap USING (request_id) JOIN p ON p.point_id = n.access_point_id JOIN f USING (feeder_id) LEFT JOIN t ON t.transformer_id = f.feeder_transformer_id),
checks AS (SELECT *, c1 AND c2 AND c3 AND c4 AND c5 AND c6 AND c7 AS usable, NOT (c1 AND c2 AND c6 AND c7) AS moves FROM ch)"""
SCHEME_CTES = ctes(q=SCHEME_REQUESTS, r=MODE_RULES, p=POINTS, f=SCHEME_FEEDERS, t=SCHEME_TRANSFORMERS, w=SWITCHES) + f", {DECISIONS}, {CHECKED}"


def _scheme_state(spark, sf):
    requests = SCHEME_REQUESTS.df(spark, sf)
    feeders, transformers = SCHEME_FEEDERS.df(spark, sf), SCHEME_TRANSFORMERS.df(spark, sf)
    decisions = cut_lineage(schemes.decide_supply_mode(requests, MODE_RULES.df(spark, sf)))
    sized = schemes.single_route_capacity(requests.withColumn("capacity_kva", F.col("capacity_kva") / 8), decisions)
    home = feeders.select(
        "feeder_id", F.col("feeder_substation_id").alias("substation_id"), F.col("feeder_busbar_id").alias("busbar_id"),
        F.col("feeder_transformer_id").alias("transformer_id"),
    )
    points = POINTS.df(spark, sf).filter("is_available").join(home, "feeder_id").select(
        F.col("point_id").alias("access_point_id"), "lng", "lat", "feeder_id", "substation_id", "busbar_id", "transformer_id",
        F.col("spare_intervals").cast("double").alias("available_bay_count"),
    )
    # Pairs of requests and points are many: both sides bring all that is checked, so a pair is judged where it is found.
    measured = schemes.with_measures(
        points, feeders.drop("feeder_substation_id", "feeder_busbar_id", "feeder_transformer_id"), transformers.drop("transformer_substation_id")
    )
    near = grid.access_points_in_range(requests.select("request_id", "lng", "lat").join(sized, "request_id"), measured, 2000.0, counted=True)
    checks = schemes.judge_capacity(near, [
        "request_id", "access_point_id", "distance_m", "feeder_id", "substation_id", "busbar_id", "transformer_id",
        "single_route_capacity_kva", "available_bay_count",
    ])
    # Check records are a stored object of the domain: later steps read them, they do not repeat the search.
    return requests, decisions, sized, stored(checks, "checks"), feeders, transformers


@query("scheme_check_capacity", SCHEME_CTES + """
SELECT request_id, access_point_id, single_route_capacity_kva, usable AS is_directly_usable, moves AS requires_load_transfer, concat_ws(',', CASE WHEN NOT c1 THEN 'feeder_available_capacity_ok' END,
  CASE WHEN NOT c2 THEN 'feeder_load_rate_ok' END, CASE WHEN NOT c3 THEN 'spare_bay_ok' END, CASE WHEN NOT c4 THEN 'connected_user_count_ok' END, CASE WHEN NOT c5 THEN 'line_loss_rate_ok' END,
  CASE WHEN NOT c6 THEN 'transformer_available_capacity_ok' END, CASE WHEN NOT c7 THEN 'transformer_load_rate_ok' END) AS failed_constraints FROM checks""")
def scheme_check_capacity(spark, sf):
    checks = _scheme_state(spark, sf)[3]
    return checks.select(
        "request_id", "access_point_id", "single_route_capacity_kva", "is_directly_usable", "requires_load_transfer", "failed_constraints"
    )


# An expansion also asks to relieve its original feeder.
ORIGINAL_KEY = "request_id * 15 + 2"
TRANSFERS = f"""og AS (SELECT q.request_id, p.point_id AS access_point_id, {sql_round(sql_haversine('q.lng', 'q.lat', 'p.lng', 'p.lat', EARTH), 1)} AS distance_m, p.feeder_id, f.feeder_substation_id AS substation_id,
  f.feeder_busbar_id AS busbar_id, f.feeder_transformer_id AS transformer_id, cap.need AS single_route_capacity_kva
  FROM q JOIN cap USING (request_id) JOIN p ON p.point_id = q.{ORIGINAL_KEY} JOIN f ON f.feeder_id = p.feeder_id WHERE business_type = '增容'),
over AS (SELECT request_id, feeder_id AS source, single_route_capacity_kva AS need FROM checks WHERE moves UNION SELECT request_id, feeder_id, single_route_capacity_kva FROM og),
tie AS (SELECT source_feeder_id AS source, target_feeder_id AS target, switch_id FROM w UNION ALL SELECT target_feeder_id, source_feeder_id, switch_id FROM w),
mv AS (SELECT request_id, o.source, tie.target, switch_id, least(0.99::DOUBLE, current_load_rate + need / 50000) AS post FROM over o JOIN tie USING (source) JOIN f ON f.feeder_id = tie.target WHERE feeder_available_kva >= need)"""


def _tasks(checks):
    """Tasks for rows of pairs: few bytes hold many of them, and they grow with requests times points."""
    return tasks_for(checks.sparkSession, checks.count())


def _originals(spark, sf, state):
    requests, _, sized, _, feeders, _ = state
    asked = requests.filter("business_type = '增容'").select("request_id", "lng", "lat", F.expr(ORIGINAL_KEY).alias("point_id"))
    points = POINTS.df(spark, sf).select("point_id", "feeder_id", F.col("lng").alias("_lng"), F.col("lat").alias("_lat"))
    placed = asked.join(points, "point_id").join(sized, "request_id").join(feeders, "feeder_id")
    return with_rounded(placed, 1, distance_m=haversine(F.col("lng"), F.col("lat"), F.col("_lng"), F.col("_lat"), EARTH_M)).select(
        "request_id", F.col("point_id").alias("access_point_id"), "distance_m", "feeder_id", F.col("feeder_substation_id").alias("substation_id"),
        F.col("feeder_busbar_id").alias("busbar_id"), F.col("feeder_transformer_id").alias("transformer_id"), "single_route_capacity_kva",
    )


def _feeder_moves(spark, sf, state):
    checks, feeders = state[3], state[4]
    pressed = checks.filter("requires_load_transfer").unionByName(_originals(spark, sf, state), allowMissingColumns=True)
    tasks = _tasks(checks)
    over = pressed.select("request_id", F.col("feeder_id").alias("source"), "single_route_capacity_kva").repartition(tasks, "source").distinct()
    ties = grid.ties(SWITCHES.df(spark, sf), "source_feeder_id", "target_feeder_id")
    return stored(schemes.feeder_transfer_plans(over, ties, feeders, tasks), "transfers")


@query("scheme_feeder_transfers", SCHEME_CTES + f", {TRANSFERS} SELECT request_id, source, target, switch_id, {sql_round('post', 3)} AS post_transfer_load_rate, post <= 0.8 AS is_feasible FROM mv")
def scheme_feeder_transfers(spark, sf):
    return _feeder_moves(spark, sf, _scheme_state(spark, sf))


@query("scheme_transformer_transfers", SCHEME_CTES + f""",
over AS (SELECT DISTINCT request_id, transformer_id AS source, single_route_capacity_kva AS need FROM checks WHERE NOT c6 OR NOT c7),
mv AS (SELECT request_id, a.transformer_id AS source, b.transformer_id AS target, b.transformer_available_kva >= need AS fits, least(0.99::DOUBLE, b.transformer_load_rate + need / 50000) AS post
  FROM over o JOIN t a ON a.transformer_id = o.source JOIN t b ON b.transformer_substation_id = a.transformer_substation_id AND a.transformer_id <> b.transformer_id)
SELECT request_id, source, target, {sql_round('post', 3)} AS post_transfer_load_rate, fits AND post <= 0.8 AS is_feasible FROM mv""")
def scheme_transformer_transfers(spark, sf):
    _, _, _, checks, _, transformers = _scheme_state(spark, sf)
    over = checks.filter("not transformer_available_capacity_ok or not transformer_load_rate_ok").select(
        "request_id", F.col("transformer_id").alias("source"), "single_route_capacity_kva"
    ).distinct()
    return schemes.transformer_transfer_plans(over, transformers.withColumnRenamed("transformer_substation_id", "substation_id"))


NEW_LINES = f"""ru AS (SELECT request_id, bool_or(usable) AS u FROM checks GROUP BY 1), rm2 AS (SELECT request_id, bool_or(post <= 0.8) AS m FROM mv GROUP BY 1),
tr AS (SELECT q.*, cap.need, concat_ws(',', CASE WHEN cap.need >= 1500 THEN 'capacity' END, CASE WHEN u = false THEN 'no_usable_point' END, CASE WHEN m = false THEN 'no_feasible_transfer' END, CASE WHEN force_new_line THEN 'forced' END) AS reasons
  FROM q JOIN cap USING (request_id) LEFT JOIN ru USING (request_id) LEFT JOIN rm2 USING (request_id)),
ns AS (SELECT tr.request_id, need, substation_id, {sql_haversine('tr.lng', 'tr.lat', 'b.lng', 'b.lat', EARTH)} AS d FROM tr JOIN b ON abs(tr.lng - b.lng) < 0.5 WHERE enable_new_line AND reasons <> ''),
pick AS (SELECT ns.request_id, min({{'d': {sql_round('d', 1)}, 's': y.substation_id, 'b': outgoing_bay_id, 't': y.transformer_id}}) AS k FROM ns JOIN y ON y.substation_id = ns.substation_id AND y.is_available
  JOIN t ON t.transformer_id = y.transformer_id AND transformer_load_rate <= 0.8 WHERE d <= 15000 AND transformer_available_kva >= need GROUP BY 1),
nl AS (SELECT tr.request_id, enable_new_line AND reasons <> '' AS is_triggered, reasons AS trigger_reasons, k.s AS selected_substation_id, k.t AS selected_transformer_id, k.b AS selected_outgoing_bay_id, k IS NOT NULL AS is_feasible FROM tr LEFT JOIN pick USING (request_id))"""
LINE_CTES = ctes(q=SCHEME_REQUESTS, r=MODE_RULES, p=POINTS, f=SCHEME_FEEDERS, t=SCHEME_TRANSFORMERS, w=SWITCHES, b=SUBSTATIONS, y=BAYS) + f", {DECISIONS}, {CHECKED}, {TRANSFERS}, {NEW_LINES}"


def _new_lines(spark, sf, state):
    requests, _, sized, checks, _, transformers = state
    moves = _feeder_moves(spark, sf, state)
    lines = schemes.decide_new_line(
        requests.join(sized, "request_id"), checks, moves, SUBSTATIONS.df(spark, sf), BAYS.df(spark, sf), transformers, threshold_kva=1500.0
    )
    return moves, lines


@query("scheme_new_line", LINE_CTES + " SELECT * FROM nl")
def scheme_new_line(spark, sf):
    return _new_lines(spark, sf, _scheme_state(spark, sf))[1]


def _combos_sql(k: int) -> str:
    """All k-combinations of usable points, nothing pruned."""
    names = [f"a{i}" for i in range(k)]
    joins = "uk a0" + "".join(f" JOIN uk a{i} ON a{i}.request_id = a0.request_id AND a{i}.n > a{i - 1}.n" for i in range(1, k))
    apart = [f"{x}.site <> {y}.site" for i, x in enumerate(names) for y in names[i + 1:]]
    ids = " || ',' || ".join(f"a{i}.access_point_id" for i in range(k))
    dist = "0::DOUBLE + " + " + ".join(f"a{i}.distance_m" for i in range(k))
    order = "[" + ", ".join(f"a{i}.n" for i in range(k)) + "]"
    return f"""SELECT a0.request_id, 'existing_access_point' AS scheme_source_type, a0.required_supply_mode AS operation_mode, CAST({ids} AS VARCHAR) AS point_ids, {k} AS route_count, {dist} AS dist, {order} AS o
FROM {joins} WHERE a0.minimum_route_count = {k}""" + "".join(f" AND {c}" for c in apart)


RANKED = f"""res AS (SELECT DISTINCT request_id, source FROM mv WHERE post <= 0.8),
us AS (SELECT request_id, access_point_id, distance_m, substation_id, busbar_id FROM checks WHERE usable OR (moves AND ((request_id, feeder_id) IN (SELECT request_id, source FROM res) OR (request_id, transformer_id) IN (SELECT request_id, source FROM res)))
  UNION ALL SELECT request_id, access_point_id, distance_m, substation_id, busbar_id FROM og WHERE ((request_id, feeder_id) IN (SELECT request_id, source FROM res) OR (request_id, transformer_id) IN (SELECT request_id, source FROM res))
    AND (request_id, access_point_id) NOT IN (SELECT request_id, access_point_id FROM checks)),
uk AS (SELECT us.request_id, access_point_id, distance_m, minimum_route_count, required_supply_mode, CASE WHEN required_different_substations THEN 's' || substation_id WHEN required_different_busbars THEN 'b' || substation_id || '/' || busbar_id ELSE 'p' || access_point_id END AS site,
  row_number() OVER (PARTITION BY us.request_id ORDER BY distance_m, access_point_id) AS n FROM us JOIN dec USING (request_id)),
allc AS ({_combos_sql(1)} UNION ALL {_combos_sql(2)} UNION ALL {_combos_sql(3)} UNION ALL {_combos_sql(4)}
UNION ALL SELECT nl.request_id, 'new_substation_outgoing_line', '新出线', '', coalesce(minimum_route_count, 1), 0, NULL FROM nl LEFT JOIN dec USING (request_id) WHERE is_triggered AND is_feasible),
sc AS (SELECT *, greatest(0::DOUBLE, 100 - dist / 20) AS ds, CASE WHEN scheme_source_type = 'existing_access_point' THEN 70::DOUBLE ELSE 80::DOUBLE END AS cs,
  (CASE route_count WHEN 1 THEN 60 WHEN 2 THEN 85 WHEN 3 THEN 95 ELSE 60 END + CASE operation_mode WHEN '双电源' THEN 95 WHEN '双回路' THEN 85 WHEN '单电源' THEN 65 ELSE 75 END)::DOUBLE / 2 AS rs FROM allc),
sd AS (SELECT *, {sql_round('ds * 0.35::DOUBLE + cs * 0.35::DOUBLE + rs * 0.3::DOUBLE', 2)} AS total FROM sc),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY total DESC, o NULLS LAST) AS INTEGER) AS rank FROM sd)"""


def _ranked(spark, sf, state):
    moves, lines = _new_lines(spark, sf, state)
    # The rows of with_original_supplies, its two parts apart: the checks are not written again.
    added = schemes.relieved_originals(state[3], _originals(spark, sf, state), moves)
    tasks = _tasks(state[3])
    usable = schemes.usable_points(state[3], moves, tasks).unionByName(schemes.usable_points(added, moves), allowMissingColumns=True)
    return schemes.rank_schemes(usable, state[1], lines, RULE, tasks)


@query("scheme_ranked", LINE_CTES + f", {RANKED}" + f"""
SELECT request_id, scheme_source_type, operation_mode, point_ids, CAST(route_count AS INTEGER) AS route_count, dist AS total_supply_distance_m, {sql_round('ds', 2)} AS distance_score, {sql_round('rs', 2)} AS reliability_score, total AS total_score, cs AS available_capacity_score, rank FROM ranked WHERE rank <= 3""")
def scheme_ranked(spark, sf):
    state = _scheme_state(spark, sf)
    return _ranked(spark, sf, state)


@query("scheme_no_solution", LINE_CTES + f", {RANKED}" + """,
lost AS (SELECT request_id FROM q WHERE request_id NOT IN (SELECT request_id FROM ranked)),
x AS (SELECT lost.request_id, unnest(CASE WHEN ch.request_id IS NULL THEN [NULL] ELSE list_filter([CASE WHEN NOT c1 THEN 'feeder_available_capacity_ok' END, CASE WHEN NOT c2 THEN 'feeder_load_rate_ok' END, CASE WHEN NOT c3 THEN 'spare_bay_ok' END, CASE WHEN NOT c4 THEN 'connected_user_count_ok' END,
  CASE WHEN NOT c5 THEN 'line_loss_rate_ok' END, CASE WHEN NOT c6 THEN 'transformer_available_capacity_ok' END, CASE WHEN NOT c7 THEN 'transformer_load_rate_ok' END], lambda z: z IS NOT NULL) END) AS c FROM lost LEFT JOIN (SELECT * FROM ch WHERE NOT (c1 AND c2 AND c3 AND c4 AND c5 AND c6 AND c7)) ch USING (request_id))
SELECT request_id, coalesce(c, '未形成满足全部约束的候选接入方案') AS failed_constraint, count(c) AS failures FROM x GROUP BY ALL""")
def scheme_no_solution(spark, sf):
    state = _scheme_state(spark, sf)
    return schemes.no_scheme_conclusions(state[0], _ranked(spark, sf, state), state[3])
