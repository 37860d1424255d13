"""Toll network queries: units at parts, stations at suppliers, rules and discounts at customers."""

from __future__ import annotations


from ontoweave.catalog.base import View, ctes, query
from ontoweave.plans import toll


def _f(text: str) -> str:
    return f"cast(floor({text}) as bigint)"


# A unit k leads from organisation k/4 to about k/2, so every organisation has few units and paths stay short.
START = _f("p_partkey / 4")
END = f"({_f('p_partkey / 2')} + (p_partkey * 7) % 3)"
UNITS = View("part", {
    "toll_interval_id": "concat('U', cast(p_partkey as string))",
    "rate_code": "case when p_size = 7 then 'RX' else cast(40 + p_partkey % 20 as string) end",
    "start_org_id": f"concat('G', cast({START} as string))", "start_org_type": f"case when {START} % 7 = 0 then 1 else 2 end",
    "end_org_id": f"concat('G', cast({END} as string))", "end_org_type": f"case when {END} % 7 = 0 then 1 else 2 end",
    "opposite_id": f"case when p_size = 11 then concat('U', cast({END} * 4 + 1 as string)) else '' end",
    "actual_length": "case when p_size = 13 then '12.5' else cast(100 + (p_partkey * 37) % 900 as string) end",
    "charge_length": "case when p_size = 14 then '7.25' else cast(50 + (p_partkey * 53) % 500 as string) end",
    "gantry_id": f"case when p_size = 5 then '' else concat('T', cast({_f('p_partkey / 3')} as string)) end",
})
STATIONS = View("supplier", {
    "station_id": "concat('G', cast(s_suppkey * 7 as string))", "use_status": "case when s_nationkey = 3 then 1 else 2 end",
})
RULE_FROM = f"({_f('c_custkey / 2')} * 5 + 3)"
RULES = View("customer", {
    "en_road_node_id": f"concat('U', cast({RULE_FROM} as string))", "en_road_node_type": "0",
    "ex_road_node_id": f"concat('U', cast(4 * ({_f(RULE_FROM + ' / 2')} + ({RULE_FROM} * 7) % 3) + 1 as string))", "ex_road_node_type": "0",
    "contiguity_type": "cast(c_nationkey % 5 as string)", "ordinal": "c_custkey",
})
RATES = View("supplier", {
    "rate_code": "cast(40 + s_suppkey % 20 as string)", "vehicle_type": "1 + cast(floor(s_suppkey / 20) as int) % 4",
    "vc_rate": "case when s_suppkey % 20 < 10 then concat('0.', cast(30 + s_suppkey % 60 as string)) else concat(cast(100 + s_suppkey % 400 as string), '.5') end",
    "ordinal": "s_suppkey",
})
DISCOUNTS = View("customer", {
    "toll_interval_id": f"concat('U', cast({_f('c_custkey / 2')} as string))", "vehicle_type": "cast(1 + c_nationkey % 4 as string)",
    "start_hour": "case when c_mktsegment = 'BUILDING' then 6 else 0 end", "end_hour": "24",
    "cpc_discount": "50 + c_custkey % 100", "etc_discount": "100 + c_custkey % 77", "ordinal": "c_custkey",
})
INT = "CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+') THEN CAST({0} AS BIGINT) ELSE 0 END"
VEHICLES = [1, 2, 3, 4]

GRAPH_SQL = f"""k AS (SELECT *, {INT.format('actual_length')} AS miles, {INT.format('charge_length')} AS charge FROM u),
e AS (
SELECT a.toll_interval_id AS en, 0 AS en_t, b.toll_interval_id AS ex, 0 AS ex_t, a.miles, a.charge, 1 AS src FROM k a JOIN k b
  ON a.end_org_id = b.start_org_id AND a.end_org_type = b.start_org_type AND a.toll_interval_id <> b.toll_interval_id
  AND (a.opposite_id = '' OR a.opposite_id <> b.toll_interval_id)
UNION ALL SELECT station_id, 1, toll_interval_id, 0, 0, 0, 2 FROM k JOIN s ON station_id = start_org_id WHERE start_org_type = 1 AND use_status = 2
UNION ALL SELECT toll_interval_id, 0, station_id, 1, miles, charge, 3 FROM k JOIN s ON station_id = end_org_id WHERE end_org_type = 1),
base AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY en, en_t, ex, ex_t ORDER BY src, miles, charge) = 1),
r2 AS (SELECT en_road_node_id AS en, 0 AS en_t, ex_road_node_id AS ex, 0 AS ex_t, CAST(contiguity_type AS INT) AS kind, ordinal FROM r WHERE contiguity_type IN ('1','2','3')),
act AS (SELECT en, en_t, ex, ex_t, bool_or(kind = 1) AS blocked, bool_or(kind <> 1) AS forced, arg_max(kind, ordinal) = 1 AS ends FROM r2 GROUP BY ALL),
g AS (SELECT coalesce(b.en, a.en) AS en_road_node_id, coalesce(b.en_t, a.en_t) AS en_road_node_type, coalesce(b.ex, a.ex) AS ex_road_node_id, coalesce(b.ex_t, a.ex_t) AS ex_road_node_type,
  b.en IS NOT NULL AS known, coalesce(forced, false) AS forced, coalesce(ends, false) AS ends,
  coalesce(forced, false) AND (b.en IS NULL OR (coalesce(blocked, false) AND NOT coalesce(ends, false))) AS rebuilt, b.miles, b.charge
  FROM base b FULL JOIN act a ON b.en = a.en AND b.en_t = a.en_t AND b.ex = a.ex AND b.ex_t = a.ex_t),
edges AS (SELECT 'E' || substr(sha1(concat_ws('|', en_road_node_id, en_road_node_type, ex_road_node_id, ex_road_node_type)), 1, 12) AS edge_id,
  en_road_node_id, en_road_node_type, ex_road_node_id, ex_road_node_type,
  CAST(CASE WHEN rebuilt THEN 0 ELSE coalesce(miles, 0) END AS BIGINT) AS miles, CAST(CASE WHEN rebuilt THEN 0 ELSE coalesce(charge, 0) END AS BIGINT) AS charge_miles,
  CASE WHEN ends THEN 1 ELSE 0 END AS invalid, CASE WHEN ends THEN 'E4' WHEN rebuilt THEN 'E5' ELSE '' END AS rule_id FROM g WHERE known OR forced)"""
FEES_SQL = f"""v AS (SELECT toll_interval_id, rate_code, {INT.format('charge_length')} AS len, unnest({VEHICLES}) AS vehicle_type FROM u),
rt AS (SELECT rate_code, vehicle_type, CAST(arg_max(vc_rate, ordinal) AS DOUBLE) AS vc_rate FROM rates GROUP BY ALL),
ds AS (SELECT toll_interval_id, CAST(vehicle_type AS INT) AS vehicle_type, arg_min(cpc_discount, ordinal) AS cpc, arg_min(etc_discount, ordinal) AS etc
  FROM disc WHERE start_hour = 0 AND end_hour = 24 GROUP BY ALL),
f AS (SELECT v.*, CAST(CASE WHEN vc_rate IS NULL THEN NULL WHEN {INT.format('v.rate_code')} < 50 THEN round_even(vc_rate * len, 0) ELSE round_even(vc_rate, 0) END AS BIGINT) AS fee, cpc, etc
  FROM v LEFT JOIN rt USING (rate_code, vehicle_type) LEFT JOIN ds USING (toll_interval_id, vehicle_type)),
params AS (SELECT toll_interval_id || ':' || vehicle_type AS param_id, toll_interval_id, vehicle_type, fee,
  CAST(CASE WHEN cpc IS NULL THEN fee ELSE round_even(fee * (1000 - cpc) / 1000, 0) END AS BIGINT) AS mfee,
  CAST(CASE WHEN etc IS NULL THEN round_even(fee * 0.95::DOUBLE, 0) ELSE round_even(fee * (1000 - etc) / 1000, 0) END AS BIGINT) AS efee,
  CASE WHEN fee IS NULL THEN 'missing_rate' WHEN cpc IS NOT NULL THEN 'discount' ELSE 'default' END AS rate_source FROM f)"""


def edges(spark, sf):
    return toll.build_graph(UNITS.df(spark, sf), STATIONS.df(spark, sf), RULES.df(spark, sf))


def fees(spark, sf):
    return toll.compute_fees(UNITS.df(spark, sf), RATES.df(spark, sf), DISCOUNTS.df(spark, sf), VEHICLES)


@query("toll_build_graph", ctes(u=UNITS, s=STATIONS, r=RULES) + "," + GRAPH_SQL + " SELECT * FROM edges")
def toll_build_graph(spark, sf):
    return edges(spark, sf)


@query("toll_compute_fees", ctes(u=UNITS, rates=RATES, disc=DISCOUNTS) + "," + FEES_SQL + " SELECT * FROM params")
def toll_compute_fees(spark, sf):
    return fees(spark, sf)


ROUNDS = 22


def _paths_sql() -> str:
    steps = ["d0 AS (SELECT 'G7|1' AS dst, CAST(0 AS BIGINT) AS cost, 1 AS hops, ['G7|1'] AS path)"]
    for i in range(1, ROUNDS + 1):
        steps.append(f"""d{i} AS MATERIALIZED (SELECT dst, m.cost AS cost, m.hops AS hops, m.path AS path FROM (
SELECT dst, min({{'cost': cost, 'hops': hops, 'path': path}}) AS m FROM (SELECT dst, cost, hops, path FROM d{i - 1}
UNION ALL SELECT n.dst, d.cost + n.weight, d.hops + 1, list_append(d.path, n.dst) FROM d{i - 1} d JOIN net n ON n.src = d.dst) GROUP BY dst))""")
    return ",\n".join(steps)


PATHS_SQL = f"""net AS MATERIALIZED (SELECT en_road_node_id || '|' || en_road_node_type AS src, ex_road_node_id || '|' || ex_road_node_type AS dst,
  coalesce(p.mfee, 0) AS weight, charge_miles FROM edges LEFT JOIN params p ON en_road_node_type = 0 AND p.toll_interval_id = en_road_node_id AND p.vehicle_type = 1 WHERE invalid = 0),
{_paths_sql()},
w AS (SELECT dst, path, unnest(range(1, len(path))) AS i FROM d{ROUNDS} WHERE len(path) > 1 AND dst IN (SELECT station_id || '|1' FROM s)),
h AS (SELECT w.dst, i, split_part(path[i], '|', 1) AS unit, coalesce(mfee, 0) AS m, coalesce(efee, 0) AS e, coalesce(net.charge_miles, 0) AS c
  FROM w LEFT JOIN params ON toll_interval_id = split_part(path[i], '|', 1) AND vehicle_type = 1 LEFT JOIN net ON net.src = path[i] AND net.dst = path[i + 1]
  WHERE path[i] LIKE '%|0'),
t AS (SELECT dst, string_agg(unit, ',' ORDER BY i) AS toll_intervals, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS chargefee_group,
  string_agg(CAST(e AS VARCHAR), ',' ORDER BY i) AS chargefee95_group, SUM(m) AS sm, SUM(e) AS se, SUM(c) AS sc FROM h GROUP BY 1)"""


@query("toll_find_paths", ctes(u=UNITS, s=STATIONS, r=RULES, rates=RATES, disc=DISCOUNTS) + "," + GRAPH_SQL + "," + FEES_SQL + "," + PATHS_SQL + """
SELECT 'G7:' || split_part(dst, '|', 1) || ':1' AS path_id, 'G7' AS en_station_id, split_part(dst, '|', 1) AS ex_station_id, 1 AS vehicle_type,
  toll_intervals, chargefee_group, chargefee95_group, CAST(floor(sm / 100 + 0.5) * 100 AS BIGINT) AS total_fee,
  CAST(floor(CAST(floor(least(se, floor(sm / 100) * 100 * 0.95::DOUBLE)) AS BIGINT) / 100 + 0.5) * 100 AS BIGINT) AS total_fee95, CAST(sc AS BIGINT) AS total_mileage FROM t""")
def toll_find_paths(spark, sf):
    stations = STATIONS.df(spark, sf)
    return toll.find_paths(edges(spark, sf), fees(spark, sf), stations.filter("station_id = 'G7'"), stations, 1)


def _next(unit: str) -> str:
    return f"(4 * ({_f(unit + ' / 2')} + ({unit} * 7) % 3) + {unit} % 4)"


FIRST = f"({_f('c_custkey / 8')} + 1)"
TOLL_PATHS = View("customer", {
    "path_id": "c_custkey",
    "toll_intervals": f"concat('U', cast({FIRST} as string), ', U', cast({_next(FIRST)} + (case when c_mktsegment = 'BUILDING' then 1 else 0 end) as string), ',U', cast({FIRST} + 1 as string), ',')",
    "chargefee_group": "concat(cast(c_nationkey * 40 as string), ',120,', case when c_mktsegment = 'FURNITURE' then '' else '75' end)",
    "chargefee95_group": "'38,114,71'",
    "total_fee": "case when c_mktsegment = 'MACHINERY' then 100 else cast(floor(cast(c_nationkey * 40 + 120 + (case when c_mktsegment = 'FURNITURE' then 0 else 75 end) as double) / 100 + 5e-1) as int) * 100 end",
    "total_fee95": "cast(200 as int)",
})


@query("toll_validate_paths", ctes(u=UNITS, s=STATIONS, r=RULES, p=TOLL_PATHS) + "," + GRAPH_SQL + """,
l AS (SELECT path_id, total_fee, total_fee95, list_filter(list_transform(string_split(toll_intervals, ','), lambda x: trim(x)), lambda x: x <> '') AS units,
  list_transform(list_filter(string_split(chargefee_group, ','), lambda x: x <> ''), lambda x: CAST(x AS BIGINT)) AS m,
  list_transform(list_filter(string_split(chargefee95_group, ','), lambda x: x <> ''), lambda x: CAST(x AS BIGINT)) AS e FROM p),
q AS (SELECT *, list_sum(m) AS sm, list_sum(e) AS se, CAST(floor(list_sum(m) / 100 + 0.5) * 100 AS BIGINT) AS want,
  CAST(floor(CAST(floor(least(list_sum(e), floor(list_sum(m) / 100) * 100 * 0.95::DOUBLE)) AS BIGINT) / 100 + 0.5) * 100 AS BIGINT) AS want95 FROM l),
x AS (SELECT path_id, units, unnest(range(1, len(units) + 1)) AS i FROM l),
g5 AS (SELECT path_id, gantry_id, i - 1 AS pos, i - lag(i) OVER (PARTITION BY path_id, gantry_id ORDER BY i) AS gap FROM x JOIN u ON toll_interval_id = units[i] WHERE gantry_id <> '')
SELECT path_id, 'V1' AS rule_id, CAST(i - 1 AS INTEGER) AS position, units[i] || '->' || units[i + 1] AS message FROM x WHERE i < len(units)
  AND NOT EXISTS (SELECT 1 FROM edges WHERE en_road_node_id = units[i] AND ex_road_node_id = units[i + 1] AND en_road_node_type = 0 AND ex_road_node_type = 0 AND invalid = 0)
UNION ALL SELECT path_id, 'V2', 0, 'recorded=' || total_fee || ' expected=' || want FROM q WHERE total_fee <> want
UNION ALL SELECT path_id, 'V3', 0, 'recorded=' || total_fee95 || ' expected=' || want95 FROM q WHERE total_fee95 <> want95
UNION ALL SELECT path_id, 'V4', 0, len(units) || '/' || len(m) || '/' || len(e) FROM q WHERE len(units) <> len(m) OR len(units) <> len(e)
UNION ALL SELECT path_id, 'V5', CAST(min(pos) AS INTEGER), gantry_id FROM g5 GROUP BY path_id, gantry_id HAVING max(gap) > 1""")
def toll_validate_paths(spark, sf):
    return toll.validate_paths(TOLL_PATHS.df(spark, sf), edges(spark, sf), UNITS.df(spark, sf))
