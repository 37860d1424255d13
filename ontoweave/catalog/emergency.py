"""Emergency response queries: events at suppliers, facilities at customers and parts."""

from __future__ import annotations


from ontoweave.catalog.base import View, ctes, query, sql_haversine, sql_round
from ontoweave.plans import emergency

# Points lie along a strip whose length follows the keys, so density stays the same at every scale.
EVENTS = View("supplier", {
    "event_id": "s_suppkey", "lng": "1e2 + cast(s_suppkey % 4000 as double) * 15e-3", "lat": "3e1 + cast((s_suppkey * 61) % 100 as double) * 1e-3",
})
ROADS = View("customer", {
    "segment_id": "c_custkey", "road_name": "c_name", "lng": "1e2 + cast(c_custkey % 60000 as double) * 1e-3",
    "lat": "3e1 + cast((c_custkey * 37) % 100 as double) * 1e-3",
})
BRIDGES = View("part", {
    "bridge_id": "p_partkey", "name": "p_name", "lng": "1e2 + cast(p_partkey % 80000 as double) * 75e-5",
    "lat": "3e1 + cast((p_partkey * 53) % 100 as double) * 1e-3",
})
DEPOTS = View("customer", {
    "depot_id": "c_custkey", "name": "c_name", "lng": "1e2 + cast(c_custkey % 60000 as double) * 1e-3",
    "lat": "2e1 + cast((c_custkey * 37) % 2000 as double) * 1e-2", "available": "case when c_acctbal > 0 then 1 else 0 end",
})
BASES = View("supplier", {
    "base_id": "s_suppkey", "name": "s_name", "lng": "1e2 + cast(s_suppkey % 4000 as double) * 15e-3",
    "lat": "3e1 + cast((s_suppkey * 61) % 100 as double) * 1e-2",
})
DRONES = View("lineitem", {
    "drone_id": "l_orderkey * 10 + l_linenumber", "base_id": "l_suppkey", "model": "l_returnflag",
    "status": "case when l_linestatus = 'F' then '可用' else '任务中' end",
})
FACILITIES = """SELECT 'RoadSegment' AS facility_type, CAST(segment_id AS VARCHAR) AS facility_id, road_name AS name, lng, lat FROM r
UNION ALL SELECT 'Bridge', CAST(bridge_id AS VARCHAR), name, lng, lat FROM b"""
KM = "6371"


@query("emergency_affected_facilities", ctes(e=EVENTS, r=ROADS, b=BRIDGES, f=FACILITIES) + f""",
d AS (SELECT event_id, facility_type, facility_id, name, {sql_haversine('e.lng', 'e.lat', 'f.lng', 'f.lat', KM)} AS d FROM e JOIN f ON abs(e.lat - f.lat) < 0.2 AND abs(e.lng - f.lng) < 0.2)
SELECT event_id, facility_type, facility_id, name, {sql_round('d', 2)} AS distance_km FROM d WHERE d <= 5""")
def emergency_affected_facilities(spark, sf):
    sites = emergency.facilities([
        ("RoadSegment", ROADS.df(spark, sf), "segment_id", "road_name"), ("Bridge", BRIDGES.df(spark, sf), "bridge_id", "name"),
    ])
    return emergency.affected_facilities(EVENTS.df(spark, sf), sites, 5.0)


def _in_range(view: str, radius: int, extra: str) -> str:
    return f""",
d AS (SELECT *, {sql_haversine('100.5', '30.0', 'lng', 'lat', KM)} AS d FROM {view})
SELECT depot_id, name, {sql_round('d', 2)} AS distance_km FROM d WHERE d <= {radius}{extra}"""


@query("emergency_depots_in_range", ctes(p=DEPOTS) + _in_range("p", 100, ""))
def emergency_depots_in_range(spark, sf):
    return emergency.depots_in_range(DEPOTS.df(spark, sf), 100.5, 30.0, 100.0).select("depot_id", "name", "distance_km")


@query("emergency_teams_in_range", ctes(p=DEPOTS) + _in_range("p", 60, " AND available <> 0"))
def emergency_teams_in_range(spark, sf):
    return emergency.rescue_teams_in_range(DEPOTS.df(spark, sf), 100.5, 30.0, 60.0).select("depot_id", "name", "distance_km")


@query("emergency_drones_in_range", ctes(d=DRONES, b=BASES) + f""",
n AS (SELECT *, {sql_haversine('100.5', '30.5', 'lng', 'lat', KM)} AS d FROM b)
SELECT drone_id, d.base_id, model, n.name AS base_name, {sql_round('n.d', 2)} AS distance_km FROM d JOIN n ON n.base_id = d.base_id WHERE n.d <= 50 AND status = '可用'""")
def emergency_drones_in_range(spark, sf):
    found = emergency.drones_in_range(DRONES.df(spark, sf), BASES.df(spark, sf), 100.5, 30.5, 50.0)
    return found.select("drone_id", "base_id", "model", "base_name", "distance_km")


@query("emergency_rule_lookup", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand = 'Brand#7' AND p_type = 'SMALL'")
def emergency_rule_lookup(spark, sf):
    rows = View("part", {"p_partkey": "p_partkey", "p_brand": "p_brand", "p_type": "p_type"}).df(spark, sf)
    return emergency.lookup(rows, ["p_brand", "p_type"], p_brand="Brand#7", p_type="SMALL")


