"""Launch control queries: missions at orders, node runs at order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoweave.catalog.base import View, ctes, query
from ontoweave.plans import launch

MISSIONS = View("orders", {
    "mission_id": "o_orderkey", "safety_interlock": "case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then '触发' when o_orderstatus = 'O' then '未知' else '正常' end",
    "subsystem_types": "concat(o_orderstatus, ', ', o_orderpriority, ',,', o_orderstatus, 'x')", "action_type": "case when o_orderpriority = '2-HIGH' then '紧急泄放' when o_orderpriority = '3-MEDIUM' then '停充' else '停机' end",
})
RUNS = View("lineitem", {
    "mission_id": "l_orderkey", "node_name": "concat('N', cast(l_linenumber as string))",
    "status": "case when l_linestatus = 'F' then 'completed' when l_returnflag = 'R' then 'failed' else 'running' end",
    "seq": "cast(cast(l_shipdate as date) as string)", "tie": "cast(l_partkey as bigint) * 1000000 + l_suppkey * 10 + cast(l_quantity as int) % 7",
})
# A small workflow over the seven node names; the start precedes N1 and N2.
FLOW = [
    ("开始", "N1"), ("开始", "N2"), ("N1", "N3"), ("N2", "N3"), ("N2", "N4"), ("N3", "N5"), ("N4", "N5"), ("N4", "N6"), ("N5", "N7"), ("N6", "N7"), ("N6", "N3"),
]
FLOW_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in FLOW) + ") AS v(from_node, to_node)"
LATEST = "latest AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY mission_id, node_name ORDER BY seq DESC, tie DESC, status DESC) = 1)"


def _flow(spark):
    return spark.createDataFrame(FLOW, "from_node string, to_node string")


def _runs(spark, sf):
    return RUNS.df(spark, sf)


ORDINALS = ["seq", "tie"]


@query("launch_node_status", ctes(m=MISSIONS, r=RUNS) + f", {LATEST}" + """
SELECT m.mission_id, n.node_name, coalesce(status, 'not_started') AS status FROM m, (SELECT unnest(['N1', 'N5']) AS node_name) n LEFT JOIN latest l ON l.mission_id = m.mission_id AND l.node_name = n.node_name""")
def launch_node_status(spark, sf):
    wanted = MISSIONS.df(spark, sf).select("mission_id", F.explode(F.array(F.lit("N1"), F.lit("N5"))).alias("node_name"))
    return launch.node_status(wanted, _ordered(spark, sf), [*ORDINALS, "status_order"])


def _ordered(spark, sf):
    return _runs(spark, sf).withColumn("status_order", F.col("status"))


@query("launch_next_executable", ctes(m=MISSIONS, r=RUNS, e=FLOW_SQL) + """,
done AS (SELECT DISTINCT mission_id, node_name FROM r WHERE status = 'completed'), t AS (SELECT DISTINCT to_node FROM e)
SELECT m.mission_id, t.to_node AS node_name FROM m, t WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.mission_id = m.mission_id AND d.node_name = t.to_node)
AND NOT EXISTS (SELECT 1 FROM e WHERE e.to_node = t.to_node AND e.from_node <> '开始' AND NOT EXISTS (SELECT 1 FROM done d WHERE d.mission_id = m.mission_id AND d.node_name = e.from_node))""")
def launch_next_executable(spark, sf):
    return launch.next_executable(MISSIONS.df(spark, sf), _flow(spark), _runs(spark, sf))


@query("launch_execute_nodes", ctes(m=MISSIONS, r=RUNS, e=FLOW_SQL) + f", {LATEST}" + """,
q AS (SELECT mission_id, node_name FROM m, (SELECT unnest(['N3', 'N5', 'N1']) AS node_name)),
un AS (SELECT q.mission_id, q.node_name, string_agg(e.from_node, ',' ORDER BY e.from_node) AS unmet FROM q JOIN e ON e.to_node = q.node_name AND e.from_node <> '开始'
  WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.mission_id = q.mission_id AND l.node_name = e.from_node AND l.status = 'completed') GROUP BY ALL)
SELECT q.mission_id, q.node_name, CASE WHEN safety_interlock = '触发' THEN 'blocked' WHEN unmet IS NULL THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN safety_interlock = '触发' THEN '安全联锁已触发，无法执行节点' ELSE coalesce(unmet, '') END AS detail FROM q JOIN m ON m.mission_id = q.mission_id LEFT JOIN un ON un.mission_id = q.mission_id AND un.node_name = q.node_name""")
def launch_execute_nodes(spark, sf):
    missions = MISSIONS.df(spark, sf)
    wanted = missions.select("mission_id", F.explode(F.array(*[F.lit(n) for n in ("N3", "N5", "N1")])).alias("node_name"))
    return launch.execute_nodes(missions, wanted, _flow(spark), _ordered(spark, sf), [*ORDINALS, "status_order"])


@query("launch_readiness", ctes(m=MISSIONS, r=RUNS) + f", {LATEST}" + """,
f AS (SELECT mission_id, max(CASE WHEN node_name = 'N1' AND status = 'completed' THEN 1 ELSE 0 END) AS a, max(CASE WHEN node_name = 'N2' AND status = 'completed' THEN 1 ELSE 0 END) AS b, max(CASE WHEN node_name = 'N4' AND status = 'completed' THEN 1 ELSE 0 END) AS c FROM latest GROUP BY 1)
SELECT m.mission_id, coalesce(a, 0) AS target_ready, coalesce(b, 0) AS alignment_ready, coalesce(c, 0) AS pump_ready, 1 AS services_ready, CASE WHEN safety_interlock = '正常' THEN 1 ELSE 0 END AS interlock_ready,
  least(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0), CASE WHEN safety_interlock = '正常' THEN 1 ELSE 0 END) AS all_ready FROM m LEFT JOIN f USING (mission_id)""")
def launch_readiness(spark, sf):
    checks = {"N1": "target_ready", "N2": "alignment_ready", "N4": "pump_ready"}
    return launch.check_readiness(MISSIONS.df(spark, sf), _ordered(spark, sf), [*ORDINALS, "status_order"], checks)


@query("launch_reservations", ctes(m=MISSIONS) + """,
i AS (SELECT mission_id, trim(unnest(string_split(subsystem_types, ','))) AS subsystem_type FROM m)
SELECT 'RES' || substr(sha1(mission_id || '|' || subsystem_type), 1, 8) AS reservation_id, mission_id, subsystem_type, '已预约' AS status FROM i WHERE subsystem_type <> ''""")
def launch_reservations(spark, sf):
    return launch.reserve_subsystems(MISSIONS.df(spark, sf))


@query("launch_interlock_and_emergency", ctes(m=MISSIONS) + """
SELECT mission_id, 'SI' || substr(sha1(mission_id || '|人工'), 1, 8) AS event_id, '人工' AS trigger_type, '触发' AS status,
  CASE WHEN contains(action_type, '泄放') OR contains(action_type, '停充') THEN '泵浦分系统' ELSE '同步分系统' END AS target_subsystem FROM m""")
def launch_interlock_and_emergency(spark, sf):
    missions = MISSIONS.df(spark, sf).select("mission_id", launch.emergency_target(F.col("action_type")).alias("target_subsystem"))
    return launch.interlock_events(missions, "人工")
