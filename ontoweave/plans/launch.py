"""Launch control: node status, executable frontier, node execution, readiness, interlocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.text import stable_id
from ontoweave.operators.filters import apply_filters, present
from ontoweave.operators.grouping import last_wins

# Fixed values of the domain.
START = "开始"
COMPLETED, FAILED, NOT_STARTED = "completed", "failed", "not_started"
INTERLOCK_NORMAL, INTERLOCK_TRIPPED = "正常", "触发"
SYNC_NODES = ["同步触发", "泵浦触发准备", "开关触发准备"]
READINESS_CHECKS = {
    "诊断设备发射准备": "diagnostics_ready",
    "测量打靶运动准备": "measurement_ready",
    "实验靶复位": "target_ready",
    "光路准直": "alignment_ready",
    "光纤种子源/二倍频出光": "light_source_ready",
    "能量精闭环": "preamplifier_ready",
    "泵浦发射准备": "pump_ready",
}


def latest_status(runs: DataFrame, ordinals: list[str]) -> DataFrame:
    """Latest run of each node of a mission."""
    return last_wins(runs.select("mission_id", "node_name", "status", *ordinals), ["mission_id", "node_name"], ordinals).select(
        "mission_id", "node_name", "status"
    )


def node_status(wanted: DataFrame, runs: DataFrame, ordinals: list[str]) -> DataFrame:
    return wanted.join(latest_status(runs, ordinals), ["mission_id", "node_name"], "left").withColumn(
        "status", F.coalesce("status", F.lit(NOT_STARTED))
    )


def subsystem(configs: DataFrame, key: str) -> DataFrame:
    """Subsystem by id, else by type or name."""
    ids = configs.filter((F.col("subsystem_type") == key) | (F.col("name") == key))
    return ids.limit(1)


def flow_edges(edges: DataFrame, phase: str = "", from_node: str = "") -> DataFrame:
    return apply_filters(edges, present({"phase": phase, "from_node": from_node}))


def next_executable(missions: DataFrame, edges: DataFrame, runs: DataFrame) -> DataFrame:
    """Nodes that are not completed while all their predecessors are.

    Met predecessors are counted from the completed runs alone, so nothing is
    enumerated per mission except nodes that follow the start directly.
    A node counts as completed as soon as any of its runs completed.
    """
    done = runs.filter(F.col("status") == COMPLETED).select("mission_id", "node_name").distinct()
    real = edges.filter(F.col("from_node") != START).select("from_node", "to_node").distinct()
    demands = edges.groupBy("to_node").agg(F.count_distinct(F.when(F.col("from_node") != START, F.col("from_node"))).alias("_need"))
    met = (
        done.join(real, F.col("node_name") == F.col("from_node"))
        .groupBy("mission_id", "to_node").agg(F.count("*").alias("_met"))
    )
    reached = met.join(demands, "to_node").filter("_met = _need").select("mission_id", "to_node")
    openers = demands.filter("_need = 0").agg(F.collect_set("to_node")).scalar()
    free = missions.select("mission_id", F.explode(openers).alias("to_node"))
    ready = reached.unionByName(free).withColumnRenamed("to_node", "node_name")
    return ready.join(done, ["mission_id", "node_name"], "left_anti")


def execute_nodes(missions: DataFrame, requests: DataFrame, edges: DataFrame, runs: DataFrame, ordinals: list[str]) -> DataFrame:
    """Outcome of running nodes now: completed, failed with the unmet predecessors, or blocked.

    ``requests``: mission_id, node_name. Each request sees the statuses before
    the call; a mission whose interlock is tripped runs nothing.
    """
    status = latest_status(runs, ordinals)
    needs = requests.join(edges.filter(F.col("from_node") != START).select("from_node", F.col("to_node").alias("node_name")), "node_name")
    unmet = (
        needs.join(
            status.filter(F.col("status") == COMPLETED).select("mission_id", F.col("node_name").alias("from_node")),
            ["mission_id", "from_node"], "left_anti",
        )
        .groupBy("mission_id", "node_name")
        .agg(F.array_join(F.array_sort(F.collect_set("from_node")), ",").alias("unmet"))
    )
    j = requests.join(missions.select("mission_id", "safety_interlock"), "mission_id").join(
        unmet, ["mission_id", "node_name"], "left"
    )
    blocked = F.col("safety_interlock") == INTERLOCK_TRIPPED
    return j.select(
        "mission_id", "node_name",
        F.when(blocked, "blocked").when(F.col("unmet").isNull(), COMPLETED).otherwise(FAILED).alias("status"),
        F.when(blocked, "安全联锁已触发，无法执行节点").otherwise(F.coalesce("unmet", F.lit(""))).alias("detail"),
    )


def check_readiness(
    missions: DataFrame, runs: DataFrame, ordinals: list[str], checks: dict[str, str] | None = None
) -> DataFrame:
    """One row per mission with a 0/1 column per check; every check and the interlock must hold."""
    table = checks or READINESS_CHECKS
    status = latest_status(runs.filter(F.col("node_name").isin(list(table))), ordinals)
    flags = status.groupBy("mission_id").agg(*[
        F.max(F.when((F.col("node_name") == node) & (F.col("status") == COMPLETED), 1).otherwise(0)).alias(name)
        for node, name in table.items()
    ])
    names = list(table.values())
    j = missions.select("mission_id", "safety_interlock").join(flags, "mission_id", "left").na.fill(0, names)
    staged = j.withColumn("interlock_ready", F.when(F.col("safety_interlock") == INTERLOCK_NORMAL, 1).otherwise(0))
    return staged.select(
        "mission_id", *names, F.lit(1).alias("services_ready"), "interlock_ready",
        F.least(*[F.col(n) for n in names], F.col("interlock_ready")).alias("all_ready"),
    )


def reserve_subsystems(requests: DataFrame) -> DataFrame:
    """One reservation per item of the comma list ``subsystem_types``."""
    items = requests.select("mission_id", F.explode(F.split("subsystem_types", ",")).alias("subsystem_type"))
    named = items.withColumn("subsystem_type", F.trim("subsystem_type")).filter("subsystem_type <> ''")
    return named.select(
        F.concat(F.lit("RES"), stable_id(F.concat_ws("|", "mission_id", "subsystem_type"), 8)).alias("reservation_id"),
        "mission_id", "subsystem_type", F.lit("已预约").alias("status"),
    )


def emergency_target(action: Column) -> Column:
    return F.when(action.contains("泄放") | action.contains("停充"), "泵浦分系统").otherwise("同步分系统")


def interlock_events(missions: DataFrame, trigger_type: str) -> DataFrame:
    """Events that trip the interlock of the given missions; other mission columns are kept."""
    return missions.withColumns({
        "event_id": F.concat(F.lit("SI"), stable_id(F.concat_ws("|", "mission_id", F.lit(trigger_type)), 8)),
        "trigger_type": F.lit(trigger_type), "status": F.lit(INTERLOCK_TRIPPED),
    })
