"""Function registry: parameters with defaults, dependencies, preconditions, constraint checks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.text import stable_id
from ontoweave.model import Function
from ontoweave.operators import guards, profile
from ontoweave.plans import emergency, launch, toll
from ontoweave.repository import ObjectRepository
from ontoweave.session import cut_lineage

_CASTS = {"int": int, "float": float, "str": str, "bool": lambda v: v if isinstance(v, bool) else str(v).lower() in ("1", "true", "yes")}


class FunctionRegistry:
    """Named functions ``fn(repository, **params) -> DataFrame`` and their declared contracts."""

    def __init__(self, repository: ObjectRepository):
        self.repository = repository
        self._functions: dict[str, tuple[Callable[..., DataFrame], Function]] = {}
        self._done: set[str] = set()

    def register(self, name: str, fn: Callable[..., DataFrame], spec: Function | None = None) -> None:
        self._functions[name] = (fn, spec or self.repository.ontology.functions.get(name) or Function(name))

    def names(self) -> list[str]:
        return sorted(self._functions)

    def order(self, name: str) -> list[str]:
        """The function after everything it depends on; a cycle is an error."""
        done: list[str] = []

        def visit(current: str, open_: tuple[str, ...]) -> None:
            if current in open_:
                raise ValueError(f"cyclic dependency: {' -> '.join([*open_, current])}")
            if current not in done:
                for other in self._functions[current][1].depends_on:
                    if other in self._functions:
                        visit(other, (*open_, current))
                done.append(current)

        visit(name, ())
        return done

    def _bound(self, spec: Function, params: dict[str, Any]) -> dict[str, Any]:
        given = dict(params)
        for p in spec.params:
            if p.name in given and given[p.name] is not None:
                given[p.name] = _CASTS.get(p.type, lambda v: v)(given[p.name])
            elif not p.required:
                given[p.name] = p.default
            else:
                raise ValueError(f"{spec.name}: missing parameter {p.name!r}")
        return given

    def check(self, name: str) -> list[str]:
        """Declared preconditions that no row of their object meets (one small existence test each)."""
        failed = []
        for need in self._functions[name][1].preconditions:
            rows = self.repository.df(need["object"])
            test = guards.precondition_column(need["field"], need.get("operator", "eq"), need.get("value"))
            wanted = need.get("operator") != "not_exists"
            test = test if wanted else F.col(need["field"]).isNotNull()
            if rows.filter(test).limit(1).isEmpty() == wanted:
                failed.append(f"{need['object']}.{need['field']} {need.get('operator', 'eq')} {need.get('value')}")
        return failed

    def call(self, name: str, **params: Any) -> DataFrame:
        """Run a function; dependencies that have not run yet run first with the shared parameters."""
        *before, _ = self.order(name)
        for other in before:
            if other not in self._done:
                accepted = {p.name for p in self._functions[other][1].params}
                self.call(other, **{k: v for k, v in params.items() if k in accepted})
        failed = self.check(name)
        if failed:
            raise ValueError(f"{name}: preconditions not met: {'; '.join(failed)}")
        fn, spec = self._functions[name]
        result = fn(self.repository, **self._bound(spec, params))
        self._done.add(name)
        return result


def register_lookups(registry: FunctionRegistry) -> None:
    """Rule lookups and point getters for every object the ontology declares."""
    objects = registry.repository.ontology.objects
    for name, (object_type, fields) in emergency.LOOKUPS.items():
        if object_type in objects:
            registry.register(name, lambda repo, _o=object_type, _f=fields, **kw: emergency.lookup(repo.df(_o), _f, **kw))
    for name, (object_type, key) in emergency.GETTERS.items():
        if object_type in objects:
            registry.register(name, lambda repo, _o=object_type, _k=key, **kw: emergency.lookup(repo.df(_o), [_k], **kw))


def register_toll(registry: FunctionRegistry) -> None:
    def build_graph(repo, version_id="", **_):
        rules = repo.df("NoContiguityRule").withColumn("ordinal", F.monotonically_increasing_id())
        return repo.replace_all("Contiguity", toll.build_graph(repo.df("TollUnit"), repo.df("TollStation"), rules))

    def compute_fees(repo, vehicle_types="1,2,3,4,11,12,13,14,15,16", **_):
        classes = [int(v) for v in str(vehicle_types).split(",") if v.strip()]
        ordered = lambda n: repo.df(n).withColumn("ordinal", F.monotonically_increasing_id())
        fees = toll.compute_fees(repo.df("TollUnit"), ordered("BaseRate"), ordered("SpecialTimeDiscount"), classes)
        return repo.replace_all("ProvinceRateParam", fees.filter("fee is not null"))

    def find_path(repo, en_station_id, ex_station_id, vehicle_type=1, **_):
        stations = repo.df("TollStation").select("station_id")
        found = toll.find_paths(
            repo.df("Contiguity"), repo.df("ProvinceRateParam"), stations.filter(F.col("station_id") == en_station_id),
            stations.filter(F.col("station_id") == ex_station_id), int(vehicle_type),
        )
        repo.insert("MinimumFeePath", found)
        return found

    def validate_path(repo, path_id, **_):
        wanted = repo.query("MinimumFeePath", {"path_id": path_id})
        errors = toll.validate_paths(wanted, repo.df("Contiguity"), repo.df("TollUnit"))
        repo.delete("ValidationError", {"path_id": path_id})
        keyed = errors.withColumn("error_id", F.concat_ws(":", "path_id", "rule_id", "position"))
        repo.insert("ValidationError", keyed)
        return errors

    for name, fn in {"build_graph": build_graph, "compute_fees": compute_fees, "find_path": find_path, "validate_path": validate_path}.items():
        registry.register(name, fn)


def register_launch(registry: FunctionRegistry) -> None:
    def frontier(repo, mission_id, **_):
        mission = repo.query("LaunchMission", {"mission_id": mission_id})
        return launch.next_executable(mission, repo.df("FlowEdge"), repo.df("FlowNode"))

    def readiness(repo, mission_id, **_):
        mission = repo.query("LaunchMission", {"mission_id": mission_id})
        runs = repo.query("FlowNode", {"mission_id": mission_id})
        return launch.check_readiness(mission, runs, ["node_id"])

    def mission_of(repo, mission_id):
        return repo.query("LaunchMission", {"mission_id": mission_id})

    def run_node(repo, mission_id, node_name, beam_ids="", **_):
        """Outcome of one node; a run row is stored unless the interlock blocks it. Run ids of a mission ascend."""
        runs = repo.query("FlowNode", {"mission_id": mission_id})
        known = repo.query("NodeDefinition", {"node_name": node_name}).dropDuplicates(["node_name"])
        wanted = known.select(F.lit(mission_id).alias("mission_id"), "node_name")
        outcome = launch.execute_nodes(mission_of(repo, mission_id), wanted, repo.df("FlowEdge"), runs, ["node_id"])
        number = F.lpad(F.lit(str(runs.count() + 1)), 8, "0")
        names = [c for c in known.columns if c not in ("mission_id", "status", "detail")]
        staged = outcome.join(known.select(*names), "node_name").withColumns({
            "node_id": F.concat_ws("-", F.lit("N"), "mission_id", number),
            "preconditions_met": F.when(F.col("detail") == "", "通过").otherwise(F.concat(F.lit("未满足: "), "detail")),
            "error_message": F.when(F.col("detail") == "", "").otherwise(F.concat(F.lit("前置节点未完成: "), "detail")),
            "input_params": F.to_json(F.struct(F.lit(beam_ids or "").alias("beam_ids"))),
        })
        if "subsystem_type" in known.columns:
            staged = staged.withColumn("subsystem_id", F.col("subsystem_type"))
        staged = cut_lineage(staged)
        repo.insert("FlowNode", staged.filter(F.col("status") != "blocked"))
        return staged

    def run_nodes(repo, mission_id, node_names, **_):
        """Each name in turn: a later one sees what the earlier ones completed."""
        names = [n.strip() for n in node_names.split(",") if n.strip()]
        return profile.union_all([run_node(repo, mission_id, n) for n in names])

    def subsystem(repo, subsystem_id, **_):
        key = repo.object("SubsystemConfig").id_field
        by = F.when(F.col(key) == subsystem_id, 0).when((F.col("subsystem_type") == subsystem_id) | (F.col("name") == subsystem_id), 1)
        return repo.df("SubsystemConfig").withColumn("_by", by).filter("_by is not null").orderBy("_by", key).limit(1).drop("_by")

    def node_status(repo, mission_id, node_name, **_):
        wanted = repo.spark.createDataFrame([(mission_id, node_name)], "mission_id string, node_name string")
        return launch.node_status(wanted, repo.query("FlowNode", {"mission_id": mission_id}), ["node_id"])

    def stored(repo, name, rows):
        repo.insert(name, rows)
        return rows

    def reserve(repo, mission_id, subsystem_types, **_):
        wanted = repo.spark.createDataFrame([(mission_id, subsystem_types)], "mission_id string, subsystem_types string")
        return stored(repo, "ServiceReservation", launch.reserve_subsystems(wanted))

    def interlock(repo, mission_id, **_):
        checks = [F.lit(True).alias(c) for c in ("shield_door_locked", "personnel_count_zero", "vacuum_normal")]
        return mission_of(repo, mission_id).select("mission_id", F.coalesce("safety_interlock", F.lit("未知")).alias("interlock_status"), *checks)

    def trip(repo, mission_id, trigger_type, **_):
        return stored(repo, "SafetyInterlockEvent", launch.interlock_events(mission_of(repo, mission_id).select("mission_id"), trigger_type))

    def emergency(repo, mission_id, action_type, reason="", **_):
        rows = repo.spark.createDataFrame([(mission_id, action_type, reason or "")], "mission_id string, action_type string, trigger_reason string")
        named = rows.withColumns({
            "action_id": F.concat(F.lit("EA"), stable_id(F.concat_ws("|", *rows.columns), 8)), "target_subsystem": launch.emergency_target(F.col("action_type")),
        })
        return stored(repo, "EmergencyAction", named)

    functions = {
        "execute_node": run_node, "execute_parallel_nodes": run_nodes, "get_subsystem": subsystem, "get_node_status": node_status,
        "trigger_sync": lambda repo, mission_id, **_: run_nodes(repo, mission_id, ",".join(launch.SYNC_NODES)),
        "reserve_subsystems": reserve, "check_interlock": interlock, "trigger_interlock": trip, "emergency_action": emergency,
    }
    for name, fn in functions.items():
        registry.register(name, fn)
    registry.register("get_next_executable_nodes", frontier)
    registry.register("check_readiness", readiness)
    registry.register("get_flow_edges", lambda repo, phase="", from_node="", **_: launch.flow_edges(repo.df("FlowEdge"), phase or "", from_node or ""))


def register_missing(registry: FunctionRegistry) -> None:
    """Declared functions without an implementation answer with one ``not_implemented`` row."""
    for name, spec in registry.repository.ontology.functions.items():
        if name not in registry.names():
            registry.register(name, lambda repo, _n=name, **_: repo.spark.createDataFrame([(_n, "not_implemented")], "function string, status string"), spec)
