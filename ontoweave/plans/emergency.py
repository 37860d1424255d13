"""Emergency response: facilities around events, resources in range, rule lookups."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.numeric import with_rounded
from ontoweave.operators.filters import apply_filters, present
from ontoweave.operators.geo import EARTH_KM, radius_join, within_range
from ontoweave.operators.profile import union_all

AVAILABLE = "可用"


def facilities(kinds: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """One table of (type name, rows, id column, name column)."""
    return union_all([
        rows.select(
            F.lit(kind).alias("facility_type"), F.col(id_column).cast("string").alias("facility_id"),
            F.col(name_column).alias("name"), "lng", "lat",
        )
        for kind, rows, id_column, name_column in kinds
    ])


def affected_facilities(events: DataFrame, sites: DataFrame, radius_km: float = 5.0) -> DataFrame:
    """Facilities within ``radius_km`` of every event that has coordinates."""
    centres = events.filter((F.col("lng") != 0) & (F.col("lat") != 0)).select(
        "event_id", F.col("lng").alias("center_lng"), F.col("lat").alias("center_lat")
    )
    met = radius_join(centres, sites, radius_km, EARTH_KM, "_d")
    return with_rounded(met, 2, distance_km=F.col("_d")).select(
        "event_id", "facility_type", "facility_id", "name", "distance_km"
    )


def depots_in_range(depots: DataFrame, lng: float, lat: float, radius_km: float = 100.0) -> DataFrame:
    return within_range(depots, lng, lat, radius_km, EARTH_KM, 2, "distance_km").orderBy("distance_km")


def rescue_teams_in_range(teams: DataFrame, lng: float, lat: float, radius_km: float = 100.0) -> DataFrame:
    ready = teams.filter(F.coalesce(F.col("available"), F.lit(0)) != 0)
    return within_range(ready, lng, lat, radius_km, EARTH_KM, 2, "distance_km").orderBy("distance_km")


def drones_in_range(drones: DataFrame, bases: DataFrame, lng: float, lat: float, radius_km: float = 50.0) -> DataFrame:
    """Available drones, placed at their base; bases out of range are cut before the join."""
    near = within_range(bases.select("base_id", F.col("name").alias("base_name"), "lng", "lat"),
                        lng, lat, radius_km, EARTH_KM, 2, "distance_km").drop("lng", "lat")
    return drones.filter(F.col("status") == AVAILABLE).join(near, "base_id").orderBy("distance_km")


def lookup(rows: DataFrame, fields: list[str], **values: Any) -> DataFrame:
    """Rule table rows for the parameters that were given; left-out parameters do not filter."""
    given = {f: values.get(f) for f in fields}
    return apply_filters(rows, present(given))


# Rule lookups of the domain: function -> (object, filter fields). Fixed values.
LOOKUPS = {
    "lookup_damage_grade": ("DamageGradeStandard", ["facility_type", "damage_grade"]),
    "lookup_event_level": ("EventLevelStandard", ["level"]),
    "lookup_clearance_technique": ("ClearanceTechniqueRule", ["facility_type", "damage_type"]),
    "lookup_traffic_control": ("TrafficControlRule", ["damage_grade", "facility_type"]),
    "lookup_response_level": ("ResponseLevelRule", ["event_level"]),
    "lookup_drone_class": ("DroneClassRule", ["category"]),
    "lookup_operator_license_rule": ("OperatorLicenseRule", ["drone_category", "operation_type"]),
    "lookup_airspace_rule": ("AirspaceRule", ["airspace_type"]),
    "lookup_flight_approval_rule": ("FlightApprovalRule", ["scenario"]),
    "lookup_payload_type": ("PayloadTypeRule", ["payload_type", "applicable_scenarios"]),
    "lookup_importance_level": ("ImportanceLevelMap", ["industry_code"]),
    "lookup_source_requirement": ("SourceRequirement", ["load_level", "importance_level"]),
}
# Point getters: function -> (object, id field). Fixed values.
GETTERS = {
    "get_road_segment": ("RoadSegment", "segment_id"),
    "get_bridge_status": ("Bridge", "bridge_id"),
    "get_tunnel_status": ("Tunnel", "tunnel_id"),
    "get_drone": ("Drone", "drone_id"),
    "get_drone_operator": ("DroneOperator", "operator_id"),
    "get_drone_base": ("DroneBase", "base_id"),
    "get_airspace_zone": ("AirspaceZone", "zone_id"),
    "get_weather_warning": ("WeatherWarning", "warning_id"),
    "get_beam_line": ("BeamLine", "beam_id"),
    "get_shield_door": ("ShieldDoor", "door_id"),
    "get_mission": ("LaunchMission", "mission_id"),
    "get_node_definition": ("NodeDefinition", "node_name"),
    "get_vacuum_status": ("VacuumStatus", "device_id"),
    "get_personnel_count": ("PersonnelCounter", "location"),
}
