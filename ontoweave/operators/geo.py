"""Distance operators: radius search, radius join, ring expansion, nearest groups.

A radius join never compares all pairs. Latitude is cut into bands at least one
radius high, every band into longitude cells at least one radius wide at its
poleward edge; a centre is sent to the few cells its circle can reach and meets
the points there by an equi-join over as many tasks as the session shuffles to.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.functions.numeric import haversine, with_rounded
from ontoweave.operators.ordering import top_per_group
from ontoweave.session import cut_lineage, tasks_for

EARTH_KM = 6371.0
EARTH_M = 6371000.0


def within_range(
    points: DataFrame, lng: float, lat: float, radius: float, earth: float, digits: int, name: str
) -> DataFrame:
    """Points within ``radius`` of one centre; a latitude band filter reaches the scan."""
    reach = math.degrees(radius / earth) * 1.000001
    near = points.filter(F.col("lat").between(lat - reach, lat + reach))
    measured = near.withColumn("_d", haversine(F.lit(float(lng)), F.lit(float(lat)), F.col("lng"), F.col("lat"), earth))
    return with_rounded(measured.filter(F.col("_d") <= radius), digits, **{name: F.col("_d")}).drop("_d")


def _band(lat: Column, height: float) -> Column:
    return F.floor((lat + 90.0) / height).cast("int")


def _cells_in_band(band: Column, height: float) -> Column:
    """Number of longitude cells in a band: each at least ``height`` degrees of arc wide."""
    edge = F.greatest(F.abs(band * height - 90.0), F.abs((band + 1) * height - 90.0))
    cosine = F.cos(F.radians(F.least(edge, F.lit(90.0))))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * cosine / height).cast("int"))


def _cell(lng: Column, cells: Column) -> Column:
    return F.floor((lng + 180.0) / (F.lit(360.0) / cells)).cast("int")


def radius_join(
    centres: DataFrame, points: DataFrame, radius: float, earth: float, distance: str = "distance", counted: bool = False
) -> DataFrame:
    """Every (centre, point) pair within ``radius``.

    ``centres`` carry ``center_lng``/``center_lat``, ``points`` carry ``lng``/``lat``. ``counted``: the pairs that
    meet in the cells are counted first (one row per cell), so that more of them make more tasks, not longer ones.
    """
    angle = radius / earth
    height = max(math.degrees(angle) * 1.000001, 1e-7)
    lat, lng = F.col("center_lat"), F.col("center_lng")
    reach_sin = F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(F.radians(lat))
    # Near a pole, or for very large circles, every longitude can be inside.
    around = (F.abs(lat) + height >= 90.0) | (F.abs(reach_sin) >= 1.0)
    half = F.when(around, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(reach_sin, F.lit(1.0)))) * 1.000001)
    spread = (
        centres.withColumn("_half", half)
        .withColumn("_band", F.explode(F.sequence(_band(lat, height) - 1, _band(lat, height) + 1)))
        .withColumn("_cells", _cells_in_band(F.col("_band"), height))
        .withColumn("_from", _cell(lng - F.col("_half"), F.col("_cells")))
        .withColumn("_to", F.least(_cell(lng + F.col("_half"), F.col("_cells")), F.col("_from") + F.col("_cells") - 1))
        .withColumn("_cell", F.explode(F.sequence(F.col("_from"), F.col("_to"))))
        .withColumn("_cell", F.pmod(F.col("_cell"), F.col("_cells")))
        .drop("_half", "_cells", "_from", "_to")
    )
    placed = points.withColumn("_band", _band(F.col("lat"), height)).withColumn(
        "_cell",
        F.pmod(_cell(F.col("lng"), _cells_in_band(F.col("_band"), height)), _cells_in_band(F.col("_band"), height)),
    )
    # Few bytes make many pairs here, so the number of tasks must not follow the bytes.
    tasks = int(centres.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counted:
        cells = [d.groupBy("_band", "_cell").agg(F.count("*").alias(n)) for d, n in ((spread, "_centres"), (placed, "_points"))]
        pairs = cells[0].join(cells[1], ["_band", "_cell"]).agg(F.sum(F.col("_centres").cast("double") * F.col("_points"))).first()[0]
        tasks = tasks_for(centres.sparkSession, int(pairs or 0), 1_500_000)
    met = spread.repartition(tasks, "_band", "_cell").join(placed.repartition(tasks, "_band", "_cell"), ["_band", "_cell"]).drop("_band", "_cell")
    return met.withColumn(
        distance, haversine(F.col("center_lng"), F.col("center_lat"), F.col("lng"), F.col("lat"), earth)
    ).filter(F.col(distance) <= radius)


def lng_lat(value: Column) -> tuple[Column, Column]:
    """Coordinates of a ``"lng,lat"`` text; what is no number counts as 0, a text without a comma as (0, 0)."""
    parts = F.split(value, ",", 2)
    number = lambda i: F.coalesce(F.when(value.contains(","), F.get(parts, F.lit(i)).try_cast("double")), F.lit(0.0))
    return number(0), number(1)


def lng_lat_of_map(value: Column) -> tuple[Column, Column]:
    """Coordinates of a map or struct with ``lng`` and ``lat``; a missing one counts as 0."""
    return tuple(F.coalesce(value[k].cast("double"), F.lit(0.0)) for k in ("lng", "lat"))


def ring_of(distance: Column, radii: list[float]) -> Column:
    """Smallest radius of the sequence that contains the distance; null beyond the last."""
    chain = None
    for radius in radii:
        chain = (F.when if chain is None else chain.when)(distance <= radius, F.lit(float(radius)))
    return chain


def expand_rings(
    candidates: DataFrame, key: str, group: str, distance: str, radii: list[float], required: Column
) -> tuple[DataFrame, DataFrame]:
    """Grow the search ring per key until enough distinct groups are found.

    Returns (points inside the stopping ring, one summary row per key). A key
    that never finds enough keeps everything inside the last ring. Only one
    (key, group) -> nearest ring row crosses the shuffle, then one row per key.
    """
    ringed = candidates.withColumn("_ring", ring_of(F.col(distance), radii)).filter(F.col("_ring").isNotNull())
    nearest = ringed.groupBy(key, group).agg(F.min("_ring").alias("_first"), F.max(required).alias("_required"))
    counts = nearest.groupBy(key).agg(
        F.max("_required").alias("_required"),
        *[F.count(F.when(F.col("_first") <= r, 1)).alias(f"_n_{i}") for i, r in enumerate(radii)],
    )
    stop = found = None
    for i, radius in enumerate(radii):
        enough = F.col(f"_n_{i}") >= F.col("_required")
        stop = (F.when if stop is None else stop.when)(enough, F.lit(float(radius)))
        found = (F.when if found is None else found.when)(enough, F.col(f"_n_{i}"))
    last = len(radii) - 1
    summary = counts.select(
        key,
        stop.otherwise(F.lit(float(radii[-1]))).alias("stopped_radius"),
        found.otherwise(F.col(f"_n_{last}")).alias("distinct_groups"),
        (F.col(f"_n_{last}") >= F.col("_required")).alias("satisfied"),
    )
    inside = ringed.join(summary.select(key, "stopped_radius"), key).filter(F.col("_ring") <= F.col("stopped_radius"))
    return inside.drop("_ring", "stopped_radius"), summary


def search_rings(
    centres: DataFrame, points: DataFrame, key: str, group: str, radii: list[float], required: int, earth: float = EARTH_M,
    allowed: Column | None = None, distance: str = "_d",
) -> tuple[DataFrame, DataFrame]:
    """``expand_rings`` of all (centre, point) pairs within the last radius, made ring by ring.

    Only centres that miss groups meet the next ring, so a crowded place costs what its own ring holds.
    ``allowed`` filters the pairs. Keys may repeat or be null: rows of one key search together.
    """
    pending, found, summaries = cut_lineage(centres), [], []
    for i, radius in enumerate(radii):
        def inside(some: DataFrame) -> DataFrame:
            met = radius_join(some, points, radius, earth, distance)  # noqa: B023
            return met if allowed is None else met.filter(allowed)

        counts = inside(pending).groupBy(key, group).agg(F.lit(1).alias("_one")).groupBy(key).agg(F.count("*").alias("distinct_groups"))
        satisfied = F.col("distinct_groups") >= required
        ended = counts if i == len(radii) - 1 else counts.filter(satisfied)
        summary = cut_lineage(ended.select(key, F.lit(float(radius)).alias("stopped_radius"), "distinct_groups", satisfied.alias("satisfied")))
        mine = summary.select(F.col(key).alias("_key"))
        same = F.col(key).eqNullSafe(F.col("_key"))
        found.append(inside(pending.join(mine, F.col(key) == F.col("_key"), "left_semi")))
        summaries.append(summary)
        if i < len(radii) - 1:
            pending = cut_lineage(pending.join(mine, same, "left_anti"))
            if pending.isEmpty():
                break
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, summaries)


def _first_radius(points: DataFrame, k: int, earth: float, most: float) -> float:
    """Radius that would hold about four times ``k`` points if all lay evenly in their bounding box; at most ``most``."""
    box = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("lng", "lat") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not box["n"]:
        return most
    high = math.radians(abs(box["hi_lat"] - box["lo_lat"])) * earth
    wide = math.radians(abs(box["hi_lng"] - box["lo_lng"])) * earth * max(math.cos(math.radians((box["hi_lat"] + box["lo_lat"]) / 2)), 0.0)
    even = math.sqrt(high * wide * 4 * k / (math.pi * box["n"]))
    return min(most, max(even, most / 1024)) if math.isfinite(even) else most


def nearest_groups(
    centres: DataFrame, points: DataFrame, key: str, group: str, tiebreak: str, k: int, earth: float = EARTH_M,
    first_radius: float | None = None, growth: float = 4.0, digits: int = 1, name: str = "distance_m",
) -> DataFrame:
    """(key, group, tiebreak, name): of each centre the nearest point of its ``k`` nearest groups, at any distance.

    Distances are rounded to ``digits``, ties go to the smallest ``tiebreak``. The ring grows only for centres
    that miss groups: a centre is done once its k-th group lies so far inside the ring that no point
    beyond it can round to the same distance. Without ``first_radius`` the first ring follows the density of
    the points, 2 km at most. The last ring is the whole globe, so a centre gets
    fewer groups only where fewer exist. ``centres``: key, center_lng, center_lat; keys are unique.
    Centres or points without a key, group or place are left out.
    """
    placed = points.select(group, tiebreak, "lng", "lat").dropna()
    pending = cut_lineage(centres.select(key, "center_lng", "center_lat").dropna())
    wanted = placed.select(group).distinct().limit(k).count()
    start = _first_radius(placed, max(k, 1), earth, 2000.0) if first_radius is None else first_radius
    widest, radius, margin, found = math.pi * earth, min(start, math.pi * earth), 2 * 10.0**-digits, []
    while wanted:
        met = with_rounded(radius_join(pending, placed, radius, earth, "_d"), digits, **{name: F.col("_d")})
        nearest = met.groupBy(key, group).agg(F.min(F.struct(name, tiebreak)).alias("_best")).select(key, group, "_best.*")
        best = cut_lineage(top_per_group(nearest, [key], [F.col(name), F.col(tiebreak)], wanted))
        if radius >= widest:
            found.append(best)
            break
        full = best.groupBy(key).agg(F.count("*").alias("_n"), F.max(name).alias("_far")).filter((F.col("_n") >= wanted) & (F.col("_far") < radius - margin))
        found.append(best.join(full.select(key), key, "left_semi"))
        pending = cut_lineage(pending.join(full.select(key), key, "left_anti"))
        if pending.isEmpty():
            break
        radius = min(radius * growth, widest)
    if not found:
        return centres.join(placed, F.lit(False)).select(key, group, tiebreak, F.lit(0.0).alias(name))
    return reduce(DataFrame.unionByName, found).select(key, group, tiebreak, name)
