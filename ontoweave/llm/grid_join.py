"""Near-duplicate vectors of one label: an epsilon grid order join.

Unit vectors are projected on the leading principal directions of all rows, cut into grid
cells as wide as the search distance and sorted in grid order within their label. The
sequence is dealt into intervals; pairs of intervals whose boxes are provably farther apart
than the distance are never opened, and an opened pair is halved recursively in the same
way down to small blocks, which are compared exactly in double precision. Equal vectors of
a label are one vector with a count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.llm.base import query, stored, table
from ontoweave.operators.graph import connected_components

DIMENSIONS = 6  # leading principal directions in the grid
INTERVAL_BITS = 10  # an interval of the sequence has up to 1024 vectors
SMALL = 64  # vectors in a block that is no longer halved
SLACK = 1e-9  # for the rounding of projections; the comparison itself has none


def _moments(batches):
    """Sums of x and of x x' over unit vectors, one row a partition and dimension count."""
    sums: dict[int, np.ndarray] = {}
    for frame in batches:
        for d, part in frame.groupby(frame["v"].map(len)):
            x = _unit(np.stack(part["v"].to_numpy()))
            x1 = np.hstack([x, np.ones((len(x), 1))])
            sums[d] = sums.get(d, 0) + x1.T @ x1
    if sums:
        yield pd.DataFrame({"d": list(sums), "m": [m.ravel() for m in sums.values()]})


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Leading eigenvectors of the covariance of all unit vectors, for each length of vector that occurs."""
    per_cell = (
        vectors.select("v").mapInPandas(_moments, "d int, m array<double>")
        .select("d", F.posexplode("m").alias("i", "x")).groupBy("d", "i").agg(F.sum("x").alias("x")).toPandas()
    )  # (dimensions + 1)^2 numbers, however many vectors
    found = {}
    for d, part in per_cell.groupby("d"):
        m = part.sort_values("i")["x"].to_numpy().reshape(d + 1, d + 1)
        mean = m[-1, :-1] / m[-1, -1]
        _, axes = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        found[int(d)] = np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS])
    return found


def _placed(axes: dict[int, np.ndarray], width: float):
    def run(batches):
        for frame in batches:
            out = []
            for d, part in frame.groupby(frame["v"].map(len)):
                at = _unit(np.stack(part["v"].to_numpy())) @ axes[d]
                out.append(part.assign(at=list(at), cell=list(np.floor(at / width).astype(np.int64))))
            if out:
                yield pd.concat(out)[["label", "id", "copies", "v", "at", "cell"]]

    return run


def _pairs_within(xa, pa, xb, pb, same: bool, limit: float, reach: float):
    """Index pairs (i, j) with cosine >= limit, by recursive halving of both sequences."""
    found = []

    def apart(a, b) -> bool:
        gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
        return float(gap @ gap) > reach * reach

    def box(p, lo, hi):
        return p[lo:hi].min(axis=0), p[lo:hi].max(axis=0)

    def join(alo, ahi, blo, bhi):
        if same and alo > blo:  # the mirror image is visited already
            return
        if ahi <= alo or bhi <= blo or apart(box(pa, alo, ahi), box(pb, blo, bhi)):
            return
        if ahi - alo <= SMALL and bhi - blo <= SMALL:
            near = np.argwhere(xa[alo:ahi] @ xb[blo:bhi].T >= limit)
            i, j = near[:, 0] + alo, near[:, 1] + blo
            keep = i < j if same else slice(None)
            found.append((i[keep], j[keep]))
            return
        am, bm = (alo + ahi + 1) // 2, (blo + bhi + 1) // 2
        halves_a = [(alo, am), (am, ahi)] if ahi - alo > SMALL else [(alo, ahi)]
        halves_b = [(blo, bm), (bm, bhi)] if bhi - blo > SMALL else [(blo, bhi)]
        for a in halves_a:
            for b in halves_b:
                join(*a, *b)

    join(0, len(xa), 0, len(xb))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *(i for i, _ in found)]), np.concatenate([none, *(j for _, j in found)])


def _exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.float64), y.astype(np.float64)
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _lowest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 .. n - 1 and the links (i, j), the lowest node each is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, root[i], low)
        np.minimum.at(after, root[j], low)
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _joined(cosine: float, reach: float):
    """(id, others, root) of every vector with a link in two intervals: the rows it links with, and the lowest of its class there."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: pd.Series(dtype="int64") for c in ("id", "others", "root")})]
        for d, a in left.groupby(left["v"].map(len)):
            b = right[right["v"].map(len) == d]
            if not len(b):
                continue
            a, b = a.sort_values("rank"), b.sort_values("rank")
            va, vb = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
            same = bool(left["home"].iloc[0] == left["other"].iloc[0])
            i, j = _pairs_within(_unit(va), np.stack(a["at"].to_numpy()), _unit(vb), np.stack(b["at"].to_numpy()), same, cosine - SLACK, reach)
            if not len(i):
                continue
            exact = _exact_cosine(va[i], vb[j]) >= cosine
            one, other = a["id"].to_numpy()[i[exact]], b["id"].to_numpy()[j[exact]]
            n_one, n_other = a["copies"].to_numpy()[i[exact]], b["copies"].to_numpy()[j[exact]]
            ids, place = np.unique(np.concatenate([one, other]), return_inverse=True)
            x, y = place[: len(one)], place[len(one) :]
            others = np.bincount(x, n_other, len(ids)) + np.bincount(y, n_one, len(ids))
            out.append(pd.DataFrame({"id": ids, "others": others.astype(np.int64), "root": ids[_lowest(x, y, len(ids))]}))
        return pd.concat(out)

    return run


def near_vectors(
    table_: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link when their labels are equal and not null and their cosine is at least
    ``cosine``. Null, empty or zero vectors, those with a null or non-finite component and
    those of another length than their partner link with nothing. Ids name rows; rows
    without an id are left out. An empty table gives an empty result.
    """
    spark = table_.sparkSession
    rows = table_.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    rows = rows.filter("id is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(sound & F.col("label").isNotNull(), F.lit(False))
    alike = stored(
        rows.filter(usable).groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors"
    )
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    axes = principal_directions(alike)
    kinds = f"label {alike.schema['label'].dataType.simpleString()}, id long, copies long, v array<double>, at array<double>, cell array<bigint>"
    placed = alike.select("label", "id", "copies", "v").mapInPandas(_placed(axes, reach), kinds)
    # grid order: cells compared from the first direction on; ranks count within a range partition, so no label is one task
    placed = placed.repartitionByRange("label", "cell", "id").sortWithinPartitions("label", "cell", "id").drop("cell")
    ranked = stored(placed.withColumn("rank", F.monotonically_increasing_id()), "grid_order").withColumn("home", F.shiftright("rank", INTERVAL_BITS))
    dims = range(DIMENSIONS)
    boxes = ranked.groupBy("label", "home").agg(
        *[F.min(F.get("at", F.lit(k))).alias(f"lo{k}") for k in dims], *[F.max(F.get("at", F.lit(k))).alias(f"hi{k}") for k in dims]
    )
    boxes = boxes.withColumn("column", F.explode(F.sequence(F.floor(F.col("lo0") / reach) - 1, F.floor(F.col("hi0") / reach) + 1)))
    boxes = stored(boxes, "boxes")  # one row for an interval and grid column it may meet
    a, b = boxes.alias("a"), boxes.alias("b")

    def gap(k):
        return F.coalesce(F.greatest(F.lit(0.0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}")), F.lit(0.0))

    distance = sum((gap(k) * gap(k) for k in dims), F.lit(0.0))
    met = (F.col("a.label") == F.col("b.label")) & (F.col("a.column") == F.col("b.column")) & (F.col("a.home") <= F.col("b.home"))
    pairs = a.join(b, met & (distance <= reach * reach)).select(F.col("a.label").alias("label"), F.col("a.home").alias("home"), F.col("b.home").alias("other"))
    pairs = stored(pairs.distinct(), "interval_pairs")
    keys = ["label", "home", "other"]
    left = ranked.join(pairs, ["label", "home"]).select(*keys, "id", "copies", "v", "at", "rank")
    right = ranked.withColumnRenamed("home", "other").join(pairs, ["label", "other"]).select(*[F.col(c).alias(c) for c in [*keys, "id", "copies", "v", "at", "rank"]])
    met_rows = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_joined(cosine, reach), "id long, others long, root long")
    met_rows = stored(met_rows, "vector_links")
    near = met_rows.groupBy("id").agg(F.sum("others").alias("others"))
    links = met_rows.filter("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst"))
    classes = connected_components(links).select(F.col("node").alias("id"), "component")
    found = alike.join(near, "id", "left").join(classes, "id", "left").select(
        "label", "v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    linked = rows.filter(usable).join(found, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    result = linked.unionByName(alone)
    return result.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP9_SQL = """
WITH RECURSIVE sound AS MATERIALIZED (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.id AS x, b.id AS y FROM sound a JOIN sound b ON a.label = b.label AND a.id <> b.id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS root, vec_id AS node FROM embeddings
  UNION
  SELECT r.root, l.y FROM reach r JOIN links l ON l.x = r.node
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) USING (vec_id)
JOIN (SELECT root AS vec_id, min(node) AS component_id FROM reach GROUP BY root) c USING (vec_id)
"""


@query("op9_embedding_near_dedup", OP9_SQL)
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
