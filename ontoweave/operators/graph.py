"""Iterative graph operators as DataFrame loops.

Each round is a join plus a mergeable aggregate. State is checkpointed to the
shared folder every round or two, so plans stay short and a lost executor only
replays the current round. The driver sees counters, never rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.session import cut_lineage


def shortest_paths(edges: DataFrame, starts: DataFrame, max_rounds: int = 10_000, rounds_per_cut: int = 3) -> DataFrame:
    """Cheapest route from every start node to every node it reaches.

    ``edges``: src, dst, weight (non-negative). ``starts``: src. Result: src,
    dst, cost, path. Only nodes whose cost fell in the last round expand
    again; equal costs are settled by fewest edges, then by the lower path.
    """
    real = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), "weight", F.lit(False).alias("_stay"))
    zero = F.lit(0).cast(edges.schema["weight"].dataType)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("_from")).unionByName(
        starts.select(F.col("src").alias("_from"))
    ).distinct()
    # A stay arc per node carries the old label into the next round, so a round reads the labels once.
    arcs = cut_lineage(real.unionByName(nodes.select("_from", F.col("_from").alias("_to"), zero.alias("weight"), F.lit(True).alias("_stay"))))
    best = cut_lineage(starts.select(
        "src", F.col("src").alias("dst"), zero.alias("cost"), F.array("src").alias("path"), F.lit(True).alias("fresh")
    ).distinct())
    for _ in range(-(-max_rounds // rounds_per_cut)):
        for _ in range(rounds_per_cut):
            best = _relax(best, arcs)
        best = cut_lineage(best)
        if best.filter("fresh").isEmpty():
            return best.drop("fresh")
    raise RuntimeError(f"routes still improve after {max_rounds} rounds")


def _relax(best: DataFrame, arcs: DataFrame) -> DataFrame:
    moves = best.join(arcs, (F.col("dst") == F.col("_from")) & (F.col("fresh") | F.col("_stay"))).select(
        "src", F.col("_to").alias("dst"), (F.col("cost") + F.col("weight")).alias("cost"),
        F.when(F.col("_stay"), F.col("path")).otherwise(F.concat("path", F.array("_to"))).alias("path"),
        (~F.col("_stay")).alias("fresh"),
    )
    # false < true: an equally good old label stays, so a round without gain leaves nothing fresh.
    return moves.groupBy("src", "dst").agg(
        F.min(F.struct("cost", F.size("path").alias("hops"), "path", "fresh")).alias("_best")
    ).select("src", "dst", "_best.cost", "_best.path", "_best.fresh")


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component): component is the smallest node id it is connected to.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), which
    need a number of rounds logarithmic in the size of a component, not in its
    diameter.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    links = cut_lineage(edges.select("src", "dst").filter("src <> dst").distinct())
    before = None
    for _ in range(max_rounds):
        links = cut_lineage(_small_star(_large_star(links)))
        state = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")
        ).first()
        if (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    parents = links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_root"))
    return nodes.join(parents, "node", "left").select(
        "node", F.least(F.coalesce("_root", "node"), F.col("node")).alias("component")
    )


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large_star(links: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the smallest node around it."""
    around = _both_ways(links)
    lowest = around.groupBy("src").agg(F.min("dst").alias("_m")).select("src", F.least("_m", "src").alias("_m"))
    return (
        around.join(lowest, "src").filter("dst > src")
        .select(F.col("dst").alias("src"), F.col("_m").alias("dst")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them."""
    down = links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    lowest = down.groupBy("src").agg(F.min("dst").alias("_m"))
    moved = down.join(lowest, "src").filter("dst <> _m").select(F.col("dst").alias("src"), F.col("_m").alias("dst"))
    return moved.unionByName(lowest.select("src", F.col("_m").alias("dst"))).distinct()


def bounded_paths(
    edges: DataFrame, starts: DataFrame, max_depth: int, fan_out: int | None = None, order: list[Column] | None = None,
    direction: str = "outgoing", ends: DataFrame | None = None,
) -> DataFrame:
    """Simple paths of 1..max_depth edges from the start nodes, with the direction of each step.

    ``direction``: edges are followed ``outgoing``, ``incoming`` or ``both`` ways.
    ``ends`` (dst) keeps only the paths that end there.

    ``edges``: src, dst, label, score. ``fan_out`` keeps the best edges per node
    in ``order``, applied once to the edge table.
    """
    ways = {"outgoing": ("src", "dst"), "incoming": ("dst", "src")}
    sides = [(name, *cols) for name, cols in ways.items() if direction in (name, "both")]
    if not sides:
        raise ValueError(f"unknown direction {direction!r}")
    arcs = reduce(DataFrame.unionByName, [
        edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"), "label", "score", F.lit(name).alias("_way")) for name, a, b in sides
    ])
    if fan_out:
        from ontoweave.operators.ordering import top_per_group

        keep = order or [F.col("score").desc(), F.col("label"), F.col("_to")]
        arcs = top_per_group(arcs, ["_from"], keep, fan_out).drop("rank")
    arcs = cut_lineage(arcs)
    level = starts.select(
        F.col("src").alias("node"), F.array("src").alias("path"),
        F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).alias("depth"),
        F.array().cast("array<string>").alias("directions"),
    )
    found = []
    for depth in range(1, max_depth + 1):
        level = (
            level.withColumnRenamed("score", "_score")
            .join(arcs, F.col("node") == F.col("_from"))
            .filter(~F.array_contains("path", F.col("_to")))
            .select(
                F.col("_to").alias("node"), F.concat("path", F.array("_to")).alias("path"),
                F.concat("labels", F.array("label")).alias("labels"),
                (F.col("_score") + F.col("score")).alias("score"), (F.col("depth") + 1).alias("depth"),
                F.concat("directions", F.array("_way")).alias("directions"),
            )
        )
        if depth < max_depth:  # nothing continues the longest paths, which are by far the most
            level = cut_lineage(level)
        found.append(level)
    out = reduce(DataFrame.unionByName, found)
    return out if ends is None else out.join(ends.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """Degree and weighted degree per node of the undirected graph; parallel edges merge."""
    ends = edges.filter("src <> dst").select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight"
    )
    merged = ends.groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    both = merged.select(F.col("a").alias("node"), "weight").unionByName(
        merged.select(F.col("b").alias("node"), "weight")
    )
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def pagerank(
    edges: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float = 1e-6, test_every: int = 4
) -> DataFrame:
    """Weighted PageRank over directed edges (src, dst, weight); ranks sum to 1.

    Rank of nodes without outgoing edges is spread evenly. Stops when the total
    change falls below ``tolerance`` per node, tested every few rounds. One
    checkpoint per round: a round reads the last ranks three times, so
    unrolled rounds would multiply.
    """
    arcs = cut_lineage(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    out = arcs.groupBy("src").agg(F.sum("weight").alias("_total"))
    shares = cut_lineage(arcs.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_total")).alias("share")))
    sources = out.select(F.col("src").alias("node"), F.lit(False).alias("_sink"))
    nodes = arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    flagged = cut_lineage(nodes.join(sources, "node", "left").select("node", F.coalesce("_sink", F.lit(True)).alias("sink")))
    total, has_sinks = flagged.count(), not flagged.filter("sink").isEmpty()
    ranks = flagged.withColumn("rank", F.lit(1.0 / total))
    for i in range(iterations):
        flow = (
            shares.join(ranks.select(F.col("node").alias("src"), "rank"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.sum(F.col("rank") * F.col("share")).alias("_in"))
        )
        base = F.lit((1 - damping) / total)
        if has_sinks:
            lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0))).scalar()
            base = base + F.lit(damping) * lost / total
        fresh = cut_lineage(ranks.join(flow, "node", "left").select(
            "node", "sink", (base + F.lit(damping) * F.coalesce("_in", F.lit(0.0))).alias("rank"), F.col("rank").alias("_old"),
        ))
        if (i + 1) % test_every == 0 and i + 1 < iterations:
            change = fresh.agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0]
            if change < tolerance * total:
                return fresh.select("node", "rank")
        ranks = fresh.drop("_old")
    if tolerance > 0 and iterations:
        change = fresh.agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0]
        if change >= tolerance * total:
            raise RuntimeError(f"ranks still change by {change} after {iterations} rounds")
    return ranks.select("node", "rank")


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community) by weighted label propagation over the undirected graph.

    In every round each node takes the label with the greatest weight around
    it (the smaller label among equals), its own label counting like its
    strongest edge. An approximation of modularity communities: greedy
    modularity merges one pair at a time and does not distribute.
    """
    ends = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
    merged = ends.groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    both = merged.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(
        merged.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight")
    )
    own = both.groupBy("node").agg(F.max("weight").alias("weight"))
    arcs = cut_lineage(both.unionByName(own.select("node", F.col("node").alias("other"), "weight")))
    labels = own.select(F.col("node").alias("other"), F.col("node").alias("label"))
    for _ in range(rounds):
        votes = arcs.join(labels, "other").groupBy("node", "label").agg(F.sum("weight").alias("weight"))
        best = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("weight"), F.col("label"))).alias("label"))
        labels = cut_lineage(best.select(F.col("node").alias("other"), "label"))
    return labels.select(F.col("other").alias("node"), F.col("label").alias("community"))


GAIN = 1e-9  # of modularity: less is no gain
PARTS = 64  # shares of the nodes that move in turn, at most


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with the weighted modularity of the communities (node, community) of an undirected graph; null without edges."""
    arcs, nodes = _undirected(edges)
    state = nodes.join(labels.select("node", "community"), "node")
    return _quality(arcs, state)


def _undirected(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, other, weight) both ways with parallel edges merged, and (node, k, inner): weighted degree, weight inside."""
    ends = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("weight").cast("double").alias("weight"))
    merged = cut_lineage(ends.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    arcs = merged.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(
        merged.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    return arcs, arcs.groupBy("node").agg(F.sum("weight").alias("k"), F.lit(0.0).alias("inner"))


def _quality(arcs: DataFrame, state: DataFrame) -> DataFrame:
    here = state.select("node", F.col("community").alias("_c"))
    there = state.select(F.col("node").alias("other"), F.col("community").alias("_d"))
    inside = arcs.join(here, "node").join(there, "other").filter("_c = _d").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    sizes = state.groupBy("community").agg(F.sum("k").alias("k"), F.sum("inner").alias("i"))
    sums = sizes.agg(F.sum("k").alias("m2"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.sum("i").alias("i"))
    within = (inside.select("w").scalar() + F.col("i")) / F.col("m2")
    return sums.select((within - F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def _moved(arcs: DataFrame, state: DataFrame, m2: float, turn: int, parts: int) -> DataFrame:
    """Every node whose turn it is goes to the community around it that gains most; ``wants`` tells whether any would gain."""
    sizes = state.groupBy("community").agg(F.sum("k").alias("size"), F.count("*").alias("members"))
    there = state.select(F.col("node").alias("other"), "community")
    links = arcs.join(there, "other").groupBy("node", "community").agg(F.sum("weight").alias("w")).join(sizes, "community")
    own = state.join(sizes, "community").select("node", "k", "inner", F.col("community").alias("own"), F.col("size").alias("own_size"), F.col("members").alias("own_members"))
    ways = links.join(own.select("node", "k", "own"), "node")
    gain = F.round(F.col("w") - F.col("k") * (F.col("size") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)) / m2, 9)
    ways = ways.withColumn("gain", gain)
    best = ways.groupBy("node").agg(
        F.min_by(F.struct("community", "gain", "members"), F.struct(-F.col("gain"), F.col("community"))).alias("best"),
        F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("stay"),
    )
    stay = F.coalesce("stay", F.round(-F.col("k") * (F.col("own_size") - F.col("k")) / m2, 9))
    swap = (F.col("own_members") == 1) & (F.col("best.members") == 1) & (F.col("best.community") > F.col("own"))  # two single nodes must not change places
    wants = F.coalesce((F.col("best.community") != F.col("own")) & (F.col("best.gain") > stay + m2 * GAIN) & ~swap, F.lit(False))
    moves = wants & (F.pmod(F.xxhash64("node", F.lit(turn // parts)), F.lit(parts)) == turn % parts)
    return own.join(best, "node", "left").select(
        "node", "k", "inner", F.when(moves, F.col("best.community")).otherwise(F.col("own")).alias("community"), wants.alias("wants")
    )


def modularity_communities(edges: DataFrame, max_rounds: int = 400) -> DataFrame:
    """(node, community) by parallel merging for modularity; a community is named after one of its nodes.

    Nodes move to the neighbouring community of the largest gain, a share of them at a time so
    that they do not all move at once; a round that loses is taken back and the shares are
    made smaller. When no node gains by moving, communities become the nodes of a smaller graph
    and move in their turn, until a level merges nothing. More than ``max_rounds`` rounds raise.
    """
    arcs, nodes = _undirected(edges)
    state = cut_lineage(nodes.withColumn("community", F.col("node")))
    home = state.select("node", "community")
    m2 = state.agg(F.sum("k")).first()[0]
    if not m2:
        return home
    quality, rounds = _quality(arcs, state).first()[0], 0
    while True:
        level, turn, parts, idle = quality, 0, 2, 0
        while idle < parts:
            if (rounds := rounds + 1) > max_rounds:
                raise RuntimeError(f"communities still gain after {max_rounds} rounds")
            fresh = cut_lineage(_moved(arcs, state, m2, turn, parts))
            if fresh.filter("wants").isEmpty():
                break
            turn += 1
            new = _quality(arcs, fresh).first()[0]
            if new > quality + GAIN:
                state, quality, idle = fresh.drop("wants"), new, 0
            elif new < quality - GAIN and parts < PARTS:
                parts, idle = parts * 2, 0
            else:
                idle += 1
        home = cut_lineage(home.withColumnRenamed("community", "_c").join(state.select(F.col("node").alias("_c"), "community"), "_c").select("node", "community"))
        if quality <= level + GAIN:
            return home
        here, there = state.select("node", F.col("community").alias("_c")), state.select(F.col("node").alias("other"), F.col("community").alias("_d"))
        between = cut_lineage(arcs.join(here, "node").join(there, "other").groupBy("_c", "_d").agg(F.sum("weight").alias("weight")))
        loops = between.filter("_c = _d").select(F.col("_c").alias("node"), F.col("weight").alias("loop"))
        sums = state.groupBy("community").agg(F.sum("k").alias("k"), F.sum("inner").alias("inner")).withColumnRenamed("community", "node")
        arcs = between.filter("_c <> _d").select(F.col("_c").alias("node"), F.col("_d").alias("other"), "weight")
        state = cut_lineage(sums.join(loops, "node", "left").select(
            "node", "k", (F.col("inner") + F.coalesce("loop", F.lit(0.0))).alias("inner"), F.col("node").alias("community")))
