import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from ontoweave.operators import filters, geo, graph, grouping, guards, links, ordering, reconcile, rules, sequences, temporal
from ontoweave.operators.links import Link
from ontoweave.operators.rules import Condition, Rule


def test_filter_grammar(spark):
    df = spark.createDataFrame([(1, "a%b", 5.0), (2, None, 7.0), (3, "", None), (4, "axb", 5.0)], "id int, t string, v double")
    ids = lambda f: sorted(r["id"] for r in filters.apply_filters(df, f).collect())
    assert ids({"t__like": "%"}) == [1]
    assert ids({"t__like": "on"}) == [2]
    assert ids({"t": None}) == [2]
    assert ids({"t__ne": "axb"}) == [1, 2, 3]
    assert ids({"t__ne": None}) == [1, 3, 4]
    assert ids({"v__gte": 5, "v__lt": 7}) == [1, 4]
    assert ids(None) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in filters.apply_filters(df, {"zzz": 1, "id": 3}, allowed=["id"]).collect()) == [3]
    with pytest.raises(ValueError):
        filters.apply_filters(df, {"v__near": 3})


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    plan = filters.apply_filters(df, {"c_acctbal__gte": 10}).select("c_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_acctbal,10" in plan and "c_name" not in plan.split("ReadSchema")[1]


def test_order_and_window(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, None)], "id int, v int")
    got = [r["id"] for r in ordering.apply_window(ordering.apply_order(df, "-v", ["id"]), 2, 1).collect()]
    assert got == [1, 3]
    assert ordering.apply_window(df, 0, 0).count() == 4 and ordering.apply_window(df, 5, 9).count() == 0
    assert ordering.safe_order_by(df, "v; drop", "id") == "id" and ordering.safe_order_by(df, "-v", "id") == "-v"


def test_first_and_last_win(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in grouping.first_wins(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", None)}
    assert {(r["k"], r["v"]) for r in grouping.last_wins(df, ["k"], ["o"]).collect()} == {("a", "x"), ("b", None)}


def test_sequences_across_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), i, rng.randrange(100)) for i in rng.sample(range(5000), 600)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    total = sequences.running_total(df, ["k"], "o", F.col("v"), "s", F.floor(F.col("o") / 64)).collect()
    before = sequences.previous_value(df, ["k"], ["o"], "v", "p", F.floor(F.col("o") / 64)).collect()
    for key in "ab":
        mine = sorted((o, v) for k, o, v in rows if k == key)
        sums, run = {}, 0
        for o, v in mine:
            run += v
            sums[o] = run
        prev = {o: (mine[i - 1][1] if i else None) for i, (o, _) in enumerate(mine)}
        assert {r["o"]: r["s"] for r in total if r["k"] == key} == sums
        assert {r["o"]: r["p"] for r in before if r["k"] == key} == prev


@pytest.mark.parametrize("rows", [7, 400])
def test_brackets_small_and_large(spark, rows):
    table = [(float(i * 10), None if i == rows - 1 else float(i * 10 + 10), i) for i in range(rows)]
    b = spark.createDataFrame(table, "lo double, hi double, rate int")
    values = [0.0, 10.0, 10.5, 35.0, 3990.0, 99999.0, -5.0]
    got = temporal.bracket_lookup(spark.createDataFrame([(v,) for v in values], "x double"), "x", b, "lo", "hi", ["rate"]).collect()

    def plain(x):
        return next((r for lo, hi, r in table if x >= lo and (hi is None or x <= hi)), table[-1][2])

    assert {r["x"]: r["rate"] for r in got} == {v: plain(v) for v in values}


def test_effective_dates(spark):
    df = spark.createDataFrame([("e1", "2020-01-01", "", 1), ("e1", "2022-01-01", "", 2), ("e1", "2030-01-01", "", 3), ("e2", "", "2021-01-01", 4), ("e3", "", "", 5)],
                               "e string, effective_date string, expiry_date string, v int")
    got = {r["e"]: r["v"] for r in temporal.select_effective(df, ["e"], "2024-06-01").collect()}
    assert got == {"e1": 2, "e3": 5}


def _haversine(a, b, c, d):
    x = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


@pytest.mark.parametrize("radius", [30.0, 900.0])
def test_radius_join_equals_all_pairs(spark, radius):
    rng = random.Random(11)
    spot = lambda: (rng.choice([rng.uniform(-180, 180), 179.9, -179.95]), rng.choice([rng.uniform(-90, 90), 89.8, -89.9, 60.0]))
    centres = [(i, *spot()) for i in range(60)]
    points = [(i, *spot()) for i in range(300)] + [(1000 + i, c[1] + rng.uniform(-0.2, 0.2), max(-90.0, min(90.0, c[2] + rng.uniform(-0.2, 0.2)))) for i, c in enumerate(centres)]
    points = [(i, (x + 180) % 360 - 180, y) for i, x, y in points]
    got = geo.radius_join(
        spark.createDataFrame(centres, "c int, center_lng double, center_lat double"), spark.createDataFrame(points, "p int, lng double, lat double"), radius, 6371.0
    ).select("c", "p").collect()
    want = {(c, p) for c, a, b in centres for p, x, y in points if _haversine(a, b, x, y) <= radius}
    assert sorted(map(tuple, got)) == sorted(want)


def test_ring_expansion(spark):
    rows = [("q", "f1", 100.0), ("q", "f2", 450.0), ("q", "f2", 150.0), ("q", "f3", 700.0), ("r", "f1", 900.0), ("r", "f9", 5000.0)]
    df = spark.createDataFrame(rows, "q string, f string, d double")
    inside, summary = geo.expand_rings(df, "q", "f", "d", [200, 500, 1000], F.lit(3))
    assert {r["q"]: (r["stopped_radius"], r["distinct_groups"], r["satisfied"]) for r in summary.collect()} == {"q": (1000.0, 3, True), "r": (1000.0, 1, False)}
    assert inside.count() == 5


def test_rule_strategies(spark):
    df = spark.createDataFrame([(1, 10.0, ["a", "b"]), (2, None, ["a", "a"]), (3, 99.0, None)], "id int, v double, tags array<string>")
    first = Rule("r", "c", [Condition("v", "lte", 10, "low"), Condition("v", "between", [5, 50], "mid")], default="none")
    both = Rule("a", "ok", [Condition("v", "gt", 5, reason="small"), rules.parse_condition({"field": "tags", "operator": "distinct_count_gte", "value": 2, "fail_reason": "tags"})], strategy="all")
    none = Rule("n", "free", [Condition("tags", "none_eq", "b", "yes")], default="no")
    top = Rule("m", "need", [Condition("v", "gt", 1, "one"), Condition("v", "gt", 50, "two")], strategy="max_requirement", requirement_order=["zero", "one", "two"], default="zero")
    rows = {r["id"]: r for r in rules.apply_rules(df, first, both, none, top).collect()}
    assert [rows[i]["c"] for i in (1, 2, 3)] == ["low", "none", "none"]
    assert [(rows[i]["ok"], rows[i]["ok_reasons"]) for i in (1, 2, 3)] == [(True, ""), (False, "small;tags"), (False, "tags")]
    assert [rows[i]["free"] for i in (1, 2, 3)] == ["no", "yes", "yes"]
    assert [rows[i]["need"] for i in (1, 2, 3)] == ["one", "zero", "two"]


def test_guards(spark):
    with pytest.raises(ValueError):
        guards.check_mutability("X", "append_only", "update")
    guards.check_mutability("X", "append_only", "insert")
    with pytest.raises(ValueError):
        guards.deadline_column("whenever")
    df = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "c"), (None, "b")], "o string, n string")
    got = [r[0] for r in df.select(guards.transition_allowed(F.col("o"), F.col("n"), {"a": ["b"], "c": []})).collect()]
    assert got == [True, False, True, False]


def test_list_and_composite_links(spark):
    left = spark.createDataFrame([(1, ["x", "y", "x"]), (2, []), (3, None)], "id int, keys array<string>")
    right = spark.createDataFrame([("x", 10), ("z", 11)], "k string, v int")
    assert [(r["id"], r["target_v"]) for r in links.query_link(left, right, Link("l", "L", "R", "keys", "k")).collect()] == [(1, 10)]
    with pytest.raises(ValueError):
        _ = Link("bad", "A", "B", "a,b", "c").key_pairs


def test_reconcile_and_upsert(spark):
    a = spark.createDataFrame([(1, 1.004, "x"), (2, 2.0, "y"), (3, 3.0, None)], "k int, v double, t string")
    b = spark.createDataFrame([(1, 1.0, "x"), (2, 2.5, "y"), (4, 4.0, "n")], "k int, v double, t string")
    got = {r["k"]: (r["status"], r["changed_fields"]) for r in reconcile.diff(a, b, ["k"], ["v", "t"]).collect()}
    assert got == {2: ("changed", "v"), 3: ("missing_expected", ""), 4: ("missing_generated", "")}
    assert sorted(r["k"] for r in reconcile.upsert(a, b, ["k"]).collect()) == [1, 2, 3, 4]


def _edges(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randrange(0, 9)) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_paths_equal_dijkstra(spark, seed):
    edges = _edges(seed, 40, 90)
    cost, heap, out = {0: 0}, [(0, 0)], {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    while heap:
        d, u = heapq.heappop(heap)
        if d > cost[u]:
            continue
        for v, w in out.get(u, []):
            if d + w < cost.get(v, 1 << 30):
                cost[v] = d + w
                heapq.heappush(heap, (d + w, v))
    df = spark.createDataFrame(edges, "src int, dst int, weight int")
    got = graph.shortest_paths(df, spark.createDataFrame([(0,)], "src int")).collect()
    assert {r["dst"]: r["cost"] for r in got} == cost
    best = {}
    for a, b, w in edges:
        best[a, b] = min(w, best.get((a, b), 1 << 30))
    for r in got:
        assert sum(best[x, y] for x, y in zip(r["path"], r["path"][1:])) == r["cost"]


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components_equal_union_find(spark, kind):
    edges = {"random": [e[:2] for e in _edges(5, 120, 80)], "chain": [(i, i + 1) for i in range(60)] + [(100, 101)], "star": [(7, i) for i in range(50)] + [(90, 91)]}[kind]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = graph.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in list(parent)}


def test_pagerank_sums_to_one(spark):
    edges = [(0, 1, 1.0), (1, 2, 2.0), (2, 0, 1.0), (2, 3, 3.0), (4, 3, 1.0)]
    got = graph.pagerank(spark.createDataFrame(edges, "src int, dst int, weight double"), iterations=40).collect()
    ranks = {r["node"]: r["rank"] for r in got}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[3] == max(ranks.values())
