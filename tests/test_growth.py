"""Plans whose shuffles, broadcasts and tasks must not outgrow the input."""

import random

from pyspark.sql import functions as F

from ontoweave.catalog import grid as grid_queries
from ontoweave.functions import text as tx
from ontoweave.operators import geo
from ontoweave.operators.ordering import top_per_group
from ontoweave.plans import docgraph, documents, grid, schemes
from ontoweave.session import tasks_for


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlaps_are_scored_where_they_meet(spark):
    rnd = random.Random(7)
    vectors = {f"s{i:02d}": {t: rnd.random() for t in rnd.sample(range(30), rnd.randint(1, 6))} for i in range(40)}
    vectors["s40"] = dict(vectors["s00"])
    rows = [(s, t, w / sum(v.values())) for s, v in vectors.items() for t, w in v.items()]
    df = {t: sum(t in v for v in vectors.values()) for t in range(30)}
    ranked = spark.createDataFrame([(s, df[t], t, w**0.5) for s, t, w in rows], "sig string, df bigint, tid bigint, u double").groupBy("sig").agg(
        F.array_sort(F.collect_list(F.struct("df", "tid", "u"))).alias("_e")
    ).withColumn("m", F.map_from_entries(F.transform("_e", lambda e: F.struct(e["tid"], e["u"]))))
    unit = {}
    for s, t, w in rows:
        unit.setdefault(s, {})[t] = w**0.5
    want = {(a, b) for a in unit for b in unit if sum(u * unit[b].get(t, 0.0) for t, u in unit[a].items()) >= 0.4}
    found = docgraph._overlaps(ranked, 0.4)
    got = [(r["source_sig"], r["target_sig"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "hashpartitioning(source_sig" not in plan_of(found) and "BroadcastExchange" not in plan_of(found)


def _ranked(spark, vectors):
    df = {}
    for v in vectors.values():
        for t in v:
            df[t] = df.get(t, 0) + 1
    rows = [(s, [(df[t], t, u) for t, u in v.items()]) for s, v in vectors.items()]
    return spark.createDataFrame(rows, "sig bigint, _e array<struct<df:bigint,tid:bigint,u:double>>").select("sig", F.array_sort("_e").alias("_e"))


def _alike(rnd, n):
    """Vectors that share their frequent terms: nearly all pairs reach a low threshold. Some are equal but for a rare term."""
    out = {}
    for s in range(n):
        weights = {t: rnd.choice([2.0, 3.0, 4.0]) for t in range(4)} | {t: 1.0 for t in rnd.sample(range(10, 60), 3)} | {1000 + s: 1.0}
        total = sum(weights.values())
        out[s] = {t: (w / total) ** 0.5 for t, w in weights.items()}
    return out


def _dot(a, b):
    return round(sum(u * b.get(t, 0.0) for t, u in a.items()), 9)


def test_overlaps_give_only_the_best_of_many_alike(spark):
    n, targets, block = 90, 3, 20
    vectors = _alike(random.Random(11), n)
    ranked = _ranked(spark, vectors)
    for few in (4, 40, 400):  # in blocks, in both ways, in packs
        got = {}
        rows = docgraph._overlaps(ranked, 0.3, targets, few=few, block=block).collect()
        for r in rows:
            assert (r["source_sig"], r["target_sig"]) not in got and r["overlap_score"] == _dot(vectors[r["source_sig"]], vectors[r["target_sig"]])
            got[r["source_sig"], r["target_sig"]] = r["overlap_score"]
        for s in vectors:
            want = sorted(((_dot(vectors[s], vectors[t]), t) for t in vectors if t != s), reverse=True)[:targets]
            assert sorted(((o, t) for (a, t), o in got.items() if a == s and t != s), reverse=True)[:targets] == want
            assert got[s, s] == _dot(vectors[s], vectors[s])
        # A source is given at most its best from each block of the few terms that bring it there.
        assert len(rows) <= n * (1 + 4 * targets * -(-n // block)) < n * n
        every = docgraph._overlaps(ranked, 0.3, few=few, block=block).collect()
        assert len(every) == sum(_dot(a, b) >= 0.3 for a in vectors.values() for b in vectors.values()) > n * n / 2


def test_titles_in_common_give_only_the_best(spark):
    n, targets = 60, 5
    vectors = _alike(random.Random(5), n)
    keys = {s: ["電网建设意见", "電网建设意见附件一二三", "no other"][s % 3] for s in vectors}
    kinds = spark.createDataFrame([(s, s, k) for s, k in keys.items()], "sig bigint, kind bigint, key string")
    sources, sinks = (kinds.toDF(*(f"{side}_{c}" for c in kinds.columns)) for side in ("source", "target"))
    for few, block in ((4, 7), (500, 4096)):
        rows = docgraph._title_overlaps(_ranked(spark, vectors), sources, sinks, targets, few, block).collect()
        got = {(r["source_kind"], r["target_kind"]): r["overlap_score"] for r in rows}
        assert len(got) == len(rows) <= n * targets * 2 * -(-n // block)
        for s in vectors:
            held = [t for t in vectors if t != s and (keys[s] in keys[t] or keys[t] in keys[s])]
            want = sorted(((_dot(vectors[s], vectors[t]), t) for t in held), reverse=True)[:targets]
            assert sorted(((o, t) for (a, t), o in got.items() if a == s), reverse=True)[:targets] == want


def test_exploded_titles_are_not_broadcast(spark):
    keys = ["", "ab", "abcdefgh", "xxabcdefghyy", "cde", "关于电网建设的意见", "电网"]
    a = spark.createDataFrame([(k,) for k in keys], "source_key string")
    b = spark.createDataFrame([(k,) for k in keys], "target_key string")
    found = docgraph.title_containment(a, b)
    assert {tuple(r) for r in found.collect()} == {(x, y) for x in keys for y in keys if x and y and (x in y or y in x)}
    assert "BroadcastExchange" not in plan_of(found)


def test_pieces_of_titles_travel_as_numbers(spark):
    rnd = random.Random(2)
    keys = ["x" * 3000 + "电网", "x", "xx", "网", "😀a", "?a", "a😀"] + ["".join(rnd.choice("ab电") for _ in range(rnd.randint(1, 14))) for _ in range(120)]
    keys = sorted(set(keys))
    a = spark.createDataFrame([(k,) for k in keys], "source_key string")
    found = docgraph.title_containment(a, a.toDF("target_key"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x in keys for y in keys if x in y or y in x}
    assert dict(a.select(docgraph._pieces(F.col("source_key")).alias("p")).dtypes)["p"] == "array<bigint>"


def test_body_terms_that_cannot_be_best_stay_in_their_row(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 24))) for _ in range(150)] + ["2020年", "一二年", "方案", "ab意见", "电网计划", "关于", "2020", "电网建设方案"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 220))) for _ in range(30)]
    rows = [(i, rnd.choice(words) + " " + rnd.choice(words), rnd.choice(words), "", t) for i, t in enumerate(texts)]
    schema = "document_id bigint, title string, category string, agency string, text string"
    docs = spark.createDataFrame(rows + [(3, "x", "y", "z", texts[0]), (3, "x", "y", "z", texts[1])], schema)
    # Every term of every row, weighed and ranked without leaving any out.
    field = lambda c, w: documents._structured(F.col(c), w)
    whole = docs.select("document_id", F.inline(F.concat(
        field("title", 8.0), field("agency", 3.0), field("category", 2.0), documents._weighted(tx.useful_terms(F.col("text")), 0.5)
    ))).groupBy("document_id", "term").agg(F.sum(F.col("weight").cast("decimal(20,8)")).cast("double").alias("term_weight"))
    order = [F.round(F.col("term_weight") * tx.length_bonus(F.col("term")), 8).desc(), F.length("term").desc(), F.col("term")]
    want = top_per_group(whole, ["document_id"], order, 12)
    got = documents.document_terms(docs, 12)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    left = docs.select(F.size(documents._leading(
        tx.useful_terms(F.col("text")), documents._least_length(tx.useful_terms(F.col("text")), 12), field("title", 8.0), 0.5, 12
    )).alias("n"))
    assert left.agg(F.max("n")).first()[0] <= 12 + 4


def test_useful_terms_are_those_of_the_rule(spark):
    texts = ["关于 电网 a b2 2020 _x __ é1 ЖЖ Ж_a x关于 关于", "", None, "a" * 5000, "日本 ab.cd-ef 12 1a\u3000z9 😀ab 年"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    rule = F.array_distinct(F.filter(tx.word_array(F.col("t")), tx.is_useful_term))
    assert rows.filter(tx.useful_terms(F.col("t")) == rule).count() == len(texts)


def test_terms_of_a_document_are_made_in_one_task(spark):
    docs = spark.createDataFrame(
        [(1, "电网 建设", "x", "y", "theme alpha beta"), (1, "电网", "x", "y", "alpha"), (None, "a b", "x", "y", "beta")],
        "document_id bigint, title string, category string, agency string, text string",
    )
    terms = documents.document_terms(docs)
    assert {r["document_id"] for r in terms.collect()} == {1, None}
    assert terms.groupBy("document_id", "term").count().filter("count > 1").isEmpty()
    assert not [x for x in plan_of(terms).splitlines() if "Exchange hashpartitioning" in x and "term" in x]


def test_chunk_batches_are_bounded_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(i, "word " * 400_000) for i in range(12)], "document_id bigint, text string").coalesce(1)
    assert documents.chunk_documents(docs).count() == 12
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 4 << 20


def _placed(spark):
    rnd = random.Random(3)
    centres = [(i % 25 if i % 13 else None, 100 + rnd.random() * 0.05, 30 + rnd.random() * 0.05) for i in range(60)]
    points = [(i, 100 + rnd.random() * 0.05, 30 + rnd.random() * 0.05, rnd.choice([None, *range(9)])) for i in range(200)]
    return (
        spark.createDataFrame(centres, "request_id bigint, center_lng double, center_lat double"),
        spark.createDataFrame(points, "point_id bigint, lng double, lat double, feeder_id bigint"),
    )


def test_rings_made_one_by_one_hold_the_same_pairs(spark):
    centres, points = _placed(spark)
    for required in (1, 5, 50):
        near = geo.radius_join(centres, points, 2000.0, geo.EARTH_M, "_d")
        want = geo.expand_rings(near, "request_id", "feeder_id", "_d", [200, 500, 2000], F.lit(required))
        got = geo.search_rings(centres, points, "request_id", "feeder_id", [200, 500, 2000], required)
        for a, b in zip(got, want, strict=True):
            assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))


def test_satisfied_centres_meet_no_further_ring(spark, monkeypatch):
    centres, points = _placed(spark)
    asked, join = [], geo.radius_join
    monkeypatch.setattr(geo, "radius_join", lambda c, p, radius, *rest: asked.append(radius) or join(c, p, radius, *rest))
    grid.search_sources(centres.withColumnsRenamed({"center_lng": "lng", "center_lat": "lat"}).withColumn("preferred_point_types", F.lit("")),
                        points.withColumn("feeder_id", F.col("point_id")).withColumn("point_type", F.lit("")), radii=[1000.0, 20000.0])
    assert asked and max(asked) == 1000.0


def test_first_ring_follows_the_density(spark):
    _, points = _placed(spark)
    assert geo._first_radius(points, 5, geo.EARTH_M, 2000.0) < 2000.0
    assert geo._first_radius(points.limit(0), 5, geo.EARTH_M, 2000.0) == 2000.0


def test_new_feeder_counts_pairs_where_they_meet(spark):
    requests = spark.createDataFrame([(1, 100.0, 30.0, 5.0), (2, 100.0, 30.0, 500.0)], "request_id int, lng double, lat double, capacity_kva double")
    sites = spark.createDataFrame([(7, 100.01, 30.0), (8, 100.02, 30.0)], "substation_id int, lng double, lat double")
    units = spark.createDataFrame([(70, 7, 9.0, 0.1, 1), (80, 8, 99.0, 0.1, 1), (81, 8, 99.0, 0.9, 1)],
                                  "transformer_id int, substation_id int, openable_capacity_kva double, load_rate double, spare_intervals int")
    found = grid.new_feeder(requests, sites, units)
    assert {(r["request_id"], r["transformer_id"], r["candidates"]) for r in found.collect()} == {(1, 70, 2), (2, None, 0)}
    # The transformers are joined below the radius join, whose tasks do not follow its bytes.
    plan = plan_of(found)
    assert "REPARTITION_BY_NUM" in plan


def test_plans_are_scored_without_sending_them(spark):
    from ontoweave.session import stored_by

    rnd = random.Random(11)
    points = spark.createDataFrame([(p, p // 2, rnd.uniform(0, 0.01), rnd.uniform(0, 0.01)) for p in range(30)] + [(3, 1, 0.004, 0.004), (40, 99, 0.003, 0.003)],
                                   "point_id long, feeder_id long, lng double, lat double")
    feeders = spark.createDataFrame([(f, f // 2, f // 4, float(f * 700)) for f in range(15)] + [(2, 1, 0, 9900.0)],
                                    "feeder_id long, busbar_id long, substation_id long, openable_capacity_kva double")
    requests = spark.createDataFrame([(r, 0.002 * r, 0.003) for r in range(4)], "request_id long, lng double, lat double")
    near = grid.access_points_in_range(requests, grid.with_feeders(points, feeders), 2000.0)
    carried = stored_by(near.select("request_id", "point_id", "feeder_id", "distance_m", "site", "room"), "request_id", "candidates")
    plain = grid.access_points_in_range(requests, points, 2000.0)
    columns = ["plan_id", "distance_score", "capacity_score", "reliability_score", "total_score"]
    for compose in (grid.compose_single, lambda c: grid.compose_dual(c, feeders, "双回路"), lambda c: grid.compose_dual(c, feeders, "双电源")):
        plans = compose(carried)
        got = grid.score_plans(plans, points, feeders, grid.distance_bounds(plans)).select(*columns)
        want = grid.score_plans(compose(plain), points, feeders).select(*columns)
        assert sorted(map(tuple, got.distinct().collect())) == sorted(map(tuple, want.distinct().collect()))
        assert got.count() > 0 and "Exchange hashpartitioning" not in plan_of(got)


def test_division_joins_nothing(spark):
    from ontoweave.operators.grouping import divide

    need = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", None), (None, 1), ("d", 3)], "g string, i int")
    done = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), ("c", None), (None, 1), ("e", 5)], "g string, i long")
    out = divide(need, done, ["g"], "i")
    assert sorted((r["g"], r["required"]) for r in out.collect()) == [("a", 2), ("b", 2)]
    assert "Join" not in plan_of(out)


def test_spread_bounds_the_share_of_a_task(spark, tmp_path):
    from ontoweave.sources.files import spread

    spark.range(200_000).coalesce(1).write.parquet(str(tmp_path / "rows"))
    scan = spark.read.parquet(str(tmp_path / "rows"))
    plain, bounded = spread(scan).rdd.getNumPartitions(), spread(scan, 16 << 10).rdd.getNumPartitions()
    assert bounded > plain and bounded >= sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) // (16 << 10)


def test_longest_paths_are_not_stored(spark):
    from ontoweave.operators import graph

    edges = spark.createDataFrame([(i, i + 1, "e", 1.0) for i in range(6)], "src long, dst long, label string, score double")
    stored = []
    real, graph.cut_lineage = graph.cut_lineage, lambda df: stored.append(1) or real(df)
    try:
        paths = graph.bounded_paths(edges, spark.createDataFrame([(0,)], "src long"), max_depth=3)
    finally:
        graph.cut_lineage = real
    assert sorted(r["depth"] for r in paths.collect()) == [1, 2, 3] and len(stored) == 3  # the edges and the two shorter lengths


def test_more_pairs_make_more_tasks(spark):
    assert [tasks_for(spark, n) for n in (0, 2_000_000, 2_000_001, 50_000_000)] == [4, 4, 5, 100]
    centres = spark.range(4000).selectExpr("id request_id", "100D center_lng", "30D center_lat")
    points = spark.range(4000).selectExpr("id point_id", "100.001D lng", "30D lat")
    assert geo.radius_join(centres, points, 2000.0, geo.EARTH_M, "_d", True).rdd.getNumPartitions() == 11
    assert geo.radius_join(centres.limit(0), points, 2000.0, geo.EARTH_M, "_d", True).count() == 0


def test_checks_of_pairs_are_judged_where_pairs_are_found(spark, tmp_path):
    spark.range(1, 60).selectExpr("id s_suppkey", "cast(id % 25 as int) s_nationkey", "cast(id * 100 as double) s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1, 900).selectExpr("id c_custkey", "cast(id % 25 as int) c_nationkey", "cast(id * 10 as double) c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 800).selectExpr("id p_partkey", "cast(id % 50 as int) p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(25).selectExpr("cast(id as int) n_nationkey", "cast(id % 5 as int) n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    seen = []
    whole = grid_queries.stored
    try:
        grid_queries.stored = lambda df, name: (seen.append(plan_of(df)), whole(df, name))[1]
        checks = grid_queries._scheme_state(spark, str(tmp_path))[3]
    finally:
        grid_queries.stored = whole
    assert checks.count() > 0
    plan = seen[0].splitlines()
    pairs = next(i for i, x in enumerate(plan) if "_band" in x and "Join" in x)  # the join that makes the pairs, nothing above it moves them
    assert not [x for x in plan[:pairs] if "Exchange" in x or "Join" in x]


def test_dealt_rows_give_the_same_schemes(spark):
    rnd = random.Random(5)
    types = "request_id int, access_point_id int, distance_m double, feeder_id int, substation_id int, busbar_id int, transformer_id int, is_directly_usable boolean, requires_load_transfer boolean"
    some = lambda n: rnd.choice([None, *range(n)])
    checks = spark.createDataFrame([
        (rnd.randrange(6), i, float(rnd.randrange(2000)), some(9), some(4), some(3), some(9), rnd.random() < 0.3, rnd.random() < 0.5) for i in range(300)
    ], types)
    moves = spark.createDataFrame([(rnd.randrange(6), some(9), rnd.random() < 0.6) for _ in range(40)], "request_id int, source int, is_feasible boolean")
    decisions = spark.createDataFrame(
        [(q, "单电源", 1 + q % 3, q % 2 == 0, q % 3 == 0) for q in range(6)],
        "request_id int, required_supply_mode string, minimum_route_count int, required_different_substations boolean, required_different_busbars boolean",
    )
    good = {(r["request_id"], r["source"]) for r in moves.collect() if r["is_feasible"] and r["source"] is not None}
    want = {r["access_point_id"] for r in checks.collect() if r["is_directly_usable"] or (
        r["requires_load_transfer"] and ((r["request_id"], r["feeder_id"]) in good or (r["request_id"], r["transformer_id"]) in good))}
    found = {}
    for tasks in (None, 3):
        usable = schemes.usable_points(checks, moves, tasks)
        assert {r["access_point_id"] for r in usable.collect()} == want
        found[tasks] = sorted(map(str, schemes.rank_schemes(usable, decisions, None, schemes.ScoringRule(), tasks).collect()))
    assert found[None] == found[3] and found[3]
