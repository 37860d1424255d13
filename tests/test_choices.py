import random

import pytest
from pyspark.sql import functions as F

from ontoweave.functions.text import doc_numbers
from ontoweave.operators.geo import EARTH_M, nearest_groups
from ontoweave.plans import docgraph, grid, payroll, sections

KEYS = ["employee_id", "tax_year", "tax_month"]
KEY_DDL = "employee_id int, tax_year int, tax_month int"


# --- nearest groups ---------------------------------------------------------------------------


def _brute(spark, centres, points, k):
    from ontoweave.functions.numeric import haversine, with_rounded
    from ontoweave.operators.ordering import top_per_group

    met = centres.crossJoin(points.select("feeder_id", "point_id", "lng", "lat"))
    far = with_rounded(met, 1, distance_m=haversine(F.col("center_lng"), F.col("center_lat"), F.col("lng"), F.col("lat"), EARTH_M))
    near = far.groupBy("request_id", "feeder_id").agg(F.min(F.struct("distance_m", "point_id")).alias("b")).select("request_id", "feeder_id", "b.*")
    return {tuple(r) for r in top_per_group(near, ["request_id"], [F.col("distance_m"), F.col("point_id")], k).select("request_id", "feeder_id", "point_id", "distance_m").collect()}


def _placed(spark, seed):
    rng = random.Random(seed)
    dense = [(rng.gauss(110, 0.02), rng.gauss(30, 0.02)) for _ in range(60)]
    wide = [(rng.uniform(-180, 180), rng.uniform(-89, 89)) for _ in range(40)]
    points = spark.createDataFrame([(i, rng.randrange(25), *p) for i, p in enumerate(dense + wide + dense[:5])], "point_id int, feeder_id int, lng double, lat double")
    spots = [(110.0, 30.0), (110.3, 30.1), (-179.99, 10.0), (179.99, -10.0), (0.0, 89.9), (0.0, -89.9), (10.0, 50.0)]
    return spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "request_id int, center_lng double, center_lat double"), points


@pytest.mark.parametrize("first_radius, growth", [(2000.0, 16.0), (3e5, 8.0)])
def test_nearest_groups_at_any_distance(spark, first_radius, growth):
    centres, points = _placed(spark, 1)
    got = nearest_groups(centres, points, "request_id", "feeder_id", "point_id", 5, first_radius=first_radius, growth=growth)
    assert {tuple(r) for r in got.collect()} == _brute(spark, centres, points, 5) and got.count() == 35


def test_nearest_groups_odd_rows(spark):
    centres, points = _placed(spark, 3)
    few = points.filter("feeder_id < 2")
    assert {tuple(r) for r in nearest_groups(centres, few, "request_id", "feeder_id", "point_id", 5, growth=64.0).collect()} == _brute(spark, centres, few, 5)
    assert nearest_groups(centres, points.limit(0), "request_id", "feeder_id", "point_id", 5, growth=64.0).count() == 0
    assert nearest_groups(centres.limit(0), points, "request_id", "feeder_id", "point_id", 5).count() == 0
    nowhere = spark.createDataFrame([(9, None, 1.0)], "request_id int, center_lng double, center_lat double")
    assert nearest_groups(nowhere, points, "request_id", "feeder_id", "point_id", 5, growth=64.0).count() == 0


def test_no_request_has_fewer_plans_than_within_a_radius(spark):
    centres, points = _placed(spark, 4)
    requests = centres.withColumnsRenamed({"center_lng": "lng", "center_lat": "lat"})
    within = grid.compose_single(grid.access_points_in_range(requests, points, 2000.0)).groupBy("request_id").count()
    anywhere = grid.compose_single_anywhere(requests, points).groupBy("request_id").count().withColumnRenamed("count", "n")
    assert anywhere.count() == 7 and anywhere.join(within, "request_id", "left").filter("count > n").count() == 0


# --- prior ledger -----------------------------------------------------------------------------


def _history(spark):
    rng = random.Random(5)
    incomes = [(e, 2024, m, round(rng.uniform(3000, 60000), 2)) for e in range(6) for m in range(1, 13)]
    return spark.createDataFrame(incomes, f"{KEY_DDL}, income double").withColumn("income", F.col("income").cast("decimal(18,2)"))


def test_prior_ledgers_give_back_the_withholding_ledger(spark):
    months = _history(spark)
    brackets = payroll.tax_brackets(spark)
    ledger = payroll.cumulative_withholding(months, brackets)
    full = ledger.join(months, KEYS).select(*KEYS, F.col("income").cast("double").alias("current_income"), "cumulative_income", F.lit(0.0).alias("cumulative_deductions"))
    nothing = spark.createDataFrame([], f"{KEY_DDL}, deduction_type string, personal_amount double")
    prior = payroll.prior_ledger(full, nothing, KEYS)
    rolled = payroll.roll_forward(prior, months, KEYS)
    again = payroll.cumulative_withholding(rolled.select(*KEYS, F.col("current_income").cast("decimal(18,2)").alias("income")), brackets)
    assert sorted(again.collect()) == sorted(ledger.collect())
    assert {tuple(r) for r in rolled.select(*KEYS, "cumulative_income").collect()} == {tuple(r) for r in ledger.select(*KEYS, "cumulative_income").collect()}


def test_prior_ledger_clips_and_takes_only_social_and_housing(spark):
    ledger = spark.createDataFrame([(1, 2024, 3, "1000.5", 900.0, 100.0), (2, 2024, 3, None, 900.0, 300.0), (3, 2024, 3, "x", None, None)],
                                   f"{KEY_DDL}, current_income string, cumulative_income double, cumulative_deductions double")
    lines = spark.createDataFrame([(1, 2024, 3, "社保", 80.0), (1, 2024, 3, "公积金", 30.0), (2, 2024, 3, "社保", 80.1), (2, 2024, 3, "补充", 50.0), (2, 2024, 2, "社保", 9.0)],
                                  f"{KEY_DDL}, deduction_type string, personal_amount double")
    got = {r["employee_id"]: (r["cumulative_income"], r["cumulative_deductions"], r["current_tax"]) for r in payroll.prior_ledger(ledger, lines, KEYS).collect()}
    assert got == {1: (0.0, 0.0, None), 2: (900.0, 219.9, None), 3: (0.0, 0.0, None)}
    assert payroll.prior_ledger(ledger.limit(0), lines, KEYS).count() == 0


# --- numbers in the original text ---------------------------------------------------------------


def test_number_context_finds_other_spellings(spark):
    lead, tail = "前" * 200, "后" * 200
    rows = [
        (f"{lead}国办发〔2020〕12号{tail}", "国办发〔2020〕12", "国办发〔2020〕12"), (f"{lead}国办发［2020］ 12号{tail}", "国办发〔2020〕12", "国办发［2020］ 12"),
        (f"{lead}国 办\n发(2020)　12号{tail}", "国办发〔2020〕12", "国 办\n发(2020)　12"), (f"{lead}{tail}", "国办发〔2020〕12", ""),
        (lead, None, ""), (None, "国办发〔2020〕12", ""), ("a.b[1]", "a*b", ""), (f"{lead}a*b\\E", "a*b\\E", "a*b\\E"), (lead, " ", ""),
    ]
    got = spark.createDataFrame(rows, "text string, number string, found string").select("text", "found", docgraph.number_context(F.col("text"), F.col("number")).alias("c")).collect()
    for r in got:
        text, place = r["text"] or "", r["c"]["position"]
        assert r["c"]["found"] == r["found"]
        if place:
            assert text[place - 1 : place - 1 + len(r["found"])] == r["found"]
            assert r["c"]["context"] == text[max(place - 1 - 180, 0) : place - 1 + len(r["found"]) + 180]
        else:
            assert r["c"]["context"] == text[:180]
    assert [bool(r["c"]["position"]) for r in got] == [True, True, True, False, False, False, False, True, False]


def test_numbers_taken_from_a_text_are_found_in_it(spark):
    df = spark.createDataFrame([("国办发〔2021〕 7号。京政发[2019]33号",)], "text string").withColumn("n", F.explode(doc_numbers(F.col("text"))))
    places = [r[0]["position"] for r in df.select(docgraph.number_context(F.col("text"), F.col("n"))).collect()]
    assert places and all(places)


# --- evidence sections ----------------------------------------------------------------------------


def _plain_bundle(picks, budget):
    used, out = 0, []
    for pick, section, path, title, content in picks:
        header = f"section_id: {section}\ndocument: {path}\ntitle: {title}\n"
        left = budget - used - len(header)
        if left <= 0:
            break
        used += len(header) + len(content[:left])
        out.append((pick, section, header, content[:left], used))
    return out


def test_sections_are_chosen_like_a_plain_loop(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)]
    secs = [(f"s{i:02d}", rng.randrange(6), f"p{i}", rng.choice(vocabulary), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 9))), rng.randrange(8)) for i in range(40)]
    asks = {r: rng.sample(vocabulary, 3) for r in range(8)} | {98: ["none"], 99: ["none"]}
    sec = spark.createDataFrame(secs, "section_id string, document_id int, path string, title string, content string, n_keywords int")
    hits = sec.select("section_id", F.col("title").alias("term"), F.lit(True).alias("in_title")).unionByName(
        sec.select("section_id", F.explode(F.split("content", " ")).alias("term"), F.lit(False).alias("in_title")))
    terms = spark.createDataFrame([(r, t) for r, ts in asks.items() for t in ts + ts[:1]] + [(0, None)], "request_id int, term string")
    sources = spark.createDataFrame([(r, "s07" if r == 98 else None) for r in asks], "request_id int, source_section_id string")
    for per_document, budget in [(None, 90), (1, 150), (2, 40), (2, 10)]:
        picks = sections.choose_sections(sections.section_scores(terms, sec, hits), sources, per_document=per_document)
        got = {}
        for r in sections.evidence_bundles(picks, sec, budget).orderBy("request_id", "pick").collect():
            got.setdefault(r["request_id"], []).append(tuple(r)[1:])
        want = {}
        for r, ts in asks.items():
            scored = []
            for s in secs:
                score = sum(4 if t == s[3] else 1 for t in ts if t == s[3] or t in s[4].split(" "))
                if score:
                    scored.append((-(score + min(5, s[5])), s))
            chosen, counts = [], {}
            for _, s in sorted(scored, key=lambda x: (x[0], x[1][0])):
                if len(chosen) < 4 and (per_document is None or counts.get(s[1], 0) < per_document):
                    counts[s[1]] = counts.get(s[1], 0) + 1
                    chosen.append(s)
            if not scored and r == 98:
                chosen = [s for s in secs if s[0] == "s07"]
            bundle = _plain_bundle([(i + 1, s[0], s[2], s[3], s[4]) for i, s in enumerate(chosen)], budget)
            if bundle:
                want[r] = bundle
        assert got == want
