import itertools
import random
import re

from pyspark.sql import functions as F

from ontoweave.operators.signs import any_sign
from ontoweave.plans import alarms, docgraph, documents, grid, launch, payroll, schemes, toll


def test_documented_payroll_example(spark):
    """The worked example of the payroll rules: gross 10000, social 1060, housing 1200, tax 595.76."""
    lines = spark.createDataFrame([(1, "C", 10000.0)], "employee_id int, payroll_company_id string, gross_pay_before_deduction double")
    paid = spark.createDataFrame([(1, 1060.0, 2450.0, 1200.0, 1200.0)], "employee_id int, personal_total double, employer_total double, housing_personal double, housing_employer double")
    ledger = spark.createDataFrame(
        [(1, None, 47193.65, 200.0, 15000.0, 857.61)],
        "employee_id int, current_income double, cumulative_income double, cumulative_deductions double, cumulative_basic_deduction double, previous_cumulative_tax_withheld double",
    )
    row = payroll.calculate_payroll(lines, paid, ledger, payroll.tax_brackets(spark)).first()
    assert row["cumulative_taxable_income"] == 39733.65
    assert row["personal_income_tax"] == 595.76
    assert row["net_pay"] == 7144.24 and row["company_total_cost"] == 13650.0


def test_tax_boundaries(spark):
    months = spark.createDataFrame([(1, 2024, 1, 41000.0), (2, 2024, 1, 5000.0), (3, 2024, 1, 2000000.0)], "employee_id int, tax_year int, tax_month int, income double")
    got = {r["employee_id"]: r["current_tax"] for r in payroll.cumulative_withholding(months, payroll.tax_brackets(spark)).collect()}
    assert got == {1: 1080.0, 2: 0.0, 3: round(1995000 * 0.45 - 181920, 2)}


def test_toll_rules_block_and_force(spark):
    units = spark.createDataFrame(
        [("A", "S1", 1, "N", 2, "", "5", "5"), ("B", "N", 2, "S2", 1, "C", "7.5", "7"), ("C", "N", 2, "S3", 1, "B", "9", "9")],
        "toll_interval_id string, start_org_id string, start_org_type int, end_org_id string, end_org_type int, opposite_id string, actual_length string, charge_length string",
    )
    stations = spark.createDataFrame([("S1", 2), ("S2", 1), ("S3", 2)], "station_id string, use_status int")
    rules = spark.createDataFrame(
        [("A", 0, "B", 0, 1, 1), ("A", 0, "C", 0, 1, 2), ("A", 0, "C", 0, 2, 3), ("B", 0, "C", 0, 3, 4), ("X", 0, "Y", 0, 1, 5)],
        "en_road_node_id string, en_road_node_type int, ex_road_node_id string, ex_road_node_type int, contiguity_type int, ordinal int",
    )
    got = {(r["en_road_node_id"], r["ex_road_node_id"]): (r["miles"], r["invalid"], r["rule_id"]) for r in toll.build_graph(units, stations, rules).collect()}
    assert got == {
        ("A", "B"): (5, 1, "E4"), ("A", "C"): (0, 0, "E5"), ("B", "C"): (0, 0, "E5"), ("S1", "A"): (0, 0, ""), ("B", "S2"): (0, 0, ""), ("C", "S3"): (9, 0, ""),
    }
    checked = toll.build_graph(units, stations, rules, check_exit_status=True)
    assert checked.filter("ex_road_node_id = 'S2'").isEmpty()


def test_dual_plans_equal_nested_loops(spark):
    """First points in order of distance, all later partners, stop after an outer round that reaches 15 plans."""
    rng = random.Random(4)
    feeders = [(f, f"B{f % 4}", f"S{f % 2}") for f in range(12)]
    points = [(q, f"{q}p{i:02d}", rng.choice([0, 0, 0, 0, rng.randrange(12)]) if q == "hot" else rng.randrange(12), float(rng.randrange(50))) for q in ("hot", "mix", "two") for i in range(2 if q == "two" else 25)]
    df = spark.createDataFrame(points, "request_id string, point_id string, feeder_id int, distance_m double")
    fd = spark.createDataFrame(feeders, "feeder_id int, busbar_id string, substation_id string")
    bus = {f: b for f, b, _ in feeders}
    want = set()
    for q in {p[0] for p in points}:
        mine, n = sorted((d, p, f) for r, p, f, d in points if r == q), 0
        for i, (d1, p1, f1) in enumerate(mine):
            for d2, p2, f2 in mine[i + 1:]:
                if f1 != f2 and bus[f1] != bus[f2]:
                    n += 3
                    want |= {(q, f"{p1},{p2}", m) for m in grid.PLAN_MODES}
            if n >= 15:
                break
    got = {(r["request_id"], r["point_ids"], r["operation_mode"][4:].split("(")[0]) for r in grid.compose_dual(df, fd, "双回路").collect()}
    assert got == want


def test_pruned_schemes_keep_the_best(spark):
    rng = random.Random(9)
    rows = [(q, f"{q}{i:02d}", float(rng.choice([10, 20, 20, 35, 60, 900, 2500])), f"s{rng.randrange(4)}", f"b{rng.randrange(3)}") for q in "abcd" for i in range(14)]
    routes = {"a": (2, True, True), "b": (3, False, True), "c": (1, False, False), "d": (3, False, False)}
    usable = spark.createDataFrame(rows, "request_id string, access_point_id string, distance_m double, substation_id string, busbar_id string")
    dec = spark.createDataFrame([(q, k, s, b, "单电源") for q, (k, s, b) in routes.items()],
                                "request_id string, minimum_route_count int, required_different_substations boolean, required_different_busbars boolean, required_supply_mode string")
    rule = schemes.ScoringRule(max_output=3)
    got = {(r["request_id"], r["rank"]): r["point_ids"] for r in schemes.rank_schemes(usable, dec, None, rule).collect()}
    want = {}
    for q, (k, subs, buses) in routes.items():
        mine = sorted((d, p, s, b) for r, p, d, s, b in rows if r == q)
        site = lambda x: x[2] if subs else (x[2], x[3]) if buses else x[1]
        combos = [c for c in itertools.combinations(mine, k) if len({site(x) for x in c}) == k]
        score = lambda c: round(max(0, 100 - sum(x[0] for x in c) / 20) * 0.35 + 70 * 0.35 + (60 + 75) / 2 * 0.3, 2)
        for rank, c in enumerate(sorted(combos, key=lambda c: -score(c))[:3], 1):
            want[q, rank] = ",".join(x[1] for x in c)
    assert got == want


def test_frontier_with_cycle_and_rerun(spark):
    missions = spark.createDataFrame([("m",), ("n",)], "mission_id string")
    edges = spark.createDataFrame([("开始", "A"), ("A", "B"), ("C", "B"), ("B", "D"), ("D", "C"), ("A", "E")], "from_node string, to_node string")
    runs = spark.createDataFrame([("m", "A", "failed", 1), ("m", "A", "completed", 2)], "mission_id string, node_name string, status string, seq int")
    got = {(r["mission_id"], r["node_name"]) for r in launch.next_executable(missions, edges, runs).collect()}
    assert got == {("m", "E"), ("n", "A")}
    status = launch.node_status(spark.createDataFrame([("m", "A"), ("m", "B")], "mission_id string, node_name string"), runs, ["seq"])
    assert {r["node_name"]: r["status"] for r in status.collect()} == {"A": "completed", "B": "not_started"}


def _parse(spark, text, station=""):
    df = spark.createDataFrame([("c", text, station)], "chain_id string, event_text string, station_name string")
    return alarms.with_flags(alarms.parse_events(df)).orderBy("sequence").collect()


def test_alarm_texts(spark):
    strict = _parse(spark, "3. 2024-01-01 10:00:00.5 至 2024-01-01 10:00:02，站点：复龙站，设备：极控，事件类型：保护，二级摘要：低电压保护动作，事件性质：异常，告警等级：1")
    assert [(r["sequence"], r["start_time"], r["alarm_level"], r["protection"], r["subsystems"]) for r in strict] == [(3, "2024-01-01 10:00:00.5", 1, True, "pole_control")]
    loose = _parse(spark, "2024-01-01 10:00:00 到 2024-01-01 10:01:00 设备：阀冷泵；摘要：阀冷异常；告警等级：2级。2024-01-01 11:00:00 断路器跳闸", "甲站")
    assert [(r["start_time"], r["end_time"], r["station_name"]) for r in loose] == [
        ("2024-01-01 10:00:00", "2024-01-01 10:01:00", "甲站"), ("2024-01-01 11:00:00", "2024-01-01 11:00:00", "甲站")]
    assert loose[0]["device_name"] == "阀冷泵" and loose[0]["valve_cooling_abnormal"] and loose[1]["negative_outcome"]
    raw = _parse(spark, "无时间文本 未发生跳闸")
    assert raw[0]["parse_quality"] == "raw" and not raw[0]["negative_outcome"] and raw[0]["alarm_level"] == 99
    assert _parse(spark, "   ") == []


def test_lock_wording(spark):
    texts = ["闭锁顺序进入", "极闭锁 闭锁顺序", "闭锁", "停运操作", "停运"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(alarms.LOCKED.column(F.col("t")).alias("l"), (~any_sign(F.col("t"), alarms.HARMLESS)).alias("n")).collect()
    assert [r["l"] for r in rows] == [False, True, True, False, False]
    assert [r["n"] for r in rows] == [False, True, True, False, True]


def _chunks(text, size):
    """Plain statement of the chunk rules, quadratic on purpose."""
    out, buf, heading = [], [], ""

    def close():
        body = "\n".join(buf).strip()
        if body:
            parts = [body]
            if len(body) > size * 1.4:
                parts, held = [], []
                for para in re.split(r"\n\s*\n", body):
                    if held and sum(len(x) + 2 for x in held) + len(para) > size:
                        parts.append("\n\n".join(held))
                        held = []
                    held.append(para)
                parts.append("\n\n".join(held))
            out.extend((heading, p) for p in parts)
        buf.clear()

    for line in text.splitlines():
        m = re.match(r"^(#{1,6})\s+(.+?)\s*$", line)
        if m:
            close()
            heading = m.group(2).strip()
        buf.append(line)
        if sum(len(x) + 1 for x in buf) >= size and not line.strip():
            close()
    close()
    return out


def test_markdown_chunks(spark):
    rng = random.Random(2)
    line = lambda: rng.choice(["", "", "# H" + str(rng.randrange(9)), "w" * rng.randrange(1, 400), "text " * rng.randrange(1, 60)])
    texts = ["\n".join(line() for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    got = {}
    for r in documents.chunk_documents(docs, 300).orderBy("document_id", "ordinal").collect():
        got.setdefault(int(r["document_id"]), []).append((r["heading"], r["content"]))
    assert got == {i: c for i, t in enumerate(texts) if (c := _chunks(t, 300))}


def test_metadata_counts_body_less(spark):
    docs = spark.createDataFrame([("d", "2024年3月计划", "成文于2019年5月6日，另见2024年1月2日", 90)], "document_id string, title string, text string, char_count int")
    meta = documents.document_metadata(docs)
    items = {(r["key"], r["value"], r["method"]): round(r["confidence"], 2) for r in meta.collect()}
    assert items["date", "2024-03", "year_month"] == 0.78 and items["date", "2019-05-06", "content_full_date"] == 0.64
    assert ("date", "2024-01-02", "content_full_date") not in items and items["extraction_quality", "low", "char_count"] == 0.8
    assert documents.best_year(meta).first()["year"] == "2024"
    assert documents.asked_years("2020到2023年") == ["2020", "2021", "2022", "2023"] and documents.asked_years("2021年") == ["2021"]


def test_query_profile_orders_by_score(spark):
    stats = spark.createDataFrame([("数字经济发展", 1, 3.0), ("计划", 9, 1.1)], "term string, doc_freq int, idf double")
    profile = documents.query_profile("", stats, 10, ["计划", "数字经济发展", "新词语"])
    assert [p[0] for p in profile] == ["数字经济发展", "新词语", "计划"] and profile[2][1] == "short"


def test_copies_relate_through_few_representatives(spark):
    """A group of equal documents stays linear and still lists its best targets."""
    rows = [(i, t, s) for i in range(30) for t, s in [("alpha beta long", 9.0), ("gamma ray burst", 5.0)]]
    rows += [(100, "alpha beta long", 9.0), (100, "delta wing shape", 5.0), (200, "lonely topic text", 3.0)]
    got = docgraph.soft_term_relations(spark.createDataFrame(rows, "document_id int, term string, score double")).collect()
    by = {}
    for r in got:
        by.setdefault(r["source_document_id"], []).append(r["target_document_id"])
    assert sorted(by[0]) == [26, 27, 28, 29] and sorted(by[29]) == [25, 26, 27, 28] and sorted(by[100]) == [26, 27, 28, 29] and 200 not in by


def test_sections_keep_every_character_and_the_size():
    rng = random.Random(8)
    line = lambda: rng.choice(["", "", "## S" + str(rng.randrange(9)), "w" * rng.randrange(1, 500), "text " * rng.randrange(1, 60)])
    for _ in range(60):
        text = "\n".join(line() for _ in range(rng.randrange(1, 50)))
        pieces = documents.split_sections(text, 300)
        assert all(0 < len(body) <= 300 for _, body, _ in pieces)
        squeeze = lambda t: re.sub(r"\s+", "", t)
        assert squeeze("".join(body for _, body, _ in pieces)) == squeeze(text)
        headings = [m.group(2).strip() for x in text.splitlines() if (m := re.match(r"^(#{1,6})\s+(.+?)\s*$", x))]
        assert {h for h, _, _ in pieces if h} == set(headings)


def test_tap_change_and_anchors(spark):
    from ontoweave.functions import text as tx

    df = spark.createDataFrame([("分接开关 由 3 档 降至 2 档",), ("5档调至7档",), ("无",)], "t string")
    assert [r[0] for r in df.select(alarms.tap_change(F.col("t"))).collect()] == ["分接头由3档降至2档", "档位由5档调至7档", ""]
    assert tx.anchor_terms("查询 2024 交通局 市委 批示 数字经济") == ["批示", "交通局", "市委", "数字经济"]
    m = spark.createDataFrame([({"a": "", "b": "x"},)], "m map<string,string>")
    assert m.select(tx.compact_map(F.col("m"))).first()[0] == {"b": "x"}


def test_members_of_large_groups_are_kept(spark):
    docs = spark.createDataFrame([(i, "关于做好安全生产工作的通知", ["国办发〔2020〕7"]) for i in range(12)], "document_id long, title string, own_numbers array<string>")
    quotes = spark.createDataFrame([(i, "安全生产管理条例") for i in range(12)], "document_id long, quote string")
    members = docgraph.relation_members(docs, quotes)
    rows = members.collect()
    assert {(r["kind"], r["document_id"]) for r in rows} == {(k, i) for k in ("quote", "series", "number") for i in range(12)}
    assert {(r["representative"], r["size"]) for r in rows} == {(0, 12)} and len(rows) == 36
    pairs = docgraph.focus_pairs(members, spark.createDataFrame([(3,)], "document_id long"))
    assert pairs.count() == 33 and {r["target_document_id"] for r in pairs.collect()} == set(range(12)) - {3}
