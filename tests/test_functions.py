import random
import re

from pyspark.sql import functions as F

from ontoweave.functions import text as tx
from ontoweave.functions.numeric import as_number, clamp_open, first_truthy, half_up_hundreds, lenient_int, round_exact, with_rounded


def test_round_exact_equals_python(spark):
    rng = random.Random(7)
    values = [2.675, 1.005, 0.5, 1.5, 2.5, -2.675, 0.125, 62.25, 1e15 + 0.5, 0.0, 12345678.905]
    values += [rng.randrange(0, 10**7) / 1000 for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(1000)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    rows = df.select("x", *[round_exact(F.col("x"), d).alias(f"r{d}") for d in (0, 1, 2, 3)]).collect()
    for row in rows:
        for d in (0, 1, 2, 3):
            assert row[f"r{d}"] == round(row["x"], d), (row["x"], d)


def test_rounding_steps_build_on_each_other(spark):
    df = spark.createDataFrame([(10000.0, 0.08), (3333.33, 0.105)], "base double, rate double")
    out = with_rounded(df, 2, part=F.col("base") * F.col("rate"))
    assert [r["part"] for r in out.orderBy("base").collect()] == [round(3333.33 * 0.105, 2), 800.0]


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("12",), (" -7 ",), ("12.5",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(lenient_int(F.col("t"))).collect()] == [12, -7, 0, 0, 0, 0]
    assert [r[0] for r in spark.createDataFrame([(12.9,), (None,)], "v double").select(lenient_int(F.col("v"), False)).collect()] == [12, 0]
    num = spark.createDataFrame([("",), (None,), ("3.5",)], "t string").select(as_number(F.col("t"))).collect()
    assert [r[0] for r in num] == [0.0, 0.0, 3.5]


def test_bounds_and_fallbacks(spark):
    df = spark.createDataFrame([(100.0, 200.0, 500.0), (900.0, 200.0, 500.0), (900.0, 0.0, 0.0), (50.0, 0.0, 40.0)], "v double, lo double, hi double")
    assert [r[0] for r in df.select(clamp_open(F.col("v"), F.col("lo"), F.col("hi"))).collect()] == [200.0, 500.0, 900.0, 40.0]
    t = spark.createDataFrame([(0.0, None, 7.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in t.select(first_truthy(F.col("a"), F.col("b"), F.col("c"))).collect()] == [7.0, 0.0]
    h = spark.createDataFrame([(149,), (150,), (250,)], "x int").select(half_up_hundreds(F.col("x"))).collect()
    assert [r[0] for r in h] == [100, 200, 300]


def test_tokens_and_kinds(spark):
    assert tx.query_tokens("Hello, wörld hello 7 x 42 世界") == ["Hello", "wörld", "hello", "7", "42", "世界"]
    df = spark.createDataFrame([("工作计划",), ("ab",), ("2024年",), ("abc-1",), ("关于数字经济发展规划纲要",), ("发展",)], "t string")
    kinds = [r[0] for r in df.select(tx.classify_term(F.col("t"))).collect()]
    assert kinds == ["form", "numeric_or_code", "form", "numeric_or_code", "quoted_theme", "short"]


def test_title_keys_quotes_and_numbers(spark):
    df = spark.createDataFrame([("关于 数字城市（试点）建设2023年度的通知", "见《城市更新办法（征求意见稿）》和“ab”，依据国办发〔2020〕12号、省政办函[2021]7号")], "title string, body string")
    row = df.select(
        tx.title_key(F.col("title")).alias("k"), tx.quoted_terms(F.col("body")).alias("q"), tx.doc_numbers(F.col("body")).alias("n")
    ).first()
    assert row["k"] == "数字城市试点建设"
    assert row["q"] == ["城市更新办法", "ab"]
    assert row["n"] == ["国办发〔2020〕12", "省政办函〔2021〕7"]


def _dates(text):
    """Plain statement of the date rules."""
    found = {}
    for pattern, conf, method, kind in tx.DATE_SHAPES:
        for m in re.finditer(pattern, text):
            parts = [int(g) for g in m.groups()]
            if method == "full_date":
                if not (1 <= parts[1] <= 12 and 1 <= parts[2] <= 31):
                    continue
                value = f"{parts[0]}-{parts[1]:02d}-{parts[2]:02d}"
            elif method == "year_month":
                if not 1 <= parts[1] <= 12:
                    continue
                value = f"{parts[0]}-{parts[1]:02d}"
            else:
                value = str(parts[0])
            found.setdefault((kind, value, method), conf)
    return found


def test_date_candidates(spark):
    texts = ["2024年3月5日印发，2024-12-31 前完成，见〔2019〕文，2023年13月", "2021/7/9 and 2021.11 x2022-5-40", "none", "2020 年度"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, row in zip(texts, df.select("t", tx.date_candidates(F.col("t")).alias("c")).collect()):
        got = {}
        for c in row["c"]:
            got.setdefault((c["kind"], c["value"], c["method"]), c["confidence"])
        assert got == _dates(text)


def test_snippet_and_occurrences(spark):
    df = spark.createDataFrame([("x" * 100 + " needle " + "y" * 300,), ("short needle needle",)], "t string")
    rows = df.select(tx.snippet(F.col("t"), "needle", ["needle"]).alias("s"), tx.occurrences(F.col("t"), "NEEDLE").alias("n")).collect()
    assert rows[0]["s"].startswith("...") and rows[0]["s"].endswith("...") and "needle" in rows[0]["s"]
    assert rows[1]["s"] == "short needle needle" and rows[1]["n"] == 2
