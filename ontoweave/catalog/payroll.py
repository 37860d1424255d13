"""Payroll queries: employees at customers, rules at nations, adjustments and income history at orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ontoweave.catalog.base import View, ctes, query, sql_round, table
from ontoweave.operators import reconcile
from ontoweave.plans import payroll

PERIOD = "2024-03"
EMPLOYEES = View("customer", {
    "employee_id": "c_custkey", "person_id": "case when c_nationkey = 9 then -1 else c_custkey end", "status": "c_mktsegment",
    "position": "case when c_nationkey < 6 then '经理' when c_nationkey < 20 then '员工' else '顾问' end",
})
PERSONS = View("customer", {"person_id": "c_custkey", "name": "c_name"})
RELATIONSHIPS = View("orders", {
    "employment_relationship_id": "o_orderkey", "employee_id": "o_custkey", "company_id": "cast(o_orderkey % 25 as int)",
    "effective_date": "case when o_orderpriority = '5-LOW' then '' else cast(cast(o_orderdate as date) as string) end",
    "expiry_date": "case when o_orderstatus = 'F' then concat(cast(cast(year(o_orderdate) as int) + 1 as string), '-12-31') else '' end",
})
PROFILES = View("orders", {
    "salary_profile_id": "o_orderkey", "employee_id": "o_custkey", "monthly_salary_base": "o_totalprice",
    "position_or_type": "case when o_orderpriority = '2-HIGH' then '' else o_orderpriority end",
    "effective_date": "cast(cast(o_orderdate as date) as string)", "expiry_date": "''",
})
COMPANIES = View("nation", {"company_id": "n_nationkey", "company_name": "n_name"})
SNAPSHOTS = View("customer", {
    "employee_id": "c_custkey", "payroll_company_id": "c_nationkey",
    "position_snapshot": "case when c_nationkey < 6 then '经理' when c_nationkey < 20 then '员工' else '顾问' end",
    "monthly_salary_total": "abs(c_acctbal) * 4e0 + 3000", "monthly_salary_base": "case when c_mktsegment = 'BUILDING' then 0e0 else abs(c_acctbal) * 3e0 end",
    "social_security_base": "case when c_mktsegment = 'MACHINERY' then abs(c_acctbal) else 0e0 end",
    "housing_fund_base": "case when c_mktsegment = 'FURNITURE' then abs(c_acctbal) + 5e-1 else 0e0 end",
})
SPLITS = View("nation", {
    "split_rule_id": "n_nationkey", "effective_period": "case when n_regionkey = 0 then '' when n_regionkey < 4 then '2024-01' else '2025-01' end",
    "position_or_type": "case when n_nationkey % 3 = 0 then '经理' when n_nationkey % 3 = 1 then '员工' else '其他' end",
    "basic_salary_rate": "cast(50 + n_nationkey as double) / 100", "performance_base_rate": "cast(50 - n_nationkey as double) / 100",
})
GRADES = View("nation", {
    "grade_rule_id": "n_nationkey", "effective_period": "case when n_regionkey = 4 then '2024-09' else '2023-01' end",
    "performance_grade": "case when n_nationkey % 4 = 0 then 'A' when n_nationkey % 4 = 1 then 'B' when n_nationkey % 4 = 2 then 'C' else 'D' end",
    "coefficient": "cast(70 + n_nationkey * 3 as double) / 100",
})
PERFORMANCE = View("orders", {
    "performance_record_id": "o_orderkey", "employee_id": "o_custkey",
    "performance_period": "case when o_orderstatus = 'P' then '2024-03' else '2024-02' end",
    "performance_grade": "case when o_orderpriority = '1-URGENT' then 'A' when o_orderpriority = '2-HIGH' then 'B' when o_orderpriority = '3-MEDIUM' then 'C' when o_orderpriority = '5-LOW' then '' else 'Z' end",
})
ADJUSTMENTS = View("orders", {
    "employee_id": "o_custkey",
    "adjustment_type": "case when o_orderpriority = '1-URGENT' then '考勤' when o_orderpriority = '2-HIGH' then '其他' when o_orderpriority = '3-MEDIUM' then '' else '奖金' end",
    "amount": "cast(floor(o_totalprice / 500) as bigint) - 400",
})
SOCIAL = View("nation", {
    "social_rule_id": "n_nationkey", "company_id": "n_nationkey", "effective_period": "case when n_regionkey = 3 then '2024-07' else '2023-07' end",
    "lower_bound": "case when n_nationkey % 5 = 0 then 0e0 else 4812e0 end", "upper_bound": "case when n_nationkey % 7 = 0 then 0e0 else 24060e0 end",
    "employer_pension_rate": "16e-2", "employer_injury_rate": "2e-3", "employer_unemployment_rate": "5e-3", "employer_medical_rate": "85e-3",
    "employer_maternity_rate": "cast(n_nationkey as double) / 1000", "personal_pension_rate": "8e-2", "personal_unemployment_rate": "5e-3",
    "personal_medical_rate": "2e-2", "personal_serious_illness_amount": "cast(n_nationkey % 3 as double) * 7",
})
HOUSING = View("nation", {
    "housing_rule_id": "n_nationkey", "company_id": "n_nationkey", "effective_period": "case when n_regionkey = 2 then '2024-12' else '' end",
    "employer_rate": "12e-2", "personal_rate": "cast(5 + n_nationkey % 8 as double) / 100",
    "rounding_rule": "case when n_nationkey % 2 = 0 then 'ROUND0' else '' end",
})
LEDGERS = View("customer", {
    "employee_id": "c_custkey", "current_income": "case when c_mktsegment = 'BUILDING' then null else abs(c_acctbal) * 2e0 end",
    "cumulative_income": "abs(c_acctbal) * 9e0 + 20000", "cumulative_deductions": "abs(c_acctbal) / 2",
    "cumulative_basic_deduction": "15000e0", "previous_cumulative_tax_withheld": "cast(c_custkey % 700 as double)",
}, "c_acctbal >= 0")
LINE_VIEWS = {"sn": SNAPSHOTS, "sp": SPLITS, "gr": GRADES, "pf": PERFORMANCE, "ad": ADJUSTMENTS}
PAY_VIEWS = {**LINE_VIEWS, "so": SOCIAL, "ho": HOUSING, "le": LEDGERS}

LINES = f"""s0 AS (SELECT * FROM sp WHERE effective_period = '' OR effective_period <= '{PERIOD}'),
s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY position_or_type ORDER BY effective_period DESC, split_rule_id DESC) = 1),
fb AS (SELECT * FROM s0 ORDER BY (position_or_type = '员工') DESC, effective_period DESC, split_rule_id DESC LIMIT 1),
g1 AS (SELECT performance_grade, coefficient FROM gr WHERE effective_period <= '{PERIOD}' QUALIFY row_number() OVER (PARTITION BY performance_grade ORDER BY effective_period DESC, grade_rule_id DESC) = 1),
p1 AS (SELECT employee_id, performance_grade FROM pf WHERE performance_period = '{PERIOD}' QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY performance_record_id DESC) = 1),
a1 AS (SELECT employee_id, CAST(coalesce(sum(CASE WHEN adjustment_type = '考勤' THEN amount END), 0) AS DOUBLE) AS att, CAST(coalesce(sum(CASE WHEN adjustment_type IN ('其他', '') THEN amount END), 0) AS DOUBLE) AS oth FROM ad GROUP BY 1),
j1 AS (SELECT sn.*, coalesce(nullif(p1.performance_grade, ''), '无等级') AS performance_grade, coalesce(s1.basic_salary_rate, fb.basic_salary_rate) AS br, coalesce(s1.performance_base_rate, fb.performance_base_rate) AS pr, coalesce(att, 0) AS att, coalesce(oth, 0) AS oth
  FROM sn LEFT JOIN s1 ON s1.position_or_type = position_snapshot LEFT JOIN fb ON true LEFT JOIN p1 ON p1.employee_id = sn.employee_id LEFT JOIN a1 ON a1.employee_id = sn.employee_id),
j2 AS (SELECT *, {sql_round('monthly_salary_total * br', 2)} AS basic_salary, {sql_round('monthly_salary_total * pr', 2)} AS performance_salary_base FROM j1),
j3 AS (SELECT j2.*, {sql_round('performance_salary_base * coalesce(coefficient, 0)', 2)} AS performance_salary FROM j2 LEFT JOIN g1 USING (performance_grade)),
lines AS (SELECT employee_id, payroll_company_id, position_snapshot, monthly_salary_total, performance_grade, basic_salary, performance_salary_base, performance_salary, att AS attendance_adjustment, oth AS other_adjustment,
  {sql_round('basic_salary + performance_salary + att + oth', 2)} AS gross_pay_before_deduction FROM j3)"""
PARTS_SQL = ", ".join(
    [f"{sql_round(f'sb * coalesce(employer_{p}_rate, 0)', 2)} AS employer_{p}" for p in payroll.EMPLOYER_PARTS]
    + [f"{sql_round(f'sb * coalesce(personal_{p}_rate, 0)', 2)} AS personal_{p}" for p in payroll.PERSONAL_PARTS]
)
CONTRIB = f"""c1 AS (SELECT sn.*, s.social_rule_id, s.lower_bound, s.upper_bound, {", ".join(f"s.employer_{p}_rate" for p in payroll.EMPLOYER_PARTS)}, {", ".join(f"s.personal_{p}_rate" for p in payroll.PERSONAL_PARTS)},
  coalesce(s.personal_serious_illness_amount, 0) AS ill, h.housing_rule_id, h.employer_rate AS her, h.personal_rate AS hpr, h.rounding_rule,
  coalesce(nullif(social_security_base, 0), nullif(monthly_salary_base, 0), nullif(monthly_salary_total, 0), 0) AS sraw, coalesce(nullif(housing_fund_base, 0), nullif(monthly_salary_base, 0), nullif(monthly_salary_total, 0), 0) AS hraw
  FROM sn LEFT JOIN so s ON s.company_id = payroll_company_id AND s.effective_period <= '{PERIOD}' LEFT JOIN ho h ON h.company_id = payroll_company_id AND (h.effective_period = '' OR h.effective_period <= '{PERIOD}')),
c2 AS (SELECT *, CASE WHEN social_rule_id IS NULL THEN 0 ELSE CASE WHEN upper_bound <> 0 THEN least(greatest(sraw, lower_bound), upper_bound) ELSE greatest(sraw, lower_bound) END END AS sb, CASE WHEN housing_rule_id IS NULL THEN 0 ELSE hraw END AS hb FROM c1),
c3 AS (SELECT *, {PARTS_SQL}, CASE WHEN rounding_rule = 'ROUND0' THEN round_even(hb * coalesce(her, 0), 0) ELSE hb * coalesce(her, 0) END AS he, CASE WHEN rounding_rule = 'ROUND0' THEN round_even(hb * coalesce(hpr, 0), 0) ELSE hb * coalesce(hpr, 0) END AS hp FROM c2),
con AS (SELECT employee_id, payroll_company_id, sb AS social_base, employer_pension, employer_injury, employer_unemployment, employer_medical, employer_maternity, personal_pension, personal_unemployment, personal_medical,
  ill AS personal_serious_illness, {sql_round('employer_pension + employer_injury + employer_unemployment + employer_medical + employer_maternity', 2)} AS employer_total, {sql_round('personal_pension + personal_unemployment + personal_medical + ill', 2)} AS personal_total,
  hb AS housing_base, {sql_round('he', 2)} AS housing_employer, {sql_round('hp', 2)} AS housing_personal, {sql_round('he + hp', 2)} AS housing_total FROM c3)"""
BRACKETS = "br AS (SELECT * FROM (VALUES " + ", ".join(
    f"({lo}::DOUBLE, {'NULL' if hi is None else f'{hi}'}::DOUBLE, {rate}::DOUBLE, {quick}::DOUBLE)" for lo, hi, rate, quick in payroll.TAX_BRACKETS
) + ") AS v(lo, hi, rate, quick))"
TAX = f"""{BRACKETS},
t1 AS (SELECT l.*, c.personal_total AS personal_social_security, c.employer_total AS employer_social_security, c.housing_personal AS personal_housing_fund, c.housing_employer AS employer_housing_fund,
  le.employee_id IS NOT NULL AS has, le.current_income AS ci, cumulative_income, cumulative_deductions, cumulative_basic_deduction, previous_cumulative_tax_withheld FROM lines l JOIN con c ON c.employee_id = l.employee_id LEFT JOIN le ON le.employee_id = l.employee_id),
t2 AS (SELECT *, CASE WHEN NOT has THEN 0 WHEN ci IS NULL THEN cumulative_income ELSE greatest(cumulative_income - ci, 0) END AS pi, CASE WHEN NOT has THEN 0 WHEN ci IS NULL THEN cumulative_deductions ELSE greatest(cumulative_deductions - personal_social_security - personal_housing_fund, 0) END AS pd,
  CASE WHEN has THEN cumulative_basic_deduction ELSE 5000 END AS bd, CASE WHEN has THEN previous_cumulative_tax_withheld ELSE 0 END AS wh FROM t1),
t3 AS (SELECT *, greatest(pi + gross_pay_before_deduction - (pd + personal_social_security + personal_housing_fund) - bd, 0) AS taxable FROM t2),
t4 AS (SELECT t3.*, (SELECT min({{'lo': lo, 'r': rate, 'q': quick}}) FROM br WHERE taxable >= lo AND (hi IS NULL OR taxable <= hi)) AS b FROM t3),
t5 AS (SELECT *, {sql_round('taxable * b.r - b.q', 2)} AS payable FROM t4),
t6 AS (SELECT *, greatest({sql_round('payable - wh', 2)}, 0) AS tax FROM t5),
pay AS (SELECT employee_id, payroll_company_id, basic_salary, performance_salary, attendance_adjustment, other_adjustment, gross_pay_before_deduction, personal_social_security, employer_social_security, personal_housing_fund, employer_housing_fund,
  taxable AS cumulative_taxable_income, payable AS cumulative_tax_payable, tax AS personal_income_tax, {sql_round('gross_pay_before_deduction - personal_social_security - personal_housing_fund - tax', 2)} AS net_pay,
  {sql_round('gross_pay_before_deduction + employer_social_security + employer_housing_fund', 2)} AS company_total_cost FROM t6)"""
PAY_COLUMNS = [
    "employee_id", "payroll_company_id", "basic_salary", "performance_salary", "attendance_adjustment", "other_adjustment",
    "gross_pay_before_deduction", "personal_social_security", "employer_social_security", "personal_housing_fund", "employer_housing_fund",
    "cumulative_taxable_income", "cumulative_tax_payable", "personal_income_tax", "net_pay", "company_total_cost",
]


def lines(spark, sf):
    v = {k: view.df(spark, sf) for k, view in LINE_VIEWS.items()}
    return payroll.payroll_lines(v["sn"], v["sp"], v["gr"], v["pf"], v["ad"], PERIOD)


def contribution_rows(spark, sf):
    return payroll.contributions(SNAPSHOTS.df(spark, sf), SOCIAL.df(spark, sf), HOUSING.df(spark, sf), PERIOD)


def pay(spark, sf):
    brackets = payroll.tax_brackets(spark)
    return payroll.calculate_payroll(lines(spark, sf), contribution_rows(spark, sf), LEDGERS.df(spark, sf), brackets)


@query("payroll_employee_state", ctes(e=EMPLOYEES, n=PERSONS, r=RELATIONSHIPS, f=PROFILES, c=COMPANIES) + """,
rel AS (SELECT * FROM r WHERE (effective_date = '' OR effective_date <= '1998-06-30') AND (expiry_date = '' OR expiry_date >= '1998-06-30') QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY effective_date DESC, employment_relationship_id DESC) = 1),
pr AS (SELECT * FROM f WHERE effective_date <= '1998-06-30' QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY effective_date DESC, salary_profile_id DESC) = 1)
SELECT e.employee_id, e.person_id, coalesce(n.name, '') AS employee_name, e.status AS employment_status, employment_relationship_id, rel.company_id, company_name, salary_profile_id, monthly_salary_base,
  coalesce(nullif(position_or_type, ''), position) AS position_or_type, concat_ws(',', CASE WHEN n.name IS NULL THEN 'Person' END, CASE WHEN employment_relationship_id IS NULL THEN 'EmploymentRelationship' END, CASE WHEN salary_profile_id IS NULL THEN 'SalaryProfile' END) AS missing
FROM e LEFT JOIN n USING (person_id) LEFT JOIN rel ON rel.employee_id = e.employee_id LEFT JOIN pr ON pr.employee_id = e.employee_id LEFT JOIN c ON c.company_id = rel.company_id""")
def payroll_employee_state(spark, sf):
    v = [x.df(spark, sf) for x in (EMPLOYEES, PERSONS, RELATIONSHIPS, PROFILES, COMPANIES)]
    return payroll.employee_state_at(*v, as_of="1998-06-30")


@query("payroll_rules_at", ctes(c=COMPANIES, s=SOCIAL, h=HOUSING) + f"""
SELECT c.company_id, company_name, social_rule_id, housing_rule_id FROM c LEFT JOIN s ON s.company_id = c.company_id AND s.effective_period <= '{PERIOD}'
LEFT JOIN h ON h.company_id = c.company_id AND (h.effective_period = '' OR h.effective_period <= '{PERIOD}')""")
def payroll_rules_at(spark, sf):
    return payroll.rules_at(COMPANIES.df(spark, sf), SOCIAL.df(spark, sf), HOUSING.df(spark, sf), PERIOD)


LINE_COLUMNS = [
    "employee_id", "payroll_company_id", "position_snapshot", "monthly_salary_total", "performance_grade", "basic_salary",
    "performance_salary_base", "performance_salary", "attendance_adjustment", "other_adjustment", "gross_pay_before_deduction",
]


@query("payroll_lines", ctes(**LINE_VIEWS) + f", {LINES} SELECT * FROM lines")
def payroll_lines(spark, sf):
    return lines(spark, sf).select(*LINE_COLUMNS)


@query("payroll_contributions", ctes(sn=SNAPSHOTS, so=SOCIAL, ho=HOUSING) + f", {CONTRIB} SELECT * FROM con")
def payroll_contributions(spark, sf):
    return contribution_rows(spark, sf)


@query("payroll_deduction_ledger", ctes(sn=SNAPSHOTS, so=SOCIAL, ho=HOUSING) + f", {CONTRIB}" + """
SELECT 'DED_SI_202403_' || payroll_company_id || '_' || employee_id AS deduction_id, employee_id, '社保' AS deduction_type, 'SI_202403_' || payroll_company_id || '_' || employee_id AS contribution_record_id, personal_total AS personal_amount, employer_total AS employer_amount FROM con
UNION ALL SELECT 'DED_HF_202403_' || payroll_company_id || '_' || employee_id, employee_id, '公积金', 'HF_202403_' || payroll_company_id || '_' || employee_id, housing_personal, housing_employer FROM con""")
def payroll_deduction_ledger(spark, sf):
    return payroll.deduction_ledger(contribution_rows(spark, sf), PERIOD)


@query("payroll_calculate", ctes(**PAY_VIEWS) + f", {LINES}, {CONTRIB}, {TAX} SELECT * FROM pay")
def payroll_calculate(spark, sf):
    return pay(spark, sf).select(*PAY_COLUMNS)


def _items_sql() -> str:
    parts = []
    for code, name, column, category, taxable, net in payroll.ITEMS:
        kind = f"CASE WHEN {column} > 0 THEN 'earning' ELSE 'deduction' END" if category == "signed" else f"'{category}'"
        parts.append(f"SELECT employee_id, payroll_company_id, '{code}' AS item_code, '{name}' AS item_name, {kind} AS item_category, abs({column}) * CASE WHEN '{category}' = 'signed' THEN 1 ELSE sign({column}) END AS amount, {taxable} AS taxable, {net} AS affects_net_pay FROM pay")
    return " UNION ALL ".join(parts)


@query("payroll_items", ctes(**PAY_VIEWS) + f", {LINES}, {CONTRIB}, {TAX}, it AS ({_items_sql()})" + """
SELECT employee_id, item_code, item_name, item_category, amount, taxable, affects_net_pay, CASE WHEN item_category IN ('earning', 'employer_cost', 'info') THEN CAST(payroll_company_id AS VARCHAR) ELSE '' END AS cost_company_id FROM it WHERE amount <> 0""")
def payroll_items(spark, sf):
    rows = pay(spark, sf).withColumn("payroll_company_id", F.col("payroll_company_id").cast("string"))
    return payroll.payroll_items(rows)


@query("payroll_reconcile", ctes(**LINE_VIEWS) + f", {LINES}" + f""",
x AS (SELECT l.employee_id, {sql_round('l.gross_pay_before_deduction', 2)} AS a, {sql_round('sn.monthly_salary_total', 2)} AS b, {sql_round('l.basic_salary', 2)} AS c, {sql_round('sn.monthly_salary_base', 2)} AS d FROM lines l JOIN sn ON sn.employee_id = l.employee_id)
SELECT employee_id, 'changed' AS status, concat_ws(',', CASE WHEN a <> b THEN 'gross_pay_before_deduction' END, CASE WHEN c <> d THEN 'basic_salary' END) AS changed_fields FROM x WHERE a <> b OR c <> d""")
def payroll_reconcile(spark, sf):
    expected = SNAPSHOTS.df(spark, sf).select(
        "employee_id", F.col("monthly_salary_total").alias("gross_pay_before_deduction"), F.col("monthly_salary_base").alias("basic_salary")
    )
    return reconcile.diff(lines(spark, sf), expected, ["employee_id"], ["gross_pay_before_deduction", "basic_salary"])


@query("payroll_cumulative_withholding", f"""WITH {BRACKETS},
m AS (SELECT o_custkey AS employee_id, CAST(year(o_orderdate) AS INTEGER) AS tax_year, CAST(month(o_orderdate) AS INTEGER) AS tax_month, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS income FROM orders GROUP BY ALL),
c AS (SELECT *, CAST(sum(income) OVER w AS DOUBLE) AS ci, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY employee_id, tax_year ORDER BY tax_month ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, greatest(ci - n * 5000::DOUBLE, 0) AS taxable FROM c),
b AS (SELECT x.*, (SELECT min({{'lo': lo, 'r': rate, 'q': quick}}) FROM br WHERE taxable >= lo AND (hi IS NULL OR taxable <= hi)) AS b FROM x),
p AS (SELECT *, {sql_round('taxable * b.r - b.q', 2)} AS ct FROM b),
q AS (SELECT *, coalesce(max(ct) OVER (PARTITION BY employee_id, tax_year ORDER BY tax_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT employee_id, tax_year, tax_month, ci AS cumulative_income, taxable AS cumulative_taxable_income, ct AS cumulative_tax, greatest({sql_round('ct - before', 2)}, 0) AS current_tax FROM q""")
def payroll_cumulative_withholding(spark, sf):
    months = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("employee_id"), F.year("o_orderdate").alias("tax_year"), F.month("o_orderdate").alias("tax_month")
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("income"))
    return payroll.cumulative_withholding(months, payroll.tax_brackets(spark))


RUNS = View("nation", {"payroll_run_id": "n_nationkey"})
INPUTS = View("orders", {
    "payroll_run_id": "cast(o_custkey % 20 as int)", "snapshot_id": "o_orderkey", "snapshot_time": "cast(cast(o_orderdate as date) as string)",
    "payroll_period": "substr(cast(cast(o_orderdate as date) as string), 1, 7)", "status": "case when o_orderstatus = 'F' then 'frozen' else '' end",
})
RUN_SNAPSHOTS = View("lineitem", {"snapshot_id": "l_orderkey"})
RUN_LINES = View("lineitem", {"payroll_run_id": "cast(l_suppkey % 23 as int)"})
VALIDATIONS = View("orders", {"payroll_run_id": "cast(o_orderkey % 25 as int)", "severity": "case when o_orderpriority = '1-URGENT' then 'warning' else 'info' end"})


@query("payroll_snapshot_status", ctes(r=RUNS, i=INPUTS, s=RUN_SNAPSHOTS, l=RUN_LINES, v=VALIDATIONS) + """,
n AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY payroll_run_id ORDER BY snapshot_time DESC, snapshot_id DESC) = 1)
SELECT r.payroll_run_id, CASE WHEN snapshot_id IS NULL THEN 'missing_snapshot' WHEN status = '' THEN 'built' ELSE status END AS status, snapshot_id, snapshot_time, payroll_period,
  (SELECT count(*) FROM s WHERE s.snapshot_id = n.snapshot_id) AS employee_snapshot_count, (SELECT count(*) FROM l WHERE l.payroll_run_id = r.payroll_run_id) AS payroll_line_count,
  (SELECT count(*) FROM v WHERE v.payroll_run_id = r.payroll_run_id AND severity = 'warning') AS validation_warning_count
FROM r LEFT JOIN n ON n.payroll_run_id = r.payroll_run_id""")
def payroll_snapshot_status(spark, sf):
    return payroll.snapshot_status(*[v.df(spark, sf) for v in (RUNS, INPUTS, RUN_SNAPSHOTS, RUN_LINES, VALIDATIONS)])


MONTH = {"employee_id": "o_custkey", "tax_year": "cast(year(o_orderdate) as int)", "tax_month": "cast(month(o_orderdate) as int)"}
EARNED = View("orders", MONTH | {"income": "cast(o_totalprice as decimal(18,2))"})
DEDUCTED = View("orders", MONTH | {
    "deduction_type": "case when o_orderstatus = 'F' then '社保' when o_orderstatus = 'O' then '公积金' else '补充' end",
    "personal_amount": "cast(o_totalprice * 8e-2 as decimal(18,2))",
})
_KEYS = "employee_id, tax_year, tax_month"


def ledgers(spark, sf):
    """Ledger of every person and month; every third person's deductions start late, so that some lines exceed them."""
    keys = _KEYS.split(", ")
    running = Window.partitionBy("employee_id", "tax_year").orderBy("tax_month").rowsBetween(Window.unboundedPreceding, 0)  # at most twelve rows
    earned = EARNED.df(spark, sf).groupBy(*keys).agg(F.sum("income").alias("_i"))
    paid = DEDUCTED.df(spark, sf).filter("deduction_type <> '补充'").groupBy(*keys).agg(F.sum("personal_amount").alias("_p"))
    joined = earned.join(paid, keys, "left").withColumn("_p", F.coalesce("_p", F.lit(0)))
    return joined.select(
        *keys, F.col("_i").cast("double").alias("current_income"), F.sum("_i").over(running).cast("double").alias("cumulative_income"),
        F.when(F.col("employee_id") % 3 == 0, 0.0).otherwise(F.sum("_p").over(running).cast("double")).alias("cumulative_deductions"),
    )


@query("payroll_prior_ledger", ctes(i=EARNED, d=DEDUCTED) + f""",
e AS (SELECT {_KEYS}, sum(income) AS income FROM i GROUP BY ALL), p AS (SELECT {_KEYS}, sum(personal_amount) AS paid FROM d WHERE deduction_type IN ('社保', '公积金') GROUP BY ALL),
l AS (SELECT e.*, coalesce(paid, 0) AS paid, CAST(sum(income) OVER w AS DOUBLE) AS ci, CASE WHEN employee_id % 3 = 0 THEN 0 ELSE CAST(sum(coalesce(paid, 0)) OVER w AS DOUBLE) END AS cd
  FROM e LEFT JOIN p USING ({_KEYS}) WINDOW w AS (PARTITION BY employee_id, tax_year ORDER BY tax_month ROWS UNBOUNDED PRECEDING)),
b AS (SELECT {_KEYS}, income, greatest({sql_round('ci - CAST(income AS DOUBLE)', 2)}, 0) AS cumulative_income, greatest({sql_round('cd - CAST(paid AS DOUBLE)', 2)}, 0) AS cumulative_deductions FROM l)
SELECT {_KEYS}, cumulative_income, cumulative_deductions, 'historical_input_from_excel' AS source, '待计算' AS reconciliation_status, {sql_round('cumulative_income + CAST(income AS DOUBLE)', 2)} AS rolled_forward FROM b""")
def payroll_prior_ledger(spark, sf):
    keys = _KEYS.split(", ")
    prior = payroll.prior_ledger(ledgers(spark, sf), DEDUCTED.df(spark, sf), keys)
    again = payroll.roll_forward(prior, EARNED.df(spark, sf), keys).select(*keys, F.col("cumulative_income").alias("rolled_forward"))
    return prior.select(*keys, "cumulative_income", "cumulative_deductions", "source", "reconciliation_status").join(again, keys)
