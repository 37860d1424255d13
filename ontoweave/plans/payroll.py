"""Payroll: employee state, pay lines, contributions, cumulative tax, items, reconciliation.

Rule tables are joined, never looked up per row. Each rounding step of the
formulas is its own projection, because later steps build on rounded values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoweave.functions.numeric import as_number, clamp_open, first_truthy, sum_columns, with_rounded
from ontoweave.operators.grouping import last_wins
from ontoweave.operators.temporal import bracket_lookup, effective_rules, select_effective, select_period_rule

# Fixed values of the domain.
STAFF = "员工"
NO_GRADE = "无等级"
ATTENDANCE, OTHER = "考勤", "其他"
EMPLOYER_PARTS = ["pension", "injury", "unemployment", "medical", "maternity"]
PERSONAL_PARTS = ["pension", "unemployment", "medical"]
FIRST_BASIC_DEDUCTION = 5000.0
# Income tax brackets: (lower, upper, rate, quick deduction).
TAX_BRACKETS = [
    (0.0, 36000.0, 0.03, 0.0),
    (36000.0, 144000.0, 0.10, 2520.0),
    (144000.0, 300000.0, 0.20, 16920.0),
    (300000.0, 420000.0, 0.25, 31920.0),
    (420000.0, 660000.0, 0.30, 52920.0),
    (660000.0, 960000.0, 0.35, 85920.0),
    (960000.0, None, 0.45, 181920.0),
]
# Pay items: (code, name, source column, category, taxable, affects net pay).
ITEMS = [
    ("BASIC_SALARY", "基本薪资", "basic_salary", "earning", 1, 1),
    ("PERFORMANCE_SALARY", "绩效薪资", "performance_salary", "earning", 1, 1),
    ("ATTENDANCE_ADJUSTMENT", "考勤补扣", "attendance_adjustment", "signed", 1, 1),
    ("OTHER_ADJUSTMENT", "其他补扣", "other_adjustment", "signed", 1, 1),
    ("PERSONAL_SOCIAL_SECURITY", "个人社保", "personal_social_security", "deduction", 0, 1),
    ("PERSONAL_HOUSING_FUND", "个人公积金", "personal_housing_fund", "deduction", 0, 1),
    ("PERSONAL_INCOME_TAX", "个人所得税", "personal_income_tax", "tax", 0, 1),
    ("EMPLOYER_SOCIAL_SECURITY", "公司社保", "employer_social_security", "employer_cost", 0, 0),
    ("EMPLOYER_HOUSING_FUND", "公司公积金", "employer_housing_fund", "employer_cost", 0, 0),
    ("COMPANY_TOTAL_COST", "公司总成本", "company_total_cost", "info", 0, 0),
]


def tax_brackets(spark) -> DataFrame:
    return spark.createDataFrame(
        TAX_BRACKETS, "lower_bound double, upper_bound double, tax_rate double, quick_deduction double"
    )


def employee_state_at(
    employees: DataFrame, persons: DataFrame, relationships: DataFrame, profiles: DataFrame, companies: DataFrame, as_of: str
) -> DataFrame:
    """State of every employee on a date: relationship, salary profile, company and what is missing."""
    rel = select_effective(relationships, ["employee_id"], as_of, tiebreak=["employment_relationship_id"]).select(
        "employee_id", "employment_relationship_id", "company_id"
    )
    pay = select_effective(profiles, ["employee_id"], as_of, tiebreak=["salary_profile_id"]).select(
        "employee_id", "salary_profile_id", "monthly_salary_base", "position_or_type"
    )
    j = (
        employees.select("employee_id", "person_id", "status", "position")
        .join(persons.select("person_id", "name"), "person_id", "left")
        .join(rel, "employee_id", "left").join(pay, "employee_id", "left")
        .join(companies.select("company_id", "company_name"), "company_id", "left")
    )
    return j.select(
        "employee_id", "person_id", F.coalesce("name", F.lit("")).alias("employee_name"),
        F.col("status").alias("employment_status"), "employment_relationship_id", "company_id", "company_name",
        "salary_profile_id", "monthly_salary_base",
        F.coalesce(F.nullif("position_or_type", F.lit("")), "position").alias("position_or_type"),
        F.concat_ws(
            ",", F.when(F.col("name").isNull(), "Person"),
            F.when(F.col("employment_relationship_id").isNull(), "EmploymentRelationship"),
            F.when(F.col("salary_profile_id").isNull(), "SalaryProfile"),
        ).alias("missing"),
    )


def rules_at(companies: DataFrame, social: DataFrame, housing: DataFrame, period: str) -> DataFrame:
    """Social and housing rule in force per company for a period."""
    s = select_period_rule(social, ["company_id"], period, tiebreak=["social_rule_id"]).select("company_id", "social_rule_id")
    h = select_period_rule(housing, ["company_id"], period, tiebreak=["housing_rule_id"]).select("company_id", "housing_rule_id")
    return companies.select("company_id", "company_name").join(s, "company_id", "left").join(h, "company_id", "left")


def snapshot_status(runs: DataFrame, inputs: DataFrame, snapshots: DataFrame, lines: DataFrame, validations: DataFrame) -> DataFrame:
    """Latest input snapshot of every payroll run and what hangs on it; runs without one are ``missing_snapshot``."""
    latest = last_wins(
        inputs.select("payroll_run_id", "snapshot_id", "snapshot_time", "payroll_period", "status"), ["payroll_run_id"], ["snapshot_time", "snapshot_id"])
    j = runs.select("payroll_run_id").join(latest, "payroll_run_id", "left")
    for rows, key, name in [
        (snapshots, "snapshot_id", "employee_snapshot_count"), (lines, "payroll_run_id", "payroll_line_count"),
        (validations.filter("severity = 'warning'"), "payroll_run_id", "validation_warning_count"),
    ]:
        j = j.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    told = F.coalesce(F.nullif("status", F.lit("")), F.lit("built"))
    return j.select(
        "payroll_run_id", F.when(F.col("snapshot_id").isNull(), "missing_snapshot").otherwise(told).alias("status"), "snapshot_id", "snapshot_time",
        "payroll_period", "employee_snapshot_count", "payroll_line_count", "validation_warning_count",
    )


def _adjustments(adjustments: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif("adjustment_type", F.lit("")), F.lit(OTHER))
    amount = as_number(F.col("amount")).cast("decimal(18,2)")

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(kind == name, amount)), F.lit(0)).cast("double")

    return adjustments.groupBy("employee_id").agg(
        total(ATTENDANCE).alias("attendance_adjustment"), total(OTHER).alias("other_adjustment")
    )


def payroll_lines(
    snapshots: DataFrame, split_rules: DataFrame, grade_rules: DataFrame, performance: DataFrame,
    adjustments: DataFrame, period: str,
) -> DataFrame:
    """Draft line per employee: salary split by position, performance by grade, adjustments, gross pay."""
    splits = effective_rules(split_rules, period)
    order = [F.coalesce(F.col("effective_period"), F.lit("")), "split_rule_id"]
    rates = F.struct("basic_salary_rate", "performance_base_rate", "split_rule_id")
    by_position = splits.groupBy("position_or_type").agg(F.max_by(rates, F.struct(*order)).alias("_split"))
    # Fallback: the staff rule, else the last rule of all; a single value, read as a scalar subquery.
    fallback = splits.agg(
        F.max_by(rates, F.struct((F.col("position_or_type") == STAFF).alias("_s"), *order))
    ).scalar()
    grades = last_wins(
        effective_rules(grade_rules, period).select("performance_grade", "coefficient", "effective_period", "grade_rule_id"),
        ["performance_grade"], [F.coalesce(F.col("effective_period"), F.lit("")), "grade_rule_id"],
    ).select("performance_grade", "coefficient")
    graded = last_wins(
        performance.filter(F.col("performance_period") == period).select("employee_id", "performance_grade", "performance_record_id"),
        ["employee_id"], ["performance_record_id"],
    ).select("employee_id", "performance_grade")
    j = (
        snapshots.join(by_position, F.col("position_snapshot") == F.col("position_or_type"), "left")
        .join(graded, "employee_id", "left")
        .withColumn("performance_grade", F.coalesce(F.nullif("performance_grade", F.lit("")), F.lit(NO_GRADE)))
        .join(grades, "performance_grade", "left")
        .join(_adjustments(adjustments), "employee_id", "left")
        .withColumns({
            "_split": F.coalesce("_split", fallback),
            "attendance_adjustment": F.coalesce("attendance_adjustment", F.lit(0.0)),
            "other_adjustment": F.coalesce("other_adjustment", F.lit(0.0)),
        })
    )
    total = F.col("monthly_salary_total")
    first = with_rounded(
        j, 2,
        basic_salary=total * F.coalesce("_split.basic_salary_rate", F.lit(1.0)),
        performance_salary_base=total * F.coalesce("_split.performance_base_rate", F.lit(0.0)),
    )
    second = with_rounded(
        first, 2, performance_salary=F.col("performance_salary_base") * F.coalesce("coefficient", F.lit(0.0))
    )
    gross = sum_columns(*[F.col(c) for c in ("basic_salary", "performance_salary", "attendance_adjustment", "other_adjustment")])
    return with_rounded(second, 2, gross_pay_before_deduction=gross).select(
        *snapshots.columns, "performance_grade", "basic_salary", "performance_salary_base", "performance_salary",
        "attendance_adjustment", "other_adjustment", "gross_pay_before_deduction",
    )


def contributions(snapshots: DataFrame, social: DataFrame, housing: DataFrame, period: str) -> DataFrame:
    """Social insurance and housing fund per employee; companies without a rule contribute 0."""
    s = select_period_rule(social, ["company_id"], period, tiebreak=["social_rule_id"])
    h = select_period_rule(housing, ["company_id"], period, tiebreak=["housing_rule_id"])
    s = s.select(F.col("company_id").alias("payroll_company_id"), *[F.col(c).alias(f"s_{c}") for c in s.columns if c != "company_id"])
    h = h.select(F.col("company_id").alias("payroll_company_id"), *[F.col(c).alias(f"h_{c}") for c in h.columns if c != "company_id"])
    j = snapshots.join(s, "payroll_company_id", "left").join(h, "payroll_company_id", "left")
    pay = [F.col("monthly_salary_base"), F.col("monthly_salary_total")]
    based = j.withColumns({
        "social_base": F.when(F.col("s_social_rule_id").isNull(), 0.0).otherwise(
            clamp_open(first_truthy(F.col("social_security_base"), *pay), F.col("s_lower_bound"), F.col("s_upper_bound"))
        ),
        "housing_base": F.when(F.col("h_housing_rule_id").isNull(), 0.0).otherwise(first_truthy(F.col("housing_fund_base"), *pay)),
    })
    rate = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    parts = {f"employer_{p}": F.col("social_base") * rate(f"s_employer_{p}_rate") for p in EMPLOYER_PARTS}
    parts |= {f"personal_{p}": F.col("social_base") * rate(f"s_personal_{p}_rate") for p in PERSONAL_PARTS}
    staged = with_rounded(based, 2, **parts)
    whole = F.col("h_rounding_rule") == "ROUND0"
    raw = {k: F.col("housing_base") * rate(f"h_{k}_rate") for k in ("employer", "personal")}
    staged = staged.withColumns({f"_{k}": F.when(whole, F.rint(v)).otherwise(v) for k, v in raw.items()})
    staged = staged.withColumn("personal_serious_illness", rate("s_personal_serious_illness_amount"))
    return with_rounded(
        staged, 2,
        employer_total=sum_columns(*[F.col(f"employer_{p}") for p in EMPLOYER_PARTS]),
        personal_total=sum_columns(*[F.col(f"personal_{p}") for p in PERSONAL_PARTS], F.col("personal_serious_illness")),
        housing_employer=F.col("_employer"), housing_personal=F.col("_personal"),
        housing_total=F.col("_employer") + F.col("_personal"),
    ).select(
        "employee_id", "payroll_company_id", "social_base", *parts, "personal_serious_illness", "employer_total",
        "personal_total", "housing_base", "housing_employer", "housing_personal", "housing_total",
    )


def deduction_ledger(contribution_rows: DataFrame, period: str) -> DataFrame:
    """Two deduction rows per employee (社保, 公积金)."""
    month = period.replace("-", "")
    kinds = F.array(
        F.struct(F.lit("社保").alias("deduction_type"), F.lit("SI").alias("code"),
                 F.col("personal_total").alias("personal_amount"), F.col("employer_total").alias("employer_amount")),
        F.struct(F.lit("公积金").alias("deduction_type"), F.lit("HF").alias("code"),
                 F.col("housing_personal").alias("personal_amount"), F.col("housing_employer").alias("employer_amount")),
    )
    rows = contribution_rows.select("employee_id", "payroll_company_id", F.inline(kinds))
    return rows.select(
        F.concat_ws("_", F.lit("DED"), "code", F.lit(month), "payroll_company_id", "employee_id").alias("deduction_id"),
        "employee_id", "deduction_type",
        F.concat_ws("_", "code", F.lit(month), "payroll_company_id", "employee_id").alias("contribution_record_id"),
        "personal_amount", "employer_amount",
    )


def income_tax(lines: DataFrame, ledgers: DataFrame, brackets: DataFrame) -> DataFrame:
    """Cumulative withholding per line.

    A ledger with empty ``current_income`` holds the totals before this period;
    otherwise this period is already in them and is taken out first.
    """
    ledger = ledgers.select(
        "employee_id", F.lit(True).alias("_has"), "current_income", "cumulative_income", "cumulative_deductions",
        "cumulative_basic_deduction", "previous_cumulative_tax_withheld",
    )
    j = lines.join(ledger, "employee_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    prior = F.col("current_income").isNull()
    has = F.col("_has").isNotNull()
    staged = j.withColumns({
        "_income": F.when(~has, 0.0).when(prior, zero("cumulative_income")).otherwise(
            F.greatest(zero("cumulative_income") - zero("current_income"), F.lit(0.0))),
        "_deducted": F.when(~has, 0.0).when(prior, zero("cumulative_deductions")).otherwise(
            F.greatest(zero("cumulative_deductions") - F.col("personal_social_security") - F.col("personal_housing_fund"), F.lit(0.0))),
        "_basic": F.when(has, zero("cumulative_basic_deduction")).otherwise(FIRST_BASIC_DEDUCTION),
        "_withheld": F.when(has, zero("previous_cumulative_tax_withheld")).otherwise(0.0),
    })
    taxable = F.greatest(
        F.col("_income") + F.col("gross_pay_before_deduction")
        - (F.col("_deducted") + F.col("personal_social_security") + F.col("personal_housing_fund")) - F.col("_basic"),
        F.lit(0.0),
    )
    rated = bracket_lookup(
        staged.withColumn("cumulative_taxable_income", taxable), "cumulative_taxable_income", brackets,
        "lower_bound", "upper_bound", ["tax_rate", "quick_deduction"],
    )
    payable = with_rounded(
        rated, 2, cumulative_tax_payable=F.col("cumulative_taxable_income") * F.col("tax_rate") - F.col("quick_deduction")
    )
    due = with_rounded(payable, 2, _due=F.col("cumulative_tax_payable") - F.col("_withheld"))
    return due.withColumn("personal_income_tax", F.greatest(F.col("_due"), F.lit(0.0))).select(
        *lines.columns, "cumulative_taxable_income", "tax_rate", "quick_deduction", "cumulative_tax_payable", "personal_income_tax"
    )


def calculate_payroll(lines: DataFrame, contribution_rows: DataFrame, ledgers: DataFrame, brackets: DataFrame) -> DataFrame:
    """Net pay and company cost per line."""
    paid = contribution_rows.select(
        "employee_id", F.col("personal_total").alias("personal_social_security"),
        F.col("employer_total").alias("employer_social_security"),
        F.col("housing_personal").alias("personal_housing_fund"), F.col("housing_employer").alias("employer_housing_fund"),
    )
    joined = lines.join(paid, "employee_id", "left").na.fill(
        0.0, ["personal_social_security", "employer_social_security", "personal_housing_fund", "employer_housing_fund"]
    )
    taxed = income_tax(joined, ledgers, brackets)
    gross = F.col("gross_pay_before_deduction")
    final = with_rounded(
        taxed, 2,
        net_pay=gross - F.col("personal_social_security") - F.col("personal_housing_fund") - F.col("personal_income_tax"),
        company_total_cost=gross + F.col("employer_social_security") + F.col("employer_housing_fund"),
    )
    return final.withColumn(
        "exception_notes", F.when(F.col("net_pay") < 0, "实发工资为负数，请确认扣款是否正确").otherwise("")
    )


def payroll_items(lines: DataFrame) -> DataFrame:
    """One row per non-zero pay item of a line."""
    def item(code: str, name: str, column: str, category: str, taxable: int, net: int) -> Column:
        value = F.col(column)
        kind = F.when(value > 0, "earning").otherwise("deduction") if category == "signed" else F.lit(category)
        return F.struct(
            F.lit(code).alias("item_code"), F.lit(name).alias("item_name"), kind.alias("item_category"),
            (F.abs(value) if category == "signed" else value).alias("amount"),
            F.lit(taxable).alias("taxable"), F.lit(net).alias("affects_net_pay"),
        )

    present = [i for i in ITEMS if i[2] in lines.columns]
    items = lines.select("employee_id", "payroll_company_id", F.inline(F.array(*[item(*i) for i in present]))).filter("amount <> 0")
    return items.withColumn(
        "cost_company_id",
        F.when(F.col("item_category").isin("earning", "employer_cost", "info"), F.col("payroll_company_id")).otherwise(""),
    ).drop("payroll_company_id")


def cumulative_withholding(months: DataFrame, brackets: DataFrame, monthly_deduction: float = 5000.0) -> DataFrame:
    """Tax withheld month by month from a full income history.

    ``months``: employee_id, tax_year, tax_month, income - one row per month, so
    the running window of a (person, year) never holds more than twelve rows.
    """
    order = Window.partitionBy("employee_id", "tax_year").orderBy("tax_month")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    cumulated = months.withColumns({
        "cumulative_income": F.sum("income").over(running).cast("double"),
        "_months": F.count("*").over(running),
    }).withColumn(
        "cumulative_taxable_income",
        F.greatest(F.col("cumulative_income") - F.col("_months") * monthly_deduction, F.lit(0.0)),
    )
    rated = bracket_lookup(
        cumulated, "cumulative_taxable_income", brackets, "lower_bound", "upper_bound", ["tax_rate", "quick_deduction"]
    )
    payable = with_rounded(
        rated, 2, cumulative_tax=F.col("cumulative_taxable_income") * F.col("tax_rate") - F.col("quick_deduction")
    )
    # What was withheld so far is the highest cumulative tax before this month: refunds are not paid out.
    before = F.coalesce(F.max("cumulative_tax").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    staged = with_rounded(payable.withColumn("_before", before), 2, _due=F.col("cumulative_tax") - F.col("_before"))
    return staged.select(
        "employee_id", "tax_year", "tax_month", "cumulative_income", "cumulative_taxable_income", "cumulative_tax",
        F.greatest(F.col("_due"), F.lit(0.0)).alias("current_tax"),
    )


# What a ledger turned into a historical input says.
HISTORICAL, UNCALCULATED = "historical_input_from_excel", "待计算"
SOCIAL, HOUSING = "社保", "公积金"


def prior_ledger(ledgers: DataFrame, deductions: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger before its period: cumulative values without the period's own income and deductions, never below zero.

    ``ledgers``: keys, current_income, cumulative_income, cumulative_deductions; ``deductions``: keys, deduction_type,
    personal_amount - lines of the period, of which social security and housing fund count. Values that are missing or no
    numbers count as 0. What the period itself computes is empty until it is calculated again.
    """
    paid = F.when(F.col("deduction_type").isin(SOCIAL, HOUSING), F.col("personal_amount").try_cast("decimal(18,2)"))
    own = deductions.groupBy(*keys).agg(F.coalesce(F.sum(paid), F.lit(0)).cast("double").alias("_paid"))
    value = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("current_income", "cumulative_income", "cumulative_deductions")}
    rounded = with_rounded(
        ledgers.join(own, keys, "left"), 2, _income=value["cumulative_income"] - value["current_income"],
        _deducted=value["cumulative_deductions"] - F.coalesce("_paid", F.lit(0.0)),
    )
    empty = F.lit(None).cast("double")
    return rounded.select(
        *keys, empty.alias("current_income"), F.greatest("_income", F.lit(0.0)).alias("cumulative_income"),
        F.greatest("_deducted", F.lit(0.0)).alias("cumulative_deductions"), empty.alias("cumulative_taxable_income"),
        empty.alias("cumulative_tax_payable"), empty.alias("current_tax"), F.lit(HISTORICAL).alias("source"), F.lit(UNCALCULATED).alias("reconciliation_status"),
    )


def roll_forward(prior: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, current_income, cumulative_income): a prior ledger with the period's income (keys, income) added again."""
    period = lines.groupBy(*keys).agg(F.sum(F.col("income").try_cast("decimal(18,2)")).cast("double").alias("current_income"))
    joined = prior.select(*keys, F.col("cumulative_income").alias("_before")).join(period, keys, "left").withColumn("current_income", F.coalesce("current_income", F.lit(0.0)))
    return with_rounded(joined, 2, cumulative_income=F.col("_before") + F.col("current_income")).drop("_before")
