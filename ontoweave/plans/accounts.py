"""Account balances and customer risk: a view source and a resolver composed from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.operators.rules import Condition, Rule, apply_rules

RISK_RULE = Rule(
    "customer_risk", "risk_level",
    [
        Condition("has_frozen", "eq", True, "review"),
        Condition("total_balance", "lt", 0, "high"),
        Condition("total_balance", "gt", 5000, "low"),
    ],
    default="normal",
)


def account_balance(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Balance per account; accounts without transactions have balance 0.

    Transactions are summed before the join, so only one row per account meets it.
    """
    sums = transactions.groupBy("account_id").agg(F.sum("amount").alias("_sum"))
    return accounts.join(sums, "account_id", "left").select(
        "account_id", "customer_id", "status", F.coalesce("_sum", F.lit(0)).cast("double").alias("balance")
    )


def customer_risk(profiles: DataFrame, balances: DataFrame, rule: Rule = RISK_RULE) -> DataFrame:
    totals = balances.groupBy("customer_id").agg(
        F.sum(F.col("balance").cast("decimal(24,2)")).alias("_total"),
        F.bool_or(F.col("status") == "frozen").alias("_frozen"),
    )
    joined = profiles.join(totals, "customer_id", "left").select(
        "customer_id", "name", "tier",
        F.coalesce("_total", F.lit(0)).cast("double").alias("total_balance"),
        F.coalesce("_frozen", F.lit(False)).alias("has_frozen"),
    )
    return apply_rules(joined, rule).drop("has_frozen")
