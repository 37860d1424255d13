"""Generic object surface: filters, paging, search, lookups, links, rules, guards, profiles, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoweave.catalog.base import View, ctes, money, query, table
from ontoweave.operators import filters, grouping, guards, links, ordering, profile, reconcile, rules, sequences, temporal
from ontoweave.operators.links import Link
from ontoweave.operators.rules import Condition, Rule
from ontoweave.plans import accounts

CUSTOMERS = View("customer", {
    "customer_id": "c_custkey", "name": "c_name", "tier": "c_mktsegment", "nation_id": "c_nationkey",
    "balance": "c_acctbal", "segment": "nullif(c_mktsegment, 'BUILDING')",
})
PARTS = View("part", {"part_id": "p_partkey", "name": "p_name", "brand": "p_brand", "kind": "p_type", "size": "p_size", "price": "p_retailprice"})
ORDERS = View("orders", {
    "order_id": "o_orderkey", "customer_id": "o_custkey", "status": "o_orderstatus", "total": "o_totalprice",
    "order_date": "cast(cast(o_orderdate as date) as string)", "priority": "o_orderpriority",
})


# --- filters and paging ------------------------------------------------------------------


@query("filter_operators", ctes(c=CUSTOMERS) + """
SELECT customer_id, name, tier, balance FROM c
WHERE balance >= 0 AND balance < 5000 AND tier <> 'BUILDING' AND contains(name, '00001')""")
def filter_operators(spark, sf):
    wanted = {"balance__gte": 0, "balance__lt": 5000, "tier__ne": "BUILDING", "name__like": "00001"}
    return filters.apply_filters(CUSTOMERS.df(spark, sf), wanted).select("customer_id", "name", "tier", "balance")


@query("filter_null_semantics", ctes(c=CUSTOMERS) + """
SELECT customer_id, segment, 'ne' AS test FROM c WHERE segment IS DISTINCT FROM 'MACHINERY'
UNION ALL SELECT customer_id, segment, 'eq_null' FROM c WHERE segment IS NULL
UNION ALL SELECT customer_id, segment, 'like_none' FROM c WHERE contains(coalesce(segment, 'None'), 'on')""")
def filter_null_semantics(spark, sf):
    c = CUSTOMERS.df(spark, sf).select("customer_id", "segment")
    tests = {"ne": {"segment__ne": "MACHINERY"}, "eq_null": {"segment": None}, "like_none": {"segment__like": "on"}}
    return profile.union_all([filters.apply_filters(c, f).withColumn("test", F.lit(n)) for n, f in tests.items()])


@query("filter_case_insensitive", ctes(p=PARTS) + "SELECT part_id, name FROM p WHERE name ILIKE '%R_NG%'")
def filter_case_insensitive(spark, sf):
    p = PARTS.df(spark, sf).select("part_id", "name")
    return filters.apply_filters(p, {"name__like": "R_NG"}, case_sensitive=False)


@query("order_and_page", ctes(o=ORDERS) + """
SELECT order_id, customer_id, total FROM o ORDER BY total DESC, order_id LIMIT 50 OFFSET 20""")
def order_and_page(spark, sf):
    o = ORDERS.df(spark, sf).select("order_id", "customer_id", "total")
    key = ordering.safe_order_by(o, "-total", "order_id")
    return ordering.apply_window(ordering.apply_order(o, key, ["order_id"]), 50, 20)


@query("search_text", ctes(p=PARTS) + """
SELECT part_id, name, kind, 'Part' AS _object_type,
  concat_ws(', ', CASE WHEN contains(name, 'ma') THEN 'name' END, CASE WHEN contains(brand, 'ma') THEN 'brand' END,
            CASE WHEN contains(kind, 'ma') THEN 'kind' END) AS _matched_field
FROM p WHERE contains(name, 'ma') OR contains(brand, 'ma') OR contains(kind, 'ma')""")
def search_text(spark, sf):
    found = filters.search_text(PARTS.df(spark, sf), "ma", ["name", "brand", "kind"], "Part")
    return found.select("part_id", "name", "kind", "_object_type", "_matched_field")


@query("point_lookup", ctes(c=CUSTOMERS) + "SELECT customer_id, name, tier, balance FROM c WHERE customer_id = 42")
def point_lookup(spark, sf):
    found = filters.apply_filters(CUSTOMERS.df(spark, sf), {"customer_id": 42}).limit(1)
    return found.select("customer_id", "name", "tier", "balance")


@query("polymorphic_lookup", """
SELECT e.id, coalesce(CASE WHEN s.s_suppkey IS NOT NULL THEN 'Supplier' END, CASE WHEN c.c_custkey IS NOT NULL THEN 'Customer' END) AS object_type,
  coalesce(s.s_name, c.c_name) AS name
FROM (SELECT DISTINCT o_custkey AS id FROM orders) e
LEFT JOIN supplier s ON s.s_suppkey = e.id LEFT JOIN customer c ON c.c_custkey = e.id""")
def polymorphic_lookup(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    suppliers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return links.resolve_in_order(ids, "id", [("Supplier", suppliers, "s_suppkey"), ("Customer", customers, "c_custkey")], ["name"])


@query("lookup_optional_parameters", ctes(p=PARTS) + """
SELECT part_id, brand, kind FROM p WHERE kind = 'PROMO'""")
def lookup_optional_parameters(spark, sf):
    given = filters.present({"kind": "PROMO", "brand": "", "size": None})
    return filters.apply_filters(PARTS.df(spark, sf), given).select("part_id", "brand", "kind")


@query("undirected_edge_lookup", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7 OR o_custkey = 7""")
def undirected_edge_lookup(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rows.filter(filters.either_equals(["o_orderkey", "o_custkey"], 7))


# --- links -------------------------------------------------------------------------------


@query("link_two_hop", """
SELECT r_name AS "Region_name", n_name AS "Nation_name", count(*) AS suppliers, CAST(SUM(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def link_two_hop(spark, sf):
    objects = {
        "Region": table(spark, sf, "region").selectExpr("r_regionkey as region_id", "r_name as name"),
        "Nation": table(spark, sf, "nation").selectExpr("n_nationkey as nation_id", "n_regionkey as region_id", "n_name as name"),
        "Supplier": table(spark, sf, "supplier").selectExpr("s_suppkey as supplier_id", "s_nationkey as nation_id", "s_acctbal as balance"),
    }
    walked = links.walk(objects, [
        Link("region_has_nations", "Region", "Nation", "region_id", "region_id"),
        Link("nation_has_suppliers", "Nation", "Supplier", "nation_id", "nation_id"),
    ])
    return walked.groupBy("Region_name", "Nation_name").agg(
        F.count("*").alias("suppliers"), F.sum(F.col("Supplier_balance").cast("decimal(18,2)")).cast("double").alias("balance")
    )


@query("link_list_key", """
WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part),
v AS (SELECT split_part(p_name, ' ', 1) AS word, count(*) AS parts FROM part GROUP BY 1)
SELECT p_partkey, w.word AS target_word, parts AS target_parts FROM w JOIN v USING (word)""")
def link_list_key(spark, sf):
    part = table(spark, sf, "part")
    source = part.select("p_partkey", F.split("p_name", " ").alias("words"))
    target = part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).agg(F.count("*").alias("parts"))
    joined = links.query_link(source, target, Link("part_words", "Part", "Word", "words", "word"))
    return joined.select("p_partkey", "target_word", "target_parts")


@query("link_composite_key", f"""
WITH s AS (SELECT l_partkey, l_suppkey, {money('l_quantity')} AS supplied FROM lineitem GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, supplied AS target_supplied
FROM lineitem l JOIN s USING (l_partkey, l_suppkey)""")
def link_composite_key(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    supply = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("supplied"))
    joined = links.query_link(lines, supply, Link("line_supply", "Line", "Supply", "l_partkey,l_suppkey", "l_partkey, l_suppkey"))
    return joined.select(*lines.columns, "target_supplied")


@query("link_exists", """
SELECT c_custkey, 'with' AS orders FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def link_exists(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    urgent = filters.apply_filters(table(spark, sf, "orders"), {"o_orderpriority": "1-URGENT"})
    link = Link("customer_orders", "Customer", "Order", "c_custkey", "o_custkey")
    return links.exists(c, urgent, link).withColumn("orders", F.lit("with")).unionByName(
        links.missing(c, urgent, link).withColumn("orders", F.lit("without"))
    )


@query("relational_division", """
WITH need AS (SELECT DISTINCT l_orderkey AS order_id, l_suppkey AS item FROM lineitem),
done AS (SELECT DISTINCT l_orderkey AS order_id, l_suppkey AS item FROM lineitem WHERE l_returnflag <> 'R')
SELECT n.order_id, CAST(count(*) AS BIGINT) AS required FROM need n LEFT JOIN done d USING (order_id, item)
GROUP BY 1 HAVING bool_and(d.order_id IS NOT NULL)""")
def relational_division(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("item"), "l_returnflag")
    need = lines.select("order_id", "item").distinct()
    return grouping.divide(need, lines.filter("l_returnflag <> 'R'"), ["order_id"], "item")


# --- view sources ------------------------------------------------------------------------

ACCOUNTS = View("orders", {
    "account_id": "o_orderkey", "customer_id": "o_custkey",
    "status": "case when o_orderpriority = '1-URGENT' and o_totalprice > 450000 then 'frozen' else 'active' end",
})
TRANSACTIONS = View("lineitem", {
    "account_id": "l_orderkey",
    "amount": "cast(case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as decimal(18,2))",
})
BALANCES = """SELECT a.account_id, a.customer_id, a.status, CAST(coalesce(SUM(t.amount), 0) AS DOUBLE) AS balance
FROM a LEFT JOIN t ON t.account_id = a.account_id GROUP BY ALL"""


@query("account_balance_view", ctes(a=ACCOUNTS, t=TRANSACTIONS) + BALANCES)
def account_balance_view(spark, sf):
    return accounts.account_balance(ACCOUNTS.df(spark, sf), TRANSACTIONS.df(spark, sf))


TOTALS = "SELECT customer_id, SUM(CAST(balance AS DECIMAL(24,2))) AS total, bool_or(status = 'frozen') AS frozen FROM b GROUP BY 1"


@query("customer_risk_view", ctes(a=ACCOUNTS, t=TRANSACTIONS, b=BALANCES, s=TOTALS) + """
SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS tier, CAST(coalesce(total, 0) AS DOUBLE) AS total_balance,
  CASE WHEN coalesce(frozen, false) THEN 'review' WHEN coalesce(total, 0) < 0 THEN 'high' WHEN coalesce(total, 0) > 5000 THEN 'low' ELSE 'normal' END AS risk_level
FROM customer LEFT JOIN s ON s.customer_id = c_custkey""")
def customer_risk_view(spark, sf):
    profiles = CUSTOMERS.df(spark, sf).select("customer_id", "name", "tier")
    balances = accounts.account_balance(ACCOUNTS.df(spark, sf), TRANSACTIONS.df(spark, sf))
    return accounts.customer_risk(profiles, balances)


# --- rules -------------------------------------------------------------------------------

SIZE_RULE = Rule("size_class", "size_class", [
    Condition("size", "lte", 5, "tiny"), Condition("size", "between", [6, 15], "small"),
    Condition("kind", "in", ["PROMO", "ECONOMY"], "offer"), Condition("name", "like", "ring", "ring"),
    Condition("size", "gt", 40, "large"),
], default="other")
PRICE_RULE = Rule("price_class", "price_class", [Condition("price", "lt", 950, "low"), Condition("price", "gte", 1000, "high")])


@query("rule_first_match_batch", ctes(p=PARTS) + """
SELECT part_id, CASE WHEN size <= 5 THEN 'tiny' WHEN size BETWEEN 6 AND 15 THEN 'small' WHEN kind IN ('PROMO', 'ECONOMY') THEN 'offer'
  WHEN contains(name, 'ring') THEN 'ring' WHEN size > 40 THEN 'large' ELSE 'other' END AS size_class,
  CASE WHEN price < 950 THEN 'low' WHEN price >= 1000 THEN 'high' END AS price_class FROM p""")
def rule_first_match_batch(spark, sf):
    return rules.apply_rules(PARTS.df(spark, sf), SIZE_RULE, PRICE_RULE).select("part_id", "size_class", "price_class")


@query("rule_all_with_reasons", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity <= 40 AND l_discount <= 0.08 AND l_tax < 0.07 AND l_returnflag <> 'R' AS ok,
  concat_ws(';', CASE WHEN NOT l_quantity <= 40 THEN 'quantity' END, CASE WHEN NOT l_discount <= 0.08 THEN 'discount' END,
            CASE WHEN NOT l_tax < 0.07 THEN 'tax' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS ok_reasons
FROM lineitem""")
def rule_all_with_reasons(spark, sf):
    rule = Rule("line_ok", "ok", [
        Condition("l_quantity", "lte", 40, reason="quantity"), Condition("l_discount", "lte", 0.08, reason="discount"),
        Condition("l_tax", "lt", 0.07, reason="tax"), Condition("l_returnflag", "ne", "R", reason="returned"),
    ], strategy="all")
    return rules.apply_rules(table(spark, sf, "lineitem"), rule).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ok", "ok_reasons"
    )


@query("rule_max_requirement", ctes(c=CUSTOMERS) + """
SELECT customer_id, CASE WHEN balance > 8000 OR tier = 'MACHINERY' THEN 'dual' WHEN nation_id < 10 OR tier = 'BUILDING' THEN 'loop' ELSE 'single' END AS mode
FROM c""")
def rule_max_requirement(spark, sf):
    rule = Rule("mode", "mode", [
        Condition("nation_id", "lt", 10, "loop"), Condition("balance", "gt", 8000, "dual"),
        Condition("tier", "eq", "BUILDING", "loop"), Condition("tier", "eq", "MACHINERY", "dual"),
    ], strategy="max_requirement", requirement_order=["single", "loop", "dual"], default="single")
    return rules.apply_rules(CUSTOMERS.df(spark, sf), rule).select("customer_id", "mode")


@query("rule_field_references", """
SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), lower(p_type)) OR p_size > n_nationkey + 20 THEN 'wide'
  WHEN len(list_distinct(string_split(p_name, ' '))) >= 2 AND p_size <= n_nationkey THEN 'fits' ELSE 'none' END AS verdict,
  (p_size >= 10 OR p_retailprice > 1000) AND (p_size > n_nationkey OR p_type = 'PROMO') AS gated
FROM part JOIN nation ON n_nationkey = p_partkey % 25""")
def rule_field_references(spark, sf):
    part = table(spark, sf, "part").withColumns({
        "words": F.split("p_name", " "), "kind": F.lower("p_type"), "nation": (F.col("p_partkey") % 25).cast("int"),
    })
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("nation"), F.col("n_nationkey").alias("Limit__low"), (F.col("n_nationkey") + 20).alias("Limit__high")
    )
    first = Rule("verdict", "verdict", [
        rules.parse_condition({"any": [
            {"field": "words", "operator": "contains_field", "value": "kind"},
            {"field": "p_size", "operator": "gt_field", "value": "Limit.high"},
        ], "result": "wide"}),
        rules.parse_condition({"all": [
            {"field": "words", "operator": "distinct_count_gte", "value": 2},
            {"field": "p_size", "operator": "lte_field", "value": "Limit.low"},
        ], "result": "fits"}),
    ], default="none")
    gated = Rule(
        "gated", "gated", [Condition("p_size", "gt_field", "Limit.low"), Condition("p_type", "eq", "PROMO")], strategy="gated_any",
        gate=rules.parse_condition({"any": [{"field": "p_size", "operator": "gte", "value": 10}, {"field": "p_retailprice", "operator": "gt", "value": 1000}]}),
    )
    return rules.apply_rules(part.join(nation, "nation"), first, gated).select("p_partkey", "verdict", "gated")


# --- guards ------------------------------------------------------------------------------

TRANSITIONS = {"O": ["P"], "P": ["F"], "F": []}
LINE_STATES = "SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_or(l_linestatus = 'F') THEN 'P' ELSE 'O' END AS new_status FROM lineitem GROUP BY 1"


@query("guard_status_transitions", f"""
WITH n AS ({LINE_STATES})
SELECT o_orderkey, o_orderstatus AS old_status, new_status,
  o_orderstatus = new_status OR (o_orderstatus = 'O' AND new_status = 'P') OR (o_orderstatus = 'P' AND new_status = 'F') AS allowed
FROM orders JOIN n ON l_orderkey = o_orderkey""")
def guard_status_transitions(spark, sf):
    done = F.col("l_linestatus") == "F"
    state = F.when(F.bool_and(done), "F").when(F.bool_or(done), "P").otherwise("O")
    fresh = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(state.alias("new_status"))
    j = table(spark, sf, "orders").join(fresh, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(
        "o_orderkey", F.col("o_orderstatus").alias("old_status"), "new_status",
        guards.transition_allowed(F.col("o_orderstatus"), F.col("new_status"), TRANSITIONS).alias("allowed"),
    )


@query("guard_constraints", ctes(o=ORDERS) + """
SELECT order_id, concat_ws(';', CASE WHEN status = 'F' THEN 'closed orders stay' END, CASE WHEN priority = '5-LOW' AND status = 'P' THEN 'low priority waits' END) AS reasons
FROM o""")
def guard_constraints(spark, sf):
    declared = [
        {"when": {"status": "F"}, "excluded_functions": ["dispatch", "cancel"], "reason": "closed orders stay"},
        {"when": {"priority": "5-LOW", "status": "P"}, "excluded_functions": ["dispatch"], "reason": "low priority waits"},
        {"when": {"status": "O"}, "excluded_functions": ["archive"], "reason": "open"},
    ]
    return ORDERS.df(spark, sf).select("order_id", guards.exclusion_reasons("dispatch", [], declared).alias("reasons"))


@query("guard_preconditions", """
SELECT o_orderkey, o_orderstatus FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'F')
  AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag IN ('A', 'N'))
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND nullif(l_tax, 0.0) IS NOT NULL AND l_quantity > 45)""")
def guard_preconditions(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    heavy = lines.filter("l_quantity > 45").withColumn("tax", F.nullif("l_tax", F.lit(0.0)))
    return guards.meets_preconditions(orders, "o_orderkey", [
        (lines, {"field": "l_linestatus", "operator": "eq", "value": "F"}),
        (lines, {"field": "l_returnflag", "operator": "in", "value": ["A", "N"]}),
        (heavy, {"field": "tax", "operator": "not_exists"}),
    ])


@query("guard_sla", """
WITH s AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, shipped, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 1 DAY WHEN o_orderpriority = '2-HIGH' THEN o_orderdate + INTERVAL 240 HOUR
        WHEN o_orderpriority <> '5-LOW' THEN o_orderdate + INTERVAL 60 DAY END AS deadline FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT o_orderkey, deadline, CASE WHEN deadline IS NULL THEN 'no_deadline' WHEN shipped IS NULL THEN 'open' WHEN shipped <= deadline THEN 'met' ELSE 'breached' END AS sla_status FROM d""")
def guard_sla(spark, sf):
    shipped = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    j = table(spark, sf, "orders").join(shipped, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    declared = [
        {"when": {"o_orderpriority": "1-URGENT"}, "deadline": "o_orderdate + 1d"},
        {"when": {"o_orderpriority": "2-HIGH"}, "deadline": "o_orderdate + 240h"},
        {"when": {"o_orderpriority": "3-MEDIUM"}, "deadline": "o_orderdate + 60d"},
        {"when": {"o_orderpriority": "4-NOT SPECIFIED"}, "deadline": "o_orderdate + 86400m"},
    ]
    return guards.check_sla(j, declared, "shipped").select("o_orderkey", "deadline", "sla_status")


@query("workflow_next_step", ctes(o=ORDERS) + """
SELECT order_id, status AS step, priority AS outcome, CASE status WHEN 'O' THEN 'P'
  WHEN 'P' THEN CASE priority WHEN '1-URGENT' THEN 'F' WHEN '2-HIGH' THEN 'O' ELSE 'P' END END AS next_step FROM o""")
def workflow_next_step(spark, sf):
    steps = [{"name": "O"}, {"name": "P", "next": {"1-URGENT": "F", "2-HIGH": "O"}}, {"name": "F"}]
    o = ORDERS.df(spark, sf).select("order_id", F.col("status").alias("step"), F.col("priority").alias("outcome"))
    return o.withColumn("next_step", guards.next_step(steps, F.col("step"), F.col("outcome")))


# --- profile tools -----------------------------------------------------------------------


@query("profile_distribution", "SELECT o_orderstatus, o_orderpriority, count(*) AS row_count FROM orders GROUP BY ALL")
def profile_distribution(spark, sf):
    return profile.distribution(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("profile_pivot", f"""
SELECT l_linestatus, {money("CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END")} AS "l_returnflag_A",
  {money("CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END")} AS "l_returnflag_N",
  {money("CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END")} AS "l_returnflag_R" FROM lineitem GROUP BY 1""")
def profile_pivot(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    out = profile.pivot_sum(table(spark, sf, "lineitem"), ["l_linestatus"], "l_returnflag", ["A", "N", "R"], price)
    return out.select("l_linestatus", *[F.col(f"l_returnflag_{v}").cast("double").alias(f"l_returnflag_{v}") for v in "ANR"])


@query("profile_describe", ctes(c=CUSTOMERS) + " UNION ALL ".join(
    f"SELECT '{f}' AS field, count({f}) AS value_count, count(*) - count({f}) AS null_count, CAST(min({f}) AS VARCHAR) AS min_value, CAST(max({f}) AS VARCHAR) AS max_value FROM c"
    for f in ("customer_id", "name", "segment", "nation_id")
))
def profile_describe(spark, sf):
    return profile.describe(CUSTOMERS.df(spark, sf), ["customer_id", "name", "segment", "nation_id"])


# --- ordered dedupe, as-of, brackets -----------------------------------------------------

LINE_ORDER = "l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity"


def _pick_sql(direction: str) -> str:
    order = LINE_ORDER if direction == "ASC" else ", ".join(f"{c.strip()} DESC" for c in LINE_ORDER.split(","))
    return f"""SELECT l_orderkey, l_returnflag, l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {order}) = 1"""


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", *[c.strip() for c in LINE_ORDER.split(",")])


@query("dedupe_first_wins", _pick_sql("ASC"))
def dedupe_first_wins(spark, sf):
    return grouping.first_wins(_lines(spark, sf), ["l_orderkey", "l_returnflag"], [c.strip() for c in LINE_ORDER.split(",")])


@query("dedupe_last_wins", _pick_sql("DESC"))
def dedupe_last_wins(spark, sf):
    return grouping.last_wins(_lines(spark, sf), ["l_orderkey", "l_returnflag"], [c.strip() for c in LINE_ORDER.split(",")])


@query("dedupe_strongest", """
SELECT l_partkey, l_suppkey, l_discount, o FROM (SELECT l_partkey, l_suppkey, l_discount, l_orderkey * 10 + l_linenumber AS o FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_discount DESC, o) = 1""")
def dedupe_strongest(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return grouping.strongest(rows, ["l_partkey", "l_suppkey"], "l_discount", "o")


@query("dedupe_with_count", """
SELECT p_name, min(p_partkey) AS p_partkey, count(*) AS duplicates FROM part GROUP BY 1""")
def dedupe_with_count(spark, sf):
    rows = table(spark, sf, "part").select("p_name", "p_partkey")
    return grouping.with_duplicate_count(rows, ["p_name"], ["p_partkey"], "duplicates")


VERSIONS = View("orders", {
    "customer_id": "o_custkey", "version_id": "o_orderkey", "rate": "o_totalprice",
    "effective_date": "case when o_orderpriority = '5-LOW' then '' else cast(cast(o_orderdate as date) as string) end",
    "expiry_date": "case when o_orderstatus = 'O' then '' else concat(cast(cast(year(o_orderdate) as int) + 1 as string), '-06-30') end",
})


@query("asof_effective", ctes(v=VERSIONS) + """
SELECT customer_id, version_id, rate, effective_date, expiry_date FROM v
WHERE (effective_date = '' OR effective_date <= '1998-03-15') AND (expiry_date = '' OR expiry_date >= '1998-03-15')
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY effective_date DESC, version_id DESC) = 1""")
def asof_effective(spark, sf):
    return temporal.select_effective(VERSIONS.df(spark, sf), ["customer_id"], "1998-03-15", tiebreak=["version_id"])


@query("asof_period_rule", ctes(v=VERSIONS) + """
SELECT customer_id, version_id, rate, effective_date FROM v WHERE effective_date = '' OR effective_date <= '1997-06'
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY effective_date DESC, version_id DESC) = 1""")
def asof_period_rule(spark, sf):
    rows = VERSIONS.df(spark, sf).select("customer_id", "version_id", "rate", "effective_date")
    return temporal.select_period_rule(rows, ["customer_id"], "1997-06", "effective_date", ["version_id"])


@query("bracket_lookup", """
WITH b AS (SELECT n_nationkey * 15000.0::DOUBLE AS lo, CASE WHEN n_nationkey < 24 THEN (n_nationkey + 1) * 15000.0::DOUBLE END AS hi, n_name FROM nation)
SELECT o_orderkey, o_totalprice, (SELECT n_name FROM b WHERE o_totalprice >= lo AND (hi IS NULL OR o_totalprice <= hi) ORDER BY lo LIMIT 1) AS bracket FROM orders""")
def bracket_lookup(spark, sf):
    last = F.col("n_nationkey") < 24
    brackets = table(spark, sf, "nation").select(
        (F.col("n_nationkey") * 15000.0).alias("lo"), F.when(last, (F.col("n_nationkey") + 1) * 15000.0).alias("hi"),
        F.col("n_name").alias("bracket"),
    )
    return temporal.bracket_lookup(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", brackets, "lo", "hi", ["bracket"])


@query("bracket_join_large", """
WITH e AS (SELECT DISTINCT p_retailprice * 400 AS lo FROM part), b AS (SELECT lo, lead(lo) OVER (ORDER BY lo) AS hi FROM e)
SELECT o_orderkey, o_totalprice, coalesce(m.lo, (SELECT max(lo) FROM b)) AS bracket_lo FROM orders LEFT JOIN LATERAL (
  SELECT min(lo) AS lo FROM b WHERE o_totalprice >= b.lo AND (b.hi IS NULL OR o_totalprice <= b.hi)) m ON true""")
def bracket_join_large(spark, sf):
    edges = table(spark, sf, "part").select((F.col("p_retailprice") * 400).alias("lo")).distinct()
    # Upper bound of a bracket is the next lower bound; both sit in one small sorted run per value range.
    ranked = sequences.previous_value(
        edges.withColumns({"k": F.lit(0), "neg": -F.col("lo")}), ["k"], ["neg"], "lo", "hi", F.floor(F.col("neg") / 1000)
    )
    brackets = ranked.select("lo", "hi", F.col("lo").alias("bracket_lo"))
    return temporal.bracket_lookup(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", brackets, "lo", "hi", ["bracket_lo"])


# --- sequences ---------------------------------------------------------------------------


@query("sequence_running_total", """
SELECT event_id, user_id, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_value FROM events""")
def sequence_running_total(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    out = sequences.running_total(e, ["user_id"], "event_id", F.col("value").cast("decimal(18,2)"), "running_value", F.floor(F.col("event_id") / 1024))
    return out.select("event_id", "user_id", F.col("running_value").cast("double").alias("running_value"))


@query("sequence_position_gaps", """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, prev FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS prev FROM d) WHERE l_linenumber - prev <> 1""")
def sequence_position_gaps(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    out = sequences.previous_value(d, ["l_orderkey"], ["l_linenumber"], "l_linenumber", "prev", F.floor(F.col("l_linenumber") / 1024))
    return out.filter(F.col("l_linenumber") - F.col("prev") != 1)


@query("sequence_neighbours", """
WITH h AS (SELECT conv_id, turn FROM conversations WHERE contains(text, 'que'))
SELECT DISTINCT c.conv_id, c.turn, c.role, length(c.text) AS chars FROM conversations c JOIN h ON h.conv_id = c.conv_id AND abs(c.turn - h.turn) <= 1""")
def sequence_neighbours(spark, sf):
    rows = table(spark, sf, "conversations")
    hits = filters.apply_filters(rows, {"text__like": "que"})
    out = sequences.neighbours(hits, rows, ["conv_id"], "turn", 1)
    return out.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("chars"))


@query("sequence_budget", """
SELECT conv_id, turn, CAST(running AS BIGINT) AS running_size FROM (SELECT conv_id, turn, SUM(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS running FROM conversations) WHERE running <= 1500""")
def sequence_budget(spark, sf):
    rows = table(spark, sf, "conversations")
    out = sequences.within_budget(rows, ["conv_id"], "turn", F.length("text").cast("bigint"), 1500, F.floor(F.col("turn") / 1024))
    return out.select("conv_id", "turn", "running_size")


@query("topk_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def topk_per_group(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordering.top_per_group(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


# --- changes -----------------------------------------------------------------------------

BASE = View("orders", {"id": "o_orderkey", "status": "o_orderstatus", "amount": "o_totalprice", "owner": "o_custkey"}, "o_orderpriority <> '5-LOW'")
PATCH = View("orders", {
    "id": "o_orderkey", "status": "case when o_orderstatus = 'P' then 'F' else o_orderstatus end",
    "amount": "case when o_orderstatus = 'O' then o_totalprice + 1 else o_totalprice end", "owner": "o_custkey",
}, "o_orderpriority <> '1-URGENT'")


@query("mutate_upsert", ctes(b=BASE, p=PATCH) + "SELECT * FROM p UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM p)")
def mutate_upsert(spark, sf):
    return reconcile.upsert(BASE.df(spark, sf), PATCH.df(spark, sf), ["id"])


@query("reconcile_diff", ctes(b=BASE, p=PATCH) + """
SELECT coalesce(b.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'missing_expected' WHEN b.id IS NULL THEN 'missing_generated' ELSE 'changed' END AS status,
  CASE WHEN b.id IS NULL OR p.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.status <> p.status THEN 'status' END, CASE WHEN b.amount <> p.amount THEN 'amount' END) END AS changed_fields
FROM b FULL JOIN p ON b.id = p.id WHERE b.id IS NULL OR p.id IS NULL OR b.status <> p.status OR b.amount <> p.amount""")
def reconcile_diff(spark, sf):
    return reconcile.diff(BASE.df(spark, sf), PATCH.df(spark, sf), ["id"], ["status", "amount"])


@query("sync_actions", ctes(b=BASE, p=PATCH) + """
SELECT coalesce(b.id, p.id) AS id, CASE WHEN b.id IS NULL THEN 'add' WHEN p.id IS NULL THEN 'delete' WHEN abs(b.amount - p.amount) <= 1e-6 THEN 'keep' ELSE 'update' END AS action
FROM b FULL JOIN p ON b.id = p.id""")
def sync_actions(spark, sf):
    return reconcile.sync_actions(BASE.df(spark, sf), PATCH.df(spark, sf), ["id"], "amount", 1e-6)


@query("sync_apply", ctes(b=BASE, p=PATCH) + """
SELECT p.* FROM p LEFT JOIN b USING (id) WHERE b.id IS NULL OR abs(b.amount - p.amount) > 1e-6
UNION ALL SELECT b.* FROM b JOIN p USING (id) WHERE abs(b.amount - p.amount) <= 1e-6""")
def sync_apply(spark, sf):
    stored, listing = BASE.df(spark, sf), PATCH.df(spark, sf)
    actions = reconcile.sync_actions(stored, listing, ["id"], "amount", 1e-6)
    return reconcile.apply_sync(stored, listing, actions, ["id"])
