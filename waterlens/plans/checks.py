"""Rule checks and comparisons over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import differs, strict_max
from ..functions.text import change_text
from ..operators import relational as rel
from ..operators import rules
from ..session import table
from .registry import query

RULES = [
    rules.Rule("customer", "c_custkey", rules.without("orders", "c_custkey", "o_custkey"), "customer without orders"),
    rules.Rule("supplier", "s_suppkey", rules.where("s_acctbal < 0"), "supplier balance below zero"),
    rules.Rule("part", "p_partkey", rules.where("p_size IS NULL OR p_size > 45"), "part size out of range"),
    rules.Rule("orders", "o_orderkey", rules.where("abs(o_totalprice - 1000) < 500"), "order price near 1000"),
    rules.Rule("orders", "o_orderkey", rules.where("o_orderstatus = 'F' AND o_orderdate >= timestamp'1997-01-01'"), "closed order in open period"),
    rules.Rule("lineitem", "l_orderkey", rules.where("l_discount > 0.09 AND l_tax > 0.07"), "line with high discount and tax"),
    rules.Rule("nation", "n_nationkey", rules.where("n_nationkey = n_regionkey"), "concat('nation ', n_name, ' equals its region')", is_sql=True),
]


@query("""
    SELECT 'customer' AS table_name, CAST(c_custkey AS BIGINT) AS id, 'customer without orders' AS error
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL
    UNION ALL SELECT 'supplier', s_suppkey, 'supplier balance below zero' FROM supplier WHERE s_acctbal < 0
    UNION ALL SELECT 'part', p_partkey, 'part size out of range' FROM part WHERE p_size IS NULL OR p_size > 45
    UNION ALL SELECT 'orders', o_orderkey, 'order price near 1000' FROM orders WHERE abs(o_totalprice - 1000) < 500
    UNION ALL SELECT 'orders', o_orderkey, 'closed order in open period' FROM orders
    WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01'
    UNION ALL SELECT 'lineitem', l_orderkey, 'line with high discount and tax' FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07
    UNION ALL SELECT 'nation', n_nationkey, 'nation ' || n_name || ' equals its region' FROM nation WHERE n_nationkey = n_regionkey""")
def check_rules_union(spark, d):
    return rules.run_rules({n: table(spark, d, n) for n in ("customer", "orders", "supplier", "part", "lineitem", "nation")}, RULES)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_missing_child(spark, d):
    return rel.missing_children(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey").select("o_orderkey", "o_custkey")


@query("""
    SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (
      SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_quantity > 40
      UNION ALL SELECT l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL
      UNION ALL SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F')""")
def not_in_union_endpoints(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    used = lines.where("l_quantity > 40").select(F.col("l_partkey").alias("k")).union(lines.select("l_suppkey")).union(orders.where("o_orderstatus = 'F'").select("o_custkey"))
    return table(spark, d, "part").join(used.where("k IS NOT NULL"), F.col("p_partkey") == F.col("k"), "left_anti").select("p_partkey", "p_name")


@query("""
    SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (
      SELECT o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))""")
def nested_in_not_in(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    clean = table(spark, d, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return table(spark, d, "customer").join(clean, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("""
    SELECT c_custkey, n_nationkey, s_nationkey FROM customer
    LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3
    LEFT JOIN supplier ON c_custkey = s_suppkey WHERE n_nationkey IS DISTINCT FROM s_nationkey""")
def null_safe_mismatch(spark, d):
    nation, supplier = table(spark, d, "nation").where("n_regionkey < 3"), table(spark, d, "supplier")
    joined = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(supplier, F.col("c_custkey") == F.col("s_suppkey"), "left")
    return joined.where(differs(F.col("n_nationkey"), F.col("s_nationkey"))).select("c_custkey", "n_nationkey", "s_nationkey")


@query("""
    SELECT c_custkey, c_acctbal, s_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
    WHERE CASE WHEN c_acctbal IS NOT NULL AND s_acctbal IS NOT NULL THEN greatest(c_acctbal, s_acctbal) END > 5000""")
def strict_max_filter(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left")
    return joined.where(strict_max(F.col("c_acctbal"), F.col("s_acctbal")) > 5000).select("c_custkey", "c_acctbal", "s_acctbal")


@query("""
    SELECT l_orderkey, l_linenumber, cn.n_name AS customer_nation, sn.n_name AS supplier_nation
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
    WHERE cn.n_name IS DISTINCT FROM sn.n_name""")
def double_lookup_join(spark, d):
    nation = table(spark, d, "nation")
    ends = [nation.select(F.col("n_nationkey").alias(f"{p}_key"), F.col("n_name").alias(f"{p}_nation")) for p in ("customer", "supplier")]
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    joined = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(ends[0], F.col("c_nationkey") == F.col("customer_key"), "left").join(ends[1], F.col("s_nationkey") == F.col("supplier_key"), "left")
    return joined.where(differs(F.col("customer_nation"), F.col("supplier_nation"))).select("l_orderkey", "l_linenumber", "customer_nation", "supplier_nation")


@query("""
    SELECT l_orderkey, l_linenumber, s_suppkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_partkey OR s_suppkey = l_suppkey""")
def theta_or_join(spark, d):
    return rel.any_key_join(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], table(spark, d, "supplier"), "s_suppkey").select("l_orderkey", "l_linenumber", "s_suppkey", "s_name")


@query("""
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey, l_suppkey) > 1 AS is_duplicated,
      CAST(row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS INTEGER) AS occurrence FROM lineitem""")
def duplicate_flag(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return rel.flag_duplicates(lines, ["l_partkey", "l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query("""
    WITH m AS (SELECT o_custkey AS k, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
               FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2)
    SELECT o_custkey, o_orderkey, o_orderpriority, v AS mode_value FROM orders JOIN m ON o_custkey = k AND rn = 1
    WHERE o_orderpriority <> v OR o_orderpriority IS NULL""")
def mode_outliers(spark, d):
    return rel.mode_outliers(table(spark, d, "orders"), "o_custkey", "o_orderpriority").select("o_custkey", "o_orderkey", "o_orderpriority", "mode_value")


def _two_sources(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("code"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    a = orders.where("code % 3 <> 0")
    b = orders.where("code % 4 <> 0").withColumn("kind", F.when(F.col("code") % 5 == 0, "1-URGENT").otherwise(F.col("kind"))).withColumn("price", F.when(F.col("code") % 7 == 0, F.col("price") + 250.0).otherwise(F.col("price")))
    return rel.outer_compare(a, b, "code")


_SOURCES = """
    WITH o AS (SELECT o_orderkey AS code, o_orderpriority AS kind, o_totalprice AS price, o_orderstatus AS status FROM orders),
    a AS (SELECT * FROM o WHERE code % 3 <> 0),
    b AS (SELECT code, CASE WHEN code % 5 = 0 THEN '1-URGENT' ELSE kind END AS kind, CASE WHEN code % 7 = 0 THEN price + 250.0 ELSE price END AS price, status
          FROM o WHERE code % 4 <> 0),
    c AS (SELECT coalesce(a.code, b.code) AS code, CASE WHEN b.code IS NULL THEN 'A' WHEN a.code IS NULL THEN 'B' ELSE 'AB' END AS in_both,
          a.kind AS kind_a, b.kind AS kind_b, a.price AS price_a, b.price AS price_b, coalesce(a.status, b.status) AS status
          FROM a FULL OUTER JOIN b ON a.code = b.code)"""


@query(_SOURCES + """
    SELECT code, in_both, CASE WHEN kind_a IS NULL AND kind_b IS NULL THEN NULL WHEN kind_a IS NOT DISTINCT FROM kind_b THEN 'not changed'
      ELSE coalesce(kind_a, 'None') || ' -> ' || coalesce(kind_b, 'None') END AS kind_change FROM c""")
def outer_compare(spark, d):
    return _two_sources(spark, d).select("code", "in_both", change_text(F.col("kind_A"), F.col("kind_B")).alias("kind_change"))


COMPARISONS = [
    {"type": "numeric", "name": "price_change", "left": "price_A", "right": "price_B", "threshold": 100.0, "priority": "warning"},
    {"type": "numeric", "name": "scaled", "left": {"divide": ["price_A", 1000]}, "right": {"max": [{"divide": ["price_B", 1000]}, 2]}, "threshold": 0.5, "priority": "critical"},
    {"type": "category", "name": "kind_change", "left": "kind_A", "right": "kind_B", "priority": "info"},
]


@query(_SOURCES + """,
    n AS (SELECT code, in_both, kind_a, kind_b,
      CASE WHEN price_a IS NULL AND price_b IS NULL THEN NULL WHEN abs(coalesce(price_b, 0) - coalesce(price_a, 0)) < 100 THEN 0.0
        ELSE coalesce(price_b, 0) - coalesce(price_a, 0) END AS pc,
      price_a / 1000 AS l, CASE WHEN price_b IS NOT NULL THEN greatest(price_b / 1000, 2.0) END AS r FROM c),
    s AS (SELECT *, CASE WHEN l IS NULL AND r IS NULL THEN NULL WHEN abs(coalesce(r, 0) - coalesce(l, 0)) < 0.5 THEN 0.0
        ELSE coalesce(r, 0) - coalesce(l, 0) END AS sc FROM n)
    SELECT code, in_both, round(pc, 6) AS price_change, round(sc, 6) AS scaled,
      CASE WHEN in_both <> 'AB' THEN NULL WHEN kind_a = kind_b THEN 'not changed' ELSE kind_a || ' -> ' || kind_b END AS kind_change,
      CAST(in_both = 'AB' AND kind_a <> kind_b AS BIGINT) AS n_info, CAST(coalesce(abs(pc) > 0, FALSE) AS BIGINT) AS n_warning,
      CAST(coalesce(abs(sc) > 0, FALSE) AS BIGINT) AS n_critical FROM s""")
def numeric_rule_compiler(spark, d):
    found = rules.apply_comparisons(_two_sources(spark, d), COMPARISONS)
    return found.select("code", "in_both", F.round("price_change", 6).alias("price_change"), F.round("scaled", 6).alias("scaled"), "kind_change", "n_info", "n_warning", "n_critical")


@query(_SOURCES + """
    SELECT status, CAST(count(*) FILTER (WHERE in_both IN ('A', 'AB')) AS BIGINT) AS count_a, CAST(count(*) FILTER (WHERE in_both IN ('B', 'AB')) AS BIGINT) AS count_b,
      CAST(count(*) FILTER (WHERE in_both = 'AB') AS BIGINT) AS count_both, round(coalesce(sum(price_a), 0), 2) AS sum_a, round(coalesce(sum(price_b), 0), 2) AS sum_b,
      round(coalesce(sum(price_b), 0) - coalesce(sum(price_a), 0), 2) AS sum_difference FROM c GROUP BY status""")
def compare_statistics(spark, d):
    both = _two_sources(spark, d).withColumn("status", F.coalesce("status_A", "status_B"))
    found = rules.compare_statistics(both, ["status"], "price_A", "price_B")
    return found.select("status", "count_a", "count_b", "count_both", *[F.round(c, 2).alias(c) for c in ("sum_a", "sum_b", "sum_difference")])


@query("""
    WITH f AS (SELECT o_custkey AS id, 1 AS rule_id, 'order over 400000' AS message FROM orders WHERE o_totalprice > 400000
      UNION ALL SELECT c_custkey, 2, 'balance below zero' FROM customer WHERE c_acctbal < 0
      UNION ALL SELECT c_custkey, 3, 'segment ' || c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'),
    x AS (SELECT f.*, fix FROM f LEFT JOIN (VALUES (1, 'split order'), (2, 'call customer')) v(rule_id, fix) ON f.rule_id = v.rule_id)
    SELECT id, CAST(count(*) AS BIGINT) AS n_rules, string_agg(message, ';' ORDER BY rule_id) AS messages, coalesce(string_agg(fix, ';' ORDER BY rule_id), '') AS fixes
    FROM x GROUP BY id""")
def fix_report(spark, d):
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    one = lambda df, key, rule, message: df.select(F.array(key).alias("ids"), F.lit(rule).alias("rule_id"), message.alias("message"))
    found = one(orders.where("o_totalprice > 400000"), "o_custkey", 1, F.lit("order over 400000"))
    found = found.union(one(customers.where("c_acctbal < 0"), "c_custkey", 2, F.lit("balance below zero"))).union(one(customers.where("c_mktsegment = 'BUILDING'"), "c_custkey", 3, F.concat(F.lit("segment "), F.col("c_mktsegment"))))
    fixes = spark.sql("SELECT * FROM VALUES (1, 'split order'), (2, 'call customer') AS t(rule_id, fix)")
    return rules.fix_report(found, fixes)


@query("""
    SELECT l_partkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_parents FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def multi_parent_warn(spark, d):
    return rel.several_parents(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS step,
      coalesce(l_quantity >= lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), TRUE) AS ascending FROM lineitem""")
def ascending_profile(spark, d):
    found = rules.change_order(table(spark, d, "lineitem"), ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], "l_quantity")
    return found.select("l_orderkey", "l_linenumber", "step", F.coalesce(F.col("step") >= 0, F.lit(True)).alias("ascending"))
