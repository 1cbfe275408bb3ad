"""Lines made of nodes, means at equal points, levels raised to a common maximum, columns with defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational, spatial
from ..session import table
from .registry import query


def _nodes(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("id"), (key * 37 % 100).cast("double").alias("x"), (key * 91 % 101).cast("double").alias("y"))


@query("""
    WITH n AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 100 AS DOUBLE) AS x, CAST(c_custkey * 91 % 101 AS DOUBLE) AS y FROM customer),
    l AS (SELECT o_orderkey, o_custkey AS a, o_orderkey * 7 % (SELECT max(c_custkey) + 20 FROM customer) AS b FROM orders)
    SELECT o_orderkey, s.x AS x1, s.y AS y1, e.x AS x2, e.y AS y2, round(sqrt((s.x - e.x) * (s.x - e.x) + (s.y - e.y) * (s.y - e.y)), 9) AS length
    FROM l JOIN n s ON a = s.id JOIN n e ON b = e.id WHERE s.x <> e.x OR s.y <> e.y
    UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL FROM l WHERE a NOT IN (SELECT id FROM n) OR b NOT IN (SELECT id FROM n)""")
def lines_between_nodes(spark, d):
    """The line of every order between two nodes, those of no length left out."""
    most = table(spark, d, "customer").agg(F.max("c_custkey").alias("most"))
    links = table(spark, d, "orders").crossJoin(F.broadcast(most)).select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_orderkey") * 7 % (F.col("most") + 20)).alias("b"))
    found = spatial.lines_of_nodes(links, _nodes(spark, d), "a", "b")
    first, last = F.col("line")[0], F.col("line")[1]
    return found.select("o_orderkey", first["x"].alias("x1"), first["y"].alias("y1"), last["x"].alias("x2"), last["y"].alias("y2"), F.round("length", 9).alias("length"))


@query("SELECT l_suppkey % 50 AS x, l_partkey % 20 AS y, round(avg(l_linenumber), 9) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
def mean_at_points(spark, d):
    """The mean of all values at the same point."""
    rows = table(spark, d, "lineitem")
    return rows.groupBy((F.col("l_suppkey") % 50).alias("x"), (F.col("l_partkey") % 20).alias("y")).agg(F.round(F.avg("l_linenumber"), 9).alias("mean"), F.count("*").alias("n"))


@query("""
    WITH t AS (SELECT c_custkey, c_nationkey, c_custkey * 37 % 1000 / 10.0 AS level, CASE WHEN c_custkey % 5 > 0 THEN c_custkey * 53 % 1000 / 10.0 END AS reference FROM customer)
    SELECT c_custkey, round(max(greatest(level, reference)) OVER () + 0.1, 2) AS over_all, round(max(greatest(level, reference)) OVER (PARTITION BY c_nationkey) + 0.1, 2) AS over_channel FROM t""")
def raised_levels(spark, d):
    """Levels raised to the highest of two columns, over all rows and over the rows of a channel."""
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", (key * 37 % 1000 / 10.0).alias("level"), F.when(key % 5 > 0, key * 53 % 1000 / 10.0).alias("reference"))
    found = relational.with_overall_max(rows, ["level", "reference"], "highest")
    found = relational.with_overall_max(found, ["level", "reference"], "of_channel", "c_nationkey")
    return found.select("c_custkey", F.round(F.col("highest") + 0.1, 2).alias("over_all"), F.round(F.col("of_channel") + 0.1, 2).alias("over_channel"))


@query("""
    SELECT s_suppkey AS id, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END, -1) AS area, coalesce(CASE WHEN s_suppkey % 4 > 0 THEN s_name END, 'none') AS label
    FROM supplier WHERE list_contains([1, 4, 7, 11], s_nationkey)""")
def defaults_of_settings(spark, d):
    """Columns under new names with defaults, of the rows whose key is in a list."""
    rows = table(spark, d, "supplier").where(F.array_contains(F.array(*map(F.lit, (1, 4, 7, 11))), F.col("s_nationkey").cast("int")))
    given = rows.select("s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey")).alias("area_id"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_name")).alias("s_name"))
    return relational.renamed_with_defaults(given, {"s_suppkey": "id", "area_id": "area", "s_name": "label"}, {"area": -1, "label": "none"})
