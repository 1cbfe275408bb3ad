"""Analyses of results, storage and attributes in full: marks of a simulation, storage rasters, change rules, fix reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster, rules, temporal
from ..session import table
from .checks import _SOURCES, _two_sources
from .registry import query

_STEPS = """l AS (SELECT user_id % 50 AS element, user_id % 5 AS k, event_id % 97 AS i, max(value) AS v FROM events GROUP BY ALL),
    rain AS (SELECT k, i AS hour, CASE WHEN i BETWEEN 30 + k AND 40 + 5 * k THEN 1.0 ELSE 0.0 END AS r FROM (SELECT DISTINCT k, i FROM l)),
    w AS (SELECT k, min(hour) FILTER (WHERE r > 0) AS a, max(hour) FILTER (WHERE r > 0) AS b, max(hour) AS n FROM rain GROUP BY 1),
    days AS (SELECT k, greatest((a - 1) / 24.0, 0) * 1440 AS s, greatest((n - b) / 24.0, 0) * 1440 AS e, n FROM w WHERE a IS NOT NULL),
    m AS (SELECT k, coalesce(min(hour) FILTER (WHERE hour * 60 > 0), 0) AS t0, coalesce(min(hour) FILTER (WHERE hour * 60 > s), 0) AS t1, coalesce(min(hour) FILTER (WHERE hour * 60 > n * 60 - e - 1440), 0) AS t2,
      coalesce(min(hour) FILTER (WHERE hour * 60 > n * 60 - e), 0) AS t3, n FROM rain JOIN days USING (k) GROUP BY k, n),
    marks AS (SELECT k, t0, t1, CASE WHEN t2 = 0 THEN n ELSE t2 - 1 END AS t2, CASE WHEN t3 = 0 THEN n ELSE t3 - 1 END AS t3, n AS t4 FROM m)"""


def _marks(spark, d):
    levels = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("element"), (F.col("user_id") % 5).alias("k"), (F.col("event_id") % 97).alias("i")).agg(F.max("value").alias("v"))
    rain = levels.select("k", "i").distinct().withColumn("r", F.when(F.col("i").between(30 + F.col("k"), 40 + 5 * F.col("k")), 1.0).otherwise(0.0))
    days = temporal.rain_days(rain, ["k"], "i", "r")
    return levels, temporal.result_marks(rain.withColumn("minutes", F.col("i") * 60), ["k"], "i", "minutes", days)


@query(f"WITH {_STEPS} SELECT k, t0 AS t_0, t1 AS t_start_rain, t2 AS t_end_rain_min_one, t3 AS t_end_rain, t4 AS t_end_sum FROM marks")
def simulation_marks(spark, d):
    """The steps at which a simulation starts, its rain starts and ends, and the last one."""
    return _marks(spark, d)[1]


@query(f"""WITH {_STEPS}, x AS (SELECT k, element, max(v) FILTER (WHERE i = t0) AS s0, max(v) FILTER (WHERE i = t1) AS s1, max(v) FILTER (WHERE i = t2) AS s2, max(v) FILTER (WHERE i = t3) AS s3, max(v) FILTER (WHERE i = t4) AS s4 FROM l JOIN marks USING (k) GROUP BY 1, 2)
    SELECT element, round(s1 - s0, 5) AS lvl_start, round(s3 - s1, 5) AS lvl_rain, round(s3 - s2, 5) AS lvl_end_rain, round(s4 - s0, 5) AS lvl_end FROM x""")
def simulation_rises(spark, d):
    """The rises of every node between those steps."""
    levels, marks = _marks(spark, d)
    found = temporal.level_rises(levels, ["k"], "element", "i", "v", marks)
    return found.select("element", *[F.round(c, 5).alias(c) for c in ("lvl_start", "lvl_rain", "lvl_end_rain", "lvl_end")])


_CURVES = "SELECT * FROM VALUES (0L, array(0D, 1D, 4D), array(0.1D, 0.2D, 0.3D), array(20D, 15D, 5D)), (1L, array(0D, 2D), array(0.05D, 0.15D), array(10D, 8D)) AS t(soil, depths, coefficients, root_zone)"
_TABLE = """c AS (SELECT s.range AS soil, n.range AS n, n.range * 0.01::DOUBLE AS d FROM range(2) s, range(1001) n),
    f AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN soil = 0 AND d <= 1 THEN 0.1 + d * 0.1 WHEN soil = 0 AND d <= 4 THEN 0.2 + (d - 1) / 30 WHEN soil = 0 THEN 0.3 WHEN d <= 2 THEN 0.05 + d * 0.05 ELSE 0.15 END AS sc,
      CASE WHEN soil = 0 AND d <= 1 THEN 20 - 5 * d WHEN soil = 0 AND d <= 4 THEN 15 - (d - 1) * 10 / 3 WHEN soil = 0 THEN 5 WHEN d <= 2 THEN 10 - d ELSE 8 END AS rz FROM c),
    t AS (SELECT soil, n, (CASE soil WHEN 0 THEN 20 ELSE 10 END - rz + sum(sc * 10) OVER (PARTITION BY soil ORDER BY n)) / 1000 AS storage FROM f)"""


@query(f"WITH {_TABLE} SELECT CAST(n_nationkey AS BIGINT) AS area, n, round(storage, 6) AS storage FROM nation JOIN t ON soil = n_nationkey % 2")
def storage_lookup(spark, d):
    """Storage of every area's soil at depths by hundredths of a metre."""
    areas = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("area"), F.col("n_nationkey") % 2).toDF("area", "soil").join(F.broadcast(spark.sql(_CURVES)), "soil")  # two curves
    return raster.storage_table(areas.drop("soil"), "area").select("area", "n", F.round("storage", 6).alias("storage"))


@query(f"""WITH {_TABLE}, p AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS soil, l_quantity AS dem, CASE WHEN l_suppkey % 6 <> 0 THEN l_quantity - CAST(l_partkey % 1300 AS DOUBLE) / 100 + 1.00371234 END AS gw FROM lineitem),
    q AS (SELECT *, dem - gw AS x, least(floor(greatest(dem - gw, 0) / 0.01), 1000) AS n FROM p)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN gw IS NULL OR q.soil = 2 THEN NULL WHEN dem = 10 OR x < 0 THEN 0 ELSE coalesce(a.storage + (x / 0.01 - q.n) * (b.storage - a.storage), a.storage) END, 6) AS storage
    FROM q LEFT JOIN t a ON a.soil = q.soil AND a.n = q.n LEFT JOIN t b ON b.soil = q.soil AND b.n = q.n + 1""")
def storage_map(spark, d):
    """Storage in the ground of every pixel, by soil, ground and groundwater."""
    low = F.col("l_quantity") - (F.col("l_partkey") % 1300).cast("double") / 100 + 1.00371234
    pixels = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3).alias("soil"), F.col("l_quantity").alias("dem"), F.when(F.col("l_suppkey") % 6 != 0, low).alias("gw"))
    found = raster.storage_raster(pixels, raster.storage_table(spark.sql(_CURVES), "soil"), "soil", "dem", "gw")
    return found.select("l_orderkey", "l_linenumber", F.round("storage", 6).alias("storage"))


@query(_SOURCES + """,
    v AS (SELECT code, in_both, price_a - price_b AS d, (price_a IS NULL) <> (price_b IS NULL) AS turned, least(price_a, price_b) * 2 - 100 AS least_price,
      CASE WHEN in_both <> 'AB' THEN NULL WHEN kind_a = kind_b THEN 'not changed' ELSE kind_a || ' -> ' || kind_b END AS kind, in_both = 'AB' AND kind_a <> kind_b AS other FROM c)
    SELECT code, round(CASE WHEN abs(d) < 100 THEN 0 ELSE d END, 6) AS price, turned AS "price_change_NaN", CASE WHEN abs(d) >= 100 THEN 'warning' ELSE '' END AS price_priority, round(least_price, 6) AS least,
      CASE WHEN abs(least_price) >= 0.00001 THEN 'critical' ELSE '' END AS least_priority, kind, CASE WHEN other THEN 'info' END AS kind_priority FROM v""")
def attribute_changes(spark, d):
    """Comparison rules as function trees, with changes from and to null and default priorities."""
    found = rules.compare_attributes(_two_sources(spark, d), [
        {"name": "price", "type": "numeric", "threshold": 100, "priority": "warning", "function": {"difference": {"left": "price_A", "right": "price_B"}}},
        {"name": "least", "type": "numeric", "function": {"difference": {"left": {"multiply": {"left": {"minimum": {"left": "price_A", "right": "price_B", "skipna": True}}, "right": 2}}, "right": 100}}},
        {"name": "kind", "type": "category", "left": "kind_A", "right": "kind_B", "priority": "info"},
    ])
    return found.select("code", F.round("price", 6).alias("price"), "price_change_NaN", "price_priority", F.round("least", 6).alias("least"), "least_priority", "kind", "kind_priority")


@query("""
    WITH x AS (SELECT c_custkey, c_acctbal, c_nationkey, c_acctbal < 0 AS b1, c_nationkey < 5 AS b2, c_custkey % 4 = 0 AS b3 FROM customer),
    y AS (SELECT c_custkey, concat_ws(';', CASE WHEN b2 THEN 'W2:nation low' END, CASE WHEN b1 THEN 'C1:balance low' END) AS s, concat_ws(';', CASE WHEN b1 OR b2 THEN 'AF7:raise' END) AS f,
      concat_ws(';', CASE WHEN b2 THEN 'W2:nation low' END, CASE WHEN b3 THEN 'W3:key' END) AS s2, concat_ws(';', CASE WHEN b2 THEN 'MF8:look up' END, CASE WHEN b3 THEN 'MF9:renumber' END) AS f2, c_acctbal, c_nationkey FROM x)
    SELECT c_custkey, nullif(s, '') AS validation_sum_c_acctbal, nullif(f, '') AS fixes_c_acctbal, nullif(s2, '') AS validation_sum_c_nationkey, nullif(f2, '') AS fixes_c_nationkey,
      CASE WHEN f <> '' THEN c_acctbal END AS c_acctbal, CASE WHEN f2 <> '' THEN c_nationkey END AS c_nationkey FROM y WHERE f <> '' OR f2 <> ''""")
def attribute_fixes(spark, d):
    """Findings and fixes of every attribute side by side."""
    mark = lambda condition, text: F.when(F.expr(condition), text)
    layer = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", mark("c_acctbal < 0", "1").alias("invalid_critical"), F.concat_ws(";", mark("c_nationkey < 5", "2"), mark("c_custkey % 4 = 0", "3"), mark("c_custkey % 5 = 0", "99")).alias("invalid_non_critical"))
    fixes = spark.sql("""SELECT * FROM VALUES (0, 'c_acctbal', array(2L, 1L), 7, 'automatic', 'raise'), (1, 'c_nationkey', array(2L), 8, 'manual', 'look up'), (2, 'c_nationkey', array(3L), 9, 'manual', 'renumber')
        AS t(position, attribute, validation_ids, fix_id, fix_type, description)""")
    named = spark.sql("SELECT * FROM VALUES (1L, 'critical', 'balance low'), (2L, 'non-critical', 'nation low'), (3L, 'non-critical', 'key') AS t(id, error_type, message)")
    return rules.by_attribute(rules.attribute_report(layer, "c_custkey", fixes, named), layer, "c_custkey", ["c_acctbal", "c_nationkey"])
