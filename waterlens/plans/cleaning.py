"""Column clean-up, code families, control steps, raster look-ups and edge filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster, relational
from ..session import table
from .registry import query


@query("""
    WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' WHEN c_custkey % 4 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) || '.5' END AS number,
      CASE c_custkey % 3 WHEN 0 THEN 'no date' WHEN 1 THEN '2020-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') ELSE '2021-02-03 04:05:' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') END AS moment FROM customer)
    SELECT id, TRY_CAST(number AS DOUBLE) AS number, CAST(trunc(coalesce(TRY_CAST(number AS DOUBLE), -9999)) AS INTEGER) AS filled, strftime(TRY_CAST(moment AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS moment, moment[1:10] AS day,
      CAST(NULL AS VARCHAR) AS remark FROM t WHERE TRY_CAST(number AS DOUBLE) IS NOT NULL OR TRY_CAST(moment AS TIMESTAMP) IS NOT NULL""")
def coerced_columns(spark, d):
    """Texts as numbers and dates, what is none becomes null or a fill value; rows with neither go."""
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    number = F.when(key % 4 == 0, "unknown").when(key % 4 == 1, text).otherwise(F.concat(text, F.lit(".5")))
    day, second = F.lpad((key % 28 + 1).cast("string"), 2, "0"), F.lpad((key % 60).cast("string"), 2, "0")
    moment = F.when(key % 3 == 0, "no date").when(key % 3 == 1, F.concat(F.lit("2020-01-"), day)).otherwise(F.concat(F.lit("2021-02-03 04:05:"), second))
    given = table(spark, d, "customer").select(key.alias("id"), number.alias("number"), moment.alias("moment"))
    found = given.withColumns({
        "filled": relational.to_number(F.col("number"), -9999, "int"), "day": F.substring("moment", 1, 10),
        "number": relational.to_number(F.col("number")), "moment": F.date_format(relational.to_date(F.col("moment")), "yyyy-MM-dd HH:mm:ss"),
    })
    found = relational.drop_empty(found, ["number", "moment"])
    return relational.conform(found, {"id": "long", "number": "double", "filled": "int", "moment": "string", "day": "string", "remark": "string"}, required=["id"])


@query("""
    WITH t AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'KST-' WHEN 1 THEN 'KDU-' WHEN 2 THEN 'KDU-X' ELSE 'ZZ-' END || s_suppkey AS code FROM supplier)
    SELECT s_suppkey, s_suppkey % 5 AS inserted, code, CASE WHEN starts_with(code, 'KDU-X') THEN 'siphon' WHEN starts_with(code, 'KDU-') THEN 'culvert' ELSE 'weir' END AS family FROM t WHERE code NOT LIKE 'ZZ-%'""")
def code_families(spark, d):
    """Rows by the family of their code, and a column put at its place."""
    prefix = F.when(F.col("s_suppkey") % 4 == 0, "KST-").when(F.col("s_suppkey") % 4 == 1, "KDU-").when(F.col("s_suppkey") % 4 == 2, "KDU-X").otherwise("ZZ-")
    coded = table(spark, d, "supplier").select("s_suppkey", F.concat(prefix, F.col("s_suppkey").cast("string")).alias("code"))
    coded = relational.with_column_at(coded, 1, "inserted", F.col("s_suppkey") % 5)
    return relational.by_family(coded, "code", {"KST-": "weir", "KDU-": "culvert", "KDU-X": "siphon"})


@query("""
    WITH t AS (SELECT n_nationkey AS id, n_nationkey * 60 + 90 AS duration FROM nation), k AS (SELECT id, duration, unnest(range(0, 20)) AS n FROM t), s AS (SELECT id, duration, n * 120 AS step, n FROM k)
    SELECT id, CAST(max(least(step, duration)) AS BIGINT) AS last_step, count(*) AS n_steps, CAST(sum(least(step, duration)) AS BIGINT) AS total, max(id % 3 * 0.5 + 1.25) AS highest, round(max(id) * 3.6 / 3600000, 12) AS rain
    FROM s WHERE n = 0 OR (n - 1) * 120 < duration GROUP BY 1""")
def control_steps(spark, d):
    """Steps of a table control up to the first that passes the duration, which is held at it; the highest of a list of
    numbers in a text; mm/h as m/s."""
    given = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") * 60 + 90).cast("long").alias("duration"))
    given = given.withColumn("planned", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: (k * 120).cast("long")))
    steps = relational.until_limit(F.col("planned"), F.col("duration"))
    text = F.concat_ws(" ", F.lit("0.25"), (F.col("id") % 3 * 0.5 + 1.25).cast("string"), F.lit("1"))
    return given.select(
        "id", F.array_max(steps).alias("last_step"), F.size(steps).cast("long").alias("n_steps"), F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"),
        relational.largest_of_text(text).alias("highest"), F.round(F.col("id") * 3.6 / 3_600_000, 12).alias("rain"),
    )


_PIXELS = "SELECT l_orderkey AS px, l_linenumber AS py, l_quantity AS dem, l_suppkey AS label, l_partkey % 5 AS kind FROM lineitem"


@query(f"""
    WITH g AS (SELECT * FROM ({_PIXELS})), b AS (SELECT o_orderkey AS px, 1 AS built FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS level FROM supplier)
    SELECT px, py, round(dem + CASE WHEN b.px IS NOT NULL THEN 0.1 ELSE 0 END, 6) AS dem, CASE WHEN kind = 2 THEN NULL ELSE label END AS label, n.level AS level, round(CASE kind WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 7.5 WHEN 3 THEN 10 ELSE 10 END * (1 + label % 2), 6) AS damage
    FROM g LEFT JOIN b USING (px) LEFT JOIN n ON n.node = g.label""")
def terrain_layers(spark, d):
    """Ground raised at buildings, labels outside a mask, levels by node and damage by a curve of each land use."""
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("px"), F.col("l_linenumber").alias("py"), F.col("l_quantity").cast("double").alias("dem"), F.col("l_suppkey").alias("label"), (F.col("l_partkey") % 5).alias("kind"))
    buildings = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("px"))
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal").cast("double")).alias("level"))
    found = raster.raised(cells, buildings, ["px"], "dem", 0.1).join(nodes, F.col("label") == F.col("node"), "left")
    found = found.withColumn("use", (F.col("label") % 2).cast("long")).withColumn("label", F.when(F.col("kind") != 2, F.col("label")))
    curves = spark.sql("SELECT * FROM VALUES (0L, array(0D, 1D, 3D), array(0D, 5D, 10D)), (1L, array(0D, 1D, 3D), array(0D, 10D, 20D)) AS t(use, depths, damages)")
    return raster.damage_by_use(found, curves, "kind", "use").select("px", "py", F.round("dem", 6).alias("dem"), "label", "level", F.round("damage", 6).alias("damage"))


@query("""
    WITH n AS (SELECT s_suppkey AS node, CAST(s_suppkey % 11 AS DOUBLE) AS level, s_suppkey % 4 = 0 AS primary_node FROM supplier),
    e AS (SELECT ps.s_suppkey AS id, ps.s_suppkey AS u, ps.s_suppkey % 40 + 1 AS v, CAST(ps.s_suppkey % 9 * 50 AS DOUBLE) AS area, CAST(ps.s_suppkey % 5 + 1 AS DOUBLE) AS len FROM supplier ps)
    SELECT e.id, round(abs(a.level - b.level) / len, 6) AS gradient, coalesce(a.primary_node, false) AND coalesce(b.primary_node, false) AS is_primary FROM e
    LEFT JOIN n a ON a.node = u LEFT JOIN n b ON b.node = v WHERE area >= 100 AND abs(a.level - b.level) / len <= 1.5""")
def filtered_edges(spark, d):
    """Edges of enough area and not too steep, and whether both of their nodes are primary ones."""
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 11).cast("double").alias("level"), (F.col("s_suppkey") % 4 == 0).alias("primary_node"))
    key = F.col("s_suppkey")
    edges = table(spark, d, "supplier").select(key.alias("id"), key.alias("u"), (key % 40 + 1).alias("v"), (key % 9 * 50).cast("double").alias("area"), (key % 5 + 1).cast("double").alias("len"))
    found = relational.with_both_ends(edges, nodes, "node", ["level", "primary_node"], "u", "v")
    gradient = F.abs(F.col("level_u") - F.col("level_v")) / F.col("len")
    both = F.coalesce("primary_node_u", F.lit(False)) & F.coalesce("primary_node_v", F.lit(False))
    return found.where((F.col("area") >= 100) & (gradient <= 1.5)).select("id", F.round(gradient, 6).alias("gradient"), both.alias("is_primary"))
