"""Raster analyses on pixel tables made of table keys (x = key % 100, y = key div 100)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.curves import interpolate, present_value_factor
from ..operators import raster
from ..session import table
from .registry import query


def _pixels(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.select((F.col(key) % 100).alias("x"), F.expr(f"{key} div 100").alias("y"), value.alias("value"))


@query("""
    SELECT p_brand, CAST(grouping(p_brand) AS INTEGER) AS is_total, round(coalesce(sum(p_retailprice), 0), 2) AS zone_sum, count(p_retailprice) AS n_pixels FROM part GROUP BY ROLLUP (p_brand)""")
def zonal_sum(spark, d):
    return raster.zonal_sum(table(spark, d, "part"), "p_brand", "p_retailprice", total=True).withColumn("zone_sum", F.round("zone_sum", 2))


@query("SELECT p_type, min(p_retailprice) AS min, max(p_retailprice) AS max, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS std FROM part GROUP BY 1")
def raster_statistics(spark, d):
    found = raster.statistics(table(spark, d, "part"), ["p_type"], "p_retailprice")
    return found.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("""
    WITH b AS (SELECT n_regionkey AS region, s_suppkey % 6 AS blok, sum(abs(s_acctbal)) AS cost, count(*) * 10.0 AS volume FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
    t AS (SELECT region, blok, cost, volume FROM b UNION ALL SELECT NULL, blok, sum(cost), sum(volume) FROM b GROUP BY 2),
    f AS (SELECT region, blok, lead(cost) OVER w - cost AS dc, lead(volume) OVER w - volume AS dv FROM t WINDOW w AS (PARTITION BY region ORDER BY blok)),
    x AS (SELECT region, blok, CASE WHEN dv IS NOT NULL AND dv <> 0 THEN greatest(dc / dv, 0) END AS x, CASE blok WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 2.0 WHEN 3 THEN 5.0 WHEN 4 THEN 5.0 END AS w FROM f WHERE blok < 5),
    n AS (SELECT x.region, x.w, CASE WHEN g.x <> 0 THEN (g.x - x.x) / g.x END AS norm FROM x JOIN x g ON g.region IS NULL AND g.blok = x.blok)
    SELECT CAST(region AS BIGINT) AS region, round(sum(norm * w) / nullif(sum(CASE WHEN norm IS NOT NULL THEN w END), 0), 6) AS indicator FROM n GROUP BY 1""")
def incremental_indicator(spark, d):
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    block = joined.groupBy(F.col("n_regionkey").cast("long").alias("region"), (F.col("s_suppkey") % 6).alias("blok")).agg(F.sum(F.abs("s_acctbal")).alias("cost"), (F.count("*") * 10.0).alias("volume"))
    block = block.union(block.groupBy("blok").agg(F.sum("cost").alias("cost"), F.sum("volume").alias("volume")).select(F.lit(None).cast("long"), "blok", "cost", "volume"))
    for value, to in (("cost", "dc"), ("volume", "dv")):
        block = raster.forward_difference(block, ["region"], ["blok"], value, to)
    rate = F.greatest(F.col("dc") / F.nullif(F.col("dv"), F.lit(0.0)), F.lit(0.0))
    each = block.where("blok < 5").select("region", "blok", F.when(F.col("dv").isNotNull() & (F.col("dv") != 0), rate).alias("x"))
    total = each.where("region IS NULL").select(F.col("blok").alias("_b"), F.col("x").alias("all"))
    weight = F.element_at(F.array(*map(F.lit, (1.0, 2.0, 2.0, 5.0, 5.0))), (F.col("blok") + 1).cast("int"))
    norm = each.join(total, F.col("blok") == F.col("_b")).select("region", weight.alias("w"), ((F.col("all") - F.col("x")) / F.nullif(F.col("all"), F.lit(0.0))).alias("norm"))
    used = F.sum(F.when(F.col("norm").isNotNull(), F.col("w")))
    return norm.groupBy("region").agg(F.round(F.sum(F.col("norm") * F.col("w")) / F.nullif(used, F.lit(0.0)), 6).alias("indicator"))


_STACK = "s AS (SELECT l_partkey AS px, l_extendedprice / 10000 AS d, [0.1, 0.03, 0.01, 0.003, 0.001, 0.0003, 0.0001][CAST(l_linenumber AS INTEGER)] AS f FROM lineitem WHERE l_linenumber <= 7)"


def _stack(spark, d) -> DataFrame:
    frequency = F.element_at(F.array(*map(F.lit, (0.1, 0.03, 0.01, 0.003, 0.001, 0.0003, 0.0001))), F.col("l_linenumber").cast("int"))
    return table(spark, d, "lineitem").where("l_linenumber <= 7").select(F.col("l_partkey").alias("px"), (F.col("l_extendedprice") / 10000).alias("d"), frequency.alias("f"))


@query(f"""
    WITH {_STACK}, e AS (SELECT px, d, sum(f) OVER (PARTITION BY px ORDER BY d, f DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e,
        row_number() OVER (PARTITION BY px ORDER BY d, f DESC) - 1 AS i FROM s),
    n AS (SELECT px, count(*) AS n, greatest(count(*) FILTER (WHERE e > 0.01) - 1, 0) AS lo, coalesce(max(e) FILTER (WHERE d > 0), 0) AS wet FROM e GROUP BY 1),
    j AS (SELECT n.*, a.d AS d0, a.e AS e0, b.d AS d1, b.e AS e1 FROM n JOIN e a ON a.px = n.px AND a.i = lo JOIN e b ON b.px = n.px AND b.i = least(lo + 1, n - 1))
    SELECT px, round(CASE WHEN wet < 0.01 THEN NULL WHEN lo = 0 THEN NULL WHEN lo = n - 1 THEN d0 ELSE d0 + (ln(100.0) - ln(1 / e0)) / (ln(1 / e1) - ln(1 / e0)) * (d1 - d0) END, 8) AS depth_t100 FROM j""")
def exceedance_interpolation(spark, d):
    found = raster.exceedance_interpolate(_stack(spark, d), ["px"], "d", "f", 100.0)
    return found.select("px", F.round("value_at_period", 8).alias("depth_t100"))


@query(f"""
    WITH {_STACK} SELECT px, round(CASE WHEN sum(f * d) <= 1e-5 THEN 0 ELSE sum(f * d) END * ((1 - pow(1 - 0.04, 50)) / 0.04), 4) AS present_value FROM s GROUP BY 1""")
def present_value_damage(spark, d):
    found = raster.yearly_damage(_stack(spark, d), ["px"], "d", "f", factor=present_value_factor(0.04, 50))
    return found.select("px", F.round("yearly_damage", 4).alias("present_value"))


@query("""
    SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 5 THEN 1.0 WHEN l_quantity <= 20 THEN 1 + (l_quantity - 5) * (4.0 / 15) WHEN l_quantity <= 40 THEN 5 + (l_quantity - 20) * (-2.0 / 20)
      WHEN l_quantity IS NOT NULL THEN 3.0 END, 6) AS storage FROM lineitem""")
def linear_lookup(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(interpolate(F.col("l_quantity"), [5, 20, 40], [1, 5, 3]), 6).alias("storage"))


@query("""
    SELECT p_partkey, round(CASE WHEN p_size < 10 THEN 0.5 * p_size WHEN p_size < 30 THEN 5 + (p_size - 10) * 0.25 ELSE 10 END + least(p_partkey % 2, 1) * 1.0, 6) AS storage
    FROM part WHERE p_size IS NOT NULL""")
def soil_storage(spark, d):
    curves = spark.sql("SELECT * FROM VALUES (0L, array(0D, 10D, 30D), array(0D, 5D, 10D)), (1L, array(0D, 10D, 30D), array(1D, 6D, 11D)) AS t(soil, depths, storages)")
    pixels = table(spark, d, "part").where("p_size IS NOT NULL").select("p_partkey", (F.col("p_partkey") % 2).alias("soil"), F.col("p_size").cast("double").alias("at"))
    return raster.soil_storage(pixels, F.broadcast(curves), "soil", F.col("at")).select("p_partkey", F.round("storage", 6).alias("storage"))


@query("""
    SELECT l_partkey, l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM lineitem""")
def cumulative_storage(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return raster.cumulative(lines, ["l_partkey"], ["l_orderkey", "l_linenumber", "q"], F.col("q"), "total").drop("q")


@query("""
    WITH a AS (SELECT p_partkey % 100 AS x, p_partkey // 100 AS y, p_retailprice / 100 AS v FROM part), b AS (SELECT c_custkey % 100 AS x, c_custkey // 100 AS y, CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000 END AS g FROM customer)
    SELECT x, y, CASE WHEN (x + y) % 10 = 0 THEN 10.0 ELSE round(CASE WHEN v IS NOT NULL AND g IS NOT NULL THEN greatest(v - g, 0) END, 6) END AS value FROM a JOIN b USING (x, y)""")
def depth_raster(spark, d):
    level = _pixels(table(spark, d, "part"), "p_partkey", F.col("p_retailprice") / 100)
    ground = _pixels(table(spark, d, "customer"), "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 1000))
    depth = raster.depth(level, ground, ["x", "y"]).withColumn("value", F.round("value", 6))
    return raster.override(depth, (F.col("x") + F.col("y")) % 10 == 0)


@query("""
    WITH a AS (SELECT p_partkey % 100 AS x, p_partkey // 100 AS y, p_retailprice AS v FROM part),
    o(dx, dy) AS (SELECT * FROM (VALUES (-1), (0), (1)) p(dx), (VALUES (-1), (0), (1)) q(dy) WHERE dx <> 0 OR dy <> 0),
    s AS (SELECT x + dx AS x, y + dy AS y, v FROM a, o),
    m AS (SELECT x, y, avg(v) AS m, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT a.x, a.y, a.v AS value, round(m, 4) AS neighbour_mean, n AS n_neighbours FROM a LEFT JOIN m ON a.x = m.x AND a.y = m.y""")
def neighbour_mean(spark, d):
    found = raster.neighbour_mean(_pixels(table(spark, d, "part"), "p_partkey", F.col("p_retailprice")))
    return found.withColumn("neighbour_mean", F.round("neighbour_mean", 4))


@query("""
    SELECT tile, row_number() OVER (PARTITION BY tile ORDER BY p_partkey, v) - 1 AS at, round(v - avg(v) OVER (PARTITION BY tile), 4) AS value FROM (SELECT p_partkey // 100 AS tile, p_partkey, p_retailprice AS v FROM part)""")
def tile_map(spark, d):
    """A numpy function over tiles of 100 pixels: differences to the tile's mean."""
    tiles = table(spark, d, "part").groupBy(F.expr("p_partkey div 100").alias("tile")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_retailprice"))), lambda s: s["p_retailprice"]).alias("data"))
    found = raster.map_tiles(tiles, lambda v: v - v.mean()).select("tile", F.posexplode("data").alias("at", "value"))
    return found.select("tile", F.col("at").cast("long").alias("at"), F.round("value", 4).alias("value"))


@query("""
    WITH a AS (SELECT p_partkey % 100 AS x, p_partkey // 100 AS y, CAST(p_size % 5 AS DOUBLE) AS v FROM part), g AS (SELECT p_partkey % 100 AS x, p_partkey // 100 AS y, CASE WHEN p_partkey % 7 = 0 THEN 10.0 ELSE 1.0 END AS w FROM part WHERE p_partkey % 3 > 0)
    SELECT x, y, CASE WHEN v <> 0 AND (w IS NULL OR w <> 10) THEN v END AS value FROM a LEFT JOIN g USING (x, y)""")
def period_map(spark, d):
    """Values of a return period, without those on water and those that are 0."""
    parts = table(spark, d, "part")
    ground = _pixels(parts.where("p_partkey % 3 > 0"), "p_partkey", F.when(F.col("p_partkey") % 7 == 0, 10.0).otherwise(1.0))
    return raster.without_water(_pixels(parts, "p_partkey", (F.col("p_size") % 5).cast("double")), ground, ["x", "y"])


@query("""
    SELECT x // 4 AS px, y // 4 AS py, round(sum(v), 2) AS total FROM (SELECT p_partkey % 100 AS x, p_partkey // 100 AS y, p_retailprice AS v FROM part) GROUP BY 1, 2""")
def resample_sum(spark, d):
    found = raster.resample(_pixels(table(spark, d, "part"), "p_partkey", F.col("p_retailprice")), "x", "y", 4.0)
    return found.groupBy("px", "py").agg(F.round(F.sum("value"), 2).alias("total"))
