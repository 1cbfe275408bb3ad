"""Spatial and graph analyses on points and edges made of table keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, spatial
from ..session import table
from .registry import query


def _places(df, key: str, x: str, y: str):
    """Points spread over 0..1000 by fixed multiples of the key."""
    return df.select(F.col(key), (F.col(key) * 37 % 1000).cast("double").alias(x), (F.col(key) * 91 % 1009).cast("double").alias(y))


_CUSTOMERS = "a AS (SELECT c_custkey, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS lx, CAST(c_custkey * 91 % 1009 AS DOUBLE) AS ly FROM customer)"
_SUPPLIERS = "b AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS rx, CAST(s_suppkey * 91 % 1009 AS DOUBLE) AS ry FROM supplier)"


@query(f"WITH {_CUSTOMERS}, {_SUPPLIERS} SELECT c_custkey, s_suppkey, round(sqrt((lx - rx) ** 2 + (ly - ry) ** 2), 6) AS distance FROM a, b WHERE sqrt((lx - rx) ** 2 + (ly - ry) ** 2) <= 25")
def spatial_bucket_join(spark, d):
    left, right = _places(table(spark, d, "customer"), "c_custkey", "lx", "ly"), _places(table(spark, d, "supplier"), "s_suppkey", "rx", "ry")
    return spatial.within_distance(left, right, 25.0).select("c_custkey", "s_suppkey", F.round("distance", 6).alias("distance"))


@query(f"""
    WITH {_CUSTOMERS}, {_SUPPLIERS}, p AS (SELECT c_custkey, s_suppkey, sqrt((lx - rx) ** 2 + (ly - ry) ** 2) AS dist FROM a, b)
    SELECT c_custkey, arg_min(s_suppkey, (dist, s_suppkey)) AS s_suppkey, round(min(dist), 6) AS distance FROM p GROUP BY 1""")
def nearest_neighbour(spark, d):
    left, right = _places(table(spark, d, "customer"), "c_custkey", "lx", "ly"), _places(table(spark, d, "supplier"), "s_suppkey", "rx", "ry")
    return spatial.nearest(left, right, "c_custkey", ["s_suppkey"], 64.0, rounds=6).select("c_custkey", "s_suppkey", F.round("distance", 6).alias("distance"))


@query(f"""
    WITH {_CUSTOMERS}, {_SUPPLIERS}, p AS (SELECT c_custkey, s_suppkey, sqrt((lx - rx) ** 2 + (ly - ry) ** 2) AS dist FROM a, b WHERE c_custkey % 5 = s_suppkey % 5)
    SELECT c_custkey, arg_min(s_suppkey, (dist, s_suppkey)) AS s_suppkey, round(min(dist), 6) AS distance FROM p WHERE dist <= 60 GROUP BY 1""")
def nearest_in_group(spark, d):
    left = _places(table(spark, d, "customer"), "c_custkey", "lx", "ly").withColumn("grp", F.col("c_custkey") % 5)
    right = _places(table(spark, d, "supplier"), "s_suppkey", "rx", "ry").withColumn("grp", F.col("s_suppkey") % 5)
    found = spatial.nearest(left, right, "c_custkey", ["s_suppkey"], 60.0, group="grp", rounds=1)
    return found.select("c_custkey", "s_suppkey", F.round("distance", 6).alias("distance"))


def _boxes(spark, d):
    supplier = _places(table(spark, d, "supplier"), "s_suppkey", "xmin", "ymin")
    return supplier.withColumn("xmax", F.col("xmin") + 20 + F.col("s_suppkey") % 30).withColumn("ymax", F.col("ymin") + 15 + F.col("s_suppkey") % 20)


@query(f"""
    WITH {_CUSTOMERS}, {_SUPPLIERS} SELECT c_custkey, s_suppkey FROM a, b
    WHERE lx >= rx AND lx < rx + 20 + s_suppkey % 30 AND ly >= ry AND ly < ry + 15 + s_suppkey % 20""")
def pip_join(spark, d):
    return spatial.points_in_boxes(_places(table(spark, d, "customer"), "c_custkey", "px", "py"), _boxes(spark, d), 32.0).select("c_custkey", "s_suppkey")


@query(f"""
    WITH {_CUSTOMERS}, {_SUPPLIERS} SELECT c_custkey, s_suppkey FROM a, b
    WHERE ly + 0.5 > ry AND lx + 0.5 > rx AND (lx + 0.5 - rx) / 40 + (ly + 0.5 - ry) / 30 < 1""")
def polygon_join(spark, d):
    """Points in right-angled triangles; the oracle writes the three edges out."""
    points = _places(table(spark, d, "customer"), "c_custkey", "px", "py").withColumn("px", F.col("px") + 0.5).withColumn("py", F.col("py") + 0.5)
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    triangles = _places(table(spark, d, "supplier"), "s_suppkey", "x", "y").select("s_suppkey", F.array(corner(0.0, 0.0), corner(40.0, 0.0), corner(0.0, 30.0), corner(0.0, 0.0)).alias("ring"))
    return spatial.points_in_polygons(points, triangles, 32.0).select("c_custkey", "s_suppkey")


@query(f"""
    WITH {_SUPPLIERS}, x AS (SELECT s_suppkey AS k, rx AS x0, ry AS y0, rx + 140 + s_suppkey % 30 AS x1, ry + 135 + s_suppkey % 20 AS y1 FROM b),
    o AS (SELECT l.k AS left_id, r.k AS right_id, (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS area FROM x l, x r
      WHERE l.k <> r.k AND least(l.x1, r.x1) > greatest(l.x0, r.x0) AND least(l.y1, r.y1) > greatest(l.y0, r.y0))
    SELECT left_id, arg_min(right_id, (-area, right_id)) AS right_id, max(area) AS area FROM o GROUP BY 1""")
def largest_overlap(spark, d):
    boxes = _boxes(spark, d).withColumns({c: F.col(c) + 120 for c in ("xmax", "ymax")})
    side = lambda p, key: boxes.select(F.col("s_suppkey").alias(key), *[F.col(c).alias(p + c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return spatial.largest_overlap(side("l", "left_id"), side("r", "right_id"), "left_id", "right_id", 32.0, other=True)


def _network(spark, d):
    """The customers and the suppliers that they buy from, as one graph."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    edges = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("u"), (-F.col("l_suppkey") - 1).alias("v")).distinct()
    vertices = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, d, "supplier").select(-F.col("s_suppkey") - 1)).distinct()
    return vertices, edges


@query()
def connected_components(spark, d):
    """Components of the whole graph; a recursive oracle would be too slow, so it is tested against a plain loop."""
    return graph.connected_components(*_network(spark, d))


@query()
def classified_components(spark, d):
    found = graph.connected_components(*_network(spark, d)).withColumn("valid", F.col("id") % 5 == 0).withColumn("active", F.col("id") % 7 == 0)
    return graph.classify_components(found, "valid", "active")


@query()
def neighbour_fill_sequential(spark, d):
    """Ordered fill inside rows of pixels; a fill depends on the one before, so it is tested against a plain loop."""
    pixels = table(spark, d, "part").select("p_partkey", F.expr("p_partkey div 100").alias("row"), F.round("p_retailprice", 2).alias("value"), (F.col("p_partkey") % 4 == 0).alias("replace"))
    cells = pixels.withColumn("near", F.array(F.col("p_partkey") - 1, F.col("p_partkey") + 1))
    return graph.ordered_fill(cells, "row", "p_partkey", "value", "replace", "near").select("p_partkey", "filled")
