"""Analyses of lines and cross-sections: crossings, ends on nodes, sections on vertices, boxes and texts of geometries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import spatial
from ..session import table
from .registry import query

_A = "a AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 91 % 1009 AS DOUBLE) AS y FROM customer)"
_B = "b AS (SELECT s_suppkey AS id, CAST(s_suppkey * 53 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 71 % 1009 AS DOUBLE) AS y FROM supplier)"


def _points(df, key: str, fx: int, fy: int):
    return df.select(F.col(key).alias("id"), (F.col(key) * fx % 1000).cast("double").alias("x"), (F.col(key) * fy % 1009).cast("double").alias("y"))


def _line(*steps):
    """A line from (x, y) by steps."""
    return F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])


def _lines(spark, d):
    """Short lines of two segments, and a few that span everything."""
    short = _points(table(spark, d, "customer"), "c_custkey", 37, 91).select("id", _line((0.0, 0.0), (20.0, 10.0), (30.0, -15.0)).alias("line"))
    far = F.when(F.col("id") % 40 == 0, 2000.0).otherwise(40.0)
    long = _points(table(spark, d, "supplier"), "s_suppkey", 53, 71).select("id", F.array(F.struct("x", "y"), F.struct((F.col("x") + far).alias("x"), (F.col("y") + far / 2 + 0.25).alias("y"))).alias("line"))
    return short, long


_TURN = "(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
_T = lambda p, q, r: _TURN.format(p=p, q=q, r=r)
_ON = lambda p, q, r: f"({r}x BETWEEN least({p}x, {q}x) AND greatest({p}x, {q}x) AND {r}y BETWEEN least({p}y, {q}y) AND greatest({p}y, {q}y))"
_MEET = f"""((sign({_T("m", "n", "p")}) * sign({_T("m", "n", "q")}) < 0 AND sign({_T("p", "q", "m")}) * sign({_T("p", "q", "n")}) < 0)
    OR ({_T("m", "n", "p")} = 0 AND {_ON("m", "n", "p")}) OR ({_T("m", "n", "q")} = 0 AND {_ON("m", "n", "q")})
    OR ({_T("p", "q", "m")} = 0 AND {_ON("p", "q", "m")}) OR ({_T("p", "q", "n")} = 0 AND {_ON("p", "q", "n")}))"""


@query(f"""
    WITH {_A}, {_B},
    s AS (SELECT id, x AS px, y AS py, x + 20 AS qx, y + 10 AS qy FROM a UNION ALL SELECT id, x + 20, y + 10, x + 30, y - 15 FROM a),
    l AS (SELECT id, x AS mx, y AS my, x + f AS nx, y + f / 2 + 0.25 AS ny FROM (SELECT *, CASE WHEN id % 40 = 0 THEN 2000.0 ELSE 40.0 END AS f FROM b))
    SELECT s.id AS c_custkey, l.id AS s_suppkey, count(*) AS n_places FROM s, l WHERE {_MEET} GROUP BY 1, 2""")
def line_crossings(spark, d):
    """Pairs of lines that cross or touch, and in how many pairs of segments."""
    short, long = _lines(spark, d)
    return spatial.lines_meet(short.withColumnRenamed("id", "c_custkey"), long.withColumnRenamed("id", "s_suppkey"), "c_custkey", "s_suppkey", 32.0)


@query(f"""
    WITH {_B}, k AS (SELECT s_suppkey AS id, s_nationkey AS at, s_suppkey % 3 AS off FROM supplier),
    n AS (SELECT n_nationkey AS id, CAST(n_nationkey * 10 AS DOUBLE) AS x, CAST(n_nationkey * 5 AS DOUBLE) AS y FROM nation WHERE n_nationkey <> 7),
    l AS (SELECT k.id, k.at AS start_node, (k.at + 1) % 25 AS end_node, k.at * 10.0 + CASE WHEN off = 1 THEN 0.5 ELSE 0 END AS sx, k.at * 5.0 AS sy, (k.at + 1) % 25 * 10.0 AS ex, (k.at + 1) % 25 * 5.0 + CASE WHEN off = 2 THEN 0.5 ELSE 0 END AS ey FROM k)
    SELECT l.id, coalesce(s.x = sx AND s.y = sy, false) AS start_ok, coalesce(e.x = ex AND e.y = ey, false) AS end_ok FROM l
    LEFT JOIN n s ON s.id = start_node LEFT JOIN n e ON e.id = end_node WHERE NOT (coalesce(s.x = sx AND s.y = sy, false) AND coalesce(e.x = ex AND e.y = ey, false))""")
def line_ends_off_nodes(spark, d):
    """Lines whose first or last point is not on the node that they refer to; a missing node counts as off."""
    at = lambda k: F.struct((k * 10).cast("double").alias("x"), (k * 5).cast("double").alias("y"))
    key, off = F.col("s_nationkey"), F.col("s_suppkey") % 3
    after = (key + 1) % 25
    start, end = at(key), at(after)
    moved = F.struct((start["x"] + F.when(off == 1, 0.5).otherwise(0.0)).alias("x"), start["y"].alias("y")), F.struct(end["x"].alias("x"), (end["y"] + F.when(off == 2, 0.5).otherwise(0.0)).alias("y"))
    lines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), key.alias("start_node"), after.alias("end_node"), F.array(*moved).alias("line"))
    nodes = table(spark, d, "nation").where("n_nationkey <> 7").select(F.col("n_nationkey").alias("node"), at(F.col("n_nationkey")).alias("place"))
    return spatial.ends_off_nodes(lines, nodes).select("id", "start_ok", "end_ok")


@query(f"""
    WITH {_A}, p AS (SELECT id, x + id % 3 * 0.25 AS x, y FROM a), q AS (SELECT l.id, r.id AS other FROM p l JOIN p r ON l.id <> r.id AND (l.x - r.x) ** 2 + (l.y - r.y) ** 2 <= 400)
    SELECT id, count(*) AS n_others, min(other) AS least_other FROM q GROUP BY 1""")
def section_duplicates(spark, d):
    """Points with others within a distance of theirs."""
    points = _points(table(spark, d, "customer"), "c_custkey", 37, 91).withColumn("x", F.col("x") + F.col("id") % 3 * 0.25)
    return spatial.close_others(points, 20.0)


@query("""
    WITH v AS (SELECT s_suppkey AS channel_id, s_suppkey * 53 % 1000 + k * 10.0 AS x, s_suppkey * 71 % 1009 + k * 5.0 AS y FROM supplier, unnest([0, 1, 2]) t(k)),
    s AS (SELECT p_partkey AS id, p_partkey % 100 + 1 AS channel_id, k, k * 53 % 1000 + p_partkey % 3 * 10.0 + CASE WHEN p_partkey % 4 = 0 THEN 0.5 ELSE 0 END AS x, k * 71 % 1009 + p_partkey % 3 * 5.0 AS y
      FROM (SELECT *, CASE WHEN p_partkey % 6 = 0 THEN (p_partkey + 1) % 100 + 1 ELSE p_partkey % 100 + 1 END AS k FROM part) WHERE k IN (SELECT s_suppkey FROM supplier)),
    h AS (SELECT s.id, s.channel_id, v.channel_id AS found FROM s JOIN v ON (s.x - v.x) ** 2 + (s.y - v.y) ** 2 <= 1e-6),
    o AS (SELECT s.id, round(min(sqrt((s.x - v.x) ** 2 + (s.y - v.y) ** 2)), 2) AS distance FROM s, v WHERE s.id NOT IN (SELECT id FROM h) GROUP BY 1)
    SELECT id, 'no vertex' AS kind, CAST(NULL AS BIGINT) AS found, distance FROM o
    UNION ALL SELECT DISTINCT id, 'other channel', CAST(found AS BIGINT), CAST(NULL AS DOUBLE) FROM h WHERE found <> channel_id""")
def sections_off_vertices(spark, d):
    """Cross-sections that are on no vertex, with the distance to the nearest, and those on a vertex of another channel."""
    supplier, part = table(spark, d, "supplier"), table(spark, d, "part")
    channels = _points(supplier, "s_suppkey", 53, 71).select(F.col("id").alias("channel_id"), _line((0.0, 0.0), (10.0, 5.0), (20.0, 10.0)).alias("line"))
    own = F.col("p_partkey") % 100 + 1
    k = F.when(F.col("p_partkey") % 6 == 0, (F.col("p_partkey") + 1) % 100 + 1).otherwise(own)
    step, off = F.col("p_partkey") % 3, F.when(F.col("p_partkey") % 4 == 0, 0.5).otherwise(0.0)
    sections = part.withColumn("k", k).select(F.col("p_partkey").alias("id"), own.alias("channel_id"), "k", (F.col("k") * 53 % 1000 + step * 10.0 + off).alias("x"), (F.col("k") * 71 % 1009 + step * 5.0).alias("y"))
    sections = sections.join(supplier.select(F.col("s_suppkey").alias("k")), "k", "left_semi")
    return spatial.off_vertices(sections, channels).select("id", "kind", F.col("found").cast("long").alias("found"), F.col("distance"))


@query(f"""
    WITH {_A} SELECT id, x AS xmin, y - 15 AS ymin, x + 30 AS xmax, y + 10 AS ymax, round(sqrt(500.0) + sqrt(725.0), 6) AS length, x + 30 AS end_x, y - 15 AS end_y,
      concat('LINESTRING (', x, ' ', y, ', ', x + 20, ' ', y + 10, ', ', x + 30, ' ', y - 15, ')') AS wkt,
      concat('POLYGON ((', x, ' ', y - 15, ', ', x + 30, ' ', y - 15, ', ', x + 30, ' ', y + 10, ', ', x, ' ', y + 10, ', ', x, ' ', y - 15, '))') AS box, true AS read_back, 3 AS n_points, x % 10 AS top FROM a""")
def line_texts(spark, d):
    """Bounds, length, last point and texts of lines, read back; lines with a height and without."""
    lines = _lines(spark, d)[0].withColumn("b", geometry.bounds(F.col("line"))).withColumn("wkt", geometry.to_wkt(F.col("line")))
    box = geometry.to_wkt(geometry.box_ring(F.col("b.xmin"), F.col("b.ymin"), F.col("b.xmax"), F.col("b.ymax")), "POLYGON")
    high = geometry.with_z(F.col("line"), F.col("b.xmin") % 10)
    return lines.select(
        "id", "b.xmin", "b.ymin", "b.xmax", "b.ymax", F.round(geometry.line_length(F.col("line")), 6).alias("length"), geometry.last_point(F.col("line"))["x"].alias("end_x"), geometry.last_point(F.col("line"))["y"].alias("end_y"),
        "wkt", box.alias("box"), (geometry.from_wkt(F.col("wkt")) == geometry.without_z(high)).alias("read_back"), F.size("line").alias("n_points"), geometry.first_point(high)["z"].alias("top"),
    )
