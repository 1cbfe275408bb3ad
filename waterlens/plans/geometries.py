"""Merged lines, overlays of polygons, lines in polygons, positions along lines, level rasters, nodes by first match."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.projection import from_national, to_national
from ..operators import graph, lines, named_rules, polygons, raster, triangles
from ..session import new_path, table
from ..sources import tiles
from .registry import query


def _point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _box(x0, y0, x1, y1):
    """The closed ring of a box."""
    return F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1), _point(x0, y1), _point(x0, y0))


def _channels(spark, d):
    """A channel for every part: seven in a row from node to node; every third row is a ring, the others lack some channels; odd
    ones are drawn from end to start. Areas are the rows' last digits."""
    k, row, o = F.col("id"), F.floor(F.col("id") / 7), F.col("id") % 7
    ring = row % 3 == 0
    node = lambda n: F.when(ring & (n == 7), _point(row * 100, row * 0)).otherwise(_point(row * 100 + n, n * (7 - n)))
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id")).where(~((row % 3 > 0) & (k % 11 == 5)))
    drawn = F.array(node(o), node(o + 1))
    return rows.select("id", (row % 10).alias("area"), F.when(k % 2 == 1, F.reverse(drawn)).otherwise(drawn).alias("line"))


_ROWS = """
    k AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey // 7 AS r, p_partkey % 7 AS o FROM part WHERE NOT (p_partkey // 7 % 3 > 0 AND p_partkey % 11 = 5)),
    full_rows AS (SELECT r FROM k WHERE r % 3 = 0 GROUP BY 1 HAVING count(*) = 7),
    i AS (SELECT *, id - row_number() OVER (PARTITION BY r ORDER BY id) AS run FROM k),
    c AS (SELECT r, run, min(id) AS merge_id, max(id) AS last, count(*) AS n_parts, r IN (SELECT r FROM full_rows) AS ring FROM i GROUP BY r, run)"""


@query(f"""
    WITH {_ROWS}, m AS (SELECT *, merge_id % 7 AS o0, last % 7 + 1 AS o1, (n_parts = 1 OR ring) AND merge_id % 2 = 1 AS back FROM c),
    e AS (SELECT *, CASE WHEN ring THEN merge_id % 7 + CAST(back AS INT) WHEN back THEN o1 ELSE o0 END AS a, CASE WHEN ring THEN merge_id % 7 + CAST(back AS INT) WHEN back THEN o0 ELSE o1 END AS b FROM m)
    SELECT merge_id, r % 10 AS area, n_parts, CAST(100 * r + a AS DOUBLE) AS start_x, CAST(100 * r + b AS DOUBLE) AS end_x, CAST(a * (7 - a) AS DOUBLE) AS start_y, CAST(b * (7 - b) AS DOUBLE) AS end_y, n_parts + 1 AS n_points FROM e""")
def merged_channels(spark, d):
    """Channels of an area merged where exactly two meet, rings among them."""
    found = lines.merged_lines(_channels(spark, d), "area")
    end = lambda k: F.element_at("line", k)
    return found.select("merge_id", "area", "n_parts", end(1)["x"].alias("start_x"), end(-1)["x"].alias("end_x"), end(1)["y"].alias("start_y"), end(-1)["y"].alias("end_y"), F.size("line").cast("long").alias("n_points"))


@query(f"WITH {_ROWS} SELECT id, merge_id FROM i JOIN c USING (r, run)")
def merged_channel_ids(spark, d):
    """Which merged channel each channel went into."""
    return lines.chains(_channels(spark, d), "area").select("id", "merge_id")


_SIDES = """
    s AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey * 37 % 500 AS x, p_partkey * 91 % 400 AS y, p_partkey % 9 AS dx, p_partkey % 7 AS dy, p_partkey % 4 AS kind FROM part),
    a AS (SELECT *, x AS ax0, y AS ay0, x + 20 AS ax1, y + 15 AS ay1, x + 5 AS hx0, y + 5 AS hy0, x + 10 AS hx1, y + 10 AS hy1, x + dx AS bx0, y + dy AS by0, x + dx + 12 AS bx1, y + dy + 18 AS by1 FROM s),
    o AS (SELECT *, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0)
      - greatest(least(hx1, bx1) - greatest(hx0, bx0), 0) * greatest(least(hy1, by1) - greatest(hy0, by0), 0) AS common FROM a)"""


@query(f"""
    WITH {_SIDES} SELECT id, CAST(CASE WHEN kind IN (1, 2) THEN 0 ELSE common END AS DOUBLE) AS area_both, CAST(CASE kind WHEN 1 THEN 0 WHEN 2 THEN 275 ELSE 275 - common END AS DOUBLE) AS area_only_a,
      CAST(CASE kind WHEN 2 THEN 0 WHEN 1 THEN 216 ELSE 216 - common END AS DOUBLE) AS area_only_b FROM o""")
def polygon_differences(spark, d):
    """Areas that two sources' polygons of the same code share and do not share: boxes with a hole against boxes. Some codes
    are in one source only."""
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_partkey") * 37 % 500).alias("x"), (F.col("p_partkey") * 91 % 400).alias("y"), (F.col("p_partkey") % 9).alias("dx"), (F.col("p_partkey") % 7).alias("dy"))
    x, y = F.col("x"), F.col("y")
    left = parts.where("id % 4 <> 1").select("id", F.array(_box(x, y, x + 20, y + 15), _box(x + 5, y + 5, x + 10, y + 10)).alias("rings"))
    bx, by = x + F.col("dx"), y + F.col("dy")
    right = parts.where("id % 4 <> 2").select("id", F.array(_box(bx, by, bx + 12, by + 18)).alias("rings"))
    found = polygons.overlay_areas(left, right, "id", 64.0)
    return found.select("id", F.round("both", 6).alias("area_both"), F.round("only_left", 6).alias("area_only_a"), F.round("only_right", 6).alias("area_only_b"))


@query("""
    WITH a AS (SELECT p_partkey % 3 AS grp, p_partkey * 37 % 300 AS x, p_partkey * 91 % 200 AS y, 3 + p_partkey % 5 AS w, 2 + p_partkey % 4 AS h FROM part),
    c AS (SELECT DISTINCT grp, x + i AS cx, y + j AS cy FROM a, unnest(range(0, w)) t(i), unnest(range(0, h)) u(j))
    SELECT grp, CAST(count(*) AS DOUBLE) AS area FROM c GROUP BY 1""")
def union_area(spark, d):
    """Area of the union of overlapping boxes, by group; the oracle counts unit squares."""
    parts = table(spark, d, "part").select((F.col("p_partkey") % 3).alias("grp"), (F.col("p_partkey") * 37 % 300).alias("x"), (F.col("p_partkey") * 91 % 200).alias("y"), (3 + F.col("p_partkey") % 5).alias("w"), (2 + F.col("p_partkey") % 4).alias("h"))
    x, y = F.col("x"), F.col("y")
    shapes = parts.select("grp", F.array(_box(x, y, x + F.col("w"), y + F.col("h"))).alias("rings"))
    return polygons.union_areas(shapes, "grp", 16.0).select("grp", F.round("area", 6).alias("area"))


@query("""
    WITH l AS (SELECT CAST(c_custkey AS BIGINT) AS line_id, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 91 % 1009 AS DOUBLE) AS y, CAST(7 + c_custkey % 90 AS DOUBLE) AS dx, CAST(5 + c_custkey % 70 AS DOUBLE) AS dy FROM customer),
    p AS (SELECT CAST(s_suppkey AS BIGINT) AS polygon_id, CAST(s_suppkey * 37 % 1000 AS DOUBLE) - 0.5 AS x0, CAST(s_suppkey * 91 % 1009 AS DOUBLE) - 0.25 AS y0, 80 + s_suppkey % 30 AS w, 60 + s_suppkey % 20 AS h FROM supplier),
    t AS (SELECT line_id, polygon_id, greatest(0, (x0 - x) / dx, (y0 - y) / dy) AS a, least(1, (x0 + w - x) / dx, (y0 + h - y) / dy) AS b, sqrt(dx * dx + dy * dy) AS n FROM l, p),
    i AS (SELECT line_id, polygon_id, round((b - a) * n, 6) AS length FROM t WHERE b > a)
    SELECT line_id, arg_max(polygon_id, (length, -polygon_id)) AS polygon_id, max(length) AS length FROM i WHERE length > 0 GROUP BY 1""")
def line_areas(spark, d):
    """The area that holds most of each line; the oracle clips by the boxes' sides."""
    k = F.col("c_custkey")
    x, y = k * 37 % 1000, k * 91 % 1009
    given = table(spark, d, "customer").select(k.cast("long").alias("line_id"), F.array(_point(x, y), _point(x + 7 + k % 90, y + 5 + k % 70)).alias("line"))
    s = F.col("s_suppkey")
    x0, y0 = s * 37 % 1000 - 0.5, s * 91 % 1009 - 0.25
    areas = table(spark, d, "supplier").select(s.cast("long").alias("polygon_id"), F.array(_box(x0, y0, x0 + 80 + s % 30, y0 + 60 + s % 20)).alias("rings"))
    return lines.longest_inside(given, areas, 64.0, digits=6)


@query("""
    WITH p AS (SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS id, l_orderkey // 4 AS line_id, CAST(l_partkey % 40 AS DOUBLE) - 5 AS x, CAST(l_suppkey % 30 AS DOUBLE) - 5 AS y FROM lineitem),
    o AS (SELECT CAST(o_orderkey AS BIGINT) AS line_id FROM orders WHERE o_orderkey % 3 > 0),
    j AS (SELECT p.id, p.x, p.y, o.line_id AS there, least(greatest(p.x, 0), 20) AS t1, least(greatest(p.y, 0), 15) AS t2 FROM p LEFT JOIN o ON o.line_id = p.line_id),
    m AS (SELECT *, sqrt((x - t1) ** 2 + y * y) AS d1, sqrt((x - 20) ** 2 + (y - t2) ** 2) AS d2 FROM j)
    SELECT id, CASE WHEN there IS NULL THEN NULL WHEN d2 < d1 THEN 20 + t2 ELSE t1 END AS "offset", CASE WHEN there IS NOT NULL THEN round(least(d1, d2), 6) END AS distance FROM m""")
def positions_along(spark, d):
    """How far along its bent channel each structure is, and how far off it; some channels are missing."""
    points = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"), F.floor(F.col("l_orderkey") / 4).alias("line_id"),
        (F.col("l_partkey") % 40 - 5).cast("double").alias("x"), (F.col("l_suppkey") % 30 - 5).cast("double").alias("y"),
    )
    bent = F.array(*[_point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (20, 0), (20, 15))])
    channels = table(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").cast("long").alias("line_id"), bent.alias("line"))
    return lines.positions(points, channels).select("id", "offset", F.round("distance", 6).alias("distance"))


@query("""
    WITH c AS (SELECT p_partkey % 40 AS i, p_partkey // 40 AS j FROM part), e AS (SELECT max(j) AS last FROM c WHERE j < (SELECT max(j) FROM c)),
    p AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderkey * 7 % 397 AS DOUBLE) + 0.5 AS px, CAST(o_orderkey * 13 % 491 AS DOUBLE) + 0.25 AS py, o_totalprice / 10000 AS dem FROM orders),
    l AS (SELECT *, CASE WHEN px BETWEEN 5 AND 395 AND py BETWEEN 15 AND 10 * last + 5 THEN 12 + px / 40 - py / 50 END AS level FROM p, e)
    SELECT id, round(level, 6) AS level, CASE WHEN level IS NOT NULL THEN round(greatest(level - dem, 0), 6) END AS depth FROM l WHERE py < 10 * last + 5 OR py > 10 * last + 15""")
def level_raster(spark, d):
    """Levels and depths at pixels, interpolated in the triangles of all cell centres. The levels lie on a plane, so that SQL
    can state them whatever the triangles are; other levels are tested against plain loops."""
    k = F.col("p_partkey")
    x, y = k % 40 * 10 + 5.0, F.floor(k / 40) * 10 + 5.0
    centres = table(spark, d, "part").select(k.cast("long").alias("id"), x.alias("x"), y.alias("y"), (12 + x / 40 - y / 50).alias("level"))
    last = F.broadcast(centres.agg(((F.max("y") - 5) / 10 - 1).alias("last")))  # one row: the last row of cells may be part of one
    o = F.col("o_orderkey")
    pixels = table(spark, d, "orders").select(o.cast("long").alias("id"), (o * 7 % 397 + 0.5).alias("px"), (o * 13 % 491 + 0.25).alias("py"), F.lit(1).cast("long").alias("cell"), (F.col("o_totalprice") / 10000).alias("dem"))
    found = triangles.level_raster(pixels.crossJoin(last), centres.where(F.col("y") > 10), 200.0, 12.0)
    found = found.where((F.col("py") < 10 * F.col("last") + 5) | (F.col("py") > 10 * F.col("last") + 15))
    return found.select("id", F.round("level", 6).alias("level"), F.round("depth", 6).alias("depth"))


def _ends(spark, d):
    """Ends of channels: for every customer a start and an end, in groups of points a few millimetres apart."""
    k = F.col("c_custkey")
    of = lambda n: F.struct(n.cast("long").alias("order"), (n % 97 * 10 + n * 31 % 23 * 0.004).alias("x"), (n * 17 % 11 * 0.003).alias("y"))
    return table(spark, d, "customer").select(k.cast("long").alias("code"), F.explode(F.array(of(k * 2), of(k * 2 + 1))).alias("p")).select("code", "p.*")


_MATCHED = """
    e AS (SELECT n AS ord, n % 97 AS grp, n % 97 * 10 + n * 31 % 23 * 0.004::DOUBLE AS x, n * 17 % 11 * 0.003::DOUBLE AS y FROM customer, unnest([c_custkey * 2, c_custkey * 2 + 1]) t(n)),
    q AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ord) AS i FROM e),
    s(grp, i, ord, node, nodes) AS (
      SELECT grp, i, ord, ord, [{'o': ord, 'x': x, 'y': y}] FROM q WHERE i = 1
      UNION ALL
      SELECT q.grp, q.i, q.ord, coalesce(m.o, q.ord), CASE WHEN m.o IS NULL THEN list_append(s.nodes, {'o': q.ord, 'x': q.x, 'y': q.y}) ELSE s.nodes END
      FROM s JOIN q ON q.grp = s.grp AND q.i = s.i + 1,
      LATERAL (SELECT list_filter(s.nodes, lambda n: sqrt((n.x - q.x) ** 2 + (n.y - q.y) ** 2) < 0.01)[1].o AS o) m)"""


@query(f'WITH RECURSIVE {_MATCHED} SELECT CAST(ord AS BIGINT) AS "order", CAST(node AS BIGINT) AS node FROM s')
def first_match_nodes(spark, d):
    """The node of every end, by the first node before it that is near enough."""
    return graph.first_match_nodes(_ends(spark, d), 0.01)


@query(f"""
    WITH RECURSIVE {_MATCHED}, n AS (SELECT node, row_number() OVER (ORDER BY node) AS id FROM (SELECT DISTINCT node FROM s)), b AS (SELECT ord, id FROM s JOIN n USING (node))
    SELECT row_number() OVER (ORDER BY c_custkey) AS id, CAST(c_custkey AS BIGINT) AS code, u.id AS connection_node_id_start, v.id AS connection_node_id_end FROM customer JOIN b u ON u.ord = c_custkey * 2 JOIN b v ON v.ord = c_custkey * 2 + 1""")
def converted_channels(spark, d):
    """Channels with the numbers of their two nodes, as the conversion to a model gives them."""
    ends = _ends(spark, d)
    found = ends.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("order", F.struct("x", "y").alias("at")))).alias("p"))
    given = found.select("code", F.transform("p", lambda p: p["at"]).alias("line"))
    return graph.channels_of_lines(given, "code", 0.01).select("id", "code", "connection_node_id_start", "connection_node_id_end")


@query("""
    WITH c AS (SELECT CAST(p_partkey AS BIGINT) AS id, round(p_retailprice, 2) AS v, p_partkey % 4 AS m, lag(round(p_retailprice, 2)) OVER w AS a, lag(round(p_retailprice, 2), 2) OVER w AS aa, lead(round(p_retailprice, 2)) OVER w AS b FROM part WINDOW w AS (ORDER BY p_partkey)),
    f AS (SELECT id, CASE m WHEN 1 THEN a WHEN 2 THEN (coalesce(aa, 0) + coalesce(b, 0)) / nullif(CAST(aa IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT), 0) ELSE v END AS filled FROM c)
    SELECT id, round(filled, 3) AS filled FROM f""")
def neighbour_fill_waves(spark, d):
    """Two of four cells of one long row are filled by their neighbours' mean, the second after the first; in rounds."""
    cells = table(spark, d, "part").select(F.lit(0).alias("row"), F.col("p_partkey").cast("long").alias("id"), F.round("p_retailprice", 2).alias("value"), (F.col("p_partkey") % 4).isin(1, 2).alias("replace"))
    found = graph.wave_fill(cells.withColumn("near", F.array(F.col("id") - 1, F.col("id") + 1)), "row", "id", "value", "replace", "near")
    return found.select("id", F.round("filled", 3).alias("filled"))


@query("""
    SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS id, CAST(l_partkey * 7 % 1009 AS DOUBLE) AS x, CAST(l_orderkey * 3 % 997 AS DOUBLE) - 300 AS y, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS value
    FROM lineitem WHERE l_partkey * 7 % 1009 >= 100 AND l_partkey * 7 % 1009 < 420 AND l_orderkey * 3 % 997 - 300 >= -75 AND l_orderkey * 3 % 997 - 300 < 260""")
def tiles_in_window(spark, d):
    """The pixels of a window, from a table written as tiles; some hold no data."""
    pixels = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"), (F.col("l_partkey") * 7 % 1009).cast("double").alias("x"),
        (F.col("l_orderkey") * 3 % 997 - 300).cast("double").alias("y"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("value"),
    )
    path = new_path(spark, "tiles")
    tiles.write_tiles(pixels, path, "value", 32.0)
    return tiles.read_tiles(spark, path, (100.0, -75.0, 420.0, 260.0))


_GENERAL = [
    {"name": "margin", "function": "difference", "inputs": {"left": "price", "right": "cost"}},
    {"name": "share", "function": "divide", "inputs": {"left": "margin", "right": "size"}},
    {"name": "is_large", "function": "greater", "inputs": {"left": "size", "right": 25}},
    {"name": "top", "function": "largest", "inputs": {"a": "share", "b": "least"}},
    {"name": "least", "function": "smallest", "inputs": {"a": "margin", "b": 10.0}},
]
_CHECKS = [
    {"id": 1, "name": "steep", "function": "less", "inputs": {"left": "share", "right": 60.0}},
    {"id": 2, "name": "topped", "function": "between", "inputs": {"value": "top", "low": 0.0, "high": 40.0}, "filter": "is_large"},
    {"id": 3, "name": "both_hold", "function": "both", "inputs": {"left": "steep", "right": "is_large"}},
    {"id": 4, "name": "idle", "function": "exists", "inputs": {"value": "share"}, "active": False},
]


@query("""
    WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_retailprice AS price, CAST(p_partkey % 1500 AS DOUBLE) AS cost, CASE WHEN p_size % 7 > 0 THEN CAST(p_size AS DOUBLE) END AS size FROM part),
    g AS (SELECT *, price - cost AS margin, (price - cost) / size AS share, size > 25 AS is_large, least(price - cost, 10) AS low FROM p),
    h AS (SELECT *, greatest(share, low) AS top, share < 60 AS steep FROM g),
    r AS (SELECT id, [steep, CASE WHEN is_large THEN top BETWEEN 0 AND 40 END, steep AND is_large] AS res, [TRUE, coalesce(is_large, FALSE), TRUE] AS used FROM h)
    SELECT id, array_to_string([i FOR i IN [1, 2, 3] IF used[i] AND res[i]], ';') AS valid, array_to_string([i FOR i IN [1, 2, 3] IF used[i] AND NOT res[i]], ';') AS invalid,
      array_to_string([i FOR i IN [1, 2, 3] IF used[i] AND res[i] IS NULL], ';') AS ignored FROM r""")
def dependent_rules(spark, d):
    """Validation rules over results of other rules, some through a filter."""
    parts = table(spark, d, "part").select(
        F.col("p_partkey").cast("long").alias("id"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 1500).cast("double").alias("cost"), F.when(F.col("p_size") % 7 > 0, F.col("p_size").cast("double")).alias("size"),
    )
    return named_rules.findings(parts, "id", _GENERAL, _CHECKS)


@query("""
    WITH p AS (SELECT CAST(c_custkey AS BIGINT) AS id, 110000.0 + c_custkey * 37 % 20000 AS x, 500000.0 + c_custkey * 91 % 30000 AS y FROM customer)
    SELECT id, x, y, TRUE AS near_home FROM p""")
def projected_there_and_back(spark, d):
    """Points of the national grid to longitude and latitude and back: the oracle gives the points themselves."""
    points = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), (110000.0 + F.col("c_custkey") * 37 % 20000).alias("x"), (500000.0 + F.col("c_custkey") * 91 % 30000).alias("y"))
    world = points.withColumn("w", from_national(F.col("x"), F.col("y")))
    back = world.withColumn("b", to_national(F.col("w.lon"), F.col("w.lat")))
    home = F.col("w.lon").between(4.6, 5.1) & F.col("w.lat").between(52.4, 52.8)
    return back.select("id", F.round("b.x", 1).alias("x"), F.round("b.y", 1).alias("y"), home.alias("near_home"))


@query("""
    WITH p AS (SELECT CAST(p_partkey % 50 AS BIGINT) AS i, CAST(p_partkey // 50 AS BIGINT) AS j, round(p_retailprice, 2) AS v FROM part),
    s AS (SELECT i * 3 + a.k AS fi, j * 3 + b.k AS fj, v FROM p, range(3) a(k), range(3) b(k))
    SELECT fi // 2 AS i, fj // 2 AS j, round(sum(v) / 9, 4) AS total FROM s GROUP BY 1, 2""")
def resampled_by_area(spark, d):
    """Sums of pixels of 3 metres given to pixels of 2 by the area that they share; the oracle adds up square metres."""
    pixels = table(spark, d, "part").select((F.col("p_partkey") % 50).cast("long").alias("i"), F.floor(F.col("p_partkey") / 50).alias("j"), F.round("p_retailprice", 2).alias("v"))
    return raster.resample_by_area(pixels, "v", 3.0, 2.0).select("i", "j", F.round("total", 4).alias("total"))
