"""Composite analyses over the driver tables: extracts, inserts, relations, overlays, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import contains_any_case
from ..operators import convert, graph, network, raster, relational, spatial
from ..session import table
from .registry import query
from .shapes import _CUSTOMERS, _SUPPLIERS, _boxes, _places


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000))""")
def dependent_extract(spark, d):
    """Sub-tables two levels below a filtered parent: chained semi-joins."""
    parents = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
    orders = table(spark, d, "orders").join(parents, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
    WITH k AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)),
    n AS (SELECT s_suppkey + (SELECT max(c_custkey) FROM customer) AS c_custkey, greatest(coalesce(s_acctbal, 2), 10) AS c_acctbal FROM supplier)
    SELECT * FROM k UNION ALL SELECT * FROM n""")
def insert_and_delete(spark, d):
    """Rows deleted by an anti-join, new rows appended with ids after the largest."""
    customers = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    large = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    top = customers.agg(F.max("c_custkey").alias("top"))  # one row
    new = table(spark, d, "supplier").join(F.broadcast(top)).select((F.col("s_suppkey") + F.col("top")).alias("c_custkey"), F.greatest(F.coalesce("s_acctbal", F.lit(2.0)), F.lit(10.0)).alias("c_acctbal"))
    return customers.join(large, "c_custkey", "left_anti").unionByName(new)


@query("""
    SELECT l_orderkey, l_linenumber, kind, name FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 'part' ELSE 'supplier' END AS kind, CASE WHEN l_partkey % 2 = 0 THEN l_partkey ELSE l_suppkey END AS id FROM lineitem) l
    LEFT JOIN (SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part WHERE p_size < 40 UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier) t USING (kind, id)""")
def polymorphic_lookup(spark, d):
    """A foreign key whose type column names the table: one join on type and id."""
    part = F.col("l_partkey") % 2 == 0
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(part, "part").otherwise("supplier").alias("kind"), F.when(part, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("id"))
    known = table(spark, d, "part").where("p_size < 40").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).union(table(spark, d, "supplier").select(F.lit("supplier"), "s_suppkey", "s_name"))
    return lines.join(known, ["kind", "id"], "left").select("l_orderkey", "l_linenumber", "kind", "name")


@query(f"""
    WITH {_CUSTOMERS}, {_SUPPLIERS}, m AS (SELECT c_custkey, s_suppkey FROM a, b WHERE lx >= rx AND lx < rx + 20 + s_suppkey % 30 AND ly >= ry AND ly < ry + 15 + s_suppkey % 20)
    SELECT c_custkey, min(s_suppkey) AS first_match, CAST(count(*) - 1 AS INTEGER) AS n_more, coalesce(array_to_string(list_sort(list(CAST(s_suppkey AS VARCHAR)))[2:], ','), '') AS more FROM m GROUP BY 1""")
def first_match_and_rest(spark, d):
    """The first spatial match of each point and the others as a list."""
    found = spatial.points_in_boxes(_places(table(spark, d, "customer"), "c_custkey", "px", "py"), _boxes(spark, d), 32.0)
    names = F.array_sort(F.collect_list(F.col("s_suppkey").cast("string")))
    return found.groupBy("c_custkey").agg(F.min("s_suppkey").alias("first_match"), names.alias("n")).select("c_custkey", "first_match", (F.size("n") - 1).alias("n_more"), F.array_join(F.slice("n", 2, F.size("n")), ",").alias("more"))


@query("""
    WITH o AS (SELECT l_orderkey, round(min(l_quantity), 2) AS deepest FROM lineitem GROUP BY 1), c AS (SELECT o_custkey, min(deepest) AS deepest FROM o JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT c_custkey, deepest FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def two_level_minimum(spark, d):
    """A minimum of grandchildren mapped back to the parents, through two levels of partial sums."""
    deepest = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.min("l_quantity"), 2).alias("deepest"))
    customer = table(spark, d, "orders").join(deepest, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.min("deepest").alias("deepest"))
    return table(spark, d, "customer").join(customer, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "deepest")


@query("""
    SELECT l_suppkey, round(avg(l_quantity), 6) AS mean_depth, min(l_quantity) AS min_depth, max(l_quantity) AS max_depth, round(avg(l_discount), 6) AS mean_width, min(l_discount) AS min_width, max(l_discount) AS max_width FROM lineitem GROUP BY 1""")
def six_aggregates(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.groupBy("l_suppkey").agg(*[a for c, to in (("l_quantity", "depth"), ("l_discount", "width")) for a in (F.round(F.avg(c), 6).alias(f"mean_{to}"), F.min(c).alias(f"min_{to}"), F.max(c).alias(f"max_{to}"))])


@query("""
    SELECT CAST(s_suppkey AS BIGINT) AS id, 'supplier' AS origin, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
    UNION ALL SELECT c_custkey, 'customer', c_name, c_acctbal, c_mktsegment FROM customer""")
def schema_union(spark, d):
    """Tables of different columns one below the other; what a table lacks is null."""
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("origin"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return supplier.unionByName(customer, allowMissingColumns=True)


@query(f"""
    WITH {_SUPPLIERS}, x AS (SELECT s_suppkey, rx AS x0, ry AS y0, rx + 20 + s_suppkey % 30 AS x1, ry + 15 + s_suppkey % 20 AS y1 FROM b),
    p AS (SELECT c_custkey % 100 * 10 + 5.0 AS px, c_custkey // 100 * 10 + 5.0 AS py, c_acctbal AS v FROM customer)
    SELECT s_suppkey, round(sum(v) * 100, 2) AS zone_sum, count(v) AS n_pixels FROM x JOIN p ON px >= x0 AND px < x1 AND py >= y0 AND py < y1 GROUP BY 1""")
def polygon_zonal_sum(spark, d):
    """Zones given as shapes: pixel centres inside them, then the zonal sum times the pixel's area."""
    pixels = table(spark, d, "customer").select((F.col("c_custkey") % 100 * 10 + 5.0).alias("px"), (F.expr("c_custkey div 100") * 10 + 5.0).alias("py"), F.col("c_acctbal").alias("v"))
    return raster.zonal_sum(spatial.points_in_boxes(pixels, _boxes(spark, d), 32.0), "s_suppkey", "v", factor=100.0).withColumn("zone_sum", F.round("zone_sum", 2))


@query(f"""
    WITH {_SUPPLIERS}, x AS (SELECT s_suppkey AS k, rx AS x0, ry AS y0, rx + 140 + s_suppkey % 30 AS x1, ry + 135 + s_suppkey % 20 AS y1 FROM b)
    SELECT l.k AS left_id, r.k AS right_id, (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS area FROM x l, x r
    WHERE l.k < r.k AND least(l.x1, r.x1) > greatest(l.x0, r.x0) AND least(l.y1, r.y1) > greatest(l.y0, r.y0)""")
def overlay_area(spark, d):
    boxes = _boxes(spark, d).withColumns({c: F.col(c) + 120 for c in ("xmax", "ymax")})
    side = lambda p, key: boxes.select(F.col("s_suppkey").alias(key), *[F.col(c).alias(p + c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return spatial.box_overlay(side("l", "left_id"), side("r", "right_id"), 32.0).where("left_id < right_id").select("left_id", "right_id", "area")


@query("""
    WITH n AS (SELECT c_custkey AS id, c_acctbal / 1000 AS s, c_acctbal / 900 AS e FROM customer)
    SELECT l_orderkey, l_linenumber, round(abs(round(a.e, 5) - round(b.e, 5)), 5) AS level_difference, CASE WHEN l_discount - 0.05 < 0 THEN -1 ELSE 1 END AS direction,
      round(abs((round(a.e, 5) - round(b.e, 5)) * 100 / (l_quantity * 0.001)), 5) AS slope_cm_km, round(a.s, 5) IS DISTINCT FROM NULL AND round(round(a.s, 5), 2) <> round(round(b.s, 5), 2) AS on_level_limit
    FROM lineitem JOIN n a ON a.id = l_suppkey JOIN n b ON b.id = l_suppkey + 1""")
def hydraulic_check(spark, d):
    lines = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.col("l_suppkey").alias("node_1"), (F.col("l_suppkey") + 1).alias("node_2"), F.col("l_quantity").alias("length"), (F.col("l_discount") - 0.05).alias("q"), F.lit(0.0).alias("u"))
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("level_start"), (F.col("c_acctbal") / 900).alias("level_end"))
    found = network.hydraulic_check(lines, nodes).where("level_difference IS NOT NULL")
    return found.select("id.l_orderkey", "id.l_linenumber", "level_difference", "direction", "slope_cm_km", "on_level_limit")


@query("""
    WITH s AS (SELECT user_id AS id, event_id % 24 AS t, arg_min(value - 50, event_id) AS q FROM events GROUP BY 1, 2)
    SELECT id, CASE WHEN id % 3 = 0 THEN '1d2d' WHEN id % 3 = 1 THEN '2d' ELSE '1d' END AS kind,
      round(CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END * max(q) FILTER (WHERE t = 3), 5) AS q_rain, round(CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END * arg_max(q, (abs(q), -t)) FILTER (WHERE t < 23), 5) AS q_max FROM s GROUP BY 1""")
def flowline_statistics(spark, d):
    series = table(spark, d, "events").groupBy(F.col("user_id").alias("line_id"), (F.col("event_id") % 24).alias("t_idx")).agg(F.min_by(F.col("value") - 50, "event_id").alias("q")).withColumn("u", F.lit(0.0))
    lines = series.select(F.col("line_id").alias("id")).distinct().withColumn("kcu", F.when(F.col("id") % 3 == 0, 51).when(F.col("id") % 3 == 1, 100).otherwise(1))
    return network.flowline_statistics(series, lines, {"rain": 3}).select("id", "kind", "q_rain", "q_max")


@query("""
    WITH r AS (SELECT o_custkey AS area_id, sum(o_totalprice) AS v FROM orders GROUP BY 1), w AS (SELECT s_suppkey AS area_id, s_acctbal * 40 AS v FROM supplier),
    f AS (SELECT c_custkey AS area_id, coalesce(round(c_acctbal, 0), 0) + coalesce(round(r.v, 0), 0) AS model_area, coalesce(round(w.v, 0), 0) AS water_area FROM customer LEFT JOIN r ON c_custkey = r.area_id LEFT JOIN w ON c_custkey = w.area_id)
    SELECT area_id, model_area - water_area AS difference, CASE WHEN model_area - water_area = water_area THEN 0 WHEN water_area = 0 THEN 100 ELSE round((model_area - water_area) / water_area * 100, 1) END AS difference_percent FROM f""")
def water_balance(spark, d):
    areas = table(spark, d, "customer").select(F.col("c_custkey").alias("area_id"))
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("area_id"), F.col("c_acctbal").alias("storage_area"))
    channels = table(spark, d, "orders").select(F.col("o_custkey").alias("area_id"), F.col("o_totalprice").alias("area"))
    water = table(spark, d, "supplier").select(F.col("s_suppkey").alias("area_id"), (F.col("s_acctbal") * 40).alias("area"))
    return network.water_balance(areas, nodes, channels, water).select("area_id", "difference", "difference_percent")


@query("""
    SELECT p_partkey, CASE WHEN b > 99 THEN 'building' WHEN w > 95 THEN 'water' WHEN g < 50 THEN 'dem' END AS replace
    FROM (SELECT p_partkey, p_size / 50.0 * 100 AS g, p_partkey % 101 AS w, p_partkey % 103 AS b FROM part)""")
def grid_flags(spark, d):
    cells = table(spark, d, "part").select("p_partkey", F.lit(100.0).alias("cell_area"), (F.col("p_size") / 50 * 100).alias("dem_area"), (F.col("p_partkey") % 101).cast("double").alias("water_area"), (F.col("p_partkey") % 103).cast("double").alias("building_area"))
    return network.grid_flags(cells).select("p_partkey", "replace")


@query("""
    SELECT x.c_custkey, CASE WHEN a = 'model error' AND b = 'model error' THEN 'model error' WHEN a = 'nuisance' OR b = 'nuisance' THEN 'nuisance' WHEN a = 'puddle' OR b = 'puddle' THEN 'puddle' END AS final_class
    FROM (SELECT c_custkey, ['puddle', 'nuisance', 'model error'][c_custkey % 3 + 1] AS a, ['model error', 'nuisance', 'model error', 'puddle'][c_custkey % 4 + 1] AS b FROM customer) x""")
def combined_classes(spark, d):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % n + 1).cast("int"))
    rows = table(spark, d, "customer").select("c_custkey", pick(("puddle", "nuisance", "model error"), 3).alias("a"), pick(("model error", "nuisance", "model error", "puddle"), 4).alias("b"))
    return rows.select("c_custkey", graph.combine_classes(F.col("a"), F.col("b")).alias("final_class"))


@query("SELECT p_partkey, coalesce(lower(p_name) LIKE '%re%', FALSE) AS has_part, regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g') AS safe_name, left(p_name, 13) AS short_name FROM part")
def name_texts(spark, d):
    return table(spark, d, "part").select("p_partkey", contains_any_case(F.col("p_name"), "re").alias("has_part"), F.regexp_replace("p_type", "[^A-Za-z0-9]+", "_").alias("safe_name"), F.substring("p_name", 1, 13).alias("short_name"))


@query("""
    SELECT min(user_id) AS first_wet_user FROM (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 95)""")
def first_wet_element(spark, d):
    """The first element with any value over the threshold."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("m")).where("m > 95").agg(F.min("user_id").alias("first_wet_user"))


@query("""
    SELECT variant, count(*) AS n_rows, CAST(sum(CASE WHEN variant = 'isolated' AND c_acctbal < 0 THEN 101 ELSE c_nationkey END) AS BIGINT) AS types FROM customer, (VALUES ('base'), ('isolated'), ('rich')) v(variant)
    WHERE variant <> 'rich' OR c_acctbal > 5000 GROUP BY 1""")
def model_variants(spark, d):
    """Variants of a base model: each a filter and changes on top of it, all from one scan."""
    base = table(spark, d, "customer").select("c_nationkey", "c_acctbal")
    kinds = F.array_compact(F.array(F.lit("base"), F.lit("isolated"), F.when(F.col("c_acctbal") > 5000, "rich")))
    kind = F.when((F.col("variant") == "isolated") & (F.col("c_acctbal") < 0), 101).otherwise(F.col("c_nationkey"))
    rows = base.withColumn("variant", F.explode(kinds)).withColumn("c_nationkey", kind)
    return rows.groupBy("variant").agg(F.count("*").alias("n_rows"), F.sum("c_nationkey").cast("long").alias("types"))


@query("""
    SELECT o_custkey, o_orderkey, o_totalprice - lag(o_totalprice) OVER w AS change, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def step_changes(spark, d):
    per = Window.partitionBy("o_custkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") - F.lag("o_totalprice").over(per.orderBy("o_orderdate", "o_orderkey"))).alias("change"), F.count("*").over(per).alias("n"))


@query("""
    WITH t AS (SELECT l_partkey, max(l_extendedprice) AS top FROM lineitem GROUP BY 1)
    SELECT p_partkey, round(greatest(greatest(p_size, p_retailprice / 70) + 0.1, top / 7000), 2) AS new_bank_level FROM part LEFT JOIN t ON p_partkey = l_partkey""")
def bank_levels(spark, d):
    sections = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("channel_id"), F.col("p_size").cast("double").alias("reference_level"), F.lit(0.0).alias("bank_level"))
    levels = table(spark, d, "part").select(F.col("p_partkey").alias("channel_id"), (F.col("p_retailprice") / 70).alias("level"))
    raised = table(spark, d, "lineitem").select(F.col("l_partkey").alias("channel_id"), (F.col("l_extendedprice") / 7000).alias("crest_level"))
    return network.bank_levels(sections, levels, raised).select(F.col("id").alias("p_partkey"), "new_bank_level")


@query("""
    SELECT c.c_custkey AS id, CASE WHEN o_custkey IS NOT NULL THEN 'active' ELSE 'idle' END AS kind FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') o ON o_custkey = c.c_custkey""")
def primary_nodes(spark, d):
    """Nodes marked by what touches them."""
    active = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey").distinct()
    found = table(spark, d, "customer").join(active, F.col("c_custkey") == F.col("o_custkey"), "left")
    return found.select(F.col("c_custkey").alias("id"), F.when(F.col("o_custkey").isNotNull(), "active").otherwise("idle").alias("kind"))


@query("""
    SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, -l_linenumber, -l_partkey)) AS top_part, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1 HAVING sum(l_extendedprice) > 300000""")
def top_totals(spark, d):
    best = F.max_by("l_partkey", F.struct(F.col("l_extendedprice"), -F.col("l_linenumber"), -F.col("l_partkey")))
    found = table(spark, d, "lineitem").groupBy("l_orderkey").agg(best.alias("top_part"), F.sum("l_extendedprice").alias("total"))
    return found.where("total > 300000").select("l_orderkey", "top_part", F.round("total", 2).alias("total"))


_SHA = "sha256('opening|' || CAST(s_suppkey AS VARCHAR))"


@query(f"""
    SELECT {_SHA}[1:8] || '-' || {_SHA}[9:12] || '-' || {_SHA}[13:16] || '-' || {_SHA}[17:20] || '-' || {_SHA}[21:32] AS globalid, s_suppkey AS weir_id, round(s_acctbal, 1) AS crest_level,
      CAST(NULL AS DOUBLE) AS width, CASE WHEN n_nationkey IS NOT NULL THEN s_nationkey END AS area_id FROM supplier LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) ON n_nationkey = s_nationkey""")
def converted_layer(spark, d):
    """A child layer made from its parents: stable ids, a fixed schema, foreign keys that exist."""
    parents = table(spark, d, "supplier").withColumn("level", F.round("s_acctbal", 1))
    openings = convert.child_layer(parents, "s_suppkey", "weir_id", {"level": "crest_level", "s_nationkey": "area_id"}, {"crest_level": "double", "width": "double", "area_id": "int"}, "opening")
    areas = table(spark, d, "nation").where("n_regionkey < 3")
    return convert.linked_layers({"opening": openings, "area": areas}, [("opening", "area_id", "area", "n_nationkey")])["opening"]


@query("""
    SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS kind, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' WHEN c_mktsegment = 'MACHINERY' THEN 'M' END AS segment FROM customer""")
def domains_decoded(spark, d):
    domains = spark.sql("SELECT * FROM VALUES ('kind', '0', 'zero'), ('kind', '1', 'one'), ('kind', '1', 'zzz'), ('segment', 'BUILDING', 'B'), ('segment', 'MACHINERY', 'M') AS t(column_name, code, name)")
    coded = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("kind"), F.col("c_mktsegment").alias("segment"))
    return convert.decode_domains(coded, domains, ["kind", "segment"])


@query(f"""
    WITH {_SUPPLIERS}, p(px) AS (SELECT unnest(range(0, 110))), q(py) AS (SELECT unnest(range(0, 110)))
    SELECT px, py, max(s_suppkey) AS value FROM b, p, q WHERE px * 10 + 5 > rx + 0.25 AND py * 10 + 5 > ry + 0.25 AND (px * 10 + 5 - rx - 0.25) / 60 + (py * 10 + 5 - ry - 0.25) / 45 < 1 GROUP BY 1, 2""")
def rasterised(spark, d):
    """Triangles as pixels of 10 by 10; the oracle writes the edges out."""
    corner = lambda dx, dy: F.struct((F.col("x") + 0.25 + dx).alias("x"), (F.col("y") + 0.25 + dy).alias("y"))
    triangles = _places(table(spark, d, "supplier"), "s_suppkey", "x", "y").select("s_suppkey", F.array(corner(0.0, 0.0), corner(60.0, 0.0), corner(0.0, 45.0), corner(0.0, 0.0)).alias("ring"))
    return raster.rasterise(triangles, "s_suppkey", 10.0)


@query()
def snapped_nodes(spark, d):
    """Nodes of all points; a recursive oracle would be too slow, so it is tested against a plain loop."""
    points = _places(table(spark, d, "customer"), "c_custkey", "x", "y").withColumnRenamed("c_custkey", "id")
    return graph.snap(points, 30.0)
