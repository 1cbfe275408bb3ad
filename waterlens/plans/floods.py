"""Chained flood analyses over graphs whose groups are known, so that SQL can write them out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flooding, raster, simulation
from ..session import table
from .registry import query


@query("""
    WITH n AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey // 7 * 7 AS BIGINT) AS g, p_partkey % 11 = 0 AND p_partkey % 5 > 0 AS active, p_partkey % 11 = 0 AND p_partkey % 5 > 0 AND p_partkey % 3 = 0 AS valid FROM part),
    c AS (SELECT g, bool_or(valid) AS v, bool_or(active) AS a, min(id) AS component FROM n GROUP BY 1)
    SELECT id, component, CASE WHEN v THEN 'nuisance' WHEN a THEN 'model error' ELSE 'puddle' END AS class FROM n JOIN c USING (g)""")
def flooded_areas(spark, d):
    """Classes of flooded areas: groups of up to seven nodes in a row, some in touch with the 1D network."""
    ids = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"))
    nodes = ids.select("id", F.lit(True).alias("is_2d"), F.lit(1.0).alias("level"))
    nodes = nodes.unionByName(ids.select((-F.col("id") - 1).alias("id"), F.lit(False).alias("is_2d"), F.when(F.col("id") % 3 == 0, 1.001).otherwise(2.0).alias("level")))
    last = F.col("id") % 7 == 6
    rows = ids.join(ids.select((F.col("id") - 1).alias("_before")), F.col("id") == F.col("_before"), "left_semi")
    lines = rows.select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit("2d2d").alias("kind"), F.when(last, 0.0).otherwise(0.5).alias("flow_area"), F.lit(1.0).alias("length"))
    up = ids.where("id % 11 = 0").select((-F.col("id") - 1).alias("u"), F.col("id").alias("v"), F.lit("1d2d").alias("kind"), F.when(F.col("id") % 5 > 0, 0.2).otherwise(0.0).alias("flow_area"), F.lit(1.0).alias("length"))
    return flooding.flood_classes(nodes, lines.unionByName(up))


@query("""
    WITH c AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_retailprice AS value, CASE p_partkey % 5 WHEN 0 THEN 'dem' END AS replace, lag(p_retailprice) OVER w AS a, lead(p_retailprice) OVER w AS b FROM part WINDOW w AS (ORDER BY p_partkey)),
    f AS (SELECT id, value, replace, CASE WHEN replace IS NULL THEN value ELSE round((coalesce(a, 0) + coalesce(b, 0)) / (CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT)), 5) END AS corrected FROM c)
    SELECT id, replace, round(corrected, 2) AS corrected, round(corrected - value, 2) AS difference, round(value / (CASE WHEN replace IS NULL THEN 80 ELSE 20 END) * 1000, 2) AS storage_mm FROM f""")
def corrected_cells(spark, d):
    """Cells in one row of which every fifth takes the mean of its neighbours."""
    cells = table(spark, d, "part").select(
        F.col("p_partkey").cast("long").alias("id"), F.col("p_retailprice").alias("value"), F.col("p_retailprice").alias("volume"), F.lit(100.0).alias("cell_area"),
        F.when(F.col("p_partkey") % 5 == 0, 20.0).otherwise(80.0).alias("dem_area"), F.lit(0.0).alias("water_area"), F.lit(0.0).alias("building_area"),
    )
    links = cells.select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = flooding.corrected_levels(cells, links.join(cells.select("id"), F.col("v") == F.col("id"), "left_semi"))
    return found.select("id", "replace", F.round("corrected", 2).alias("corrected"), F.round("difference", 2).alias("difference"), "storage_mm")


@query("""
    WITH n AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey // 7 * 7 AS BIGINT) AS g FROM part), s AS (SELECT * FROM (VALUES ('peak', 11), ('block', 13)) t(name, m)),
    c AS (SELECT name, g, bool_or(id % m = 0 AND id % 5 > 0) AS a, bool_or(id % m = 0 AND id % 5 > 0 AND id % 3 = 0) AS v FROM n, s GROUP BY 1, 2),
    k AS (SELECT name, g, CASE WHEN v THEN 'nuisance' WHEN a THEN 'model error' ELSE 'puddle' END AS class FROM c),
    w AS (SELECT id, p.class AS class_peak, b.class AS class_block FROM n JOIN k p ON p.g = n.g AND p.name = 'peak' JOIN k b ON b.g = n.g AND b.name = 'block')
    SELECT *, CASE WHEN class_peak = 'model error' AND class_block = 'model error' THEN 'model error' WHEN 'nuisance' IN (class_peak, class_block) THEN 'nuisance' WHEN 'puddle' IN (class_peak, class_block) THEN 'puddle' END AS final_class FROM w""")
def flooded_in_two_scenarios(spark, d):
    """Classes of flooded areas in two scenarios of the same cells, and what both say."""
    ids = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"))
    last = F.col("id") % 7 == 6
    rows = ids.join(ids.select((F.col("id") - 1).alias("_before")), F.col("id") == F.col("_before"), "left_semi")
    between = rows.select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit("2d2d").alias("kind"), F.when(last, 0.0).otherwise(0.5).alias("flow_area"), F.lit(1.0).alias("length"))

    def scenario(every):
        nodes = ids.select("id", F.lit(True).alias("is_2d"), F.lit(1.0).alias("level"))
        nodes = nodes.unionByName(ids.select((-F.col("id") - 1).alias("id"), F.lit(False).alias("is_2d"), F.when(F.col("id") % 3 == 0, 1.001).otherwise(2.0).alias("level")))
        up = ids.where(F.col("id") % every == 0).select((-F.col("id") - 1).alias("u"), F.col("id").alias("v"), F.lit("1d2d").alias("kind"), F.when(F.col("id") % 5 > 0, 0.2).otherwise(0.0).alias("flow_area"), F.lit(1.0).alias("length"))
        return nodes, between.unionByName(up)

    cells = ids.select(F.explode(F.array(F.lit("peak"), F.lit("block"))).alias("name"), "id", (F.col("id") % 10).alias("x"), F.floor(F.col("id") / 10).alias("y"))
    return flooding.combined_flood_classes({"peak": scenario(11), "block": scenario(13)}, cells)


@query("""
    WITH r AS (SELECT name, l_partkey % 300 AS px, l_suppkey * 7 + l_linenumber AS py, max(l_quantity) AS q, max(l_extendedprice) AS e FROM lineitem, unnest(['dem', 'landuse', 'friction']) t(name) GROUP BY ALL),
    v AS (SELECT name, px, py, CASE WHEN q > 3 THEN CASE name WHEN 'dem' THEN q / 4 WHEN 'landuse' THEN q + 0.75 ELSE e / 1000 END END AS value FROM r)
    SELECT name, CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, round(CASE WHEN name = 'dem' AND py % 9 = 0 AND value IS NOT NULL THEN 10 WHEN name = 'landuse' THEN floor(value) ELSE value END, 6) AS value FROM v WHERE px % 5 > 0""")
def rasters_of_model(spark, d):
    """Rasters clipped to a model, the ground held at a fixed level where there is water."""
    spot = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 300).cast("long").alias("px"), (F.col("l_suppkey") * 7 + F.col("l_linenumber")).cast("long").alias("py")).agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("e"))
    value = F.when(F.col("name") == "dem", F.col("q") / 4).when(F.col("name") == "landuse", F.col("q") + 0.75).otherwise(F.col("e") / 1000)
    given = spot.withColumn("name", F.explode(F.array(*map(F.lit, ("dem", "landuse", "friction"))))).select("name", "px", "py", F.when(F.col("q") > 3, value).alias("value"))
    places = spot.select("px", "py")
    found = raster.clipped_to_model(given, places.where("px % 5 > 0"), places.where("py % 9 = 0"))
    return found.select("name", "px", "py", F.round("value", 6).alias("value"))


@query("""
    WITH g AS (SELECT CAST(p_partkey % 50 AS BIGINT) AS x, CAST(p_partkey // 50 AS BIGINT) AS y, CASE WHEN p_partkey % 11 > 0 THEN round(p_retailprice, 2) END AS v FROM part),
    f AS (SELECT x * 2 + i AS px, y * 2 + j AS py, v FROM g, range(2) a(i), range(2) b(j))
    SELECT px, py, round(v + CASE WHEN (px + py) % 3 = 0 THEN 0.1 ELSE 0 END, 4) AS value FROM f""")
def ground_for_damage(spark, d):
    """Ground in finer pixels, higher where a building stands."""
    ground = table(spark, d, "part").select((F.col("p_partkey") % 50).cast("long").alias("px"), F.floor(F.col("p_partkey") / 50).alias("py"), F.when(F.col("p_partkey") % 11 > 0, F.round("p_retailprice", 2)).alias("value"))
    twice = F.explode(F.sequence(F.lit(0), F.lit(1)))
    houses = ground.withColumn("i", twice).withColumn("j", twice).select((F.col("px") * 2 + F.col("i")).alias("px"), (F.col("py") * 2 + F.col("j")).alias("py")).where("(px + py) % 3 = 0")
    return raster.damage_ground(ground, houses).select("px", "py", F.round("value", 4).alias("value"))


@query("""
    WITH c AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS node, CAST(10 + o_orderkey % 90 AS INTEGER) AS step, floor(o_totalprice) / 100 AS q FROM orders),
    t AS (SELECT id, node, step, i, step * i * 60 AS t, round(q + i, 2) AS q FROM c, range(0, 8) r(i))
    SELECT id, node AS connection_node, string_agg(CAST(least(t, 18000) AS INTEGER) || ':' || CAST(q AS DECIMAL(18, 2)), ' ' ORDER BY i) AS series FROM t WHERE t - step * 60 <= 18000 GROUP BY 1, 2""")
def lateral_flows(spark, d):
    """Laterals with their flows up to the end of a simulation of five hours."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("connection_node_id"), (10 + F.col("o_orderkey") % 90).alias("step"), (F.floor("o_totalprice") / 100).alias("q"))
    line = lambda i: F.concat_ws(",", (F.col("step") * i).cast("string"), F.round(F.col("q") + i, 2).cast("string"))
    given = orders.select("id", "connection_node_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), line), "\n").alias("timeseries"))
    found = simulation.laterals(given, 18_000)
    series = F.array_join(F.transform("values", lambda v: F.concat_ws(":", F.get(v, 0).cast("int").cast("string"), F.get(v, 1).cast("decimal(18, 2)").cast("string"))), " ")
    return found.select("id", "connection_node", series.alias("series"))


@query("""
    WITH a AS (SELECT l_orderkey AS t, string_agg(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ';' || CAST(l_linenumber AS VARCHAR) || ' 9', '#' ORDER BY l_linenumber) AS acts, list([CAST(CAST(l_quantity AS INTEGER) AS DOUBLE), CAST(l_linenumber AS DOUBLE)] ORDER BY l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ';') AS v FROM lineitem GROUP BY 1)
    SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS BIGINT) AS node, CASE WHEN t IS NOT NULL THEN CASE WHEN o_orderkey % 2 = 0 THEN 's1' ELSE 'discharge' END END AS variable,
      CASE WHEN o_orderkey % 3 > 0 THEN array_to_string([CAST(CAST(x[1] AS INTEGER) AS VARCHAR) || ':' || CAST(CAST(x[2] AS INTEGER) AS VARCHAR) || CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE ':' || CAST(CAST(x[2] AS INTEGER) AS VARCHAR) END FOR x IN v], ' ') END AS actions
    FROM orders LEFT JOIN a ON t = o_orderkey WHERE o_orderkey % 10 > 0 AND o_orderkey % 7 > 0""")
def simulation_controls(spark, d):
    """Table controls of a group with where they measure and what they do; some have no node, some an unknown action."""
    orders, k = table(spark, d, "orders"), F.col("o_orderkey")
    controls = orders.select(k.cast("long").alias("id"), F.when(k % 10 > 0, "table").otherwise("memory").alias("control_type"), k.alias("control_id"), F.when(k % 7 > 0, 1).otherwise(2).alias("control_group_id"), F.col("o_custkey").alias("measure_group_id"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("measure_group_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    kind = F.when(F.col("measure_group_id") % 4 > 0, "v2_connection_nodes").otherwise("v2_pumpstation")
    measures = customers.select((F.col("measure_group_id") * 2 + F.col("n")).alias("id"), "measure_group_id", kind.alias("object_type"), (F.col("measure_group_id") - 1 + F.col("n")).cast("long").alias("object_id"))
    lines = table(spark, d, "lineitem").withColumn("text", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(";"), F.col("l_linenumber").cast("string")))
    acts = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "text"))).alias("s"))
    kind = F.when(F.col("id") % 3 == 1, "set_crest_level").when(F.col("id") % 3 == 2, "set_discharge_coefficients").otherwise("set_nothing")
    text = F.array_join(F.transform("s", lambda s: F.when(F.col("id") % 3 == 2, F.concat(s["text"], F.lit(" 9"))).otherwise(s["text"])), "#")
    tables_ = acts.select("id", text.alias("action_table"), kind.alias("action_type"), F.lit("weir").alias("target_type"), F.col("id").alias("target_id"), F.when(F.col("id") % 2 == 0, "waterlevel").otherwise("discharge").alias("measure_variable"))
    found = simulation.table_controls(controls, measures, tables_, 1, 3600)
    actions = F.array_join(F.transform("values", lambda v: F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), ":")), " ")
    return found.select("id", "node", "variable", actions.alias("actions"))
