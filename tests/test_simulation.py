"""Inputs of a simulation, combined floods and clipped rasters on hand-made tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from waterlens.operators import flooding, graph, raster, simulation


def test_table_controls(spark):
    controls = spark.createDataFrame([(1, "table", 10, 1, 100), (2, "table", 11, 1, 101), (3, "table", 12, 2, 100), (4, "memory", 13, 1, 100), (5, "table", 99, 1, 100), (6, None, 10, 1, 100)], "id long, control_type string, control_id long, control_group_id int, measure_group_id long")
    measures = spark.createDataFrame([(1, 100, "v2_connection_nodes", 7), (2, 100, "v2_connection_nodes", 8), (3, 101, "v2_weir", 9)], "id long, measure_group_id long, object_type string, object_id long")
    tables = spark.createDataFrame([(10, "0.5;1#0.7;2", "set_crest_level", 20, "v2_weir", "waterlevel"), (11, "1;2 3#4;5 6", "set_discharge_coefficients", 21, "v2_orifice", "discharge"), (12, "1;2", "set_gate", 22, "v2_weir", None)], "id long, action_table string, action_type string, target_id long, target_type string, measure_variable string")
    found = {r["id"]: r.asDict() for r in simulation.table_controls(controls, measures, tables, 1, 600).collect()}
    assert found.keys() == {1, 2, 5}
    assert found[1] == {"id": 1, "node": 8, "variable": "s1", "operator": ">", "structure_type": "v2_weir", "structure_id": 20, "type": "set_crest_level", "values": [[0.5, 1.0], [0.7, 2.0]], "duration": 600}
    assert found[2]["node"] is None and found[2]["variable"] == "discharge" and found[2]["values"] == [[1.0, 2.0, 2.0], [4.0, 5.0, 5.0]]
    assert found[5]["values"] is None and found[5]["type"] is None
    other = {r["id"]: r["values"] for r in simulation.table_controls(controls, measures, tables, 2, 600).collect()}
    assert other == {3: None} and simulation.table_controls(controls, measures, tables, None, 600).count() == 0
    assert {r["id"] for r in simulation.refused_controls(controls, 1).collect()} == {4, 6}


def test_laterals_boundaries_aggregations(spark):
    given = spark.createDataFrame([(1, 5, "0,1.5\n5,2\n10,3\n11,4\n12,5"), (2, 6, "0,1\n99,2"), (3, 7, None), (4, 8, ""), (5, 9, "20,1\n1,2")], "id long, connection_node_id long, timeseries string")
    found = {r["id"]: r["values"] for r in simulation.laterals(given, 600).collect()}
    assert found == {1: [[0.0, 1.5], [300.0, 2.0], [600.0, 3.0], [600.0, 4.0]], 2: [[0.0, 1.0], [600.0, 2.0]], 3: None, 4: [], 5: [[600.0, 1.0]]}
    assert simulation.boundaries(given.where("id = 2").select("id", "timeseries")).first()["values"] == [[0.0, 1.0], [99.0, 2.0]]
    settings = spark.createDataFrame([("a", "waterlevel", "max", 60), ("b", "discharge", "cum", None)], "var_name string, flow_variable string, aggregation_method string, timestep long")
    assert [tuple(r) for r in simulation.aggregations(settings).orderBy("name").collect()] == [("a", "water_level", "max", 60), ("b", "discharge", "cum", None)]


def test_two_scenarios_must_be_of_the_same_cells(spark):
    kinds = ["puddle", "nuisance", "model error", None]
    rows = spark.createDataFrame([(a, b) for a in kinds for b in kinds], "a string, b string")
    found = {(r["a"], r["b"]): r["c"] for r in rows.withColumn("c", graph.combine_classes(F.col("a"), F.col("b"))).collect()}
    for (a, b), c in found.items():
        assert c == ("model error" if a == b == "model error" else "nuisance" if "nuisance" in (a, b) else "puddle" if "puddle" in (a, b) else None)
    nodes = spark.createDataFrame([(1, True, 1.0), (2, True, 1.0)], "id long, is_2d boolean, level double")
    lines = spark.createDataFrame([(1, 2, "2d2d", 0.5, 1.0)], "u long, v long, kind string, flow_area double, length double")
    cells = [("p", 1, 0.0, 0.0), ("p", 2, 1.0, 0.0), ("b", 1, 0.0, 0.0), ("b", 2, 1.0, 0.0)]
    of = lambda rows: flooding.combined_flood_classes({"p": (nodes, lines), "b": (nodes, lines.limit(0))}, spark.createDataFrame(rows, "name string, id long, x double, y double"))
    assert sorted(map(tuple, of(cells).collect())) == [(1, "puddle", "puddle", "puddle"), (2, "puddle", "puddle", "puddle")]
    for wrong in (cells[:3], [*cells[:3], ("b", 2, 1.0, 0.5)], [*cells, ("b", 3, 0.0, 0.0)]):
        with pytest.raises(flooding.UnequalCells):
            of(wrong)


def test_large_groups_are_filled_in_rounds(spark, monkeypatch):
    cells = spark.range(40).select("id", (F.col("id") * 0.5).alias("value"), F.lit(1.0).alias("volume"), F.lit(100.0).alias("cell_area"), F.when(F.col("id") % 4 > 1, 10.0).otherwise(80.0).alias("dem_area"), F.lit(0.0).alias("water_area"), F.lit(0.0).alias("building_area"))
    links = spark.range(39).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    of = lambda: sorted((r["id"], r["corrected"]) for r in flooding.corrected_levels(cells, links).collect())
    expected = of()
    monkeypatch.setattr(flooding, "TASK_CELLS", 3)
    assert of() == expected


def test_clipped_rasters(spark):
    rasters = spark.createDataFrame([("dem", 0, 0, 1.5), ("dem", 1, 0, None), ("dem", 2, 0, 2.5), ("dem", 9, 9, 1.0), ("landuse", 0, 0, 3.9), ("landuse", 2, 0, -3.9), ("friction", 0, 0, 0.25)], "name string, px long, py long, value double")
    model, water = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (2, 0)], "px long, py long"), spark.createDataFrame([(0, 0), (1, 0), (0, 0)], "px long, py long")
    found = {(r["name"], r["px"]): r["value"] for r in raster.clipped_to_model(rasters, model, water).collect()}
    assert found == {("dem", 0): 10.0, ("dem", 1): None, ("dem", 2): 2.5, ("landuse", 0): 3.0, ("landuse", 2): -3.0, ("friction", 0): 0.25}
    ground = spark.createDataFrame([(0, 0, 1.0), (1, 0, None)], "px long, py long, value double")
    houses = spark.createDataFrame([(1, 1), (2, 0), (1, 1)], "px long, py long")
    fine = {(r["px"], r["py"]): r["value"] for r in raster.damage_ground(ground, houses).collect()}
    assert fine == {(0, 0): 1.0, (1, 0): 1.0, (0, 1): 1.0, (1, 1): 1.1, (2, 0): None, (3, 0): None, (2, 1): None, (3, 1): None}
