"""Small cases of result marks, storage, attribute rules and fix reports: nulls, nothing found, odd values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from waterlens.operators import network, raster, rules, temporal


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def marks(spark, rain):
    """Marks of one simulation with a step an hour."""
    hours = spark.createDataFrame([("a", h, r) for h, r in enumerate(rain)], "k STRING, h LONG, r DOUBLE")
    days = temporal.rain_days(hours, ["k"], "h", "r")
    return days, temporal.result_marks(hours.withColumn("m", F.col("h") * 60), ["k"], "h", "m", days)


def test_marks_of_a_simulation(spark):
    days, found = marks(spark, [0.0] * 5 + [1.0] * 30 + [0.0] * 13)
    assert rows(days, "dry_start", "dry_end") == [(4 / 24, 13 / 24)]
    # The last step is 47: the rain ends 13 hours before it, at 34, and its mark is the step before the first one past that.
    assert rows(found, "t_0", "t_start_rain", "t_end_rain_min_one", "t_end_rain", "t_end_sum") == [(1, 5, 10, 34, 47)]


def test_marks_that_no_step_reaches(spark):
    _, found = marks(spark, [1.0, 0.0, 1.0])  # wet to the end: no step lies past it, so the last one counts; a day before: also
    assert rows(found, "t_start_rain", "t_end_rain_min_one", "t_end_rain", "t_end_sum") == [(1, 2, 2, 2)]
    _, found = marks(spark, [0.0, 0.0, None])
    assert rows(found, "t_0", "t_start_rain", "t_end_rain_min_one", "t_end_rain", "t_end_sum") == [(1, None, None, None, 2)]


def test_rises(spark):
    found = spark.createDataFrame([("a", 0, 1, 2, 3, 3)], "k STRING, t_0 LONG, t_start_rain LONG, t_end_rain_min_one LONG, t_end_rain LONG, t_end_sum LONG")
    levels = spark.createDataFrame([("a", 7, i, v) for i, v in enumerate([1.0, 2.0, 5.0, 4.5])] + [("a", 8, 0, 1.0)], "k STRING, id LONG, i LONG, v DOUBLE")
    got = temporal.level_rises(levels, ["k"], "id", "i", "v", found)
    assert rows(got, "id", "lvl_start", "lvl_rain", "lvl_end_rain", "lvl_end") == [(7, 1.0, 2.5, -0.5, 3.5), (8, None, None, None, None)]


def test_storage(spark):
    curves = spark.createDataFrame([(1, [0.0, 1.0], [0.1, 0.1], [10.0, 5.0])], "soil LONG, depths ARRAY<DOUBLE>, coefficients ARRAY<DOUBLE>, root_zone ARRAY<DOUBLE>")
    table = raster.storage_table(curves, "soil", 0.5, 2.0)
    assert [(n, round(s, 6)) for n, s in rows(table, "n", "storage")] == [(0, 0.0), (1, 0.0525), (2, 0.105), (3, 0.155), (4, 0.205)]
    given = [(1, 1, 3.0, 2.75), (2, 1, 10.0, 2.0), (3, 1, 1.0, 2.0), (4, 1, None, 2.0), (5, 2, 3.0, 2.0), (6, None, 3.0, 2.0), (7, 1, 30.0, 2.0), (8, 1, 3.0, 3.0)]
    pixels = spark.createDataFrame(given, "id LONG, soil LONG, dem DOUBLE, gw DOUBLE")
    got = dict(rows(raster.storage_raster(pixels, table, "soil", "dem", "gw", 0.5), "id", "storage"))
    assert {k: v if v is None else round(v, 6) for k, v in got.items()} == {1: 0.02625, 2: 0.0, 3: 0.0, 4: None, 5: None, 6: None, 7: 0.205, 8: 0.0}
    assert rows(raster.storage_raster(pixels.limit(0), table, "soil", "dem", "gw", 0.5), "id") == []


def test_compare_attributes(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, "AB"), (2, 5.0, None, "A"), (3, None, None, "AB"), (4, 3.0, 1.0, "both")], "id LONG, a DOUBLE, b DOUBLE, in_both STRING")
    tree = {"difference": {"left": "a", "right": "b"}}
    found = rules.compare_attributes(df, [
        {"name": "d", "type": "numeric", "function": tree}, {"name": "c", "type": "category", "left": "a", "right": "b"},
        {"name": "m", "type": "numeric", "function": {"maximum": {"left": "a", "right": "b"}}}, {"name": "s", "type": "numeric", "function": {"add": {"left": {"minimum": {"left": "a", "right": "b", "skipna": True}}, "right": 1}}},
    ])
    assert rows(found, "id", "d", "d_change_NaN", "d_priority") == [(1, 0.0, False, ""), (2, None, True, ""), (3, None, False, ""), (4, 2.0, False, "critical")]
    assert rows(found, "id", "c", "c_priority") == [(1, "not changed", None), (2, None, None), (3, None, None), (4, "3 -> 1", "critical")]
    assert rows(found, "id", "m", "s", "s_change_NaN") == [(1, 1.0, 2.0, None), (2, None, 6.0, None), (3, None, None, None), (4, 3.0, 2.0, None)]
    for wrong in ({"divide": {"left": "a", "right": "b"}}, {"add": {"left": "z", "right": 1}}):
        with pytest.raises(ValueError, match="unknown"):
            rules.compare_attributes(df, [{"name": "x", "type": "numeric", "function": wrong}])


def test_attribute_report(spark):
    layer = spark.createDataFrame([("x", 1.5, "1;2", "2; 3"), ("y", 2.5, None, "9"), ("z", 3.5, None, ""), ("w", None, "2", None)], "code STRING, level DOUBLE, invalid_critical STRING, invalid_non_critical STRING")
    fixes = spark.createDataFrame([(0, "level", [2, 1], 5, "automatic", "f"), (1, "level", [3], 6, "manual", "g"), (2, "shape", [2], 7, "manual", "h")], "position INT, attribute STRING, validation_ids ARRAY<LONG>, fix_id INT, fix_type STRING, description STRING")
    named = spark.createDataFrame([(1, "critical", "m1"), (2, "non-critical", "m2")], "id LONG, error_type STRING, message STRING")
    report = rules.attribute_report(layer, "code", fixes, named)
    assert rows(report, "code", "attribute", "validation_sum", "fixes") == [
        ("w", "level", "W2:m2", "AF5:f"), ("w", "shape", "W2:m2", "MF7:h"), ("x", "level", "W2:m2;C1:m1", "AF5:f;MF6:g"), ("x", "shape", "W2:m2", "MF7:h"),
    ]
    wide = rules.by_attribute(report, layer, "code", ["level", "shape"])
    assert rows(wide, "code", "level", "fixes_shape") == [("w", None, "MF7:h"), ("x", 1.5, "MF7:h")]


def test_map_tiles_of_nulls(spark):
    tiles = spark.createDataFrame([(1, [1.0, None, 3.0]), (2, None), (3, []), (4, [5.0])], "id LONG, data ARRAY<DOUBLE>").coalesce(1)
    assert rows(raster.map_tiles(tiles, lambda v: v * 2), "id", "data") == [(1, [2.0, None, 6.0]), (2, None), (3, []), (4, [10.0])]
    assert rows(raster.map_tiles(tiles, lambda v: v[:1]), "id", "data") == [(1, [1.0]), (2, None), (3, []), (4, [5.0])]
    assert rows(raster.map_tiles(tiles.limit(0), lambda v: v), "id") == []


def test_without_water(spark):
    values = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 0.0), (4, None), (5, 2.0)], "x LONG, value DOUBLE")
    ground = spark.createDataFrame([(1, 1.0), (2, 10.0), (3, 1.0), (4, 1.0)], "x LONG, value DOUBLE")
    assert rows(raster.without_water(values, ground, ["x"]), "x", "value") == [(1, 2.0), (2, None), (3, None), (4, None), (5, 2.0)]


def test_leaks_and_manholes(spark):
    lines = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 2.0), (3, 1.0, None), (4, None, 2.0)], "id LONG, dpumax DOUBLE, held DOUBLE")
    crossings = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", 0.5), (4, "a", None)], "line_id LONG, kind STRING, crest_level DOUBLE")
    assert rows(network.leaking_lines(lines, crossings, "held"), "id", "kind", "leaks") == [(1, "b", True), (2, "a", True), (3, None, False), (4, None, False)]
    nodes = spark.createDataFrame([(1, 3.0), (2, None), (3, 30.0), (4, 1.0)], "id LONG, storage_area DOUBLE")
    found = network.manhole_proposals(nodes, nodes.where("id = 1"), spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 1.0), (3, 2.0)], "id LONG, crest_level DOUBLE"))
    got = rows(found, "id", "calculation_type", "drain_level", "surface_level", "storage_area")
    assert got == [(1, 1, 99.0, 10.0, 3.0), (2, 2, 6.0, None, 10.0), (3, 2, 2.0, None, 30.0)]


def test_primary_lines(spark):
    channels = spark.createDataFrame([(1, 10, 11, 4), (2, 11, 12, 3), (3, None, 13, 4), (4, 1, 2, None)], "id LONG, connection_node_id_start LONG, connection_node_id_end LONG, zoom INT")
    weirs = spark.createDataFrame([("weir", 1, 10, 13), ("weir", 2, 11, 12), ("weir", 3, None, 10)], "kind STRING, id LONG, connection_node_id_start LONG, connection_node_id_end LONG")
    found = network.primary_lines(channels, weirs, "zoom")
    assert rows(found, "kind", "id", "is_primary") == [("channel", 1, True), ("channel", 2, False), ("channel", 3, True), ("channel", 4, False), ("weir", 1, True), ("weir", 2, False), ("weir", 3, False)]
