"""Chained flood analyses on small graphs."""

from __future__ import annotations

from waterlens.operators import flooding

CELLS = "id LONG, value DOUBLE, volume DOUBLE, cell_area DOUBLE, dem_area DOUBLE, water_area DOUBLE, building_area DOUBLE"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_flood_classes(spark):
    nodes = spark.createDataFrame([(k, True, 1.0) for k in (1, 2, 3, 4, 5)] + [(6, True, None), (10, False, 1.0), (11, False, 3.0)], "id LONG, is_2d BOOLEAN, level DOUBLE")
    lines = [(1, 2, "2d2d", 0.5, 10.0), (2, 3, "2d2d", 0.0, 10.0), (3, 4, "2d2d", 0.5, 0.0), (5, 6, "2d2d", 0.5, 1.0), (10, 1, "1d2d", 0.5, 5.0), (11, 2, "1d2d", 0.5, 5.0), (3, 11, "1d2d", 0.5, 5.0), (10, 4, "1d2d", None, 5.0)]
    found = flooding.flood_classes(nodes, spark.createDataFrame(lines, "u LONG, v LONG, kind STRING, flow_area DOUBLE, length DOUBLE"))
    assert rows(found, "id", "component", "class") == [(1, 1, "nuisance"), (2, 1, "nuisance"), (3, 3, "model error"), (4, 4, "puddle"), (5, 5, "puddle"), (6, 6, "puddle")]
    none = flooding.flood_classes(nodes.limit(0), spark.createDataFrame([], "u LONG, v LONG, kind STRING, flow_area DOUBLE, length DOUBLE"))
    assert rows(none, "id") == []


def test_corrected_levels_run_in_order(spark):
    # 2 and 3 are replaced: 2 takes 1's level alone, as 3 holds none yet; 3 then the mean of 2 and 4. 6 has no neighbour.
    given = [(1, 1.0, 4.0, 100.0, 80.0, 0.0, 0.0), (2, 9.0, 4.0, 100.0, 10.0, 0.0, 0.0), (3, 9.0, 4.0, 100.0, 80.0, 96.0, 0.0), (4, 3.0, 4.0, 100.0, 80.0, 0.0, None), (5, None, 4.0, 100.0, 0.0, 0.0, 0.0), (6, 7.0, None, 100.0, 80.0, 0.0, 100.0)]
    cells = spark.createDataFrame(given, CELLS)
    links = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (4, 5)], "u LONG, v LONG")
    found = flooding.corrected_levels(cells, links)
    assert rows(found, "id", "replace", "corrected", "difference") == [
        (1, None, 1.0, 0.0), (2, "dem", 1.0, -8.0), (3, "water", 2.0, -7.0), (4, None, 3.0, 0.0), (5, "dem", None, None), (6, "building", None, None),
    ]
    assert rows(found, "id", "storage_mm")[:2] == [(1, 50.0), (2, 400.0)]
