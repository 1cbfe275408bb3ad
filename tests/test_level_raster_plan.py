"""Level rasters bring no table of centres to the driver and work on tiles near pixels only."""

from __future__ import annotations

import pytest

from waterlens.operators import triangles


@pytest.mark.parametrize("blend", [False, True])
def test_no_table_is_broadcast(spark, blend):
    centres = spark.createDataFrame([(i * 20 + j, i * 10.0, j * 10.0, None if blend and (i + j) % 7 == 0 else i + 2.0 * j) for i in range(20) for j in range(20)], "id long, x double, y double, level double")
    pixels = spark.createDataFrame([(12.0, 13.0, 1, 0.5), (14.0, 31.0, 1, 500.0)], "px double, py double, cell long, dem double")
    found = triangles.level_raster(pixels, centres, 30.0, 12.0, blend=blend)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    if not blend:
        assert sorted((r["px"], round(r["level"], 9), round(r["depth"], 9)) for r in found.collect()) == [(12.0, 3.8, 3.3), (14.0, 7.6, 0.0)]
    every, near = triangles.triangles(centres, 30.0, 12.0), triangles.triangles(centres, 30.0, 12.0, near=pixels)
    assert near.count() < every.count() / 3 and near.exceptAll(every).isEmpty()
