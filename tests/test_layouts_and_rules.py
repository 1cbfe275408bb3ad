"""Tiles and their pruning, rules that use each other, the national grid, resampling by area, places along channels."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from waterlens.functions.projection import from_national, line_to_national, to_national
from waterlens.operators import named_rules, network, raster
from waterlens.session import new_path
from waterlens.sources import tiles


def test_ranges_hold_the_window_and_little_else():
    rng = random.Random(1)
    for _ in range(40):
        x0, y0 = tiles.MIDDLE + rng.randint(-50, 50), tiles.MIDDLE + rng.randint(-50, 50)
        x1, y1 = x0 + rng.randint(0, 12), y0 + rng.randint(0, 12)
        for most in (8, 48, 10_000):
            ranges = tiles.key_ranges(x0, y0, x1, y1, most)
            inside = {tiles._key(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
            assert all(any(a <= k <= b for a, b in ranges) for k in inside) and len(ranges) <= most
            if most == 10_000:
                assert sum(b - a + 1 for a, b in ranges) == len(inside)


def test_a_window_reads_its_blocks_only(spark):
    pixels = spark.range(200 * 200).select((F.col("id") % 200 - 100.0).alias("x"), (F.floor(F.col("id") / 200) - 100.0).alias("y"), F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, float("nan")).otherwise(F.col("id") * 0.5).alias("value"), "id")
    pixels = pixels.unionByName(spark.createDataFrame([(None, 1.0, 1.0, -1)], pixels.schema))
    path = new_path(spark, "tiles")
    tiles.write_tiles(pixels, path, "value", 4.0)
    clean = pixels.where("x IS NOT NULL").withColumn("value", F.nanvl("value", F.lit(None)))
    everything = tiles.read_tiles(spark, path)
    assert everything.count() == clean.count() and everything.select(*clean.columns).exceptAll(clean).count() == 0
    window = (-13.0, 20.0, 9.5, 41.0)
    found = tiles.read_tiles(spark, path, window)
    expected = clean.where("x >= -13 AND x < 9.5 AND y >= 20 AND y < 41")
    assert found.count() == expected.count() > 0 and found.select(*clean.columns).exceptAll(expected).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "block" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(tile" in plan  # keys reach the row groups
    touched = {tiles._key(x + tiles.MIDDLE, y + tiles.MIDDLE) >> tiles.BLOCK_BITS for x in range(-4, 3) for y in range(5, 11)}
    assert {r[0] for r in found.select(F.regexp_extract(F.input_file_name(), r"block=(\d+)", 1).cast("long")).distinct().collect()} <= touched
    assert tiles.read_tiles(spark, path, (500.0, 500.0, 600.0, 600.0)).count() == 0


RULE = {"name": "a", "function": "sum", "inputs": {"x": "v", "y": 1.0}}


@pytest.mark.parametrize(
    ("rules", "said"),
    [
        ([RULE, {"name": "b", "function": "sum", "inputs": {"x": "nowhere"}}], "nowhere"),
        ([RULE, RULE], "twice"),
        ([{"name": "v", "function": "sum", "inputs": {}}], "twice"),
        ([{"name": "b", "function": "guess", "inputs": {"x": "v"}}], "guess"),
        ([{"name": "b", "function": "less", "inputs": {"left": "v"}}], "b"),
        ([{"name": n, "function": "sum", "inputs": {"x": m}} for n, m in (("p", "q"), ("q", "r"), ("r", "p"))], "wait for each other"),
    ],
)
def test_rules_that_cannot_be_compiled(rules, said):
    with pytest.raises(named_rules.RuleError, match=said):
        named_rules.expressions(named_rules.in_order(rules, ["id", "v"]), ["id", "v"]) if "guess" not in said else named_rules.expressions(rules, ["id", "v"])


def test_rules_use_results_in_any_order(spark):
    rows = spark.createDataFrame([(1, 2.0, 5), (2, None, 5), (3, 9.0, None)], "id long, v double, node long")
    lines = spark.createDataFrame([(5, 6), (7, 5), (5, 5), (None, 5)], "start_node long, end_node long")
    counted = named_rules.ends_on(rows, "id", lines, "node", "n_ends")
    general = [
        {"name": "twice", "function": "multiply", "inputs": {"left": "more", "right": 2}},
        {"name": "more", "function": "sum", "inputs": {"x": "v", "y": 1.0}},
        {"name": "meets", "function": "at_least", "inputs": {"left": "n_ends", "right": 1}},
    ]
    checks = [
        {"id": 7, "name": "small", "function": "less", "inputs": {"left": "twice", "right": 10}},
        {"id": 8, "name": "told", "function": "exists", "inputs": {"value": "v"}},
        {"id": 9, "name": "near", "function": "equal", "inputs": {"left": "v", "right": 9.2, "tolerance": 0.5}, "filter": "meets"},
        {"id": 10, "name": "chosen", "function": "if_else", "inputs": {"test": "told", "then": True, "otherwise": False}},
        {"id": 11, "name": "off", "function": "exists", "inputs": {"value": "v"}, "active": False},
    ]
    full = {r["id"]: (r["n_ends"], r["twice"]) for r in named_rules.with_results(counted, general).collect()}
    assert full == {1: (5, 6.0), 2: (5, None), 3: (0, 20.0)}
    found = {r["id"]: (r["valid"], r["invalid"], r["ignored"]) for r in named_rules.findings(counted, "id", general, checks).collect()}
    assert found == {1: ("7;8;10", "9", ""), 2: ("", "8;10", "7;9"), 3: ("8;10", "7", "")}
    assert named_rules.findings(counted, "id", general, []).where("valid <> '' OR invalid <> '' OR ignored <> ''").count() == 0


def test_the_national_grid_comes_back(spark):
    places = [(x, y) for x in range(20_000, 280_001, 26_000) for y in range(310_000, 620_001, 31_000)]
    given = spark.createDataFrame([(float(x), float(y)) for x, y in places] + [(None, 1.0)], "x double, y double")
    back = given.withColumn("w", from_national(F.col("x"), F.col("y"))).withColumn("b", to_national(F.col("w.lon"), F.col("w.lat")))
    for r in back.collect():
        if r["x"] is None:
            assert r["b"]["x"] is None
        else:
            assert math.hypot(r["b"]["x"] - r["x"], r["b"]["y"] - r["y"]) < 0.01
    centre = given.limit(1).select(from_national(F.lit(155000.0), F.lit(463000.0)).alias("w"), to_national(F.lit(4.8832), F.lit(52.3732)).alias("b")).first()
    assert (centre["w"]["lon"], centre["w"]["lat"]) == pytest.approx((5.38720621, 52.1551744))
    assert (centre["b"]["x"], centre["b"]["y"]) == pytest.approx((120_700, 487_525), abs=400)  # the tower of a known church
    line = given.limit(1).select(line_to_national(F.array(F.struct(F.lit(5.38720621).alias("x"), F.lit(52.1551744).alias("y")))).alias("l")).first()["l"]
    assert tuple(line[0]) == pytest.approx((155000, 463000), abs=0.01)


@pytest.mark.parametrize(("size", "new"), [(3.0, 2.0), (2.0, 3.0), (1.0, 0.25), (2.0, 2.0)])
def test_resampling_keeps_sums(spark, size, new):
    rng = random.Random(3)
    rows = [(i, j, rng.randint(-40, 40) / 8 if rng.random() < 0.9 else None) for i in range(-3, 4) for j in range(5)]
    found = {(r["i"], r["j"]): r for r in raster.resample_by_area(spark.createDataFrame(rows, "i long, j long, v double"), "v", size, new).collect()}
    sums, areas = {}, {}
    fine = 12  # parts of a metre
    for i, j, v in rows:
        if v is not None:
            for a in range(round(i * size * fine), round((i + 1) * size * fine)):
                for b in range(round(j * size * fine), round((j + 1) * size * fine), fine // 4):
                    at = (math.floor(a / (new * fine)), math.floor(b / (new * fine)))
                    part = 1 / fine / 4
                    sums[at], areas[at] = sums.get(at, 0.0) + v * part, areas.get(at, 0.0) + part
    assert found.keys() == sums.keys()
    for at, r in found.items():
        assert (r["total"], r["area"], r["mean"]) == pytest.approx((sums[at] / size**2, areas[at], sums[at] / areas[at]))
    assert sum(r["total"] for r in found.values()) == pytest.approx(sum(v for _, _, v in rows if v is not None))


def test_sections_find_their_place_on_a_channel(spark):
    point = "struct<x: double, y: double>"
    channels = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0)]), (2, None)], f"id long, line array<{point}>")
    sections = spark.createDataFrame([(7, 1, 3.0, 2.0, 1.5), (8, 1, 12.0, 4.0, None), (9, 2, 0.0, 0.0, 1.0), (10, 77, 0.0, 0.0, 1.0)], "id long, channel_id long, x double, y double, reference_level double")
    found = {r["id"]: (r["channel_id"], r["offset"], r["length"]) for r in network.sections_on_channels(sections, channels).collect()}
    assert found == {7: (1, 3.0, 15.0), 8: (1, 14.0, 15.0), 9: (2, None, None), 10: (77, None, None)}
