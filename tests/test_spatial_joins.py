"""Joins of shapes and points against loops over all pairs, and what they compare on the way."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from waterlens.operators import graph, lines, polygons, spatial

LINE = "array<struct<x:double,y:double>>"


def compared(monkeypatch):
    """Collects how many pairs each join on cells compares."""
    counts, plain = [], spatial._join_cells

    def join(left, right, keys, test, pairs):
        counts.append(plain(left, right, keys, F.lit(True), pairs).count())
        return plain(left, right, keys, test, pairs)

    monkeypatch.setattr(spatial, "_join_cells", join)
    return counts


def meet(p, q):
    """Whether two segments of whole coordinates have a point in common."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    boxes = all(max(min(p[0][k], p[1][k]), min(q[0][k], q[1][k])) <= min(max(p[0][k], p[1][k]), max(q[0][k], q[1][k])) for k in (0, 1))
    return boxes and turn(*p, q[0]) * turn(*p, q[1]) <= 0 and turn(*q, p[0]) * turn(*q, p[1]) <= 0


def test_crossings_of_short_and_very_long_lines(spark, monkeypatch):
    rng = random.Random(4)
    walk = lambda n, step: [(x, y) for x, y in [(rng.randint(0, 400), rng.randint(0, 400))] for _ in range(n) for x, y in [(x + rng.randint(-step, step), y + rng.randint(-step, step))]]
    left = {k: walk(rng.choice((1, 2, 3)), 6) for k in range(600)} | {900: [(5, 5), (5, 5)], 901: [(0, 0), (40, 40), (80, 80)], 902: None}
    right = {k: [(x := rng.randint(0, 400), y := rng.randint(0, 400)), (x + 2000, y + 1500)] if k % 3 == 0 else walk(2, 9) for k in range(150)} | {903: [(5, 0), (5, 900)], 904: [(20, 20), (60, 60)], 905: [(80, 80), (20, 20)]}
    steps = lambda line: list(zip(line, line[1:], strict=False)) if line else []
    expected = {(a, b, n) for a in left for b in right if (n := sum(meet(p, q) for p in steps(left[a]) for q in steps(right[b])))}
    counts = compared(monkeypatch)
    frame = lambda side, key: spark.createDataFrame([(k, v and [(float(x), float(y)) for x, y in v]) for k, v in side.items()], f"{key} long, line {LINE}")
    found = spatial.lines_meet(frame(left, "a"), frame(right, "b"), "a", "b", 32.0)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert counts[0] < sum(len(steps(v)) for v in left.values()) * len(right) / 4  # a long line's box holds everything
    assert spatial.lines_meet(frame(left, "a").limit(0), frame(right, "b"), "a", "b", 32.0).collect() == []


@pytest.mark.parametrize("size", [1.0, 32.0])
def test_boxes_of_all_sizes_meet_once(spark, monkeypatch, size):
    rng = random.Random(5)

    def boxes(n, p, widths):
        rows = []
        for k in range(n):
            x, y, w, h = rng.randint(-90, 90), rng.randint(-90, 90), rng.choice(widths), rng.choice(widths)
            rows.append((k, *map(float, (x, y, x + w, y + h))))
        return rows, spark.createDataFrame([*rows, (n, None, 1.0, 2.0, 3.0), (n + 1, float("nan"), 1.0, 2.0, 3.0)], f"{p} long, " + ", ".join(f"{p}{c} double" for c in ("xmin", "ymin", "xmax", "ymax")))

    for lw, rw in (((0,), (0,)), ((0,), (3, 9)), ((1, 5, 150), (0, 20)), ((14, 15), (14, 15))):
        (a, left), (b, right) = boxes(300, "l", lw), boxes(200, "r", rw)
        counts = compared(monkeypatch)
        found = sorted(map(tuple, spatial.boxes_meet(left, right, size).select("l", "r").collect()))
        expected = [(i, j) for i, x0, y0, x1, y1 in a for j, u0, v0, u1, v1 in b if x0 <= u1 and u0 <= x1 and y0 <= v1 and v0 <= y1]
        assert found == sorted(expected)
        if lw == rw == (14, 15):  # cells of one level held many that do not meet
            assert counts[-1] < 4 * len(expected) + 2 * len(a)


def test_longest_inside_is_that_of_all_lengths(spark):
    rng = random.Random(6)
    ring = lambda x, y, r: [(x - r, y), (x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    box = lambda x, y, r: [(x, y), (x + r, y), (x + r, y + r), (x, y + r), (x, y)]
    place = lambda: (float(rng.randint(0, 60)), float(rng.randint(0, 60)))
    shapes = spark.createDataFrame([(k, [(ring if k % 3 else box)(*place(), float(rng.randint(3, 15)))]) for k in range(80)] + [(90, None), (91, [])], f"polygon_id long, rings array<{LINE}>")
    for sizes in ((2,), (1, 2, 3, 4)):
        given = spark.createDataFrame([(k, [place() for _ in range(rng.choice(sizes))]) for k in range(60)] + [(70, [(5.0, 5.0), (5.0, 40.0)]), (71, [(3.0, 8.0), (3.0, 8.0)]), (72, None)], f"line_id long, line {LINE}")
        every = lines.lengths_inside(given, shapes, 8.0).withColumn("length", F.round("length", 4)).where("length > 0").collect()
        expected = {}
        for r in sorted(every, key=lambda r: (-r["length"], r["polygon_id"])):
            expected.setdefault(r["line_id"], (r["polygon_id"], r["length"]))
        found = {r["line_id"]: (r["polygon_id"], r["length"]) for r in lines.longest_inside(given, shapes, 8.0, digits=4).collect()}
        assert found == expected and len(expected) > 30


def test_equal_polygons_are_one(spark, monkeypatch):
    counts, plain = [], polygons._edges
    monkeypatch.setattr(polygons, "_edges", lambda shapes, size: (counts.append(shapes.count()), plain(shapes, size))[1])
    box = lambda x, r: [[(x, 0.0), (x + r, 0.0), (x + r, r), (x, r), (x, 0.0)]]
    given = spark.createDataFrame([(k % 2, box(float(k % 3), 2.0)) for k in range(240)] + [(None, box(0.0, 3.0))] * 2, f"grp long, rings array<{LINE}>")
    assert {r["grp"]: round(r["area"], 9) for r in polygons.union_areas(given, "grp", 4.0).collect()} == {0: 8.0, 1: 8.0, None: 9.0}
    assert counts == [7]


@pytest.mark.parametrize("group", [None, "grp"])
@pytest.mark.parametrize("rounds", [None, 1, 3])
def test_nearest_among_many_compares_few(spark, monkeypatch, group, rounds):
    rng = random.Random(7)
    # dense, with equal places, and a few far away
    right = [(k, float(rng.randint(0, 40)), float(rng.randint(0, 40)), k % 3) for k in range(2000)] + [(9000, 500.0, 700.0, 1), (9001, None, 3.0, 1)]
    left = [(k, rng.uniform(-5, 45), rng.uniform(-5, 45), k % 4) for k in range(300)] + [(400, 480.0, 650.0, 1), (401, None, 1.0, 1), (402, 7.0, 7.0, None)]
    limit = float("inf") if rounds is None else 16.0 * 2 ** (rounds - 1)
    expected = {}
    for k, x, y, g in left:
        near = [(((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, u, v, h in right if None not in (x, u) and (group is None or g == h)]
        if near and min(near)[0] <= limit:
            expected[k] = min(near)[1]
    counts, plain = [], spatial._close
    monkeypatch.setattr(spatial, "_close", lambda *a, **b: (counts.append((out := plain(*a, **b)).count()), out)[1])
    side = lambda rows, p, key: spark.createDataFrame(rows, f"{key} long, {p}x double, {p}y double, grp long").drop(*["grp"] * (group is None))
    found = spatial.nearest(side(left, "l", "k"), side(right, "r", "r"), "k", ["r"], 16.0, group=group, rounds=rounds)
    assert {r["k"]: r["r"] for r in found.collect()} == expected
    assert sum(counts) < 300 * 60  # 300 * 800 at the given radius


def test_others_nearby_are_counted_by_runs(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, rng.randint(0, 60) / 4.0, float(rng.randint(0, 15))) for k in range(900)] + [(k, -40.0, 3.0) for k in range(1000, 1004)] + [(2000, 90.0, 90.0), (2001, None, 1.0)]
    expected = []
    for k, x, y in rows:
        near = [j for j, u, v in rows if j != k and None not in (x, u) and (x - u) ** 2 + (y - v) ** 2 <= 25]
        if near:
            expected.append((k, len(near), min(near)))
    pairs, plain = [], spatial._close
    monkeypatch.setattr(spatial, "_close", lambda *a, **b: (pairs.append(1), plain(*a, **b))[1])
    found = spatial.close_others(spark.createDataFrame(rows, "id long, x double, y double"), 5.0)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert not pairs  # no join of all pairs


def test_snapping_compares_few_of_dense_points(spark):
    rng = random.Random(9)
    at = [(rng.uniform(0, 6), rng.uniform(0, 6)) for _ in range(600)]  # one dense node
    at += [(20 + rng.uniform(0, 8), rng.uniform(0, 8)) for _ in range(25)]  # some chains
    at += [(40.0, 0.0), (43.0, 0.0), (46.0, 0.0), (49.01, 0.0), (49.01, 3.0), (40.0, 3.0), (60.0, 0.0), (62.1, 2.1), (60.0, 0.0)]
    points = dict(enumerate(at))
    node = dict.fromkeys(points)
    for k in points:
        if node[k] is None:
            node[k], seen = k, [k]
            for a in seen:
                for b in points:
                    if node[b] is None and (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2 <= 9:
                        node[b] = k
                        seen.append(b)
    df = spark.createDataFrame([(k, *p) for k, p in points.items()] + [(9000, None, 1.0)], "id long, x double, y double")
    found = {r["id"]: (r["node"], r["x"], r["y"]) for r in graph.snap(df, 3.0).collect()}
    assert found == {k: (n, *at[n]) for k, n in node.items()}
    assert "within_distance" not in graph.snap.__code__.co_names  # no join of all points within the tolerance


def test_points_in_polygons_of_short_and_long_rings(spark, monkeypatch):
    rng = random.Random(10)
    star = lambda x, y, n: [(x + rng.randint(2, 9) * math.cos(k * 2 * math.pi / n), y + rng.randint(2, 9) * math.sin(k * 2 * math.pi / n)) for k in range(n)]
    points = [(k, rng.uniform(0, 60), rng.uniform(0, 60)) for k in range(400)]
    for most in (6, 30):
        rings = {k: (r := star(rng.randint(0, 60), rng.randint(0, 60), rng.choice((3, 4, most)))) + r[:1] for k in range(60)}
        held = lambda x, y, r: sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:], strict=False)) % 2
        loops, plain = [], spatial.in_ring
        monkeypatch.setattr(spatial, "in_ring", lambda *a, loops=loops, plain=plain: (loops.append(1), plain(*a))[1])
        found = spatial.points_in_polygons(spark.createDataFrame(points, "p long, px double, py double"), spark.createDataFrame([*rings.items(), (99, None)], f"s long, ring {LINE}"), 8.0)
        assert sorted((r["p"], r["s"]) for r in found.collect()) == sorted((p, s) for p, x, y in points for s, r in rings.items() if held(x, y, r))
        assert bool(loops) == (most > 16)  # edges of short rings are written out
        monkeypatch.undo()


@pytest.mark.parametrize("other", [False, True])
def test_largest_overlap_equals_all_pairs(spark, other):
    rng = random.Random(11)
    boxes = [(k, x := float(rng.randint(0, 60)), y := float(rng.randint(0, 60)), x + rng.choice((0, 9, 30, 34)), y + rng.choice((2, 28, 30))) for k in range(300)] + [(900, 500.0, 500.0, 510.0, 510.0), (901, 509.0, 480.0, 700.0, 501.0)]
    expected = {}
    for i, x0, y0, x1, y1 in boxes:
        areas = [(-(min(x1, u1) - max(x0, u0)) * (min(y1, v1) - max(y0, v0)), j) for j, u0, v0, u1, v1 in boxes if min(x1, u1) > max(x0, u0) and min(y1, v1) > max(y0, v0) and not (other and i == j)]
        if areas:
            expected[i] = (min(areas)[1], -min(areas)[0])
    side = lambda p: spark.createDataFrame(boxes, f"{p} long, " + ", ".join(f"{p}{c} double" for c in ("xmin", "ymin", "xmax", "ymax")))
    found = {r["l"]: (r["r"], r["area"]) for r in spatial.largest_overlap(side("l"), side("r"), "l", "r", 16.0, other=other).collect()}
    assert found == expected
