"""Merged lines, overlays, triangles, nodes by first match and fills in rounds against plain loops, with the odd cases."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waterlens.operators import graph, lines, polygons, triangles

POINT = "struct<x: double, y: double>"


def points(*xy):
    return [(float(x), float(y)) for x, y in xy]


# -- merged lines


def plain_chains(rows):
    """(id, merge_id, place, turned) of rows (id, group, line) by walking from line to line."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and len(r[2]) > 1]
    line, at = {r[0]: r[2] for r in rows}, defaultdict(list)
    for k, g, p in rows:
        at[g, p[0]].append((k, 0))
        at[g, p[-1]].append((k, 1))
    group = {k: g for k, g, _ in rows}

    def beyond(k, side):
        ends = at[group[k], line[k][-1 if side else 0]]
        other = [e for e in ends if e != (k, side)]
        return other[0] if len(ends) == 2 and other[0][0] != k else None

    found, seen = [], set()
    for k in sorted(line):
        if k in seen:
            continue
        ways = []
        for side in (0, 1):  # the end that a walk leaves k by
            walk, now, ring = [(k, side == 0)], (k, side), False
            while (step := beyond(*now)) is not None:
                if step[0] == k:
                    ring = True
                    break
                walk.append((step[0], step[1] == 1))
                now = (step[0], 1 - step[1])
            ways.append((walk, ring))
        if ways[0][1]:
            walk = ways[1][0]
        else:  # both walks start at k: one way through the whole chain
            back = [(i, not turned) for i, turned in reversed(ways[0][0])][:-1]
            walk = back + ways[1][0]
            flipped = [(i, not turned) for i, turned in reversed(walk)]
            walk = min(walk, flipped, key=lambda w: (w[0][0], w[0][1]))
        walk = [(i, bool(t)) for i, t in walk]
        seen |= {i for i, _ in walk}
        found += [(i, min(j for j, _ in walk), n, t) for n, (i, t) in enumerate(walk)]
    return found


def test_merged_lines_equal_a_walk(spark):
    rng = random.Random(4)
    rows = []
    for k in range(220):  # a loose net on few nodes, in two groups
        a, b = rng.sample(range(150), 2)
        rows.append((k, k % 2, points((a, a % 7), (k + 0.5, 99), (b, b % 7))))
    ring = [points((1000 + i, i * (9 - i))) + points(((1000 + (i + 1) % 9), (i + 1) % 9 * (9 - (i + 1) % 9))) for i in range(9)]
    rows += [(500 + i, 1, p if i % 2 else p[::-1]) for i, p in enumerate(ring)]
    rows += [(600 + i, 0, points((2000 + i, 0), (2001 + i, 0))) for i in range(70)]  # a long one
    rows += [(700, 0, points((5, 5.5), (6, 6), (5, 5.5))), (701, 1, points((7, 70), (8, 80))), (702, 1, points((8, 80), (7, 70)))]
    rows += [(800, None, points((1, 1), (2, 2))), (801, 1, None), (802, 1, points((3, 3))), (803, 1, [])]
    given = spark.createDataFrame(rows, f"id long, area long, line array<{POINT}>")
    found = sorted(tuple(r) for r in lines.chains(given, "area").select("id", "merge_id", "place", "turned").collect())
    expected = sorted(plain_chains(rows))
    assert found == expected
    merged = {r["merge_id"]: r for r in lines.merged_lines(given, "area").collect()}
    line = {k: p for k, _, p in rows}
    for m, r in merged.items():
        parts = [line[i][::-1] if t else line[i] for i, n, t in sorted(((i, n, t) for i, mm, n, t in expected if mm == m), key=lambda x: x[1])]
        assert [tuple(p) for p in r["line"]] == parts[0] + [q for p in parts[1:] for q in p[1:]] and r["n_parts"] == len(parts)
    assert merged[500]["n_parts"] == 9 and merged[500]["line"][0] == merged[500]["line"][-1]
    assert lines.chains(given.limit(0), "area").count() == 0


# -- lines and polygons

STAR = [points((0, 0), (10, 0), (10, 10), (5, 3), (0, 10), (0, 0)), points((4, 1), (6, 1), (6, 2), (4, 2), (4, 1))]


def test_lengths_inside(spark):
    given = spark.createDataFrame(
        [(1, points((-5, 1.5), (15, 1.5))), (2, points((5, -5), (5, 20))), (3, points((20, 20), (30, 30))), (4, points((1, 1), (3, 1), (3, 2))), (5, None), (6, points((1, 1))), (7, points((0.5, 8), (9.5, 8)))],
        f"line_id long, line array<{POINT}>",
    )
    areas = spark.createDataFrame([(1, STAR), (2, None), (3, []), (4, [points((9, 0), (40, 0), (40, 40), (9, 40), (9, 0))])], f"polygon_id long, rings array<array<{POINT}>>")
    found = {(r["line_id"], r["polygon_id"]): round(r["length"], 9) for r in lines.lengths_inside(given, areas, 4.0).collect()}
    expected = {(1, 1): 8.0, (1, 4): 6.0, (2, 1): 2.0, (3, 4): round(math.sqrt(200), 9), (4, 1): 3.0, (7, 1): round(2 * (10 - 5 - 5 * 5 / 7) - 0.5 * 2, 9), (7, 4): 0.5}
    assert found == expected
    assert {r["line_id"]: r["polygon_id"] for r in lines.longest_inside(given, areas, 4.0).collect()} == {1: 1, 2: 1, 3: 4, 4: 1, 7: 4 if expected[7, 4] > expected[7, 1] else 1}


def test_positions_and_nearest_lines(spark):
    rng = random.Random(5)
    shapes = {k: points(*[(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.randint(2, 6))]) for k in range(12)}
    shapes[3] = points((10, 10), (10, 10), (50, 10))

    def plain(x, y, line):
        done, best = 0.0, None
        for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
            n = math.hypot(bx - ax, by - ay)
            t = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n / n)) if n else 0.0
            off = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
            if best is None or off < best[1]:
                best = (done + t * n, off)
            done += n
        return best

    marks = [(k, k % 13, rng.uniform(-10, 110), rng.uniform(-10, 110)) for k in range(150)]
    channels = spark.createDataFrame([*shapes.items(), (20, points((1, 1))), (21, None)], f"line_id long, line array<{POINT}>")
    given = spark.createDataFrame(marks, "id long, line_id long, x double, y double")
    for r in lines.positions(given, channels).collect():
        expected = plain(r["x"], r["y"], shapes[r["line_id"]]) if r["line_id"] in shapes else (None, None)
        assert (r["offset"], r["distance"]) == pytest.approx(expected)
    near = {r["id"]: (r["line_id"], r["distance"]) for r in lines.nearest_lines(given.select("id", "x", "y"), channels, 7.0, 9.0).collect()}
    for k, _, x, y in marks:
        off, line = min((plain(x, y, p)[1], n) for n, p in shapes.items())
        assert (k in near) == (off <= 9.0)
        assert k not in near or (near[k][0] == line and near[k][1] == pytest.approx(off))


# -- overlays


def triangle_overlap(p, q):
    """Area that two triangles share, by clipping one with the sides of the other."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    p, q = (t if turn(*t) > 0 else t[::-1] for t in (p, q))
    poly = list(p)
    for a, b in zip(q, q[1:] + q[:1], strict=True):
        out = []
        for c, d in zip(poly, poly[1:] + poly[:1], strict=True):
            s, t = turn(a, b, c), turn(a, b, d)
            if s >= 0:
                out.append(c)
            if (s > 0 > t) or (s < 0 < t):
                out.append((c[0] + (d[0] - c[0]) * s / (s - t), c[1] + (d[1] - c[1]) * s / (s - t)))
        poly = out
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(poly, poly[1:] + poly[:1], strict=True))) / 2 if poly else 0.0


def plain_overlap(left, right):
    """Shared area of two polygons with holes, by signed triangles from one corner; rings are turned the right way first."""

    def fans(rings):
        for n, ring in enumerate(rings):
            area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:], strict=False))
            for a, b in zip(ring, ring[1:], strict=False):
                o = (-3.0, -7.0)
                t = (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
                if t:
                    yield (o, a, b), math.copysign(1, t) * math.copysign(1, area) * (1 if n == 0 else -1)

    return sum(s * t * triangle_overlap(p, q) for p, s in fans(left) for q, t in fans(right))


def area_of(rings):
    each = [abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(r, r[1:], strict=False))) / 2 for r in rings]
    return each[0] - sum(each[1:])


def turned(rings, angle, dx, dy):
    c, s = math.cos(angle), math.sin(angle)
    return [[(x * c - y * s + dx, x * s + y * c + dy) for x, y in r] for r in rings]


@pytest.mark.parametrize("size", [3.0, 100.0])
def test_overlay_areas(spark, size):
    rng = random.Random(7)
    convex = [points((0, 0), (8, 1), (9, 6), (3, 9), (0, 0))]
    left, right = {}, {}
    for k in range(12):
        left[k] = turned(STAR if k % 2 else convex, rng.uniform(0, 6), rng.uniform(-4, 4), rng.uniform(-4, 4))
        right[k] = turned(STAR if k % 3 else convex, rng.uniform(0, 6), rng.uniform(-4, 4), rng.uniform(-4, 4))
    left[20], right[20] = STAR, STAR  # the same
    left[21], right[22] = STAR, convex  # one side only
    left[23], right[23] = STAR, [points((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))]  # common sides
    schema = f"code long, rings array<array<{POINT}>>"
    of = lambda side, *more: spark.createDataFrame([*side.items(), *more], schema)
    found = {r["code"]: r for r in polygons.overlay_areas(of(left, (30, None), (31, [])), of(right), "code", size).collect()}
    assert found.keys() == left.keys() | right.keys()
    for k, r in found.items():
        a, b = (area_of(side[k]) if k in side else 0.0 for side in (left, right))
        both = plain_overlap(left[k], right[k]) if k in left and k in right else 0.0
        assert (r["both"], r["only_left"], r["only_right"]) == pytest.approx((both, a - both, b - both), abs=1e-6), k


def test_union_of_overlapping_shapes(spark):
    rng = random.Random(9)
    boxes = [(k % 2, rng.randint(0, 30), rng.randint(0, 30), rng.randint(1, 9), rng.randint(1, 9)) for k in range(80)]
    cells = defaultdict(set)
    for g, x, y, w, h in boxes:
        cells[g] |= {(x + i, y + j) for i in range(w) for j in range(h)}
    rows = [(g, [points((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]) for g, x, y, w, h in boxes]
    given = spark.createDataFrame(rows, f"grp long, rings array<array<{POINT}>>")
    assert {r["grp"]: round(r["area"], 6) for r in polygons.union_areas(given, "grp", 8.0).collect()} == {g: len(c) for g, c in cells.items()}
    slanted = spark.createDataFrame([(None, [points((0, 0), (4, 0), (0, 4), (0, 0))]), (None, [points((4, 4), (4, 0), (0, 4), (4, 4))]), (None, [points((0, 0), (4, 4), (0, 4), (0, 0))])], f"grp long, rings array<array<{POINT}>>")
    assert [(r["grp"], round(r["area"], 6)) for r in polygons.union_areas(slanted, "grp", 3.0).collect()] == [(None, 16.0)]


# -- triangles


def grid_points(spark):
    rng = random.Random(3)
    rows = [(i * 30 + j, i * 10.0, j * 10.0, rng.uniform(0, 5) if (i + j) % 5 else None) for i in range(14) for j in range(12)]
    rows += [(2000 + k, rng.uniform(0, 130), rng.uniform(0, 110), rng.uniform(0, 5)) for k in range(60)]
    rows += [(3000, None, 1.0, 1.0), (3001, 10.0, 10.0, 2.0)]  # the last lies on another
    return rows, spark.createDataFrame(rows, "id long, x double, y double, level double")


def test_triangles_do_not_hang_on_tiles(spark):
    rows, given = grid_points(spark)
    found = [sorted(map(tuple, triangles.triangles(given, tile, 15.0).collect())) for tile in (20.0, 37.0, 1000.0)]
    assert found[0] == found[1] == found[2] and len({r[::3] for r in found[0]}) == len(found[0])
    x, y = np.array([r[1] for r in rows[:-2]]), np.array([r[2] for r in rows[:-2]])
    for r in found[0]:  # no other point lies inside a circle, but for what points are moved by
        cx, cy, squared = triangles._circles(np.array([r[1], r[4], r[7]]), np.array([r[2], r[5], r[8]]), np.array([[0, 1, 2]]))
        assert (np.hypot(x - cx[0], y - cy[0]) > math.sqrt(squared[0]) - 0.01).all()
    turn = lambda r: abs((r[4] - r[1]) * (r[8] - r[2]) - (r[5] - r[2]) * (r[7] - r[1])) / 2
    inner = [r for r in found[0] if all(0 <= v <= 130 for v in r[1::3])]
    assert sum(map(turn, inner)) == pytest.approx(130 * 110, rel=0.02)  # they cover the grid once


@pytest.mark.parametrize("blend", [False, True])
def test_levels_equal_a_loop(spark, blend):
    rows, given = grid_points(spark)
    rng = random.Random(4)
    pixels = [(k, rng.uniform(-5, 135), rng.uniform(-5, 115), None if k % 9 == 0 else rng.choice(rows[:168])[0], rng.uniform(0, 4)) for k in range(400)] + [(900, 20.0, 20.0, 62, None), (901, 20.0, 20.0, 62, 1.0)]
    frame = spark.createDataFrame(pixels, "id long, px double, py double, cell long, dem double")
    found = {r["id"]: (r["level"], r["depth"]) for r in triangles.level_raster(frame, given, 40.0, 15.0, blend).collect()}
    level = {r[0]: r[3] for r in rows}
    used = given if blend else given.where("level IS NOT NULL")
    shapes = [tuple(r) for r in triangles.triangles(used, 1000.0, 15.0).collect()]
    for k, px, py, cell, dem in pixels:
        value = None
        for a, ax, ay, b, bx, by, c, cx, cy in sorted(shapes, key=lambda s: s[::3]):
            whole = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
            if whole == 0:
                continue
            w = [((bx - px) * (cy - py) - (by - py) * (cx - px)) / whole, ((px - ax) * (cy - ay) - (py - ay) * (cx - ax)) / whole, ((bx - ax) * (py - ay) - (by - ay) * (px - ax)) / whole]
            if min(w) >= -1e-12:
                known = [(s, level[n]) for s, n in zip(w, (a, b, c), strict=True) if level[n] is not None]
                total = sum(s for s, _ in known)
                value = sum(s * v for s, v in known) / total if total > 0.5 else None
                break
        if blend:
            value = None if cell is None else level[cell] if value is None else value
        depth = None if value is None or dem is None else max(value - dem, 0.0)
        assert found[k] == pytest.approx((value, depth)), k


def test_border_points(spark):
    cells = [(0, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 1.0, 0.0, 2.0, 1.0, 3.0), (2, 0.0, 1.0, 1.0, 2.0, 5.0), (3, 1.0, 1.0, 2.0, 2.0, 7.0), (4, 2.0, 1.0, 3.0, 2.0, None)]
    found = triangles.border_points(spark.createDataFrame(cells, "id long, xmin double, ymin double, xmax double, ymax double, level double"), 10)
    at = {(r["x"], r["y"]): r["level"] for r in found.collect()}
    assert at == {(0, 0): 1, (1, 0): 2, (2, 0): 3, (0, 1): 3, (2, 1): 5, (0, 2): 5, (1, 2): 6, (2, 2): 7}


# -- nodes by first match and fills in rounds


def plain_matches(rows, tolerance):
    nodes, found = [], []
    for order, x, y in sorted(rows):
        node = next((o for o, a, b in nodes if math.sqrt((a - x) ** 2 + (b - y) ** 2) < tolerance), None)
        if node is None:
            node = order
            nodes.append((order, x, y))
        found.append((order, node))
    return found


@pytest.mark.parametrize("parts", [1, 7])
def test_nodes_by_first_match_equal_a_pass(spark, parts):
    rng = random.Random(6)
    rows = [(k, rng.randint(0, 40) * 0.25, rng.randint(0, 30) * 0.25) for k in range(500)]
    rows += [(1000 + k, 100 + k * 0.75, -3.0) for k in range(40)]  # each waits for the one before
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, "order long, x double, y double").union(spark.createDataFrame([(None, 1.0, 1.0), (7777, None, 2.0)], "order long, x double, y double"))
    found = sorted((r["order"], r["node"]) for r in graph.first_match_nodes(given.repartition(parts), 1.0).collect())
    assert found == plain_matches(rows, 1.0)
    assert graph.first_match_nodes(given.where("false"), 1.0).count() == 0


def test_channels_take_both_nodes(spark):
    rows = [("b", points((5, 5), (9, 9))), ("a", points((0, 0), (5.004, 5))), ("c", points((9, 9.003), (0.002, 0))), ("d", None)]
    found = graph.channels_of_lines(spark.createDataFrame(rows, f"code string, line array<{POINT}>"), "code", 0.01, 10, 5)
    assert sorted((r["id"], r["code"], r["connection_node_id_start"], r["connection_node_id_end"]) for r in found.collect()) == [(5, "a", 10, 11), (6, "b", 11, 12), (7, "c", 12, 10)]


def test_waves_equal_one_pass(spark):
    rng = random.Random(8)
    cells = []
    for g in (0, 1):
        for k in range(100):
            near = [n for n in (k - 1, k + 1, k - 10, k + 10) if 0 <= n < 100]
            cells.append((g, k, None if rng.random() < 0.1 else rng.randint(0, 64) / 8, rng.choice([True, True, False, None]) if g else rng.random() < 0.3, near))
    cells += [(2, 1, 1.0, True, []), (2, 2, 1.0, True, [1]), (2, 3, 2.0, True, [77])]
    given = spark.createDataFrame(cells, "grp long, id long, value double, swap boolean, near array<long>")
    of = lambda df: sorted((r["grp"], r["id"], r["filled"]) for r in df.collect())
    plain = of(graph.ordered_fill(given.withColumn("swap", F.coalesce("swap", F.lit(False))), "grp", "id", "value", "swap", "near"))
    assert of(graph.wave_fill(given, "grp", "id", "value", "swap", "near")) == [pytest.approx(r) for r in plain]
    assert graph.wave_fill(given.limit(0), "grp", "id", "value", "swap", "near").count() == 0
