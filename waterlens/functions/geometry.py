"""Planar geometry over coordinate arrays (array<struct<x,y>>), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(points: Column) -> Column:
    return F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def line_length(points: Column) -> Column:
    return F.aggregate(_steps(points), F.lit(0.0), lambda t, s: t + distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))


def ring_area(points: Column) -> Column:
    """Area inside a closed ring (first point repeated at the end)."""
    return F.abs(F.aggregate(_steps(points), F.lit(0.0), lambda t, s: t + (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]))) / 2


def in_ring(x: Column, y: Column, points: Column) -> Column:
    """Whether a point is inside a closed ring, by the number of edges a ray to the right crosses."""
    crossed = F.filter(_steps(points), lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)) + s["a"]["x"]))
    return F.size(crossed) % 2 == 1


def in_short_ring(x: Column, y: Column, points: Column, n: int) -> Column:
    """What `in_ring` says of closed rings of at most `n` points, with every edge written out."""
    crossed = F.lit(False)
    for k in range(n - 1):
        a, b = F.get(points, F.lit(k)), F.get(points, F.lit(k + 1))
        across = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])
        crossed = crossed != F.coalesce(across, F.lit(False))
    return crossed


def overlap_area(axmin, aymin, axmax, aymax, bxmin, bymin, bxmax, bymax) -> Column:
    """Common area of two axis-aligned boxes."""
    width = F.least(axmax, bxmax) - F.greatest(axmin, bxmin)
    height = F.least(aymax, bymax) - F.greatest(aymin, bymin)
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment."""
    squared = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    along = F.coalesce(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(squared, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def first_point(points: Column) -> Column:
    return F.try_element_at(points, F.lit(1))


def last_point(points: Column) -> Column:
    return F.try_element_at(points, F.lit(-1))


def segments(points: Column) -> Column:
    """The steps of a line: array of (a, b), each a point."""
    return _steps(points)


def bounds(points: Column) -> Column:
    """The box around points: xmin, ymin, xmax, ymax."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The closed ring of a box, from its low corner against the clock."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin))])


def to_wkt(points: Column, kind: str = "LINESTRING") -> Column:
    """Well-known text of a line or polygon ring."""
    body = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    left, right = ("((", "))") if kind == "POLYGON" else ("(", ")")
    return F.concat(F.lit(f"{kind} {left}"), body, F.lit(right))


def from_wkt(text: Column) -> Column:
    """Points of a well-known text of one line, point or polygon without holes; null if it is none of them."""
    body = F.regexp_extract(text, r"(?i)^\s*(?:LINESTRING|POINT|POLYGON)\s*(?:Z\s*)?\(\(?([^()]*)\)?\)\s*$", 1)
    parts = F.transform(F.split(body, r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    points = F.transform(parts, lambda p: F.struct(F.try_element_at(p, F.lit(1)).try_cast("double").alias("x"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("y")))
    return F.when(F.length(body) > 0, points)


def with_z(points: Column, z: Column) -> Column:
    """Points with one height for all."""
    return F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z")))


def without_z(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether segments a-b and c-d (points) have a point in common, their ends included."""
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    d1, d2, d3, d4 = turn(c, d, a), turn(c, d, b), turn(a, b, c), turn(a, b, d)
    within = lambda p, q, r: r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
    across = (((d1 > 0) & (d2 < 0)) | ((d1 < 0) & (d2 > 0))) & (((d3 > 0) & (d4 < 0)) | ((d3 < 0) & (d4 > 0)))
    return across | ((d1 == 0) & within(c, d, a)) | ((d2 == 0) & within(c, d, b)) | ((d3 == 0) & within(a, b, c)) | ((d4 == 0) & within(a, b, d))


def parts_of_kind(parts: Column, kind: str) -> Column:
    """The parts (kind, points) of a collection that are of one kind."""
    return F.filter(parts, lambda p: p["kind"] == kind)


def along_line(x: Column, y: Column, points: Column) -> Column:
    """(offset, distance): how far along a line its nearest place to a point is (ties: the first), and how far off it."""

    def step(state: Column, s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        first = F.struct(distance(ax, ay, bx, by).alias("n"), ((x - ax) * (bx - ax) + (y - ay) * (by - ay)).alias("dot"))

        def place(v: Column) -> Column:
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v["dot"] / F.nullif(v["n"] * v["n"], F.lit(0.0)), F.lit(0.0))))
            return let(t, lambda t: F.struct(v["n"].alias("n"), t.alias("t"), distance(x, y, ax + t * (bx - ax), ay + t * (by - ay)).alias("off")))

        def taken(p: Column) -> Column:
            here = F.struct((state["done"] + p["n"]).alias("done"), (state["done"] + p["t"] * p["n"]).alias("offset"), p["off"].alias("distance"))
            before = F.struct((state["done"] + p["n"]).alias("done"), state["offset"].alias("offset"), state["distance"].alias("distance"))
            return F.when(state["distance"].isNull() | (p["off"] < state["distance"]), here).otherwise(before)

        return let(let(first, place), taken)

    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("done"), none.alias("offset"), none.alias("distance"))
    return F.aggregate(_steps(points), start, step, lambda s: F.struct(s["offset"].alias("offset"), s["distance"].alias("distance")))


def length_inside(points: Column, rings: Column) -> Column:
    """How much of a line is inside the closed rings of a polygon (holes among them), by the even-odd rule.

    Each step of the line is cut where it crosses an edge; a piece counts if its middle is inside. A piece along an edge
    counts as its middle does for the rule: on low and left edges inside, on high and right ones outside.
    """
    cross = lambda ax, ay, bx, by: ax * by - ay * bx

    def share(s: Column, e: Column) -> Column:
        """Where on the step the edge is, from 0 to 1; null where it is not."""
        ends = F.struct(
            (s["b"]["x"] - s["a"]["x"]).alias("dx"), (s["b"]["y"] - s["a"]["y"]).alias("dy"), (e["b"]["x"] - e["a"]["x"]).alias("ex"),
            (e["b"]["y"] - e["a"]["y"]).alias("ey"), (e["a"]["x"] - s["a"]["x"]).alias("wx"), (e["a"]["y"] - s["a"]["y"]).alias("wy"),
        )

        def at(v: Column) -> Column:
            turn = F.nullif(cross(v["dx"], v["dy"], v["ex"], v["ey"]), F.lit(0.0))
            both = F.struct((cross(v["wx"], v["wy"], v["ex"], v["ey"]) / turn).alias("t"), (cross(v["wx"], v["wy"], v["dx"], v["dy"]) / turn).alias("u"))
            return let(both, lambda p: F.when(p["t"].between(0.0, 1.0) & p["u"].between(0.0, 1.0), p["t"]))

        return let(ends, at)

    def inside(x: Column, y: Column, edges: Column) -> Column:
        crossed = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]))
        return F.size(crossed) % 2 == 1

    def middle_inside(s: Column, a: Column, b: Column, edges: Column) -> Column:
        on = lambda c: s["a"][c] + (a + b) / 2 * (s["b"][c] - s["a"][c])
        return let(F.struct(on("x").alias("x"), on("y").alias("y")), lambda p: inside(p["x"], p["y"], edges))

    def piece(s: Column, edges: Column) -> Column:
        # where an edge lies along the step, its ends are cuts as well: those that other edges give
        cuts = F.filter(F.transform(edges, lambda e: share(s, e)), lambda t: t.isNotNull())
        every = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts)))
        spans = let(every, lambda at: F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
        part = F.aggregate(spans, F.lit(0.0), lambda total, p: total + F.when(middle_inside(s, p["a"], p["b"], edges), p["b"] - p["a"]).otherwise(0.0))
        return part * distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])

    every_edge = F.flatten(F.transform(rings, _steps))
    return let(every_edge, lambda edges: F.aggregate(F.transform(_steps(points), lambda s: piece(s, edges)), F.lit(0.0), lambda total, length: total + length))
