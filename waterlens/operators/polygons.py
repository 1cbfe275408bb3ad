"""Areas of polygon overlays by slabs: no polygon is ever clipped against another.

Polygons are cut into tiles. In a tile, horizontal lines through all corners and crossings of edges make slabs in which no
two edges cross, so the edges of a slab stand in one order from left to right. A running count along that order says how many
polygons of either side cover each trapezoid between two edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bounds, segments
from ..session import cut
from .spatial import boxes_meet


def _edges(shapes: DataFrame, size: float) -> DataFrame:
    """The edges of shapes (grp, side, shape, rings) in every tile that a shape's box touches: (grp, side, shape, tx, ty, ax,
    ay, bx, by) with ay < by, cut at the tile's low and high line and, left or right of the tile, laid on its border."""
    ring = shapes.select("grp", "side", "shape", "rings", bounds(F.flatten("rings")).alias("b")).where("b.xmin IS NOT NULL")
    tile = lambda c: F.floor(F.col(f"b.{c}") / size).cast("long")
    tiles = ring.withColumn("tx", F.explode(F.sequence(tile("xmin"), tile("xmax"))))
    edges = tiles.withColumn("ring", F.explode("rings")).withColumn("e", F.explode(segments(F.col("ring")))).where("e.a.y <> e.b.y")
    up = F.col("e.a.y") < F.col("e.b.y")
    pick = lambda c, low: F.when(up == low, F.col(f"e.a.{c}")).otherwise(F.col(f"e.b.{c}"))
    edges = edges.select("grp", "side", "shape", "tx", pick("x", True).alias("x0"), pick("y", True).alias("y0"), pick("x", False).alias("x1"), pick("y", False).alias("y1"))
    edges = edges.withColumn("ty", F.explode(F.sequence(F.floor(F.col("y0") / size).cast("long"), (F.ceil(F.col("y1") / size) - 1).cast("long"))))
    slope = (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    x_at = lambda y: F.when(y == F.col("y0"), F.col("x0")).when(y == F.col("y1"), F.col("x1")).otherwise(F.col("x0") + (y - F.col("y0")) * slope)
    low, high = F.greatest("y0", F.col("ty") * size), F.least("y1", (F.col("ty") + 1) * size)
    edges = edges.select("grp", "side", "shape", "tx", "ty", x_at(low).alias("ax"), low.alias("ay"), x_at(high).alias("bx"), high.alias("by"))
    # a piece that crosses a border of the tile is cut there
    left, right = F.col("tx") * size, (F.col("tx") + 1) * size
    y_at = lambda x: F.col("ay") + (x - F.col("ax")) * (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    through = lambda x: F.when((F.least("ax", "bx") < x) & (x < F.greatest("ax", "bx")), y_at(x))
    ys = F.array_sort(F.array_distinct(F.filter(F.array(F.col("ay"), through(left), through(right), F.col("by")), lambda y: y.isNotNull())))
    clamp = lambda x: F.greatest(left, F.least(right, x))
    at = lambda y: F.when(y == F.col("ay"), F.col("ax")).when(y == F.col("by"), F.col("bx")).otherwise(F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    spans = F.zip_with(F.slice(ys, 1, F.size(ys) - 1), F.slice(ys, 2, F.size(ys) - 1), lambda a, b: F.struct(clamp(at(a)).alias("ax"), a.alias("ay"), clamp(at(b)).alias("bx"), b.alias("by")))
    return edges.select("grp", "side", "shape", "tx", "ty", F.explode(spans).alias("s")).select("grp", "side", "shape", "tx", "ty", "s.*").where("ay < by")


def _crossings(edges: DataFrame, size: float) -> DataFrame:
    """The heights (grp, tx, ty, y) at which two edges of a tile cross inside both."""
    border = (F.col("ax") == F.col("bx")) & ((F.col("ax") == F.col("tx") * size) | (F.col("ax") == (F.col("tx") + 1) * size))
    of = lambda p: edges.where(~border).select(
        F.struct("grp", "tx", "ty").alias(f"{p}at"), *[F.col(c).alias(p + c) for c in ("ax", "ay", "bx", "by")], F.xxhash64("side", "shape", "ax", "ay", "bx", "by").alias(f"{p}key"),
        F.least("ax", "bx").alias(f"{p}xmin"), F.col("ay").alias(f"{p}ymin"), F.greatest("ax", "bx").alias(f"{p}xmax"), F.col("by").alias(f"{p}ymax"),
    )
    met = boxes_meet(of("l"), of("r"), size / 16).where(F.col("lat").eqNullSafe(F.col("rat")) & (F.col("lkey") < F.col("rkey")))
    ex, ey, fx, fy = F.col("lbx") - F.col("lax"), F.col("lby") - F.col("lay"), F.col("rbx") - F.col("rax"), F.col("rby") - F.col("ray")
    turn = F.nullif(ex * fy - ey * fx, F.lit(0.0))
    wx, wy = F.col("rax") - F.col("lax"), F.col("ray") - F.col("lay")
    t, u = (wx * fy - wy * fx) / turn, (wx * ey - wy * ex) / turn
    y = F.when(t.between(0.0, 1.0) & u.between(0.0, 1.0), F.col("lay") + t * ey)
    return met.select("lat.*", y.alias("y")).where("y IS NOT NULL")


def overlay_areas(left: DataFrame, right: DataFrame, group: str, size: float) -> DataFrame:
    """(`group`, both, only_left, only_right): areas that polygons of both sides cover, and of one side alone, by group.

    Sides: (`group`, rings), rings an array of closed rings, holes among them by the even-odd rule. Polygons of one side may
    overlap: what several cover counts once, so the sum of the areas of a side is that of its union. A group may have one
    side only. Null or empty rings cover nothing; a null group is a group. Tiles of `size` bound what meets in one place:
    neither a group of very many polygons nor a large polygon is one task. Equal polygons of a group and side are one.
    """
    of = lambda df, side: df.select(F.col(group).alias("grp"), F.lit(side).alias("side"), "rings")
    # equal polygons cover what one covers; all their edges would meet in pairs
    shapes = of(left, 0).unionByName(of(right, 1)).distinct().withColumn("shape", F.monotonically_increasing_id())
    edges = cut(_edges(cut(shapes), size))
    at = ["grp", "tx", "ty"]
    heights = edges.select(*at, F.explode(F.array("ay", "by")).alias("y")).unionByName(_crossings(edges, size)).distinct()
    slabs = heights.withColumn("top", F.lead("y").over(Window.partitionBy(*at).orderBy("y"))).where("top > y")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in at]
    spans = edges.alias("e").join(slabs.alias("s"), [*same, F.col("e.ay") <= F.col("s.y"), F.col("s.top") <= F.col("e.by")])
    middle = (F.col("s.y") + F.col("s.top")) / 2
    x = F.col("e.ax") + (middle - F.col("e.ay")) * (F.col("e.bx") - F.col("e.ax")) / (F.col("e.by") - F.col("e.ay"))
    spans = spans.select(*[F.col(f"e.{c}") for c in at], "e.side", "e.shape", F.col("s.y").alias("y"), (F.col("s.top") - F.col("s.y")).alias("height"), x.alias("x"))
    slab = Window.partitionBy(*at, "y")
    own = F.row_number().over(Window.partitionBy(*at, "y", "shape").orderBy("x"))
    counted = spans.withColumn("turn", F.when(own % 2 == 1, 1).otherwise(-1))
    order = slab.orderBy("x", "shape", F.col("turn").desc())
    cover = lambda side: F.sum(F.when(F.col("side") == side, F.col("turn")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) > 0
    pieces = counted.select("grp", (F.col("height") * (F.lead("x").over(order) - F.col("x"))).alias("area"), cover(0).alias("l"), cover(1).alias("r"))
    total = lambda rule: F.coalesce(F.sum(F.when(rule, F.col("area"))), F.lit(0.0))
    inside: Column = F.col("l") & F.col("r")
    sums = pieces.groupBy("grp").agg(total(inside).alias("both"), total(F.col("l") & ~F.col("r")).alias("only_left"), total(F.col("r") & ~F.col("l")).alias("only_right"))
    return sums.withColumnRenamed("grp", group)


def union_areas(polygons: DataFrame, group: str, size: float) -> DataFrame:
    """(`group`, area): the area of the union of a group's polygons (`group`, rings)."""
    return overlay_areas(polygons, polygons.limit(0), group, size).select(group, F.col("only_left").alias("area"))
