"""Triangulated levels: Delaunay triangles of cell centres by tiles, and pixels interpolated inside them.

Cell centres lie on a regular grid, so many of them are on one circle and a triangulation is not unique. Every centre is
therefore moved by a small amount that its own coordinates give: then it is, and each tile finds the same triangles.
A triangle belongs to the tile of its circle's centre. A tile knows all points up to `reach` around it, so every circle of
a radius up to `reach` that it owns is known in full: what is empty there is empty everywhere, and tiles agree at their seams.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: How far a point is moved, as a part of `reach`.
_MOVE = 1e-5


def _moved(x: np.ndarray, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Points moved by what a hash of their coordinates gives, the same wherever they are met."""
    seed = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (y.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    seed = (seed ^ (seed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    seed ^= seed >> np.uint64(32)
    part = lambda s: (s & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32 - 0.5
    return x + part(seed) * _MOVE * reach, y + part(seed >> np.uint64(32)) * _MOVE * reach


def _circles(x: np.ndarray, y: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre and squared radius of the circles through rows of three corners."""
    a, b, c = corners.T
    bx, by, cx, cy = x[b] - x[a], y[b] - y[a], x[c] - x[a], y[c] - y[a]
    d = 2 * (bx * cy - by * cx)
    with np.errstate(divide="ignore", invalid="ignore"):
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return x[a] + ux, y[a] + uy, ux * ux + uy * uy


def triangulate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of three corners of the Delaunay triangles of points in general position, by inserting one point after the
    other: the triangles whose circle holds it make a hole, and the hole's border is joined with it."""
    n = len(x)
    if n < 3:
        return np.empty((0, 3), dtype=np.int64)
    middle, span = (x.mean(), y.mean()), max(float(np.ptp(x)), float(np.ptp(y)), 1e-9) * 30
    px = np.append(x - middle[0], [-span, span, 0.0])
    py = np.append(y - middle[1], [-span, -span, span])
    corners = np.zeros((4 * n + 8, 3), dtype=np.int64)
    circle = np.full((3, len(corners)), -1.0)  # x, y, squared radius; a radius below zero is a free row
    corners[0] = (n, n + 1, n + 2)
    circle[:, 0] = [v[0] for v in _circles(px, py, corners[:1])]
    used, free = 1, []
    for k in np.random.default_rng(0).permutation(n).tolist():  # any order gives the same triangles
        hit = np.flatnonzero((circle[0, :used] - px[k]) ** 2 + (circle[1, :used] - py[k]) ** 2 < circle[2, :used])
        sides: set[tuple[int, int]] = set()
        for a, b, c in corners[hit].tolist():
            for side in ((a, b), (b, c), (c, a)):
                if side[::-1] in sides:
                    sides.remove(side[::-1])
                else:
                    sides.add(side)
        circle[2, hit] = -1.0
        free += hit.tolist()
        made = np.array([(a, b, k) for a, b in sorted(sides)], dtype=np.int64)
        rows = [free.pop() if free else -1 for _ in range(len(made))]
        for i, r in enumerate(rows):
            if r < 0:
                rows[i], used = used, used + 1
        corners[rows] = made
        circle[:, rows] = _circles(px, py, made)
    found = corners[:used][circle[2, :used] >= 0]
    return found[(found < n).all(axis=1)]


def triangles(points: DataFrame, tile: float, reach: float, value: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """(a, b, c, each with x and y) of the Delaunay triangles of points (id, x, y) whose circle has a radius up to `reach`;
    a < b < c. Each corner has its `value` as well, if a column is named: av, bv, cv. With `near` (px, py), triangles may be
    left out that hold none of these places: tiles whose circles reach none are not worked on.

    Points of equal coordinates are one, the smallest id. Points without coordinates are left out. The triangles do not hang
    on the size of a tile. A tile and its surroundings are one task's work: choose `tile` so that it holds some hundred
    points; the centres of grid cells are no closer than a cell's width, so no tile holds more than its area allows.
    """
    places = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min_by(F.struct("id", (F.col(value) if value else F.lit(None)).cast("double").alias("v")), "id").alias("_i")).select("x", "y", "_i.*")
    low = lambda c: F.floor((F.col(c) - reach * 1.01) / tile).cast("long")
    high = lambda c: F.floor((F.col(c) + reach * 1.01) / tile).cast("long")
    dealt = places.withColumn("tx", F.explode(F.sequence(low("x"), high("x")))).withColumn("ty", F.explode(F.sequence(low("y"), high("y"))))

    if near is not None:  # a triangle is no further from its circle's centre than `reach`
        of = lambda c: F.explode(F.sequence(low(c), high(c)))
        wanted = near.select(of("px").alias("tx"), "py").distinct().select("tx", of("py").alias("ty")).distinct()
        dealt = dealt.join(wanted, ["tx", "ty"], "left_semi")

    def of_tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        x, y, ids, v = (rows[c].to_numpy() for c in ("x", "y", "id", "v"))
        mx, my = _moved(x, y, reach)
        found = np.sort(triangulate(mx, my), axis=1)
        cx, cy, squared = _circles(mx, my, found)
        found = found[(squared <= reach * reach) & (np.floor(cx / tile) == key[0]) & (np.floor(cy / tile) == key[1])]
        columns = {n: of[found[:, k]] for k, p in enumerate("abc") for n, of in ((p, ids), (f"{p}x", x), (f"{p}y", y), (f"{p}v", v))}
        return pd.DataFrame(columns)

    schema = ", ".join(f"{p} long, {p}x double, {p}y double, {p}v double" for p in "abc")
    found = dealt.groupBy("tx", "ty").applyInPandas(of_tile, schema)
    return found if value else found.drop("av", "bv", "cv")


def pixel_weights(pixels: DataFrame, found: DataFrame, cell: float) -> DataFrame:
    """`pixels` (px, py, more) that are in a triangle, with its corners a, b, c, their weights wa, wb, wc and, if triangles
    have them, values av, bv, cv; a pixel on a common side or corner is in the triangle of the smallest (a, b, c). Triangles meet pixels in cells of `cell`."""
    bound = lambda pick, c: F.floor(pick(*[F.col(p + c) for p in "abc"]) / cell).cast("long")
    spread = found.withColumn("_cx", F.explode(F.sequence(bound(F.least, "x"), bound(F.greatest, "x")))).withColumn("_cy", F.explode(F.sequence(bound(F.least, "y"), bound(F.greatest, "y"))))
    own = pixels.withColumn("_cx", F.floor(F.col("px") / cell).cast("long")).withColumn("_cy", F.floor(F.col("py") / cell).cast("long"))
    turn = lambda ax, ay, bx, by, cx, cy: (F.col(bx) - F.col(ax)) * (F.col(cy) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(cx) - F.col(ax))
    whole = F.nullif(turn("ax", "ay", "bx", "by", "cx", "cy"), F.lit(0.0))
    shares = {"wa": turn("px", "py", "bx", "by", "cx", "cy") / whole, "wb": turn("ax", "ay", "px", "py", "cx", "cy") / whole, "wc": turn("ax", "ay", "bx", "by", "px", "py") / whole}
    met = own.join(spread, ["_cx", "_cy"]).withColumns(shares).where("wa >= -1e-12 AND wb >= -1e-12 AND wc >= -1e-12")
    best = F.min_by(F.struct("a", "b", "c", "wa", "wb", "wc", *[c for c in ("av", "bv", "cv") if c in found.columns]), F.struct("a", "b", "c")).alias("_t")
    return met.groupBy(*pixels.columns).agg(best).select(*pixels.columns, "_t.*")


def level_raster(pixels: DataFrame, centres: DataFrame, tile: float, reach: float, blend: bool = False) -> DataFrame:
    """`pixels` (px, py, cell, dem, more; one row each) with `level` and `depth`, the level above the dem but not below 0.

    centres: (id, x, y, level) of grid cells, and of points on the border of the grid. The level is the mean of a triangle's
    corners weighted by the pixel's place in it. Centres without a level are left out of the triangulation and pixels
    outside all triangles have no level. With `blend` they stay in it with no weight: where the others weigh more than half
    in sum, their weighted mean counts; elsewhere, and outside all triangles, a pixel has the level of its own cell. A pixel
    without a cell then has none.
    """
    used = centres if blend else centres.where("level IS NOT NULL")
    places = cut(pixels.select("px", "py").distinct())
    # values go with the corners of triangles, so no table of all centres is joined or broadcast
    found = cut(triangles(used, tile, reach, "level", places))
    inside = pixel_weights(places, found, reach / 2)
    # pandas makes NaN and null one: it is a null where there are centres without a level
    known = {p: F.when(~F.isnan(f"{p}v"), F.col(f"{p}v")) if blend else F.coalesce(f"{p}v", F.lit(math.nan)) for p in "abc"}
    weight = sum((F.when(known[p].isNotNull(), F.col(f"w{p}")).otherwise(0.0) for p in "abc"), F.lit(0.0))
    share = sum((F.coalesce(F.col(f"w{p}") * known[p], F.lit(0.0)) for p in "abc"), F.lit(0.0))
    sums = inside.select(F.col("px").alias("_px"), F.col("py").alias("_py"), weight.alias("_w"), share.alias("_s"))
    out = pixels.join(sums.hint("merge"), (F.col("px") == F.col("_px")) & (F.col("py") == F.col("_py")), "left")
    level: Column = F.when(F.col("_w") > 0.5, F.col("_s") / F.col("_w"))
    if blend:
        own = centres.select(F.col("id").alias("_cell"), F.col("level").alias("_own"))
        out = out.join(own.hint("merge"), F.col("cell") == F.col("_cell"), "left")
        level = F.when(F.col("cell").isNotNull(), F.coalesce(level, "_own"))
        out = out.withColumn("level", level).drop("_cell", "_own")
    else:
        out = out.withColumn("level", level)
    depth = F.when(F.col("level").isNotNull() & F.col("dem").isNotNull(), F.greatest(F.col("level") - F.col("dem"), F.lit(0.0)))
    return out.withColumn("depth", depth).drop("_px", "_py", "_w", "_s")


def border_points(cells: DataFrame, first_id: int) -> DataFrame:
    """(id, x, y, level) of points on the border of a grid of cells (id, xmin, ymin, xmax, ymax, level): the corners of cells
    with a level that fewer than four quarters around them cover, each with the mean level of the cells that have it.

    Ids run from `first_id` by the places' order. Corners of a larger cell that lie on a side of smaller ones count for
    the smaller ones' corners only.
    """
    known = cells.where("level IS NOT NULL")
    corners = known.select(F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("xmin", "xmax") for y in ("ymin", "ymax")])).alias("p"), "level")
    found = corners.groupBy("p.x", "p.y").agg(F.count("*").alias("n"), F.avg("level").alias("level")).where("n < 4")
    return found.select((F.lit(first_id) + F.pmod(F.xxhash64("x", "y"), F.lit(math.floor(2**61)))).alias("id"), "x", "y", "level")
