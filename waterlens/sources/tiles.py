"""Pixel tables in tiles: a sink and a scan whose windows become ranges of tile keys.

A tile's key interleaves the bits of its column and row, so tiles that lie together have keys that lie together. Files are
partitioned by blocks of 64 tiles and sorted by key inside: a window is a few ranges of keys, which prune directories first and
row groups then. The size of a tile and the number that stands for no data are kept with the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns and rows are counted from the middle of this many; keys of a block share all but their last BLOCK_BITS bits.
MIDDLE, BITS, BLOCK_BITS = 1 << 24, 25, 6
#: Ranges of keys that a window is cut into at most; beyond it they take in tiles outside, which the exact test drops.
MOST_RANGES = 48
_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(v: Column) -> Column:
    return reduce(lambda w, m: w.bitwiseOR(F.shiftleft(w, m[0])).bitwiseAND(F.lit(m[1])), _MASKS, v.cast("long"))


def tile_key(x: Column, y: Column, size: float) -> Column:
    """The key of the tile that holds a point."""
    at = lambda c: F.floor(c / size).cast("long") + MIDDLE
    return _spread(at(x)).bitwiseOR(F.shiftleft(_spread(at(y)), 1))


def _key(x: int, y: int) -> int:
    return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(BITS))


def key_ranges(x0: int, y0: int, x1: int, y1: int, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, ends included, of the tiles from (x0, y0) to (x1, y1): quarters of the plane are split while they
    reach beyond the window and there are not too many."""
    whole: list[tuple[int, int]] = []
    open_ = [(0, 0, BITS)]
    while open_ and len(whole) + 4 * len(open_) <= most:
        following = []
        for x, y, level in open_:
            side = 1 << level
            if x > x1 or y > y1 or x + side <= x0 or y + side <= y0:
                continue
            if level == 0 or (x >= x0 and y >= y0 and x + side - 1 <= x1 and y + side - 1 <= y1):
                whole.append((_key(x, y), _key(x, y) + side * side - 1))
            else:
                half = side // 2
                following += [(x + i * half, y + j * half, level - 1) for j in (0, 1) for i in (0, 1)]
        open_ = following
    for x, y, level in open_:
        side = 1 << level
        if not (x > x1 or y > y1 or x + side <= x0 or y + side <= y0):
            whole.append((_key(x, y), _key(x, y) + side * side - 1))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(whole):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


@dataclass(frozen=True)
class Layout:
    size: float
    nodata: float


def write_tiles(pixels: DataFrame, path: str, value: str, size: float, nodata: float = -9999.0) -> None:
    """Writes pixels (x, y, `value`, more) as tiles. A null or not-a-number value is kept as `nodata`; pixels without a place
    go. All pixels of a block of tiles come to one task, whose rows a tile of a raster bounds."""
    key = tile_key(F.col("x"), F.col("y"), size)
    kept = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None)), F.lit(nodata))
    tiled = pixels.where("x IS NOT NULL AND y IS NOT NULL").withColumn(value, kept).withColumns({"tile": key, "block": F.shiftright(key, BLOCK_BITS)})
    tiled.repartition("block").sortWithinPartitions("block", "tile").write.partitionBy("block").parquet(f"{path}/tiles")
    pixels.sparkSession.range(1).select(F.lit(float(size)).alias("size"), F.lit(float(nodata)).alias("nodata"), F.lit(value).alias("value")).coalesce(1).write.json(f"{path}/layout")


def read_tiles(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The pixels of `write_tiles`, no data as null; with a window (xmin, ymin, xmax, ymax; low sides in, high sides out) those
    in it, of which only blocks and tiles that it touches are read."""
    layout = spark.read.schema("size double, nodata double, value string").json(f"{path}/layout").first()
    rows = spark.read.parquet(f"{path}/tiles")
    if window is not None:
        low, high = [int(v // layout["size"]) + MIDDLE for v in window[:2]], [int(v // layout["size"]) + MIDDLE for v in window[2:]]
        ranges = key_ranges(*low, *high)
        blocks = reduce(Column.__or__, (F.col("block").between(a >> BLOCK_BITS, b >> BLOCK_BITS) for a, b in ranges))
        keys = reduce(Column.__or__, (F.col("tile").between(a, b) for a, b in ranges))
        inside = (F.col("x") >= window[0]) & (F.col("x") < window[2]) & (F.col("y") >= window[1]) & (F.col("y") < window[3])
        rows = rows.where(blocks & keys & inside)
    value = layout["value"]
    return rows.withColumn(value, F.when(F.col(value) != layout["nodata"], F.col(value))).drop("tile", "block")
