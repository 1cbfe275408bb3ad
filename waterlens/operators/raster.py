"""Raster operators on pixel tables (x, y, value): map algebra, zonal sums, return periods, damage, storage.

Null is no data. Pixels meet by equi-joins on their key and are summed with map-side combine, so rasters of any size
run as partitions of one job. `map_tiles` runs a numpy function over tile rows where columns cannot say it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curves import interpolate_arrays
from ..functions.geometry import in_ring

WATER = 10.0


def depth(level: DataFrame, ground: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Water depth: level minus ground, not under 0, null where either is null."""
    joined = level.withColumnRenamed("value", "_level").join(ground.withColumnRenamed("value", "_ground"), list(keys))
    return joined.select(*keys, F.when(F.col("_level").isNotNull() & F.col("_ground").isNotNull(), F.greatest(F.col("_level") - F.col("_ground"), F.lit(0.0))).alias("value"))


def override(raster: DataFrame, mask: Column, value: float = WATER) -> DataFrame:
    """A fixed value where the mask holds."""
    return raster.withColumn("value", F.when(mask, F.lit(value)).otherwise(F.col("value")))


def zonal_sum(pixels: DataFrame, zone: str, value: str, total: bool = False, factor: float = 1.0) -> DataFrame:
    """Sum and count per zone, with a row of all zones (null zone, is_total 1) if asked for."""
    grouped = pixels.rollup(zone) if total else pixels.groupBy(zone)
    marks = [F.grouping(zone).cast("int").alias("is_total")] if total else []
    return grouped.agg(*marks, (F.coalesce(F.sum(value), F.lit(0.0)) * factor).alias("zone_sum"), F.count(value).alias("n_pixels"))


def statistics(pixels: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return pixels.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def exceedance_interpolate(stack: DataFrame, keys: Sequence[str], value: str, frequency: str, period: float, minimum: float = 0.0) -> DataFrame:
    """The value of a return period per pixel, from a stack of values with yearly frequencies.

    Values are sorted up (ties: the higher frequency first); E is the frequency with which a value is met or exceeded.
    With target frequency f, the neighbours are the last value with E > f but one, and the next; the value is linear in
    ln(1/E). Null where even the rarest is expected more often, or the wet part is rarer than f; the largest value
    where all are.
    """
    target = 1.0 / period
    up = Window.partitionBy(*keys).orderBy(F.col(value), F.col(frequency).desc())
    reach = F.sum(frequency).over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    listed = stack.withColumn("_e", reach).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("d"), (-F.col("_e")).alias("e")))).alias("_s"))
    n = F.size("_s")
    low = F.greatest(F.size(F.filter("_s", lambda s: -s["e"] > target)) - 1, F.lit(0))
    high = F.least(low + 1, n - 1)
    d = lambda at: F.get("_s", at)["d"]
    t = lambda at: F.log(F.lit(1.0) / -F.get("_s", at)["e"])
    wet = F.array_max(F.transform(F.filter("_s", lambda s: s["d"] > minimum), lambda s: -s["e"]))
    between = d(low) + (F.log(F.lit(period)) - t(low)) / (t(high) - t(low)) * (d(high) - d(low))
    found = F.when(F.coalesce(wet, F.lit(0.0)) < target, None).when(low == 0, None).when(low == n - 1, d(n - 1)).otherwise(between)
    return listed.select(*keys, found.alias("value_at_period"))


def yearly_damage(stack: DataFrame, keys: Sequence[str], damage: str, frequency: str, floor: float = 1e-5, factor: float = 1.0) -> DataFrame:
    """Expected damage a year per pixel, times a factor: sums of frequency x damage, 0 up to the floor; null or
    negative damage is 0."""
    amount = F.sum(F.col(frequency) * F.greatest(F.coalesce(damage, F.lit(0.0)), F.lit(0.0)))
    return stack.groupBy(*keys).agg(amount.alias("_d")).select(*keys, (F.when(F.col("_d") <= floor, 0.0).otherwise(F.col("_d")) * factor).alias("yearly_damage"))


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, to: str) -> DataFrame:
    """Running sum of a value along an order, per key."""
    return df.withColumn(to, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def forward_difference(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, to: str) -> DataFrame:
    """The next row's value minus this one's, null for the last."""
    return df.withColumn(to, F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)) - F.col(value))


def neighbour_mean(pixels: DataFrame, x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """Mean of the up to eight neighbours' values, null without one: each pixel is sent to its neighbours."""
    around = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    sent = pixels.where(F.col(value).isNotNull()).select(F.explode(around).alias("_d"), x, y, value).select((F.col(x) + F.col("_d.dx")).alias("_x"), (F.col(y) + F.col("_d.dy")).alias("_y"), value)
    means = sent.groupBy("_x", "_y").agg(F.avg(value).alias("neighbour_mean"), F.count("*").alias("n_neighbours"))
    return pixels.join(means, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left").drop("_x", "_y")


def soil_storage(pixels: DataFrame, curves: DataFrame, soil: str, at: Column) -> DataFrame:
    """Storage by soil curve at a depth; curves: (soil, depths array, storages array), one row per soil."""
    joined = pixels.join(curves.withColumnRenamed(soil, "_soil"), F.col(soil) == F.col("_soil"), "left")
    found = F.when(at < 0, 0.0).otherwise(interpolate_arrays(at, F.col("depths"), F.col("storages")))
    return joined.withColumn("storage", F.when(at.isNotNull() & F.col("_soil").isNotNull(), found)).drop("_soil", "depths", "storages")


def resample(pixels: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Pixel keys of coordinates at another resolution."""
    return pixels.withColumn("px", F.floor(F.col(x) / size)).withColumn("py", F.floor(F.col(y) / size))


def rasterise(polygons: DataFrame, value: str, size: float) -> DataFrame:
    """(px, py, value) of the pixels whose centre a polygon (ring: closed array<struct<x,y>>) holds; where several do,
    the largest value stays. Pixel centres are made row by row, so a large polygon spreads over its rows."""
    bounds = lambda axis, f: f(F.transform("ring", lambda p: p[axis]))
    low = lambda axis: F.floor(bounds(axis, F.array_min) / size).cast("long")
    high = lambda axis: F.floor(bounds(axis, F.array_max) / size).cast("long")
    rows = polygons.select("ring", value, F.explode(F.sequence(low("y"), high("y"))).alias("py"))
    pixels = rows.select("ring", value, "py", F.explode(F.sequence(low("x"), high("x"))).alias("px"))
    inside = pixels.where(in_ring((F.col("px") + 0.5) * size, (F.col("py") + 0.5) * size, F.col("ring")))
    return inside.groupBy("px", "py").agg(F.max(value).alias("value"))


def map_tiles(tiles: DataFrame, function: Callable[[np.ndarray], np.ndarray], value: str = "data") -> DataFrame:
    """A numpy function over each tile's values (array<double>, null as NaN), tile by tile, in Arrow batches. Null tiles
    stay null; the values of a batch are one flat buffer, of which a tile is a slice."""
    at, names, schema = tiles.columns.index(value), tiles.columns, tiles.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            flat, starts = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            parts = [function(flat[starts[k] : starts[k + 1]].copy()) if known[k] else flat[:0] for k in range(len(lists))]
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            offsets = pa.array(ends, mask=np.append(~known, False))
            made = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([flat[:0], *parts]), from_pandas=True))
            yield pa.RecordBatch.from_arrays([made if k == at else batch.column(k) for k in range(len(names))], names=names)

    return tiles.mapInArrow(run, schema)


def raised(cells: DataFrame, places: DataFrame, keys: Sequence[str], value: str, by: float) -> DataFrame:
    """`cells` with `value` raised where `places` has the keys."""
    marked = places.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_by", F.lit(by))
    found = cells.join(marked, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    return found.select(*[(F.col(value) + F.coalesce("_by", F.lit(0.0))).alias(value) if c == value else c for c in cells.columns])


def damage_by_use(cells: DataFrame, curves: DataFrame, depth: str, use: str) -> DataFrame:
    """`cells` with the damage of their depth by the curve (depths, damages) of their land use; null without a curve."""
    known = curves.select(F.col(use).alias("_use"), "depths", "damages")
    found = cells.join(known, F.col(use) == F.col("_use"), "left")
    return found.withColumn("damage", interpolate_arrays(F.col(depth).cast("double"), F.col("depths"), F.col("damages"))).drop("_use", "depths", "damages")


def storage_table(curves: DataFrame, soil: str, step: float = 0.01, deepest: float = 10.0) -> DataFrame:
    """(soil, n, storage, following) in metres at depths of n steps: what the root zone can take more at that depth, and
    the unsaturated zone down to it. curves: (soil, depths, coefficients, root_zone), arrays, the last in millimetres."""
    d = F.round(F.col("n") * step, 5)
    at = lambda c: interpolate_arrays(d, F.col("depths"), F.col(c))
    rows = curves.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(round(deepest / step)))))
    rows = rows.withColumn("_local", F.when(F.col("n") == 0, 0.0).otherwise(at("coefficients") * step * 1000))
    down = Window.partitionBy(soil).orderBy("n")  # a soil has one row a step
    total = (F.array_max("root_zone") - at("root_zone") + F.sum("_local").over(down)) / 1000
    return rows.withColumn("storage", total).select(soil, "n", "storage", F.lead("storage").over(down).alias("following"))


def storage_raster(pixels: DataFrame, table: DataFrame, soil: str, ground: str, groundwater: str, step: float = 0.01) -> DataFrame:
    """`pixels` with their storage by soil and depth to the groundwater, linear between the steps of the table. Zero on
    water and where groundwater stands over the ground; null where ground, groundwater or soil is null or not in the
    table. The join is on soil and step, so that a common soil is spread."""
    depth = F.col(ground) - F.col(groundwater)
    rows = pixels.withColumn("_depth", depth).withColumn("_n", F.floor(F.greatest(F.col("_depth"), F.lit(0.0)) / step))
    last = table.agg(F.max("n").alias("_most"))
    rows = rows.crossJoin(F.broadcast(last)).withColumn("_n", F.least("_n", "_most"))  # one row
    known = table.select(F.col(soil).alias("_soil"), F.col("n").alias("_step"), F.col("storage").alias("_a"), F.col("following").alias("_b"))
    found = rows.join(known, (F.col(soil) == F.col("_soil")) & (F.col("_n") == F.col("_step")), "left")
    between = F.coalesce(F.col("_a") + (F.col("_depth") / step - F.col("_n")) * (F.col("_b") - F.col("_a")), F.col("_a"))
    dry = F.when((F.col(ground) == WATER) | (F.col("_depth") < 0), 0.0).otherwise(between)
    return found.withColumn("storage", F.when(F.col("_depth").isNotNull() & F.col("_soil").isNotNull(), dry)).select(*pixels.columns, "storage")


def without_water(values: DataFrame, ground: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values of pixels, null on water and where they are 0; a pixel without ground keeps its value."""
    below = ground.select(*keys, F.col("value").alias("_ground"))
    keep = F.coalesce(F.col("_ground") != WATER, F.lit(True)) & (F.col("value") != 0)
    return values.join(below, list(keys), "left").withColumn("value", F.when(keep, F.col("value"))).drop("_ground")


def resample_by_area(pixels: DataFrame, value: str, size: float, new_size: float) -> DataFrame:
    """(i, j, total, mean, area) of pixels of `new_size` from pixels (i, j, `value`) of `size`, both counted from the same corner.

    A pixel's value is shared out by the area that each new pixel has of it: totals add up to the given total. The mean is
    weighted by area, and area is what known pixels cover. Null values cover nothing.
    """
    known = pixels.where(F.col(value).isNotNull())

    def cut_up(c: str) -> Column:
        low, high = F.col(c) * size, (F.col(c) + 1) * size
        share = lambda k: F.least(high, (k + 1) * new_size) - F.greatest(low, k * new_size)
        spans = F.transform(F.sequence(F.floor(low / new_size), F.ceil(high / new_size) - 1), lambda k: F.struct(k.alias("k"), share(k).alias("w")))
        return F.explode(F.filter(spans, lambda s: s["w"] > 0))

    shared = known.select("i", "j", F.col(value).alias("_v")).withColumn("_i", cut_up("i")).withColumn("_j", cut_up("j"))
    area = F.col("_i.w") * F.col("_j.w")
    sums = shared.groupBy(F.col("_i.k").alias("i"), F.col("_j.k").alias("j")).agg(F.sum(area * F.col("_v")).alias("_s"), F.sum(area).alias("area"))
    return sums.select("i", "j", (F.col("_s") / (size * size)).alias("total"), (F.col("_s") / F.col("area")).alias("mean"), "area")


def clipped_to_model(rasters: DataFrame, model: DataFrame, water: DataFrame, water_value: float = WATER, ground: str = "dem", whole: Sequence[str] = ("landuse",)) -> DataFrame:
    """(name, px, py, value) of named rasters at the pixels of a model, one row for each.

    rasters: (name, px, py, value); model: (px, py) of its pixels; water: (px, py) of those that are water. A raster's pixel
    keeps no value outside the model or where it has none; ground that is water is `water_value`, and rasters of `whole`
    numbers drop what follows the point. Each table is matched once for all rasters.
    """
    inside = model.select(F.col("px").alias("_mx"), F.col("py").alias("_my")).distinct()
    wet = water.select(F.col("px").alias("_wx"), F.col("py").alias("_wy")).distinct()
    found = rasters.join(inside, (F.col("px") == F.col("_mx")) & (F.col("py") == F.col("_my")), "left_semi")
    found = found.join(wet, (F.col("px") == F.col("_wx")) & (F.col("py") == F.col("_wy")), "left")
    known = F.when((F.col("name") == ground) & F.col("_wx").isNotNull() & F.col("value").isNotNull(), F.lit(water_value)).otherwise(F.col("value"))
    return found.select("name", "px", "py", F.when(F.col("name").isin(*whole), F.signum(known) * F.floor(F.abs(known))).otherwise(known).alias("value"))


def damage_ground(dem: DataFrame, buildings: DataFrame, parts: int = 2, height: float = 0.1) -> DataFrame:
    """(px, py, value) of the ground that damage is reckoned from: each pixel of `dem` (px, py, value) in `parts` x `parts`
    finer ones, higher where `buildings` (px, py of finer pixels) has one; no value where the ground has none."""
    step = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    fine = dem.withColumn("_i", step).withColumn("_j", step).select((F.col("px") * parts + F.col("_i")).alias("px"), (F.col("py") * parts + F.col("_j")).alias("py"), "value")
    return raised(fine, buildings, ["px", "py"], "value", height)
