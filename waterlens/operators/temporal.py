"""Time-series operators: as-of lookup, values at a maximum, rain windows, means of a slice.

A series is long: (element, t, value). Every choice is an aggregate with map-side combine; no series is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WET = 1e-5


def asof_nearest(series: DataFrame, keys: Sequence[str], at: Column, t: str, tolerance: Column | float, value: str) -> DataFrame:
    """Per key the value at the time nearest to `at` (ties: the earlier), null if none is within the tolerance."""
    off = F.abs(F.col(t) - at)
    best = series.groupBy(*keys).agg(F.min_by(F.struct(F.col(t).alias("t"), F.col(value).alias("value"), off.alias("off")), F.struct(off, F.col(t))).alias("_best"))
    near = F.col("_best.off") <= tolerance
    return best.select(*keys, F.when(near, F.col("_best.t")).alias("t_found"), F.when(near, F.col("_best.value")).alias("value_found"))


def value_at_max(series: DataFrame, keys: Sequence[str], value: Column, by: Column, t: Column) -> DataFrame:
    """Per key the value where `by` is largest, the first time on ties."""
    return series.groupBy(*keys).agg(F.max_by(value, F.struct(by, -t)).alias("value_at_max"))


def signed_extreme(series: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Per key the signed value of the largest magnitude, the first on ties."""
    return value_at_max(series, keys, F.col(value), F.abs(value), F.col(order))


def rain_window(series: DataFrame, keys: Sequence[str], index: str, rain: str, wet: float = WET) -> DataFrame:
    """Per key the first and last index with rain, the dry indexes before and after them; null without rain."""
    raining = F.col(rain) > wet
    out = series.groupBy(*keys).agg(
        F.min(F.when(raining, F.col(index))).alias("first_wet"), F.max(F.when(raining, F.col(index))).alias("last_wet"),
        F.min(index).alias("_begin"), F.max(index).alias("_end"),
    )
    return out.select(*keys, "first_wet", "last_wet", (F.col("first_wet") - F.col("_begin")).alias("dry_before"), (F.col("_end") - F.col("last_wet")).alias("dry_after"))


def first_after(series: DataFrame, keys: Sequence[str], t: str, index: str, after: Column) -> DataFrame:
    """Per key the first index with a time after `after`; 0 if there is none."""
    return series.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(t) > after, F.col(index))), F.lit(0)).alias("first_after"))


def slice_mean(series: DataFrame, keys: Sequence[str], t: str, begin: Column, end: Column, value: str) -> DataFrame:
    """Per key the mean over begin <= t < end."""
    return series.where((F.col(t) >= begin) & (F.col(t) < end)).groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n_values"))


def level_differences(series: DataFrame, element: str, t: str, value: str, marks: dict[str, int]) -> DataFrame:
    """Per element the values at marked times side by side, and the rises between neighbouring marks."""
    wide = series.where(F.col(t).isin(*marks.values())).groupBy(element).agg(*[F.max(F.when(F.col(t) == at, F.col(value))).alias(name) for name, at in marks.items()])
    names = list(marks)
    return wide.select(element, *names, *[(F.col(b) - F.col(a)).alias(f"{a}_to_{b}") for a, b in zip(names, names[1:], strict=False)])


def rain_days(rain: DataFrame, keys: Sequence[str], hour: str, value: str, wet: float = WET) -> DataFrame:
    """Per key the dry days before and after the rain of an hourly list (hours from 0); null without rain."""
    window = rain_window(rain, keys, hour, value, wet)
    last = F.col("last_wet") + F.col("dry_after")
    days = lambda hours: F.when(F.col("first_wet").isNotNull(), F.greatest(hours / 24, F.lit(0.0)))
    return window.select(*keys, days(F.col("first_wet") - 1).alias("dry_start"), days(last - F.col("last_wet")).alias("dry_end"))


def result_marks(steps: DataFrame, keys: Sequence[str], index: str, minutes: str, days: DataFrame) -> DataFrame:
    """Per key the indexes of the start, the start of the rain, one day before its end, its end and the last step.

    steps: (keys, index from 0, minutes); days: as rain_days gives them. A mark that no step reaches falls on index 0;
    the two marks at the end of the rain lie one step before theirs, and before index 0 comes the last one. Null without
    rain, but for the first and the last mark.
    """
    ends = steps.groupBy(*keys).agg(F.max(minutes).alias("_end"), F.max(index).alias("_last"))
    every = steps.join(ends.join(days, list(keys), "left"), list(keys))
    t, dry_end = F.col(minutes), F.col("dry_end") * 1440
    first = lambda condition: F.coalesce(F.min(F.when(condition, F.col(index))), F.lit(0))
    found = every.groupBy(*keys, "_last", "dry_start").agg(
        first(t > 0).alias("t_0"), first(t > F.col("dry_start") * 1440).alias("_rain"), first(t > F.col("_end") - dry_end - 1440).alias("_day"),
        first(t > F.col("_end") - dry_end).alias("_stop"), first(t == F.col("_end")).alias("t_end_sum"),
    )
    before = lambda c: F.when(F.col(c) == 0, F.col("_last")).otherwise(F.col(c) - 1)
    marks = {"t_start_rain": F.col("_rain"), "t_end_rain_min_one": before("_day"), "t_end_rain": before("_stop")}
    return found.select(*keys, "t_0", *[F.when(F.col("dry_start").isNotNull(), c).alias(name) for name, c in marks.items()], "t_end_sum")


def level_rises(levels: DataFrame, keys: Sequence[str], element: str, index: str, value: str, marks: DataFrame) -> DataFrame:
    """Per element the rises up to the rain, in it, on its last day, and from the start to the end. marks: result_marks."""
    names = [c for c in marks.columns if c not in keys]
    at = levels.join(marks, list(keys)).groupBy(*keys, element).agg(*[F.max(F.when(F.col(index) == F.col(m), F.col(value))).alias(m) for m in names])
    rise = lambda a, b: F.col(b) - F.col(a)
    return at.select(
        *keys, element, rise("t_0", "t_start_rain").alias("lvl_start"), rise("t_start_rain", "t_end_rain").alias("lvl_rain"),
        rise("t_end_rain_min_one", "t_end_rain").alias("lvl_end_rain"), rise("t_0", "t_end_sum").alias("lvl_end"),
    )
