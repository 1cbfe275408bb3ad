"""Piecewise-linear curves as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """The curve through (xs, ys) at x, clamped at both ends; xs ascending, null for a null x."""
    points = list(zip(xs, ys, strict=True))
    if not points:
        raise ValueError("a curve needs a point")
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(x.isNotNull(), F.lit(float(points[-1][1])))


def interpolate_arrays(x: Column, xs: Column, ys: Column) -> Column:
    """The same with the curve in array columns, as in a lookup table."""
    n = F.size(xs)
    after = F.size(F.filter(xs, lambda v: v < x))
    x0, x1 = F.get(xs, after - 1), F.get(xs, after)
    y0, y1 = F.get(ys, after - 1), F.get(ys, after)
    return F.when(x.isNull() | (n <= 0), None).when(after == 0, F.get(ys, F.lit(0))).when(after >= n, F.get(ys, n - 1)).otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0))


def present_value_factor(rate: float, years: int) -> float:
    """The factor of a yearly amount over a number of years at a discount rate."""
    return (1 - (1 - rate) ** years) / rate
