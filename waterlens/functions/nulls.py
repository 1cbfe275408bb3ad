"""Null and rounding rules that differ between engines, made explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_max(a: Column, b: Column) -> Column:
    """The larger value, null if either is null (`greatest` skips nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def strict_min(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def differs(a: Column, b: Column) -> Column:
    """Whether two values differ, null being a value of its own."""
    return ~a.eqNullSafe(b)


def differs_or_null(a: Column, b: Column) -> Column:
    """Whether two values differ, a null differing from everything, another null included."""
    return F.coalesce(a != b, F.lit(True))


def sum_or_zero(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in every float column, which readers apply once."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes])


def sentinel_to_null(column: Column, *sentinels: float) -> Column:
    """Null for the values that stand for no data."""
    return F.when(~column.isin(*sentinels), column)


def half_even(column: Column, digits: int = 0) -> Column:
    return F.bround(column, digits)
