"""Text columns: change descriptions, identifiers, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def change_text(left: Column, right: Column, same: str = "not changed") -> Column:
    """"a -> b" where two values differ, `same` where they agree, null where both are null. Whole numbers show no
    decimals."""
    shown = lambda c: F.coalesce(F.regexp_replace(c.cast("string"), r"^(-?\d+)\.0$", "$1"), F.lit("None"))
    return F.when(left.isNull() & right.isNull(), None).when(left.eqNullSafe(right), same).otherwise(F.concat(shown(left), F.lit(" -> "), shown(right)))


def identifier(prefix: str, layer: str, *candidates: Column) -> Column:
    """prefix.layer.code with the first candidate that is not null."""
    return F.concat(F.lit(f"{prefix}.{layer}."), F.coalesce(*[c.cast("string") for c in candidates]))


def domain_value(column: Column, allowed: list[str], default: str) -> Column:
    """The value if the domain has it, else the default."""
    return F.when(column.isin(*allowed), column).otherwise(F.lit(default))


def time_label(seconds: Column) -> Column:
    """1h, 30min, 1h30min for a number of seconds, max for null."""
    hours, minutes = F.floor(seconds / 3600).cast("string"), F.floor((seconds % 3600) / 60).cast("string")
    return (
        F.when(seconds.isNull(), "max")
        .when(seconds % 3600 < 60, F.concat(hours, F.lit("h")))
        .when(seconds < 3600, F.concat(minutes, F.lit("min")))
        .otherwise(F.concat(hours, F.lit("h"), minutes, F.lit("min")))
    )


def contains_any_case(column: Column, part: str) -> Column:
    """Whether the text holds `part` in any case; false for null."""
    return F.coalesce(F.lower(column).contains(part.lower()), F.lit(False))
