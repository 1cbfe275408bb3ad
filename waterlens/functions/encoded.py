"""Values encoded in a string cell: pair tables, tag lists, number lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_pairs(column: Column, row_sep: str = "\n", col_sep: str = ",") -> Column:
    """"a,b\\nc,d" as array<struct<x,y>> of doubles; rows without two numbers are left out, null stays null."""
    rows = F.filter(F.split(column, _literal(row_sep)), lambda r: F.trim(r) != "")
    part = lambda r, n: F.get(F.split(r, _literal(col_sep)), F.lit(n)).try_cast("double")
    pairs = F.transform(rows, lambda r: F.struct(part(r, 0).alias("x"), part(r, 1).alias("y")))
    return F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def parse_longs(column: Column, row_sep: str, col_sep: str) -> Column:
    """The same with whole numbers."""
    rows = F.filter(F.split(column, _literal(row_sep)), lambda r: F.trim(r) != "")
    part = lambda r, n: F.get(F.split(r, _literal(col_sep)), F.lit(n)).try_cast("long")
    pairs = F.transform(rows, lambda r: F.struct(part(r, 0).alias("x"), part(r, 1).alias("y")))
    return F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def format_pairs(pairs: Column, row_sep: str = "\n", col_sep: str = ",") -> Column:
    """The string of an array<struct<x,y>>, the inverse of the parsers."""
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws(col_sep, p["x"].cast("string"), p["y"].cast("string"))), row_sep)


def sort_pairs(pairs: Column) -> Column:
    """Pairs by x, then y: the order that a control table needs."""
    return F.array_sort(pairs)


def parse_tags(column: Column) -> Column:
    """"1,2" or "[1, 2]" as array<long>; null or nothing gives an empty array."""
    parts = F.split(F.regexp_replace(F.coalesce(column, F.lit("")), r"[\[\]\s]", ""), ",")
    return F.filter(F.transform(parts, lambda p: p.try_cast("long")), lambda v: v.isNotNull())


def tag_names(tags: Column, names: Column) -> Column:
    """The names of tag ids by a map column, unknown ids left out, order kept."""
    return F.filter(F.transform(tags, lambda t: F.try_element_at(names, t)), lambda n: n.isNotNull())


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if c in r".^$*+?()[]{}|\\" else c for c in text)
