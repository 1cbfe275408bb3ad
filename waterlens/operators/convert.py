"""Conversions between layer schemas: mapped columns, ids, child layers, domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import conform, fk_cleanup


def stable_id(*columns: Column) -> Column:
    """An id in the form of a UUID from the values that identify a row: the same in every run and on every retry."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def mapped_layer(df: DataFrame, mapping: Mapping[str, str], schema: Mapping[str, str]) -> DataFrame:
    """A layer of a fixed schema: columns renamed by the mapping (old to new), cast, missing ones null, others gone."""
    return conform(df.select(*[F.col(old).alias(new) for old, new in mapping.items() if old in df.columns]), schema)


def child_layer(parent: DataFrame, key: str, fk: str, mapping: Mapping[str, str], schema: Mapping[str, str], name: str) -> DataFrame:
    """One child per parent that has a key: its own stable id, the parent's key, mapped columns, the child's schema."""
    rows = parent.where(F.col(key).isNotNull()).withColumn("_id", stable_id(F.lit(name), F.col(key)))
    return mapped_layer(rows, {"_id": "globalid", key: fk, **mapping}, {"globalid": "string", fk: dict(parent.dtypes)[key], **schema})


def linked_layers(layers: Mapping[str, DataFrame], links: Sequence[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Layers whose foreign keys point only to rows that exist. links: (child, fk, parent, pk), parents first."""
    out = dict(layers)
    for child, fk, parent, pk in links:
        out[child] = fk_cleanup(out[child], fk, out[parent], pk)
    return out


def decode_domains(df: DataFrame, domains: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes replaced by their names, all coded columns in one join each with the domain table (column_name, code,
    name); a code that a domain has twice gives its first name, an unknown one null."""
    for column in columns:
        names = domains.where(F.col("column_name") == column).groupBy(F.col("code").cast("string").alias("_code")).agg(F.min("name").alias("_name"))
        df = df.join(names, F.col(column).cast("string") == F.col("_code"), "left").withColumn(column, F.col("_name")).drop("_code", "_name")
    return df
