"""Readers and writers of exchange files: CSV, database layers, text dump and restore, content hashes."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.nulls import nan_to_null


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ";") -> DataFrame:
    """A delimited file with a header and a given schema; NaN becomes null."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("sep", separator).csv(path))


def write_csv(df: DataFrame, path: str, separator: str = ";") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def read_domains(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """(column_name, code, name) of an XML domain document: one element per value, with these children."""
    return spark.read.format("xml").option("rowTag", row_tag).schema("column_name string, code string, name string").load(path)


def read_query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """A query that a database runs, as a table; what is filtered afterwards is pushed to it where it can be. With
    partitionColumn, lowerBound, upperBound and numPartitions among the options it is read in as many parts."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"({sql}) given", **options).load()


def round_numbers(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so dumps of equal data are equal text."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def dump(df: DataFrame, digits: int = 6) -> DataFrame:
    """One JSON text per row, numbers rounded, null fields kept out."""
    return round_numbers(df, digits).select(F.to_json(F.struct(*df.columns)).alias("line"))


def restore(lines: DataFrame, schema: StructType | str) -> DataFrame:
    """The typed rows of a dump."""
    return lines.select(F.from_json("line", schema).alias("_r")).select("_r.*")


def schema_text(layers: Mapping[str, DataFrame]) -> str:
    """The schemas of named layers as JSON."""
    return json.dumps({name: df.schema.jsonValue() for name, df in sorted(layers.items())}, indent=1, sort_keys=True)


def row_hash(columns: list[str]) -> Column:
    return F.md5(F.to_json(F.struct(*columns)))


def content_hash(df: DataFrame) -> DataFrame:
    """One row (n_rows, content): equal for equal rows in any order, computed with map-side sums."""
    part = F.conv(F.substring(row_hash(df.columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("content"))


def clip_rows(df: DataFrame, inside: Column, geometry: str) -> DataFrame:
    """Rows inside a shape, and rows without a geometry."""
    return df.where(F.coalesce(inside, F.lit(False)) | F.col(geometry).isNull())
