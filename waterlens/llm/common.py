"""What the training-data operators share: table reads, the shared folder, lineage cuts and id hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterlens.session import cut, new_path, shared_dir, table

__all__ = ["cut", "id_crc", "new_path", "shared_dir", "table", "written"]


def id_crc(column: str) -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table of the shared folder. Unlike a checkpoint its size is that of its files, so plans of many rounds
    neither carry the estimates of all earlier joins along nor miss that a table is small."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
