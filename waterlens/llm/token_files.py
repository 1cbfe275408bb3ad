"""Token ids as ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .token_encoding import default_path, encoder

END_ID = 1
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
#: Parts whose totals are broadcast; past it they are joined by a shuffle.
BROADCAST_PARTS = 100_000


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, stripe_bytes: int = 32 << 20, row_group: int = 10_000) -> None:
    """Writes the ids of every text of `docs`, each with `end_id` after it, to ORC files in ascending doc_id order.

    Files are ranges of doc_id (null ids first, equal ids by a hash of their text), rows inside a file are in that
    order, and a row holds its part and the ids before it in the part. Null texts count as empty: the end id alone. The
    text is shuffled once, before it is encoded, so nothing is encoded twice. An empty table writes no rows.
    """
    vocabulary = tokenizer or default_path("word_bpe_49k.json")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, ids, sizes in known.slices(batch.column(1), end_id):
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), type=pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first : first + len(sizes)].cast(pa.int64()), pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(before + ends - sizes), pa.array(sizes), lists,
                ], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
                before += int(ends[-1])

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = ordered.select("doc_id", "text").mapInArrow(encode, SCHEMA)
    (
        files.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", row_group)
        .option("orc.stripe.size", stripe_bytes)
        .orc(path)
    )


def read(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The rows of the files; with `doc_ids`, their predicate reaches the stripes' statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        ends = np.cumsum(np.concatenate(([0], lists.value_lengths().to_numpy(zero_copy_only=False))))
        crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends), type=pa.int64()), pa.array(crcs, type=pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per row of the files: doc_id, start (ids of all rows before it), n_tokens, ids_crc32 (unsigned, of the ids as
    little-endian unsigned 32-bit integers)."""
    rows = read(spark, path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    if totals.count() <= BROADCAST_PARTS:
        before = F.broadcast(before)
    found = rows.select("doc_id", "part", "part_start", "ids").mapInArrow(_digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return found.join(before, F.col("part") == F.col("_part")).select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
