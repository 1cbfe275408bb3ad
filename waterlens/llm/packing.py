"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

Only the histogram, at most `capacity` rows whatever the data, reaches the driver. It is packed there bin pattern by
bin pattern; a pattern is used as often as its lengths last, so the work follows the number of lengths. Spark ranks the
pieces of each length and gives each its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .token_encoding import default_path, encoder

CAPACITY = 2048
SEPARATOR = 0
#: Pieces of one length that are ranked in one task, in expectation.
RANKED = 10_000
Pattern = list[tuple[int, int]]


def fullest(counts: dict[int, int], capacity: int) -> Pattern:
    """The fullest combination of the available lengths that fits: (length, copies), longest first.

    Subset sums are the bits of an integer; multiples of a length join it by doubling. The search ends when the
    capacity is met and walks back over the sums before each step.
    """
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Bin patterns and how often each is used, until nothing is left: the longest length first, then the fullest
    combination beside it, which is removed."""
    counts, out = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        beside = fullest({k: v for k, v in counts.items() if v}, capacity - longest)
        counts[longest] += 1
        pattern = dict(beside)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        out.append((sorted(pattern.items(), reverse=True), times))
        for k, n in pattern.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """The pieces of every text: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for.

    A document is its ids and the separator; only one longer than the capacity is cut, into full pieces after a first
    one that may be shorter. Null texts count as empty: the separator alone.
    """
    vocabulary = tokenizer or default_path("byte_bpe_50k.json")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        for batch in batches:
            for first, ids, sizes in known.slices(batch.column(1), separator):
                ends, rows, blobs = np.cumsum(sizes).tolist(), [], []
                for doc, end, total in zip(batch.column(0)[first : first + len(sizes)].to_pylist(), ends, sizes.tolist(), strict=True):
                    start, n = 0, 0
                    while start < total:
                        size = (total - start) % capacity or capacity
                        part = ids[end - total + start : end - total + start + size]
                        rows.append((doc, n, start, size, zlib.crc32(part)))
                        if with_ids:
                            blobs.append(part.astype(np.int32))
                        start, n = start + size, n + 1
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                if with_ids:
                    arrays.append(pa.array(blobs, type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut_up, schema)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`found` (pieces) with sequence_id and offset. Pieces are numbered as they are materialised, so rows that are equal
    or have a null doc_id are dealt out like any others."""
    spark, columns = found.sparkSession, found.columns
    found = cut(found.withColumn("_row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < k <= capacity for k in histogram):
        raise ValueError("a piece's length must be from 1 to the capacity")
    places, bins, used = [], 0, {}
    for pattern, times in plan(histogram, capacity):
        offset = 0
        for length, copies in pattern:
            first = used.get(length, 0)
            places.append((length, first, copies, bins, offset))
            used[length] = first + copies * times
            offset += length * copies
        bins += times
    places.sort()
    shared = spark.sparkContext.broadcast(np.array(places, dtype=np.int64).reshape(-1, 5))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        row = table[np.searchsorted(keys, length.to_numpy() * (1 << 48) + rank.to_numpy(), side="right") - 1]
        nth = rank.to_numpy() - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + nth // row[:, 2], "offset": row[:, 4] + nth % row[:, 2] * row[:, 0]})

    salts = sum(histogram.values()) // RANKED + 1
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("length").alias("_length"), F.col("_salt").alias("_of"), (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1
    ranked = salted.withColumn("_nth", nth).join(before, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_of")))
    placed = ranked.withColumn("_place", place.asNondeterministic()("length", F.col("_before") + F.col("_nth")))
    return placed.select(*columns, "_place.sequence_id", "_place.offset")


def report(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of the packed texts of `docs`: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows and rows with a null doc_id are documents of their own; an empty table gives no pieces.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, doc_ids and ids, at most `capacity` ids in each."""
    packed = pack(pieces(docs, tokenizer, capacity, with_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return grouped.select("sequence_id", F.size(ids).alias("n_tokens"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), ids.alias("ids"))
