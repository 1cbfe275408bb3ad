"""Vector code compression: product codes of integer vectors, the nearest codebook entries found by VA-file filtering.

A VA-file keeps, for every entry of a codebook, the cell of each coordinate in a few bits. A vector part makes one look-up
table for each coordinate, of its least and largest squared distance to every cell; sums of these bound the distance to an
entry from below and above. Entries whose lower bound is above the least upper bound cannot be the nearest; the others are
refined with exact integer distances, and ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a coordinate's cell, and rows of a batch that are bounded and refined at once.
CELL_BITS, SLICE_ROWS = 3, 2048
#: Integer components below this size keep every squared distance of up to 512 components within 64 bits.
LARGEST = 1 << 26
#: Labels whose sums are broadcast; past it they are joined by a shuffle, each label's rows dealt to SALTS tasks.
BROADCAST_LABELS, SALTS = 100_000, 16


@dataclass(frozen=True)
class Codebook:
    """The entries of one part position, and their VA-file: lower and upper marks of each coordinate's cells, and cells."""

    entries: np.ndarray  # (entries, width)
    low: np.ndarray  # (width, cells)
    high: np.ndarray
    cells: np.ndarray  # (entries, width)

    @classmethod
    def of(cls, entries: np.ndarray, bits: int = CELL_BITS) -> Codebook:
        count = 1 << bits
        least, most = entries.min(axis=0), entries.max(axis=0)
        step = (most - least) // count + 1
        cells = (entries - least) // step
        low = least[:, None] + step[:, None] * np.arange(count)
        return cls(entries, low, low + step[:, None] - 1, cells)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row of `x` the index of the nearest entry, the lower one of a tie, and its squared distance."""
        index, best = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
        for a in range(0, len(x), SLICE_ROWS):
            some = x[a : a + SLICE_ROWS]
            index[a : a + SLICE_ROWS], best[a : a + SLICE_ROWS] = self._nearest(some)
        return index, best

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Which entries the bounds leave for each row: a superset of its nearest ones."""
        below, above = self.low[None] - x[:, :, None], x[:, :, None] - self.high[None]
        near = np.maximum(np.maximum(below, above), 0) ** 2  # (rows, width, cells)
        far = np.maximum(self.high[None] - x[:, :, None], x[:, :, None] - self.low[None]) ** 2
        lower, upper = np.zeros((len(x), len(self.entries)), dtype=np.int64), np.zeros((len(x), len(self.entries)), dtype=np.int64)
        for k in range(x.shape[1]):
            lower += near[:, k, self.cells[:, k]]
            upper += far[:, k, self.cells[:, k]]
        return lower <= upper.min(axis=1, keepdims=True)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, entry = np.nonzero(self.candidates(x))
        exact = np.full((len(x), len(self.entries)), np.iinfo(np.int64).max)
        exact[row, entry] = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        index = exact.argmin(axis=1)
        return index, exact[np.arange(len(x)), index]


def _packed(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the integer components as little-endian 32-bit integers, of the vectors that take part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).cast(pa.list_(pa.float64()))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls are NaN
            ends = np.cumsum(sizes)
            faults = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            keep = lists.is_valid().to_numpy(zero_copy_only=False) & (faults[ends] == faults[ends - sizes])
            q = np.floor(SCALE * np.where(np.isfinite(x), x, 0.0))
            if (np.abs(q) >= LARGEST)[np.repeat(keep, sizes)].any():
                raise ValueError(f"components of {LARGEST // SCALE} or more have no exact 64-bit distances")
            data = np.where(np.abs(q) < LARGEST, q, 0).astype("<i4").tobytes()
            blobs = [data[4 * (e - n) : 4 * e] for e, n, k in zip(ends.tolist(), sizes.tolist(), keep.tolist(), strict=True) if k]
            rows = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows).cast(pa.int64()), batch.column(1).take(rows).cast(pa.int64()), pa.array(blobs, type=pa.binary())], names=["vec_id", "label", "parts"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(pack, "vec_id long, label long, parts binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = b"".join(column.to_pylist()) if width else b""
    return np.frombuffer(flat, dtype="<i4").astype(np.int64).reshape(len(column), width) if flat else np.zeros((len(column), width), dtype=np.int64)


def _sums(packed: DataFrame, books: list[Codebook], width: int) -> DataFrame:
    """Per part, entry and position the sum and count of the components assigned to it: one small table from each task."""
    part_width = width // PARTS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, ENTRIES, part_width), dtype=np.int64)
        counts = np.zeros((PARTS, ENTRIES), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for p, book in enumerate(books):
                part = x[:, p * part_width : (p + 1) * part_width]
                index, _ = book.nearest(part)
                np.add.at(total[p], index, part)
                counts[p] += np.bincount(index, minlength=ENTRIES)
        p, e, k = np.indices(total.shape)
        used = np.broadcast_to((counts > 0)[:, :, None], total.shape).ravel()
        columns = (p, e, k, total, np.broadcast_to(counts[:, :, None], total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()[used].astype(np.int64)) for c in columns], names=["part", "entry", "position", "total", "n"])

    found = packed.select("parts").mapInArrow(sums, "part long, entry long, position long, total long, n long")
    return found.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _train(packed: DataFrame, seeds: np.ndarray, width: int, rounds: int) -> np.ndarray:
    """The codebooks (part, entry, position) after `rounds` passes over all vectors; the driver sees 16 x width sums a pass."""
    entries = seeds.reshape(len(seeds), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = [Codebook.of(part) for part in entries]
        for row in _sums(packed, books, width).collect():
            entries[row["part"], row["entry"], row["position"]] = row["total"] // row["n"]
    return entries


def _codes(packed: DataFrame, entries: np.ndarray, width: int) -> DataFrame:
    part_width = width // PARTS
    books = [Codebook.of(part) for part in entries] if part_width else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), width)
            index, error = np.zeros((len(x), PARTS), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
            for p, book in enumerate(books):
                index[:, p], best = book.nearest(x[:, p * part_width : (p + 1) * part_width])
                error += best
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in index], type=pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return packed.mapInArrow(encode, "vec_id long, label long, code binary, error long")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, one byte a part, and the codebooks (part, entry, position).

    `vectors` has vec_id, embedding and label; other columns are ignored. Every component becomes floor(4096 * x). A
    vector that is null or holds a null or non-finite component takes no part. All vectors have the length of the one
    with the smallest vec_id (null ids last, equal ids by their components); those of another length, and all if it is
    no multiple of 8, take no part either. Repeated rows count and are returned each. Codebooks start from the 16
    smallest vec_ids, or all if fewer, and an empty table has none. The integer vectors are written once to the shared
    folder, so the passes read only what they need and a lost executor's share is read again.

    Returns vec_id, label, code (binary), error (squared distances summed over parts).
    """
    packed = written(_packed(vectors), "vectors")
    order = (F.col("vec_id").asc_nulls_last(), "parts")
    first = packed.orderBy(*order).limit(1).collect()
    width = len(first[0]["parts"]) // 4 if first else 0
    kept = packed.where(F.length("parts") == 4 * width) if width % PARTS == 0 else packed.where(F.lit(False))
    seeds = kept.orderBy(*order).limit(ENTRIES).select("parts").collect()
    if not seeds:
        return _codes(kept, np.zeros((PARTS, 0, 0), dtype=np.int64), 0), np.zeros((PARTS, 0, 0), dtype=np.int64)
    start = _matrix(pa.array([bytes(r["parts"]) for r in seeds], type=pa.binary()), width)
    entries = _train(kept, start, width, rounds if width else 0)
    return _codes(kept, entries, width), entries


def codebooks_sha256(entries: np.ndarray) -> str:
    """Of the decimal components of all entries by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """`codes` with label_error, the errors summed over the rows of equal labels; null labels are one label.

    Sums are combined before they are shuffled. They are broadcast up to a checked number of labels; beyond it each
    label's rows are dealt to several tasks.
    """
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= BROADCAST_LABELS:
        return codes.join(F.broadcast(sums), same).drop("_label")
    salted = codes.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    copies = sums.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, same & (F.col("_salt") == F.col("_copy"))).drop("_label", "_salt", "_copy")


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256 of every vector that takes part."""
    codes, entries = compress(vectors)
    return with_label_error(written(codes, "codes")).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_sha256(entries)).alias("codebooks_sha256"),
    )
