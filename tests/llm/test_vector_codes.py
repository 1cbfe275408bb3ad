"""Vector codes against plain loops, and the bounds of the VA-file."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from waterlens.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def plain(rows):
    """(vec_id, code, error, label_error, sha) of rows (vec_id, vector, label) by loops over Python integers."""
    kept = [(v, [math.floor(4096 * float(np.float32(x))) for x in e], label) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], dtype="<i4").tobytes()))
    width = len(kept[0][1]) if kept else 0
    kept = [r for r in kept if len(r[1]) == width and width % 8 == 0]
    w = width // 8
    cut = [[q[p * w : (p + 1) * w] for p in range(8)] for _, q, _ in kept]
    books = [[parts[p] for parts in cut[:16]] for p in range(8)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            held = defaultdict(list)
            for parts in cut:
                held[nearest(p, parts[p])[1]].append(parts[p])
            for k, some in held.items():
                books[p][k] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found, sums = [], defaultdict(int)
    for (v, _, label), parts in zip(kept, cut, strict=True):
        best = [nearest(p, parts[p]) for p in range(8)]
        found.append((v, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        sums[label] += found[-1][2]
    return sorted((v, c, e, sums[label], sha) for v, c, e, label in found)


def rows_of(spark, rows):
    return spark.createDataFrame([(v, e, label, "x", 1) for v, e, label in rows], SCHEMA)


def found(df):
    return sorted(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in vector_codes.report(df).collect())


def test_codes_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(int(v), rng.normal(0, 1, 16).tolist(), None if v % 7 == 0 else int(v % 3)) for v in rng.permutation(120)]
    rows += [(500, None, 1), (501, [1.0] * 15 + [None], 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] + [0.0] * 15, None), (504, [0.5] * 8, 2), (505, [], 2)]
    rows += rows[:9] + [(900, rows[3][1], 1), (901, [-0.1] * 16, 1), (902, [0.0] * 16, 1)]
    assert found(rows_of(spark, rows)) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(3, None, 1)], [(3, [0.25] * 8, None)], [(3, [], 1), (4, [], None)], [(3, [1.0] * 9, 1)], [(k, [1.5] * 8, 1) for k in range(30)]])
def test_few_rows_and_ties(spark, rows):
    assert found(rows_of(spark, rows)) == plain(rows)


def test_labels_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(k, [k / 7, -k / 5] * 4, k % 5 or None) for k in range(60)]
    expected = found(rows_of(spark, rows))
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert found(rows_of(spark, rows)) == expected


@pytest.mark.parametrize("bits", [1, 4, 6])
def test_bounds_keep_every_nearest_entry(bits):
    rng = np.random.default_rng(bits)
    entries, x = rng.integers(-5000, 5000, (16, 8)), rng.integers(-6000, 6000, (3000, 8))
    book = vector_codes.Codebook.of(entries, bits)
    exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    kept = book.candidates(x)
    assert kept[exact == exact.min(axis=1, keepdims=True)].all()
    assert bits == 1 or kept.mean() < (0.5 if bits == 4 else 0.4)
    index, best = book.nearest(x)
    assert (index == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()


def test_components_without_exact_distances(spark):
    with pytest.raises(Exception, match="no exact 64-bit distances"):
        found(rows_of(spark, [(1, [1e30] * 8, 1)]))
