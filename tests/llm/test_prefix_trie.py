"""The trie of rebuilt conversations against plain loops, with small blocks, chunks and hot names."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from waterlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, name long, depth long, at long"


def plain(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        host = c - (c % 100 if c >= 0 else -(-c % 100))
        made[c] = own.get(host, [])[:h] + own[c][h:]
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in kids[k])
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(nodes[k]) if len(made[c]) == len(k)).encode()).hexdigest()
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1000, len(m), len(kids[k]), leaves[k], saved[k], sha(k)) for k, m in nodes.items())


def found(spark, rows):
    given = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    return sorted((r[0], r[1], -1000 if r[2] is None else r[2], *r[3:]) for r in prefix_trie.report(given).collect())


def odd_rows():
    rng = random.Random(2)
    some = [(c, rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice([None, "user", "a"]), rng.choice([None, "", "x", "yé😀"])) for c in [*range(-110, 120, 3), None, 100, 100] for _ in range(rng.randint(1, 9))]
    long = [(300, k % 50, "u", f"t{k % 3}") for k in range(70)]
    return some + long + [(301 + k, j, "u", "same") for k in range(30) for j in range(7)]


@pytest.mark.parametrize(("block", "chunk", "hot"), [(4, 3, 5), (1024, 4096, 500)])
def test_nodes_equal_a_loop(spark, monkeypatch, block, chunk, hot):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "HOT_ROWS", hot)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = odd_rows()
    assert found(spark, rows) == plain(rows)


def test_nodes_of_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "lost")]) == []
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    short = [(lone, 1, "user", "a")]  # its head is longer than it is, and its host is not there: no turns
    assert found(spark, short) == plain(short) and len(plain(short)) == 1
