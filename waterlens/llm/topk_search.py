"""Exact top-k inner-product search: a ball tree per shard, branch and bound, the current kth score shared.

Candidates are dealt to shards and queries to blocks, both of bounded size; each (shard, block) pair meets in one
cogrouped task. Every block first meets one shard alone; the kth scores found there are lower bounds that go with the
queries to all other shards, whose trees prune by them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

K = 20
SCALE = 64
#: Vectors of a shard and queries of a block, in expectation.
SHARD = 16_384
BLOCK = 8_192
LEAF = 512
#: Norms up to which inner products are exact in doubles, so that a tree may be used.
FINE = 2.0**26
FOUND = "query_id long, variant long, vec_id long, score long"
_NO_BOUND = -(1 << 63)


class BallTree:
    """Rows split at the median of their widest direction; a node knows its centre, radius and rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.ids, self.rows = ids, rows
        self.nodes: list[tuple[np.ndarray, float, np.ndarray | None, int, int]] = []
        if len(ids):
            self._grow(np.arange(len(ids)), leaf)

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        points = self.rows[members]
        centre = points.mean(axis=0)
        offset = points - centre
        radius = math.sqrt(float((offset * offset).sum(axis=1).max()))
        at = len(self.nodes)
        self.nodes.append((centre, radius, members, -1, -1))
        if len(members) > leaf and radius > 0:
            far = offset[np.argmax((offset * offset).sum(axis=1))]
            order = np.argsort(offset @ far, kind="stable")
            half = len(members) // 2
            left, right = self._grow(members[order[:half]], leaf), self._grow(members[order[half:]], leaf)
            self.nodes[at] = centre, radius, None, left, right
        return at

    def search(self, own: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int):
        """(query row, vec_id, score) of rows that can be among each query's k best, given lower bounds of its kth."""
        kth = kth.astype(np.float64).copy()
        best = [np.empty(0, dtype=np.int64) for _ in range(3)]
        norms = np.sqrt((queries * queries).sum(axis=1))
        slack = 1e-9 * (1 + norms)
        if not self.nodes or not len(queries):
            return best

        def bound(node, rows):
            centre, radius = self.nodes[node][:2]
            reach = queries[rows] @ centre + norms[rows] * radius
            return reach + slack[rows] * (1 + np.abs(reach))

        every = np.arange(len(queries))
        heap = [(-float(bound(0, every).max()), 0, every)]
        while heap:
            _, node, rows = heapq.heappop(heap)
            rows = rows[bound(node, rows) >= kth[rows]]
            if not len(rows):
                continue
            _, _, members, left, right = self.nodes[node]
            if members is None:
                for child in (left, right):
                    upper = bound(child, rows)
                    heapq.heappush(heap, (-float(upper.max()), child, rows))
                continue
            for part in range(0, len(members), LEAF):
                some = members[part : part + LEAF]
                scores = queries[rows] @ self.rows[some].T
                a, b = np.nonzero((scores >= kth[rows][:, None]) & (self.ids[some][None, :] != own[rows][:, None]))
                if len(a):
                    best = top([np.concatenate((x, y)) for x, y in zip(best, (rows[a], self.ids[some][b], scores[a, b].astype(np.int64)), strict=True)], k)
                    full = np.flatnonzero(np.bincount(best[0], minlength=len(queries)) >= k)
                    if len(full):
                        last = np.searchsorted(best[0], full, side="right") - 1
                        kth[full] = np.maximum(kth[full], best[2][last])
        return best


def top(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each query: higher scores, then smaller ids; sorted so."""
    query, ids, score = found
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return [query[keep], ids[keep], score[keep]]


def quantised(embedding: Column) -> Column:
    """floor(64 * x) of each component, whole numbers as doubles; null for a vector that takes no part: a null one, or one
    with a null or non-finite component."""
    scaled = F.transform(embedding, lambda x: x.cast("double") * SCALE)  # doubles from 2^53 on are whole as they are
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(embedding.isNotNull() & fine, whole)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _exact_top(own: int, query: np.ndarray, ids: np.ndarray, rows: np.ndarray, kth: int, k: int) -> list[tuple[int, int]]:
    """(-score, vec_id) of a query's k best rows, in Python integers."""
    if not (np.isfinite(query).all() and np.isfinite(rows).all()):
        raise OverflowError("a component passes the range of doubles when quantised")
    whole = [int(x) for x in query]
    scored = ((-sum(a * int(b) for a, b in zip(whole, row, strict=True)), int(vec)) for vec, row in zip(ids, rows, strict=True) if vec != own)
    best = heapq.nsmallest(k, (s for s in scored if -s[0] >= kth))
    if any(not -(1 << 63) <= -score < 1 << 63 for score, _ in best):
        raise OverflowError("a score passes a long")
    return best


def _search(k: int):
    def task(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "variant": [], "vec_id": [], "score": []}, dtype="int64")
        own, ids = queries["vec_id"].to_numpy(np.int64), vectors["vec_id"].to_numpy(np.int64)
        q, v = _matrix(queries["v"]), _matrix(vectors["v"])
        kth = queries["kth"].to_numpy(np.int64)
        with np.errstate(over="ignore"):
            fine_q, fine_v = (np.sqrt((m * m).sum(axis=1)) < FINE for m in (q, v))
        asked = np.flatnonzero(fine_q)
        at, found, score = BallTree(ids[fine_v], v[fine_v]).search(own[asked], q[asked], kth[asked], k)
        parts = [(asked[at], found, score)]
        for a in range(len(q)):  # doubles would round
            some = np.flatnonzero(~fine_v) if fine_q[a] else np.arange(len(v))
            if len(some):
                best = _exact_top(int(own[a]), q[a], ids[some], v[some], int(kth[a]), k)
                parts.append((np.full(len(best), a), np.array([i for _, i in best], dtype=np.int64), np.array([-s for s, _ in best], dtype=np.int64)))
        at, found, score = (np.concatenate([p[n] for p in parts]).astype(np.int64) for n in range(3))
        if len(parts) > 1:
            at, found, score = top([at, found, score], k)
        return pd.DataFrame({"query_id": own[at], "variant": queries["variant"].to_numpy(np.int64)[at], "vec_id": found, "score": score})

    return task


def search(vectors: DataFrame, k: int = K, every: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, its k best other rows.

    Scores are inner products of quantised vectors, ties go to the smaller vec_id. Null vectors, vectors with a null or
    non-finite component and rows with a null vec_id take no part; a vector meets only those of its own length; repeated
    vec_ids as candidates count once per row, and a query's own id is none of its candidates. Different vectors of one
    vec_id are queries of their own, equal ones a single one. Large components are multiplied as integers; an
    OverflowError says that a score among the k best passes a long. Empty tables give no rows.
    """
    rows = vectors.select("vec_id", quantised(F.col("embedding")).alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0)).withColumn("dim", F.size("v"))
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    shards, blocks = -(-sizes["n"] // shard) or 1, -(-sizes["q"] // block) or 1
    spread = F.xxhash64("vec_id", F.lit("shard"))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("variant", F.xxhash64("v")).dropDuplicates(["vec_id", "v"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int"))
    candidates = rows.withColumn("shard", F.pmod(spread, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(asked: DataFrame, given: DataFrame) -> DataFrame:
        given = given.select(*[F.col(c).alias(c) for c in ("vec_id", "v", "dim", "block", "shard")])  # columns of its own: both sides stem from one table
        asked = asked.select(*[F.col(c).alias(c) for c in ("vec_id", "variant", "v", "dim", "block", "shard", "kth")])
        return asked.groupBy("dim", "block", "shard").cogroup(given.groupBy("dim", "block", "shard")).applyInPandas(_search(k), FOUND)

    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    first = queries.withColumn("shard", home).withColumn("kth", F.lit(_NO_BOUND).cast("long"))
    found = cut(meet(first, candidates.where(F.col("shard") == home)))
    if shards > 1:
        bounds = found.groupBy("query_id", "variant").agg(F.when(F.count("*") >= k, F.min("score")).alias("_kth"))
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home)
        again = queries.join(bounds.withColumnRenamed("variant", "_of"), (F.col("vec_id") == F.col("query_id")) & (F.col("variant") == F.col("_of")), "left")
        again = again.withColumn("kth", F.coalesce("_kth", F.lit(_NO_BOUND).cast("long"))).withColumn("shard", F.explode(others))
        found = found.union(meet(again, candidates.where(F.col("shard") != home)))
    best = found.groupBy("query_id", "variant").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))


def report(embeddings: DataFrame) -> DataFrame:
    """The 20 best of every query row, as `search` defines them."""
    return search(embeddings)
