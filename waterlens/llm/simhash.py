"""SimHash near-duplicates: 64-bit fingerprints, BK-tree search within shards, components by star contraction.

`report` links 64-bit fingerprints of 3-word shingles at radius 2: these agree in at least two of four 16-bit blocks, so each distinct fingerprint goes to the six
shards of its block pairs and every link is found inside a shard. A shard's BK-tree is built and searched in the task
that holds the shard: the trees of all documents have no size bound, so they are dealt by key and not broadcast.
A shard returns the star forest of its links (one edge per member), never all pairs.

`deduplicate` links texts whose sets of 5-word shingles have a Jaccard similarity of 0.8. Its shards are keys of several
min-hashes, whose recall does not depend on the number of rows; pairs that meet there and agree in enough bits of their
sketches are candidates, and every candidate is verified on the shingles of both texts unless a chain of links joins the
two already or a bound proves it dissimilar. An exhaustive search lets every pair of texts meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waterlens.operators.graph import components

from .common import cut, written

RADIUS = 2
SHINGLE = 3
SEED = 42
_BLOCK = 16
#: Fingerprints of a shard up to which each is sought in the tree of those before it; past it all descend together.
TOGETHER = 64
#: For `deduplicate`: tables of keys, min-hashes of a key, bits of a sketch (one of each min-hash).
TABLES = 20
KEY = 6
BITS = 128
_CHUNK = 1 << 16
#: Partners of a row that the first search verifies; each further one takes MORE times as many, up to MOST.
NEAREST, MORE, MOST = 8, 4, 128
#: Places of a shingle set's parities, a power of two.
PLACES = 1024
#: Rows of a block: those of a larger key are dealt to blocks, and each two blocks meet. Ids that are broadcast.
WINDOW = 8_192
BROADCAST_IDS = 1_000_000
#: While leaders lead this part of what is left, one in _MANY, the next one is the middle of the rest.
_MANY = 16


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _shingles(tokens: list[bytes], size: int) -> Iterator[bytes]:
    if len(tokens) < size:
        return iter([b" ".join(tokens)] if tokens else [])
    return map(b" ".join, zip(*(tokens[k:] for k in range(size)), strict=False))


def _majority(digests: list[bytes]) -> bytes:
    """The bits that more than half of the digests set, most significant first."""
    bits = 8 * len(digests[0])
    ones = np.zeros(bits, dtype=np.int64)
    for k in range(0, len(digests), _CHUNK):
        part = digests[k : k + _CHUNK]
        ones += np.unpackbits(np.frombuffer(b"".join(part), dtype=np.uint8)).reshape(len(part), bits).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(digests)).tobytes()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned; zero without words."""
    digests = [xxhash.xxh64_digest(run, SEED) for run in _shingles(_words(text), shingle)]
    return int.from_bytes(_majority(digests), "big") if digests else 0


_DRAW = np.random.default_rng(SEED)
_FACTORS = _DRAW.integers(0, 1 << 64, BITS, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _DRAW.integers(0, 1 << 64, BITS, dtype=np.uint64)


def _set_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(run, SEED) for run in set(_shingles(_words(text), shingle))], dtype=np.uint64))


def set_name(hashes: np.ndarray) -> int:
    """A name of a shingle set, signed; zero for the empty one."""
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes(), SEED), "big", signed=True) if len(hashes) else 0


def sketch(hashes: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Both halves of a shingle set's sketch and its keys, signed: a key of a table is a hash of KEY min-hashes, a bit of
    the sketch one bit of a min-hash. Zeros and no keys for the empty set."""
    if not len(hashes):
        return 0, 0, np.empty(0, dtype=np.int64)
    least = np.full(BITS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), _CHUNK // BITS):
        least = np.minimum(least, (hashes[None, k : k + _CHUNK // BITS] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1))
    hi, lo = np.packbits(((least >> np.uint64(7)) & np.uint64(1)).astype(np.uint8)).view(np.int64).tolist()
    runs = [least[KEY * t : KEY * (t + 1)].tobytes() for t in range(TABLES)]
    return hi, lo, np.array([xxhash.xxh3_64_intdigest(run, t) for t, run in enumerate(runs)], dtype=np.uint64).view(np.int64)


def parities(hashes: np.ndarray) -> bytes:
    """Whether an odd number of a set's hashes falls on each of PLACES places. Those of two sets differ in no more places
    than the sets do in elements."""
    return np.packbits((np.bincount((hashes & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES) & 1).astype(np.uint8)).tobytes()


def _named_sets(shingle: int):
    """A task over (id, text): id, size, parities and sorted shingle hashes of the texts whose shingle set it names."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, sizes, odd = [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = _set_hashes(text, shingle)
                if set_name(hashes) == name:  # doc_ids may repeat with other texts
                    ids.append(name)
                    sizes.append(len(hashes))
                    odd.append(parities(hashes))
                    sets.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in ((ids, pa.int64()), (sizes, pa.int64()), (odd, pa.binary()), (sets, pa.binary()))], names=["id", "size", "parities", "hashes"])

    return task


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


class BKTree:
    """Values by Hamming distance: a node's children are keyed by their distance to it, and a search follows only edges
    whose distance differs from its own by no more than the radius."""

    def __init__(self, values: Iterable[int] = ()):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for value in values:
            self.insert(value)

    def insert(self, value: int) -> None:
        node = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at < node:
            d = (self.values[at] ^ value).bit_count()
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = node
                return
            at = child

    def near(self, value: int, radius: int) -> Iterator[int]:
        """The nodes within the radius of one value."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            if self.children[at]:
                stack += [child for edge, child in self.children[at].items() if -radius <= distance - edge <= radius]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the 64-bit queries within the radius). All queries descend together, each along its own
        edges."""
        stack = [(0, np.arange(len(queries)))] if self.values else []
        while stack:
            at, rows = stack.pop()
            distance = np.bitwise_count(queries[rows] ^ np.uint64(self.values[at])).astype(np.int64)
            near = rows[distance <= radius]
            if len(near):
                yield at, near
            for edge, child in self.children[at].items():
                follow = rows[np.abs(distance - edge) <= radius]
                if len(follow):
                    stack.append((child, follow))


def _close_pairs(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Positions (later, earlier) of values within the radius: each is sought in the tree of those before it."""
    if len(values) <= TOGETHER:
        tree = BKTree()
        for k, value in enumerate(values):
            for node in tree.near(value, radius):
                yield k, node
            tree.insert(value)
        return
    for node, near in BKTree(values).within(np.array(values, dtype=np.uint64), radius):
        for k in near[near > node].tolist():
            yield k, node


def star_forest(values: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Edges (position of a member, of the least member) of the components that links within the radius make."""
    parent = list(range(len(values)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in _close_pairs(values, radius):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    for k in range(len(values)):
        if (top := root(k)) != k:
            yield k, top


def _shards(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where shards of more than one row start and end."""
    edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    many = np.flatnonzero(np.diff(edges) > 1)
    return zip(edges[many].tolist(), edges[many + 1].tolist(), strict=True)


def _whole(rows: np.ndarray) -> list[int]:
    """The words of each row as one unsigned integer."""
    words = np.ascontiguousarray(rows).view(np.uint64).tolist()
    return [w[0] if len(w) == 1 else w[0] << 64 | w[1] for w in words]


def _longs(column: pa.Array) -> np.ndarray:
    """A column of longs, or the longs of each row of a column of as many bytes each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(len(column), -1) if pa.types.is_binary(column.type) else column.to_numpy()


def _whole_shards(work):
    """A task over rows (key, ...) sorted by key that gives whole shards to `work`, as keys and the other columns."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = np.empty(0, dtype=np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.column_stack([_longs(batch.column(k)) for k in range(1, batch.num_columns)])
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            rows = more if rows is None else np.concatenate((rows, more))
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if whole:
                yield from work(keys[:whole], rows[:whole])
                keys, rows = keys[whole:], rows[whole:]
        if len(keys):
            yield from work(keys, rows)

    return task


def _shard_edges(radius: int):
    """A task over rows (key, id, fingerprint) sorted by key: the star forest of each shard, by its BK-tree."""

    def edges(keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        for start, end in _shards(keys):
            forest = list(star_forest(_whole(rows[start:end, 1:]), radius))
            if forest:
                found.append(rows[start:end][np.array(forest, dtype=np.int64), 0])
        out = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, k])) for k in (0, 1)], names=["u", "v"])

    return _whole_shards(edges)


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (u, v), u the member and v its shard's least member, that connect all `fp` within radius 2."""
    blocks = [F.shiftrightunsigned("fp", _BLOCK * k).bitwiseAND(F.lit((1 << _BLOCK) - 1)) for k in range(64 // _BLOCK)]
    pairs = F.array(*[
        F.shiftleft(F.lit(n).cast("long"), 2 * _BLOCK) + F.shiftleft(blocks[a], _BLOCK) + blocks[b]
        for n, (a, b) in enumerate(combinations(range(64 // _BLOCK), 2))
    ])
    shards = fingerprints.select(F.explode(pairs).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    return shards.select("key", F.col("fp").alias("id"), "fp").mapInArrow(_shard_edges(RADIUS), "u long, v long")


def radius_of(similarity: float, bits: int = BITS) -> int:
    """Differing bits that the sketches of a pair of this Jaccard similarity have at most, with 4 standard deviations to
    spare (what that lets through is verified): a bit differs with half the chance that the min-hashes do."""
    share = (1 - similarity) / 2
    return math.ceil(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array(column, type=pa.int64()) for name, column in columns.items()})


def _middle(words: np.ndarray) -> int:
    """The row closest to the majority of all rows' bits: in a group of copies, what they are copies of."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1)
    return int(np.argmin((bits != (bits.sum(axis=0, dtype=np.int64) * 2 > len(words))).sum(axis=1)))


def _distances(words: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words ^ one).sum(axis=1, dtype=np.int64)


def _led(words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its leader (-1 for none) and their distance.

    The first leader is the middle row, the next the middle of what is left while leaders lead many, else the first row
    left. Rows within the radius of a leader follow it.
    """
    leader, far = np.full(len(words), -1), np.zeros(len(words), dtype=np.int64)
    left, many = np.arange(len(words)), True
    while len(left) > 1:
        lead = left[_middle(words[left])] if many else left[0]
        distance = _distances(words[left], words[lead])
        follow = (distance <= radius) & (left != lead)
        leader[left[follow]], far[left[follow]] = lead, distance[follow]
        many = bool(follow.sum() * _MANY >= len(left))
        left = left[~follow & (left != lead)]
    return leader, far


def _first_meetings(radius: int):
    """A task over rows (key, id, words of the sketch) sorted by key: key and id of the rows of shards of more than one, each
    with its leader (v, or its own id) and their distance."""

    def work(keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        for start, end in _shards(keys):
            part = rows[start:end]
            leader, far = _led(np.ascontiguousarray(part[:, 1:]).view(np.uint64), radius)
            follows = np.where(leader >= 0, part[leader, 0], part[:, 0])
            found.append(np.column_stack((keys[start:end], part[:, 0], follows, far)))
        out = np.concatenate(found) if found else np.empty((0, 4), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, k])) for k in range(4)], names=["key", "id", "v", "distance"])

    return _whole_shards(work)


def _unlike_pairs(radius: int, most: int, similarity: float):
    """A task over rows (key, id, label, tried, past distance, past id, words of the sketch, size, parities) sorted by key:
    pairs (u, v, distance) within the radius whose labels differ.

    A row gives its `most` closest ones after (past distance, past id) but that which it was `tried` with; equal distances by
    id. Pairs whose sizes or parities prove them less similar are left out: sets of this Jaccard similarity differ in at
    most (1 - similarity) / (1 + similarity) of the sum of their sizes. Small shards are searched in their BK-tree; in others
    the rows of a label are compared with all rows of other labels: at this radius a large tree leaves out little.
    """
    share = (1 - similarity) / (1 + similarity)

    def work(keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v, distance = [], [], []
        for start, end in _shards(keys):
            part = rows[start:end]
            labels, group = np.unique(part[:, 1], return_inverse=True)
            if len(labels) < 2:
                continue
            ids, sizes = part[:, 0], part[:, 7]
            words, odd = (np.ascontiguousarray(part[:, k]).view(np.uint64) for k in (slice(5, 7), slice(8, None)))
            values = _whole(words) if len(part) <= TOGETHER else []
            tree = BKTree(values) if values else None
            for label in range(len(labels)):
                others = np.flatnonzero(group != label)
                theirs = words[others]
                for k in np.flatnonzero(group == label).tolist():
                    _, _, tried, past, past_id = part[k, :5].tolist()
                    if tree is None:
                        far = _distances(theirs, words[k])
                        near = np.flatnonzero(far <= radius)
                        at, far = others[near], far[near]
                    else:
                        at = np.array([n for n in tree.near(values[k], radius) if group[n] != label], dtype=np.int64)
                        far = _distances(words[at], words[k])
                    keep = (ids[at] != tried) & ((far > past) | ((far == past) & (ids[at] > past_id)))
                    at, far = at[keep], far[keep]
                    differ = np.maximum(np.abs(sizes[at] - sizes[k]), _distances(odd[at], odd[k]))
                    keep = differ <= (sizes[at] + sizes[k]) * share + 1e-6
                    at, far = at[keep], far[keep]
                    first = np.lexsort((ids[at], far))[:most]
                    u += [int(ids[k])] * len(first)
                    v += ids[at[first]].tolist()
                    distance += far[first].tolist()
        yield _batch({"u": u, "v": v, "distance": distance})

    return _whole_shards(work)


def jaccard(left: np.ndarray, right: np.ndarray) -> float:
    """Of two sorted sets of shingle hashes; 1 for two empty ones."""
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both / (len(left) + len(right) - both) if len(left) or len(right) else 1.0


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (u, v) whose shingle sets (id, hashes: sorted 64-bit integers) have at least this Jaccard similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda scalar: np.frombuffer(scalar.as_py(), dtype=np.uint64)
        for batch in batches:
            keep = [jaccard(of(a), of(b)) >= similarity for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    side = lambda key, name: sets.select(F.col("id").alias(key), F.col("hashes").alias(name))
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return both.join(side("u", "left"), "u").join(side("v", "right"), "v").select("u", "v", "left", "right").mapInArrow(check, "u long, v long")


def dealt(rows: DataFrame) -> DataFrame:
    """(key, id, hi, lo) of the rows of each key that several have. The rows of a key of more than WINDOW are dealt to blocks by
    a hash, and each goes to a key for its block with every block, so any two of them still meet."""
    counts = rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("_key"), F.ceil(F.col("count") / WINDOW).alias("blocks"))
    met = rows.join(counts, F.col("key") == F.col("_key")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return met.select(F.when(F.col("blocks") > 1, both).otherwise(F.col("key")).alias("key"), "id", "hi", "lo")


def similar_labels(classes: DataFrame, docs: DataFrame, similarity: float, shingle: int, exhaustive: bool = False) -> DataFrame:
    """(id, label) of the ids of `classes` (id, first_id, hi, lo, keys) that meet others: the component of verified links.

    Rows that share a key meet; what meets no other row is left out from then on, and the shingle sets of the rest are made
    once. In a first pass each row is verified with the closest of its leaders in all shards. In each further pass every
    row takes its closest partners of other components that it has not come to yet, NEAREST first and more from pass to
    pass, until no row has a partner left: no candidate is dropped. If `exhaustive`, all rows share one key, and a pair is
    left out only where its sizes or parities prove it dissimilar, so no link is lost; the work grows with the square of
    the rows.
    """
    radius = radius_of(similarity)
    pairs = "u long, v long, distance long"
    rows = classes.where("size(keys) > 0").select("id", "hi", "lo", F.lit(0).cast("long").alias("key") if exhaustive else F.explode("keys").alias("key"))
    shards = dealt(rows).repartition("key").sortWithinPartitions("key", "id").select("key", "id", "hi", "lo")
    met = written(shards.mapInArrow(_first_meetings(radius), "key long, id long, v long, distance long"), "met")

    wanted = written(met.select("id").distinct().join(classes.select("id", "first_id", "hi", "lo"), "id").select("id", "first_id", "hi", "lo"), "wanted")
    by_id = wanted.select("id", "first_id")
    by_id = F.broadcast(by_id) if wanted.count() <= BROADCAST_IDS else by_id
    found = docs.select("doc_id", "text").join(by_id, F.col("doc_id") == F.col("first_id")).select("id", "text")
    named = found.mapInArrow(_named_sets(shingle), "id long, size long, parities binary, hashes binary")
    sets = written(named.groupBy("id").agg(*[F.first(c).alias(c) for c in ("size", "parities", "hashes")]), "sets")
    sides = written(wanted.select("id", "hi", "lo").join(sets.select("id", "size", "parities"), "id"), "sides")

    first = written(met.where("v <> id").groupBy("id").agg(F.min_by("v", F.struct("distance", "v")).alias("v")).select(F.col("id").alias("u"), "v"), "asked")
    label = components(verified(first, sets, similarity)).select(F.col("u").alias("id"), F.col("v").alias("label"))
    tried = first.select(F.col("u").alias("id"), F.col("v").alias("tried"))
    whole = lambda name, other: F.coalesce(name, other).cast("long").alias(name)
    state = wanted.select("id").join(label, "id", "left").join(tried, "id", "left").select("id", whole("label", "id"), whole("tried", "id"), F.lit(-1).cast("long").alias("past"), F.lit(0).cast("long").alias("past_id"))
    met, most = met.select("key", "id"), NEAREST
    while True:
        state = written(state, "state")  # past, past_id: how far each row has come
        labels = met.join(state.select("id", "label"), "id").groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("last"))
        met = written(met.join(labels.where("least <> last").select("key"), "key"), "met")  # shards of one label have nothing left
        shards = met.join(state, "id").join(sides, "id").repartition("key").sortWithinPartitions("key", "id")
        shards = shards.select("key", "id", "label", "tried", "past", "past_id", "hi", "lo", "size", "parities")
        offered = shards.mapInArrow(_unlike_pairs(BITS if exhaustive else radius, most, similarity), pairs).distinct()
        place = F.row_number().over(Window.partitionBy("u").orderBy("distance", "v"))  # TABLES x most of a row and block at most
        asked = written(offered.withColumn("place", place).where(F.col("place") <= most), "asked")
        if asked.isEmpty():
            return state.select("id", "label")
        came = asked.groupBy(F.col("u").alias("id")).agg(F.max(F.struct("distance", "v")).alias("to")).select("id", "to.distance", "to.v")
        more = written(verified(asked, sets, similarity), "edges")
        now = state.withColumn("least", F.lit(None).cast("long"))
        if not more.isEmpty():
            of = lambda end: state.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
            between = more.join(of("u"), "u").join(of("v"), "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
            now = state.join(components(between).select(F.col("u").alias("label"), F.col("v").alias("least")), "label", "left")
        state = now.join(came, "id", "left").select("id", whole("least", "label").alias("label"), "tried", whole("distance", "past").alias("past"), whole("v", "past_id").alias("past_id"))
        most = min(MORE * most, MOST)


def report(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, fp (long), fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most two differing bits. Null and empty texts have
    fingerprint zero and link like any other; rows with a null doc_id take part in links but never name a component (it
    is null if no row of the component has an id). Repeated rows each give a row; an empty table gives none.
    """
    of = F.pandas_udf(_fingerprints, "long").asNondeterministic()
    prints = cut(docs.select("doc_id", of("text").alias("fp")))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(classes))
    member = found.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(found.select("v", "v").distinct())
    named = member.join(classes, "fp")
    roots = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = named.join(roots, "root").select("fp", "least_id")
    classes = classes.join(named, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("least_id", "first_id").alias("component_id"))
    out = prints.join(classes, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, exhaustive: bool = False) -> DataFrame:
    """(doc_id, group_id) of every distinct non-null doc_id: the smallest doc_id that links of at least this Jaccard
    similarity of word shingles reach. Texts of equal shingles always link, null and empty ones among themselves.
    `exhaustive` as in `similar_labels`."""

    def prints_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                hashes = _set_hashes(text, shingle)
                rows.append((set_name(hashes), *sketch(hashes)))
            yield pd.DataFrame(rows, columns=["id", "hi", "lo", "keys"])

    of = F.pandas_udf(prints_of, "id long, hi long, lo long, keys array<long>").asNondeterministic()
    docs = docs.where("doc_id IS NOT NULL")
    prints = written(docs.select("doc_id", of("text").alias("p")).select("doc_id", "p.*"), "prints")
    classes = written(prints.groupBy("id", "hi", "lo", "keys").agg(F.min("doc_id").alias("first_id")), "classes")
    found = similar_labels(classes, docs, similarity, shingle, exhaustive).select(F.col("id").alias("u"), "label")
    named = classes.join(found, F.col("id") == F.col("u"), "left").select("id", "first_id", F.coalesce("label", "id").alias("root"))
    roots = named.groupBy("root").agg(F.min("first_id").alias("group_id"))
    named = named.join(roots, "root").select("id", "group_id")
    return prints.select("doc_id", "id").join(named, "id").groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def deduplicate(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """`docs` with one row of each group of near duplicates: that of the smallest doc_id.

    All columns stay. Of several rows of that doc_id the one with the least hash of its doc_id and text stays. Rows with
    a null doc_id cannot be named, so they stay. Only the ids of what goes are joined with the rows.
    """
    groups = cut(similar_groups(docs, similarity, shingle))
    repeated = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")))
    losing = groups.where("doc_id <> group_id").select(F.col("doc_id").alias("_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept"), F.col("doc_id").alias("_doc"))
    rows = rows.join(losing, F.col("_doc") == F.col("_id"), "left_anti")
    if not repeated.isEmpty():
        named = F.col("_doc") == F.col("_id")
        one = rows.join(repeated, named, "left_semi").groupBy("_doc").agg(F.min_by("_kept", F.xxhash64(F.col("_kept.doc_id"), F.col("_kept.text"))).alias("_kept"))
        rows = rows.join(repeated, named, "left_anti").select("_kept").union(one.select("_kept"))
    return rows.select("_kept.*")
