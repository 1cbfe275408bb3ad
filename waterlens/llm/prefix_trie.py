"""Conversation prefix trie by prefix-doubling naming.

Every turn gets a dense name, equal turns the same one. Blocks of two, four, eight ... turns at aligned places are named
from the pairs of names of their halves, one join round for each power of two. A prefix of d turns is the blocks of d's
binary decomposition, largest first: prefixes whose d has r bits set are named in round r from a named prefix of r - 1 bits
and the block that completes it. Two prefixes of equal length are equal exactly if their names are, so nodes are groups of
(depth, name). All rounds together name each turn and each prefix once, however long a conversation is.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, written

#: Conversations c share the head of conversation c - c % HOST, of fewer than HEADS turns.
HOST, HEADS = 100, 6
#: A name of at least HOT_ROWS rows, and of at least a HOT_NAMES-th of all rows, is joined by broadcast: HOT_NAMES at most.
HOT_ROWS, HOT_NAMES = 500, 100_000
#: Turns of a conversation that are summed in one window, and ids of one piece of text that is hashed.
BLOCK, CHUNK = 1024, 4096


def _part() -> Column:
    """The task that gave a row its place `at`."""
    return F.shiftright("at", 33)


@dataclass(frozen=True)
class Named:
    """The distinct keys of some rows with dense names from 0, and the rows of each (n); `most` is the largest n."""

    names: DataFrame
    keys: tuple[str, ...]
    rows: int
    most: int

    def attach(self, rows: DataFrame) -> DataFrame:
        """`rows` with their keys replaced by the name."""
        least = max(HOT_ROWS, self.rows // HOT_NAMES)
        return by_hot_keys(rows, self.names, list(self.keys), least, self.most).drop(*self.keys, "n")


def by_hot_keys(rows: DataFrame, facts: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """Inner join of `rows` with `facts` (keys, n rows of each, more): facts of `least` rows or more are broadcast, so no
    task of the shuffled rest gets more than that of one key. `most` is the largest n."""
    if most < least:
        return rows.join(facts, keys)
    hot = F.broadcast(facts.where(F.col("n") >= least))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(facts.where(F.col("n") < least), keys)
    return rows.join(hot, keys).unionByName(rest)


def dense_names(rows: DataFrame, *keys: str) -> Named:
    """Dense names of the distinct keys: each task numbers its own, and the counts of the tasks before it are added."""
    distinct = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    numbered = written(distinct.withColumn("at", F.monotonically_increasing_id()), "names")
    parts = sorted(numbered.groupBy(_part().alias("part")).agg(F.count("*"), F.sum("n"), F.max("n")).collect())  # one row a task
    before, starts = 0, []
    for part, count, _, _ in parts:
        starts.append((part, before))
        before += count
    bases = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, base long"))
    named = numbered.join(bases, _part() == F.col("part")).select(*keys, (F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("name"), "n")
    return Named(named, keys, sum(p[2] for p in parts), max((p[3] for p in parts), default=0))


def _turn_rows(conversations: DataFrame) -> DataFrame:
    """One row a turn in ascending (conv_id, turn) order over all partitions: conv_id, digest, chars, and its place `at`.

    Rows of a conversation may span tasks. Equal turns are ordered by their digest; rows equal in all have no order, and a
    number of their own spreads them over tasks.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"),
    )
    order = (F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "chars", F.monotonically_increasing_id().alias("at"))
    return written(placed, "turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (conv_id, depth from 1, digest, chars, last) and all conversations (conv_id,
    length, which may be 0)."""
    rows = _turn_rows(conversations)
    runs = rows.groupBy("conv_id", _part().alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    one = Window.partitionBy("conv_id")
    runs = runs.withColumns({
        "before": F.coalesce(F.sum("n").over(one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum("n").over(one), "host": F.col("conv_id") - F.col("conv_id") % HOST, "head": id_crc("conv_id") % HEADS,
    })
    hosts = runs.where((F.col("before") == 0) & (F.col("conv_id") % HOST == 0)).select(F.col("conv_id").alias("host"), F.col("total").alias("there"))
    runs = runs.join(hosts, "host", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    runs = written(runs.withColumn("length", F.col("taken") + F.greatest(F.col("total") - F.col("head"), F.lit(0))).drop("there"), "runs")
    convs = runs.where(F.col("before") == 0)
    placed = rows.withColumn("part", _part()).join(runs, ["conv_id", "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before"))
    own = placed.where(F.col("place") >= F.col("head")).withColumn("depth", F.col("place") - F.col("head") + F.col("taken") + 1)
    heads = placed.where((F.col("conv_id") % HOST == 0) & (F.col("place") < HEADS - 1)).select("host", (F.col("place") + 1).alias("depth"), "digest", "chars")
    shared = convs.join(heads, "host").where(F.col("depth") <= F.col("taken"))
    columns = ("conv_id", "depth", "digest", "chars", (F.col("depth") == F.col("length")).alias("last"))
    return own.select(*columns).unionByName(shared.select(*columns)), convs.select("conv_id", "length")


def _blocks(turns: DataFrame, longest: int) -> Iterator[DataFrame]:
    """Level by level the named blocks (conv_id, j, name) of 2^level turns from turn j * 2^level on."""
    named = dense_names(turns, "digest")
    level = written(named.attach(turns.select("conv_id", (F.col("depth") - 1).alias("j"), "digest")), "blocks")
    yield level
    for _ in range(1, longest.bit_length()):
        half = lambda odd, name, level=level: level.where(F.col("j") % 2 == odd).select("conv_id", F.shiftright("j", 1).alias("j"), F.col("name").alias(name))
        pairs = half(0, "a").join(half(1, "b"), ["conv_id", "j"])
        level = written(dense_names(pairs, "a", "b").attach(pairs), "blocks")
        yield level


def _prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """The name of every prefix: conv_id, depth, name."""
    pieces = functools.reduce(DataFrame.unionByName, (
        level.where(F.col("j") % 2 == 0).select("conv_id", F.shiftleft(F.col("j") + 1, k).alias("depth"), F.shiftleft("j", k).alias("before"), F.col("name").alias("block"))
        for k, level in enumerate(_blocks(turns, longest))
    ))
    of_bits = lambda r: pieces.where(F.bit_count("depth") == r)
    found = [of_bits(1).select("conv_id", "depth", F.col("block").alias("name"))]
    for r in range(2, longest.bit_length() + 1):
        heads = found[-1].select("conv_id", F.col("depth").alias("before"), F.col("name").alias("upto"))
        joined = of_bits(r).join(heads, ["conv_id", "before"]).select("conv_id", "depth", F.col("depth").alias("d"), "upto", "block")
        found.append(written(dense_names(joined, "d", "upto", "block").attach(joined), "prefixes"))
    return functools.reduce(DataFrame.unionByName, found)


def _later_sums(rows: DataFrame, columns: list[str], longest: int) -> DataFrame:
    """`rows` (conv_id, depth, ...) with each of `columns` summed from its row to the conversation's end, in windows of at
    most BLOCK rows."""
    one = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc())
    blocked = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    summed = blocked.withColumns({c: F.sum(c).over(one.rowsBetween(Window.unboundedPreceding, 0)) for c in columns})
    if longest < BLOCK:
        return summed.drop("block")
    totals = blocked.groupBy("conv_id", F.col("block").alias("depth")).agg(*[F.sum(c).alias(c) for c in columns])
    after = _later_sums(totals, columns, longest // BLOCK).select("conv_id", (F.col("depth") - 1).alias("block"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = summed.join(after, ["conv_id", "block"], "left")
    return both.withColumns({c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in columns}).drop("block", *[f"_{c}" for c in columns])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted rows (depth, name, conv_id) as comma-joined texts of at most CHUNK ids of one node."""
    held: list[int] = []
    node: tuple | None = None

    def emit(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[], [], [], []]
        return pa.RecordBatch.from_arrays([*[pa.array(c, type=pa.int64()) for c in columns[:3]], pa.array(columns[3], type=pa.string())], names=["depth", "name", "first", "ids"])

    for batch in batches:
        done = []
        for d, n, c in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if node != (d, n) or len(held) == CHUNK:
                if held:
                    done.append((*node, held[0], ",".join(map(str, held))))
                node, held = (d, n), []
            held.append(c)
        yield emit(done)
    if held:
        yield emit([(*node, held[0], ",".join(map(str, held)))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's texts, joined by commas as they come; only the running digest is held."""
    node: tuple | None = None
    running = None

    def emit(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[], [], []]
        return pa.RecordBatch.from_arrays([*[pa.array(c, type=pa.int64()) for c in columns[:2]], pa.array(columns[2], type=pa.string())], names=["depth", "name", "ends_sha256"])

    for batch in batches:
        done = []
        for d, n, _, ids in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if node == (d, n):
                running.update(b",")
            else:
                if node is not None:
                    done.append((*node, running.hexdigest()))
                node, running = (d, n), hashlib.sha256()
            running.update(ids.encode())
        yield emit(done)
    if node is not None:
        yield emit([(*node, running.hexdigest())])


def _ends(rows: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the conversations that end there. Ids are joined into long texts where they lie after a sort
    by ranges, so the one stream that a digest needs has a row for CHUNK ids."""
    order = ("depth", "name", "conv_id")
    ended = rows.where("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = ended.mapInArrow(_chunks, "depth long, name long, first long, ids string")
    streams = chunks.repartition("depth", "name").sortWithinPartitions("depth", "name", "first")
    return streams.mapInArrow(_digests, "depth long, name long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations given by turns (conv_id, depth from 1 without gaps, digest, chars, last) and
    convs (conv_id, length): see `report`."""
    turns = written(turns, "turns")
    longest = turns.agg(F.max("depth")).first()[0] or 0
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("chars"), (F.col("length") == 0).alias("last"))
    rows = written(_prefixes(turns, longest).join(turns.drop("digest"), ["conv_id", "depth"]).unionByName(root), "rows") if longest else root
    nodes = written(rows.groupBy("depth", "name").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), ((F.count("*") - 1) * F.max("chars")).alias("saved"), F.min(F.col("last").cast("long")).alias("leaf"),
    ), "nodes")
    size = nodes.agg(F.sum("n_convs"), F.max("n_convs")).first()
    above = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("upper"))
    edges = written(nodes.select("conv_id", "depth", "name").join(above, ["conv_id", "depth"]).select("depth", "name", "upper"), "edges")
    uppers = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("upper"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("n"))
    parents = by_hot_keys(edges, uppers, ["depth", "upper"], max(HOT_ROWS, (size[0] or 0) // HOT_NAMES), size[1] or 0).select("depth", "name", "parent_conv_id")
    children = edges.groupBy((F.col("depth") - 1).alias("depth"), F.col("upper").alias("name")).agg(F.count("*").alias("n_children"))
    held = rows.select("conv_id", "depth", "name").join(nodes.select("conv_id", "depth", "saved", "leaf"), ["conv_id", "depth"], "left")
    sums = _later_sums(held.na.fill(0, ["saved", "leaf"]), ["saved", "leaf"], longest).groupBy("depth", "name").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    found = nodes.select("depth", "name", "conv_id", "n_convs")
    for part in (parents, children, sums, _ends(rows)):
        found = found.join(part, ["depth", "name"], "left")
    zero: Column = F.lit(0).cast("long")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: a node for each distinct sequence of first turns (role, text).

    A conversation c is rebuilt from the first h turns of conversation c - c % 100, or as many as there are, and its own
    turns after its first h; h = crc32(c as text) % 6. Turns are in ascending `turn` order, null first, equal ones by a
    digest of role and text; a null role or text is empty. Rows without a conv_id belong to no conversation and take no
    part. Repeated rows are turns of their own. Other columns are ignored. An empty table has no nodes.

    Per node: conv_id (its smallest member), depth, parent_conv_id (the parent's conv_id, null at the root), n_convs
    (members), n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, members but one times
    the code points of the last text), ends_sha256 (of the ids of members that end there, ascending, comma-joined).
    """
    return trie(*rebuilt(conversations))
