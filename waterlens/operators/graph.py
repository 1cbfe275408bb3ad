"""Graph operators: components, their classification, ordered fills and trees."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..session import cut, written
from .relational import with_new_ids


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of the edges (u, v) but the least of its component, with that least node.

    Alternates large-star and small-star contraction until a round changes nothing. Each round is written to the shared
    folder; the driver sees two numbers of it. Minima are combined on the map side.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least(pairs):
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = least(large)
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(lows.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    return edges


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): every vertex with the least vertex of its component, itself if it has no edge."""
    found = components(edges.where("u IS NOT NULL AND v IS NOT NULL"))
    return vertices.select("id").join(found.select(F.col("u").alias("_u"), "v"), F.col("id") == F.col("_u"), "left").select("id", F.coalesce("v", "id").alias("component"))


def snap(points: DataFrame, tolerance: float) -> DataFrame:
    """(id, node, x, y): points (id, x, y) that chains of steps within the tolerance join are one node, named and placed
    by its smallest id. Equal points are one node however many there are.

    Places go to cells so small that all of one cell are one node. Cells are linked first where the places of each that are
    farthest towards the other are near enough; only cells that this leaves in different nodes are searched for a near pair.
    """
    side = tolerance / math.sqrt(2) * (1 - 1e-6)
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    known = points.where("x IS NOT NULL AND y IS NOT NULL")
    places = cut(known.groupBy("x", "y").agg(F.min("id").alias("place")).withColumns({"cx": cell("x"), "cy": cell("y")}))
    ways = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    at = F.struct("x", "y")
    ends = [f(at, F.col("x") * i + F.col("y") * j).alias(f"{name}{k}") for k, (i, j) in enumerate(ways) for name, f in (("high", F.max_by), ("low", F.min_by))]
    cells = cut(places.groupBy("cx", "cy").agg(F.min("place").alias("name"), *[f(c).alias(f.__name__ + c) for c in "xy" for f in (F.min, F.max)], *ends))
    box = ["cx", "cy", "name", "minx", "maxx", "miny", "maxy"]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"high{k}").alias("end")) for k, (i, j) in enumerate(ways)]))
    ahead = cells.select(*[F.col(c).alias(f"u{c}") for c in box], steps.alias("s")).select("*", "s.*").drop("s")
    lows = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.col(f"low{k}").alias("start")) for k, (i, j) in enumerate(ways)]))
    behind = cells.select(*[F.col(c).alias(f"v{c}") for c in box], lows.alias("s")).select("*", "s.*").drop("s")
    met = ahead.join(behind, (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")) & (F.col("ucx") + F.col("i") == F.col("vcx")) & (F.col("ucy") + F.col("j") == F.col("vcy")))
    gap = distance(F.col("end.x"), F.col("end.y"), F.col("start.x"), F.col("start.y"))
    pairs = cut(met.select(*[f"{p}{c}" for p in "uv" for c in box], (gap <= tolerance).alias("linked")))
    links = pairs.where("linked").select(F.col("uname").alias("u"), F.col("vname").alias("v"))
    names = cells.select(F.col("name").alias("id"))
    first = cut(connected_components(names, links))
    of = lambda p: first.select(F.col("id").alias(f"_{p}"), F.col("component").alias(f"{p}node"))
    apart = pairs.where("NOT linked").join(of("u"), F.col("uname") == F.col("_u")).join(of("v"), F.col("vname") == F.col("_v")).where("unode <> vnode")
    # of each of the two cells only the places that are near the other's box
    off = lambda p, c, q: F.greatest(F.col(f"{q}min{c}") - F.col(c), F.col(c) - F.col(f"{q}max{c}"), F.lit(0.0))
    near = lambda p, q: F.sqrt(off(p, "x", q) * off(p, "x", q) + off(p, "y", q) * off(p, "y", q)) <= tolerance * (1 + 1e-9)
    spots = lambda p: places.select(F.col("cx").alias(f"_{p}cx"), F.col("cy").alias(f"_{p}cy"), "x", "y")
    here = lambda p: (F.col(f"{p}cx") == F.col(f"_{p}cx")) & (F.col(f"{p}cy") == F.col(f"_{p}cy"))
    lefts = apart.join(spots("u"), here("u")).where(near("u", "v")).select("uname", "vname", "unode", "vnode", "vcx", "vcy", *[f"u{m}{c}" for c in "xy" for m in ("min", "max")], F.col("x").alias("lx"), F.col("y").alias("ly"))
    both = lefts.join(spots("v"), here("v")).where(near("v", "u") & (distance(F.col("lx"), F.col("ly"), F.col("x"), F.col("y")) <= tolerance))
    more = both.select(F.col("unode").alias("u"), F.col("vnode").alias("v")).distinct()
    last = connected_components(first.select(F.col("component").alias("id")).distinct(), more).withColumnsRenamed({"id": "_first", "component": "node"})
    named = first.join(last, F.col("component") == F.col("_first")).select(F.col("id").alias("_name"), "node")
    nodes = cells.select(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "name").join(named, F.col("name") == F.col("_name")).select("_cx", "_cy", "node")
    spots_of = places.select(F.col("place").alias("_place"), F.col("x").alias("node_x"), F.col("y").alias("node_y"))
    nodes = nodes.join(spots_of, F.col("node") == F.col("_place")).drop("_place")
    found = known.withColumns({"_x": cell("x"), "_y": cell("y")}).join(nodes, (F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy")))
    return found.select("id", "node", F.col("node_x").alias("x"), F.col("node_y").alias("y"))


def classify_components(members: DataFrame, valid: str, active: str) -> DataFrame:
    """Class of each component by its contact with the 1D network: any valid contact, any active one, or none."""
    found = members.groupBy("component").agg(F.count("*").alias("n_members"), F.bool_or(valid).alias("_v"), F.bool_or(active).alias("_a"))
    kind = F.when(F.col("_v"), "nuisance").when(F.col("_a"), "model error").otherwise("puddle")
    return found.select("component", "n_members", kind.alias("class"))


def combine_classes(a, b):
    """Class of a place from two scenarios: model error if both are, else nuisance if either is, else puddle if either is. A
    missing class is none of them."""
    is_ = lambda kind: (F.coalesce(a == kind, F.lit(False)), F.coalesce(b == kind, F.lit(False)))
    (ea, eb), (na, nb), (pa, pb) = map(is_, ("model error", "nuisance", "puddle"))
    return F.when(ea & eb, "model error").when(na | nb, "nuisance").when(pa | pb, "puddle")


def ordered_fill(cells: DataFrame, group: str, order: str, value: str, replace: str, neighbours: str) -> DataFrame:
    """Replaced cells get, one after the other, the rounded mean of their neighbours' current values.

    Each filled value counts for the next, so the order matters and a group (cells that can reach each other) runs in
    one task; groups are what connected components of replaced cells and their neighbours give.
    """

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        now = {k: v for k, v, r in zip(rows[order], rows[value], rows[replace], strict=True) if not r and pd.notna(v)}
        out = []
        for key, first, swap, near in zip(rows[order], rows[value], rows[replace], rows[neighbours], strict=True):
            if swap and pd.notna(first):
                known = [now[n] for n in near if n in now]
                if known:
                    now[key] = float(np.rint(sum(known) / len(known) * 1e5) / 1e5)
            out.append(now.get(key))
        return rows.assign(filled=pd.array(out, dtype="Float64").astype("float64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields) + ", filled double"
    return cells.groupBy(group).applyInPandas(fill, schema)


def prefix_paths(df: DataFrame, levels: Sequence[str], separator: str = "/") -> DataFrame:
    """The group tree of level columns: each distinct path with its depth, its parent and the rows below it."""
    parts = F.array(*[F.col(c).cast("string") for c in levels])
    depth = F.explode(F.sequence(F.lit(1), F.lit(len(levels))))
    paths = df.select(parts.alias("_p"), depth.alias("depth")).select("depth", F.array_join(F.slice("_p", 1, F.col("depth")), separator).alias("path"), F.when(F.col("depth") > 1, F.array_join(F.slice("_p", 1, F.col("depth") - 1), separator)).alias("parent"))
    return paths.groupBy("path", "depth", "parent").agg(F.count("*").alias("n_rows"))


def first_match_nodes(points: DataFrame, tolerance: float) -> DataFrame:
    """(order, node) of points (order long, x, y): what one pass over the points in their order gives, in which a point takes
    the first node so far that is nearer than the tolerance, or else is a new node; a node is named by its own order.

    The nodes are the first independent set in that order. It is found in rounds without the pass: in a cell whose points
    are all nearer to each other than the tolerance only the first open one can be the next node, and it is one if no
    cell around holds an earlier open point. Points nearer than the tolerance to an earlier node are closed. Equal points
    are one. Orders must be unique; points with a null coordinate or order are left out.
    """
    known = points.where("x IS NOT NULL AND y IS NOT NULL AND order IS NOT NULL").select(F.col("order").cast("long").alias("order"), "x", "y")
    size = tolerance / 1.5  # its diagonal is shorter than the tolerance
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    places = written(known.groupBy("x", "y").agg(F.min("order").alias("first")).withColumns({"cx": cell("x"), "cy": cell("y")}), "places")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])

    def spread(df: DataFrame, p: str) -> DataFrame:
        """Rows of `df` (first, x, y, cx, cy) at all cells that can hold a point nearer than the tolerance."""
        return df.withColumn("_d", F.explode(around)).select((F.col("cx") + F.col("_d.i")).alias("cx"), (F.col("cy") + F.col("_d.j")).alias("cy"), *[F.col(c).alias(p + c) for c in ("first", "x", "y")])

    near = distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")) < tolerance
    open_, nodes = places, None
    while not open_.isEmpty():
        heads = written(open_.groupBy("cx", "cy").agg(F.min_by(F.struct("first", "x", "y"), "first").alias("h")).select("cx", "cy", "h.*"), "heads")
        earliest = spread(heads, "n").groupBy("cx", "cy").agg(F.min("nfirst").alias("earliest"))
        new = written(heads.join(earliest, ["cx", "cy"]).where("first = earliest").select("first", "x", "y", "cx", "cy"), "nodes")
        nodes = new if nodes is None else nodes.unionByName(new)
        closed = open_.join(spread(new, "n"), ["cx", "cy"]).where(near).select(F.col("first").alias("_first")).distinct()
        open_ = written(open_.join(closed, F.col("first") == F.col("_first"), "left_anti"), "open")
    if nodes is None:
        return known.select("order", F.lit(None).cast("long").alias("node"))
    taken = places.join(spread(nodes, "n"), ["cx", "cy"]).where(near & (F.col("nfirst") <= F.col("first"))).groupBy("x", "y").agg(F.min("nfirst").alias("node"))
    return known.join(taken, ["x", "y"]).select("order", "node")


def wave_fill(cells: DataFrame, group: str, order: str, value: str, replace: str, neighbours: str) -> DataFrame:
    """What `ordered_fill` gives, in rounds over all groups at once: a replaced cell is filled as soon as all replaced
    neighbours before it are. The rounds are those of the longest chain of cells that wait for each other, so this is for
    groups too large for a task; each round is a join of what is open."""
    at, swap = F.struct(F.col(group), F.col(order)), F.coalesce(F.col(replace) & F.col(value).isNotNull(), F.lit(False))
    rows = cells.select(at.alias("cell"), swap.alias("swap"), F.coalesce(F.col(replace), F.lit(False)).alias("marked"), F.col(value).cast("double").alias("value"), F.col(neighbours).alias("near"))
    links = written(rows.where("swap").select("cell", F.explode("near").alias("_n")).select("cell", F.struct(F.col(f"cell.{group}"), F.col("_n").alias(order)).alias("other")).distinct(), "links")
    given = rows.select(F.col("cell").alias("other"), F.when(~F.col("marked"), F.col("value")).alias("now"), "swap")
    known = links.join(given, "other")  # neighbours of other groups are not seen
    fixed = written(known.where("now IS NOT NULL").groupBy("cell").agg(F.sum("now").alias("total"), F.count("*").alias("n")), "fixed")
    waits = written(known.where(F.col("swap") & (F.col(f"other.{order}") < F.col(f"cell.{order}"))).select("cell", "other"), "waits")
    open_ = written(rows.where("swap").select("cell").join(fixed, "cell", "left").na.fill(0, ["total", "n"]), "open")
    done = None
    while not open_.isEmpty():
        blocked = waits.select("cell").distinct()
        ready = open_.join(blocked, "cell", "left_anti").withColumn("filled", F.when(F.col("n") > 0, F.rint(F.col("total") / F.col("n") * 1e5) / 1e5))
        ready = written(ready.select("cell", "filled"), "ready")
        done = ready if done is None else done.unionByName(ready)
        passed = waits.join(ready.select(F.col("cell").alias("other"), "filled"), "other")
        more = passed.where("filled IS NOT NULL").groupBy("cell").agg(F.sum("filled").alias("_t"), F.count("*").alias("_m"))
        open_ = open_.join(ready.select("cell"), "cell", "left_anti").join(more, "cell", "left")
        open_ = written(open_.select("cell", (F.col("total") + F.coalesce("_t", F.lit(0.0))).alias("total"), (F.col("n") + F.coalesce("_m", F.lit(0))).alias("n")), "open")
        waits = written(waits.join(ready.select(F.col("cell").alias("other")), "other", "left_anti").select("cell", "other"), "waits")
    out = cells.withColumn("_cell", at)
    if done is None:
        return out.withColumn("filled", F.when(~F.coalesce(F.col(replace), F.lit(False)), F.col(value).cast("double"))).drop("_cell")
    out = out.join(done.select(F.col("cell").alias("_done"), F.col("filled").alias("_filled")), F.col("_cell") == F.col("_done"), "left")
    return out.withColumn("filled", F.when(F.coalesce(F.col(replace), F.lit(False)), F.col("_filled")).otherwise(F.col(value).cast("double"))).drop("_cell", "_done", "_filled")


def channels_of_lines(lines: DataFrame, order: str, tolerance: float, first_node: int = 1, first_channel: int = 1) -> DataFrame:
    """`lines` (`order`, line) as channels with id, connection_node_id_start and connection_node_id_end: what one pass over the
    lines gives that takes each line's start, then its end, to the first node nearer than the tolerance or to a new one.
    Nodes and channels are numbered in that order; lines without points go, and orders must be unique."""
    numbered = with_new_ids(lines.where(F.size("line") > 0), "id", [order], first_channel - 1)
    side = lambda k, at: F.struct((F.col("id") * 2 + k).alias("order"), F.element_at("line", at).alias("at"))
    ends = numbered.select(F.explode(F.array(side(0, 1), side(1, -1))).alias("e")).select("e.order", "e.at.x", "e.at.y")
    matched = written(first_match_nodes(ends, tolerance), "matched")
    ids = with_new_ids(matched.select("node").distinct(), "node_id", ["node"], first_node - 1)
    named = written(matched.join(ids, "node").select("order", "node_id"), "named")
    out = numbered
    for k, name in ((0, "connection_node_id_start"), (1, "connection_node_id_end")):
        at = named.select(F.col("order").alias("_o"), F.col("node_id").alias(name))
        out = out.join(at, F.col("id") * 2 + k == F.col("_o"), "left").drop("_o")
    return out
