"""Chained analyses of flood results: classes of flooded areas, and levels of grid cells corrected by their neighbours."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .graph import classify_components, combine_classes, connected_components, ordered_fill, wave_fill
from .network import grid_flags
from .relational import unpivot, with_both_ends

#: Cells of a group that one task fills.
TASK_CELLS = 100_000


def flood_classes(nodes: DataFrame, lines: DataFrame, least_area: float = 0.001, steepest: float = 0.00125) -> DataFrame:
    """(id, component, class) of every 2D node. Lines with enough flow area are active, and valid if their level gradient is
    not too steep. Valid lines between 2D nodes make the groups; a group is a nuisance if a node of it has a valid line
    to the 1D network, a model error if it has an active one only, and a puddle without.

    nodes: (id, is_2d, level); lines: (u, v, kind as 2d2d or 1d2d, flow_area, length). A null level, area or length, or a
    length of 0, makes no line valid.
    """
    known = with_both_ends(lines, nodes, "id", ["level"], "u", "v")
    gradient = F.abs((F.col("level_v") - F.col("level_u")) / F.nullif(F.col("length"), F.lit(0.0)))
    active = known.where(F.col("flow_area") >= least_area).withColumn("is_valid", F.coalesce(gradient <= steepest, F.lit(False)))
    inside = nodes.where("is_2d")
    groups = connected_components(inside, active.where("kind = '2d2d' AND is_valid").select("u", "v"))
    contacts = unpivot(active.where("kind = '1d2d'"), ["is_valid"], {"u": "u", "v": "v"}, "_node", "_side").groupBy("_node").agg(F.bool_or("is_valid").alias("_valid"))
    members = groups.join(contacts, F.col("id") == F.col("_node"), "left").select("id", "component", F.coalesce("_valid", F.lit(False)).alias("has_valid"), F.col("_node").isNotNull().alias("has_active"))
    kinds = classify_components(members, "has_valid", "has_active").select(F.col("component").alias("_of"), "class")
    return members.join(kinds, F.col("component") == F.col("_of")).select("id", "component", "class")


class UnequalCells(ValueError):
    """Two scenarios that are not of the same cells."""


def combined_flood_classes(scenarios: Mapping[str, tuple[DataFrame, DataFrame]], cells: DataFrame, least_area: float = 0.001, steepest: float = 0.00125) -> DataFrame:
    """(id, class_<name> of each scenario, final_class) of every 2D node of two scenarios by name, each with its nodes and
    lines as for `flood_classes`, where both say more than one: model error if both are, else nuisance, else puddle if
    either is.

    cells: (name, id, x, y) of the scenarios' cells. Where a cell of one is missing in the other, or elsewhere, the
    scenarios cannot be combined, which is an error.
    """
    (one, two) = scenarios
    place = cells.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.countDistinct("x", "y").alias("places"))
    if not place.where("names <> 2 OR n <> 2 OR places <> 1").isEmpty():
        raise UnequalCells(f"{one} and {two} are not of the same cells")
    of = {name: flood_classes(nodes, lines, least_area, steepest).select(F.col("id").alias(f"_{name}"), F.col("class").alias(f"class_{name}")) for name, (nodes, lines) in scenarios.items()}
    found = of[one].join(of[two], F.col(f"_{one}") == F.col(f"_{two}"), "full")
    final = combine_classes(F.col(f"class_{one}"), F.col(f"class_{two}")).alias("final_class")
    return found.select(F.coalesce(f"_{one}", f"_{two}").alias("id"), f"class_{one}", f"class_{two}", final)


def corrected_levels(cells: DataFrame, links: DataFrame, dem: float = 50.0, water: float = 95.0, building: float = 99.0) -> DataFrame:
    """`cells` with why their level is replaced, the corrected level, its difference and the storage in millimetres.

    cells: as for grid_flags, with `value` and `volume`; links: (u, v), once for each pair of touching cells. Replaced cells
    take, in order of id, the mean of their neighbours' current levels. Only replaced cells and their neighbours run in
    groups, those that touch in a chain together; all others keep their level. A group of more than TASK_CELLS cells is
    filled in rounds, not in one task.
    """
    flagged = grid_flags(cells, dem, water, building)
    marked = flagged.where("replace IS NOT NULL").select("id")
    both = links.select("u", "v").union(links.select("v", "u")).distinct()
    around = both.join(marked, F.col("u") == F.col("id"), "left_semi")
    near = around.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("near"))
    touched = around.select(F.col("u").alias("id")).union(around.select("v")).distinct()
    groups = connected_components(touched, around.select("u", "v"))
    rows = flagged.join(groups, "id").join(near.withColumnRenamed("u", "id"), "id", "left").select("id", "component", "value", F.col("replace").isNotNull().alias("swap"), F.coalesce("near", F.array().cast("array<long>")).alias("near"))
    rows = cut(rows)
    large = rows.groupBy("component").count().where(F.col("count") > TASK_CELLS).select("component")
    small = ordered_fill(rows.join(large, "component", "left_anti"), "component", "id", "value", "swap", "near")
    filled = small if large.isEmpty() else small.unionByName(wave_fill(rows.join(large, "component", "left_semi"), "component", "id", "value", "swap", "near"))
    filled = filled.select(F.col("id").alias("_id"), "filled")
    out = flagged.join(filled, F.col("id") == F.col("_id"), "left")
    own = F.when(F.col("_id").isNotNull(), F.col("filled")).when(F.col("replace").isNull(), F.col("value"))
    storage = F.round(F.col("volume") / F.nullif(F.col("dem_area"), F.lit(0.0)) * 1000, 2)
    return out.withColumn("corrected", own).withColumn("difference", F.round(F.col("corrected") - F.col("value"), 5)).withColumn("storage_mm", storage).drop("_id", "filled")
