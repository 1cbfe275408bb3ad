"""Checks of structures against the cross-sections beside them, of the ground raster and of paved surface.

Structure sides are rows (id, code, side, node_id, level): one for each end, so that both ends are one job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import structure_relations
from .raster import WATER, rasterise
from .relational import carry_min, case_update, unpivot
from .rules import Rule, where

HIGHEST_GROUND = 400.0

# The messages of the report.
HEIGHT_UNUSED = "WARNING: cross section definition height not used for shape type 1"
COUNTS_DIFFER = "ERROR: multiple height and width entries must have the same count"
GROUND_TOO_HIGH = "Maximale waarde DEM: {} is te hoog"
GROUND_FITS = "Maximale waarde DEM: {} voldoet aan de norm"


def section_entry_rules(strict_parity: bool = False) -> list[Rule]:
    """Heights that a shape does not use, and heights and widths of unequal number. The original rules compare literals
    and so never report; `strict_parity` gives that: no rules."""
    blanks = lambda c: f"length({c}) - length(replace({c}, ' ', ''))"
    rules = [
        Rule("cross_section_location", "id", where("cross_section_height IS NOT NULL AND cross_section_shape = 1"), HEIGHT_UNUSED),
        Rule("cross_section_location", "id", where(f"{blanks('cross_section_height')} <> {blanks('cross_section_width')}"), COUNTS_DIFFER),
    ]
    return [] if strict_parity else rules


def wrong_sections(structures: DataFrame, levels: Mapping[str, str], channels: DataFrame, sections: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cross-sections whose reference level lies over a structure beside them, with the level proposed: the lowest of the
    structures that meet there (ties: code, then side). Nodes with a bottom level are not considered.

    levels: the column of `structures` with the level of its start and end; nodes: (id, bottom_level); channels and
    sections as for structure_relations.
    """
    sides = unpivot(structures, ["id", "code", *sorted(set(levels.values()))], {"connection_node_id_start": "start", "connection_node_id_end": "end"}, "node_id", "side")
    level = F.when(F.col("side") == "start", F.col(levels["start"])).otherwise(F.col(levels["end"]))
    known = sides.select("id", "code", "side", "node_id", level.alias("_level")).join(nodes.where("bottom_level IS NOT NULL").select(F.col("id").alias("node_id")), "node_id", "left_anti")
    found = known.join(structure_relations(structures, channels, sections), ["id", "side"]).where("_level < min_reference")
    named = found.select(F.col("min_section").alias("section_id"), F.col("min_reference").alias("reference_level"), F.col("code").alias("structure_code"), F.col("side").alias("structure_side"), F.col("_level").alias("proposed_level"))
    return lowest_of_section(named)


def lowest_of_section(wrong: DataFrame) -> DataFrame:
    """Of rows of wrong_sections, those with the lowest proposal of their section."""
    order = [F.col("proposed_level"), F.col("structure_code"), F.col("structure_side")]
    return carry_min(wrong, ["section_id"], order, ["reference_level", "structure_code", "structure_side", "proposed_level"])


def with_assumptions(wrong: DataFrame, sources: DataFrame) -> DataFrame:
    """`level_is_assumed`: the structure's level at that side was assumed in the source. sources: (code, assumption), where
    the text names bed_level_up (start), bed_level_down (end) or bottom_level (both sides)."""
    held = lambda part: F.coalesce(F.col("assumption").contains(part), F.lit(False))
    marks = F.array_compact(F.array(F.when(held("bed_level_up") | held("bottom_level"), F.lit("start")), F.when(held("bed_level_down") | held("bottom_level"), F.lit("end"))))
    assumed = sources.select(F.col("code").alias("_code"), F.explode(marks).alias("_side")).distinct()
    found = wrong.join(assumed, (F.col("structure_code") == F.col("_code")) & (F.col("structure_side") == F.col("_side")), "left")
    return found.withColumn("level_is_assumed", F.col("_code").isNotNull()).drop("_code", "_side")


def with_proposals(sections: DataFrame, wrong: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """`sections` with the proposed reference levels, but for excluded ids."""
    return case_update(sections, wrong.select(F.col("section_id").alias("id"), "proposed_level"), "id", "reference_level", "proposed_level", excluded)


def control_channels(structures: DataFrame, controls: DataFrame, kind: str, channels: DataFrame, sections: DataFrame) -> DataFrame:
    """Controlled structures of a kind with every channel that touches one of their nodes and its cross-sections; nulls
    where there is none. The join on either end is an equi-join of the unpivoted ends."""
    ends = {"connection_node_id_start": "start", "connection_node_id_end": "end"}
    held = structures.join(controls.where(F.col("target_type") == kind).select(F.col("target_id").alias("id"), F.col("id").alias("control_id")), "id")
    pair = unpivot(held, ["id"], ends, "_node", "_side").join(unpivot(channels.select(F.col("id").alias("channel_id"), *ends), ["channel_id"], ends, "_node", "_end"), "_node").select("id", "channel_id").distinct()
    found = held.select("id", "code", "control_id").join(pair, "id", "left")
    return found.join(sections.select("channel_id", F.col("id").alias("section_id"), "reference_level"), "channel_id", "left").select("id", "code", "control_id", "channel_id", "section_id", "reference_level")


def ground_verdict(pixels: DataFrame, value: str = "value", limit: float = HIGHEST_GROUND) -> DataFrame:
    """One row: the highest ground, whether it is over the limit, and the message; an empty raster fits, with null."""
    top = pixels.agg(F.max(value).alias("highest"))
    text = lambda t: F.replace(F.lit(t), F.lit("{}"), F.coalesce(F.col("highest").cast("string"), F.lit("-")))
    high = F.coalesce(F.col("highest") > limit, F.lit(False))
    return top.select("highest", high.alias("too_high"), F.when(high, text(GROUND_TOO_HIGH)).otherwise(text(GROUND_FITS)).alias("message"))


def dewatering_depth(ground: DataFrame, areas: DataFrame, level: str, size: float) -> DataFrame:
    """Ground minus the level of the area around it, per pixel (px, py, value); null without an area and on water.
    areas: rings with a level; where they overlap the highest counts."""
    levels = rasterise(areas, level, size).withColumnRenamed("value", "_level")
    found = ground.join(levels, ["px", "py"], "left")
    return found.withColumn("value", F.when(F.col("value") != WATER, F.col("value") - F.col("_level"))).drop("_level")


def paved_summary(surfaces: DataFrame, area: str, polder: DataFrame, polder_area: str) -> DataFrame:
    """One row: paved surface and polder in whole hectares, cut off, and their difference. Without a polder the last two
    are null."""
    hectares = lambda df, c, to: df.agg((F.sum(c) / 10000).cast("long").alias(to))
    paved = surfaces.agg((F.coalesce(F.sum(area), F.lit(0.0)) / 10000).cast("long").alias("paved_ha"))
    both = paved.crossJoin(F.broadcast(hectares(polder, polder_area, "polder_ha")))  # one row each
    return both.withColumn("difference_ha", F.col("paved_ha") - F.col("polder_ha"))
