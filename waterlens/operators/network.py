"""Checks and analyses of a network model: nodes, channels, structures, controls and simulation results.

Tables are DataFrames by name (connection_node, channel, cross_section_location, weir, orifice, culvert, pipe, pump,
pump_map, surface, surface_map, boundary_condition_1d, table_control, tags). Every analysis is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encoded
from ..functions.curves import interpolate_arrays
from ..functions.geometry import line_length
from ..functions.nulls import strict_max
from .lines import positions
from .relational import carry_max, first_per_key, unpivot
from .rules import Rule, run_rules, where

Tables = Mapping[str, DataFrame]
STRUCTURES = ("weir", "orifice", "culvert")
OPEN_CREST = 15
LEVEL_TOLERANCE = 0.05

# The messages of the report.
MESSAGES = {
    "node_missing": "ERROR: impervious surface map refers to non-existent node",
    "surface_unmapped": "WARNING: surface is not in mapping table",
    "map_unknown": "WARNING: surface map is not in surface layer",
    "node_without_surface": "WARNING: connection node without impervious surface",
    "channel_without_section": "ERROR: channel without cross section location",
    "section_shape": "ERROR: cross section location has no definition shape",
    "culvert_shape": "ERROR: culvert has no definition shape",
    "weir_shape": "ERROR: weir has no definition shape",
    "orifice_shape": "ERROR: orifice has no definition shape",
    "boundary_node": "WARNING: 1d boundary without connection node",
    "section_level": "ERROR: cross section location without reference level",
    "node_level": "WARNING: connection node without initial waterlevel",
    "node_isolated": "ERROR: node without connection",
    "pump_level": "WARNING: start level for pump station not close to initial waterlevel",
    "pump_loop": "ERROR: pumpstation from and to the same connection node",
    "weir_loop": "ERROR: weir from and to the same connection node",
    "orifice_loop": "ERROR: orifice from and to the same connection node",
    "culvert_loop": "ERROR: culvert from and to the same connection node",
    "levels_differ": "WARNING: initial water level at start and end node are not equal ",
    "percentage": "WARNING: percentage = 100 and should be 14.4 or 11.5",
    "action_table": "ERROR: action_table has more than 1000 characters (model will crash)",
}


def _absent(other: str, own: str, key: str):
    """Rows whose key the other table lacks; a null key is no finding, and a null in the other table hides none."""

    def broken(df: DataFrame, tables: Tables) -> DataFrame:
        return df.where(F.col(own).isNotNull()).join(tables[other].select(F.col(key).alias("_k")), F.col(own) == F.col("_k"), "left_anti")

    return broken


def _childless(child: str, fk: str):
    def broken(df: DataFrame, tables: Tables) -> DataFrame:
        return df.join(tables[child].select(F.col(fk).alias("_k")), F.col("id") == F.col("_k"), "left_anti")

    return broken


def with_levels(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """`df` with the initial levels of its start and end node."""
    side = lambda p: nodes.select(F.col("id").alias(f"_{p}"), F.col("initial_water_level").alias(f"level_{p}"))
    return df.join(side("start"), F.col("connection_node_id_start") == F.col("_start"), "left").join(side("end"), F.col("connection_node_id_end") == F.col("_end"), "left").drop("_start", "_end")


def _levels(condition: Column | str):
    return lambda df, tables: with_levels(df, tables["connection_node"]).where(condition)


def _mapped_to_nothing(df: DataFrame, tables: Tables) -> DataFrame:
    lost = tables["surface_map"].where("surface_id IS NOT NULL").join(tables["surface"].select(F.col("id").alias("_s")), F.col("surface_id") == F.col("_s"), "left_anti")
    return df.join(lost.select(F.col("connection_node_id").alias("_n")), F.col("id") == F.col("_n"), "left_semi")


def endpoints(tables: Tables) -> DataFrame:
    """Every node that a line, pump or pump map uses, once."""
    parts = [tables[t].select(F.col(f"connection_node_id_{side}").alias("node_id")) for t in ("channel", "pipe", *STRUCTURES) for side in ("start", "end")]
    parts += [tables["pump"].select(F.col("connection_node_id").alias("node_id")), tables["pump_map"].select(F.col("connection_node_id_end").alias("node_id"))]
    return reduce(DataFrame.union, parts).where("node_id IS NOT NULL").distinct()


def _isolated(df: DataFrame, tables: Tables) -> DataFrame:
    return df.join(endpoints(tables), F.col("id") == F.col("node_id"), "left_anti")


def _pump_level(df: DataFrame, tables: Tables) -> DataFrame:
    levels = tables["connection_node"].select(F.col("id").alias("_n"), F.col("initial_water_level").alias("_level"))
    return df.join(levels, F.col("connection_node_id") == F.col("_n")).where(F.abs(F.col("_level") - F.col("start_level")) > LEVEL_TOLERANCE)


def _pump_loop(df: DataFrame, tables: Tables) -> DataFrame:
    ends = tables["pump_map"].select(F.col("pump_id").alias("_p"), "connection_node_id_end")
    return df.join(ends, (F.col("id") == F.col("_p")) & (F.col("connection_node_id") == F.col("connection_node_id_end")))


def model_rules() -> list[Rule]:
    """The checks of a network model."""
    loop = where("connection_node_id_start = connection_node_id_end")
    off = lambda side: F.abs(F.col(f"level_{side}") - F.col("crest_level")) > LEVEL_TOLERANCE
    differ = F.col("level_start") != F.col("level_end")
    flows = (F.col("discharge_coefficient_positive") != 0) & (F.col("discharge_coefficient_negative") != 0)
    upper = strict_max(F.col("level_start"), F.col("level_end"))
    invert = strict_max(F.col("invert_level_start"), F.col("invert_level_end"))
    both = f"concat('{MESSAGES['levels_differ']}', level_start, ', ', level_end)"
    return [
        Rule("surface_map", "id", _absent("connection_node", "connection_node_id", "id"), MESSAGES["node_missing"]),
        Rule("surface", "id", _absent("surface_map", "id", "surface_id"), MESSAGES["surface_unmapped"]),
        Rule("surface_map", "id", _absent("surface", "id", "id"), MESSAGES["map_unknown"]),
        Rule("connection_node", "id", _mapped_to_nothing, MESSAGES["node_without_surface"]),
        Rule("channel", "id", _childless("cross_section_location", "channel_id"), MESSAGES["channel_without_section"]),
        Rule("cross_section_location", "id", where("cross_section_shape IS NULL"), MESSAGES["section_shape"]),
        *[Rule(t, "id", where("cross_section_shape IS NULL"), MESSAGES[f"{t}_shape"]) for t in ("culvert", "weir", "orifice")],
        Rule("boundary_condition_1d", "id", _absent("connection_node", "connection_node_id", "id"), MESSAGES["boundary_node"]),
        Rule("cross_section_location", "id", where("reference_level IS NULL"), MESSAGES["section_level"]),
        Rule("connection_node", "id", where("initial_water_level IS NULL"), MESSAGES["node_level"]),
        Rule("connection_node", "id", _isolated, MESSAGES["node_isolated"]),
        Rule("pump", "id", _pump_level, MESSAGES["pump_level"]),
        Rule("pump", "id", _pump_loop, MESSAGES["pump_loop"]),
        *[Rule(t, "id", loop, MESSAGES[f"{t}_loop"]) for t in STRUCTURES],
        Rule("weir", "id", _levels(off("start") & off("end") & (F.col("crest_level") != OPEN_CREST)), "concat('WARNING: start level ', crest_level, ' not close to initial waterlevel ', level_start, ', ', level_end)", True),
        Rule("channel", "id", _levels(differ), both, True),
        Rule("orifice", "id", _levels(differ & flows & (F.col("crest_level") < upper)), both, True),
        Rule("culvert", "id", _levels(differ & flows & (invert < upper)), both, True),
        Rule("surface_map", "id", where("percentage = 100"), MESSAGES["percentage"]),
        Rule("table_control", "id", where("length(action_table) > 1000"), MESSAGES["action_table"]),
    ]


def check_model(tables: Tables) -> DataFrame:
    """(table_name, id, error) of all checks, in one plan."""
    return run_rules(tables, model_rules())


def control_overview(tables: Tables) -> DataFrame:
    """Controlled structures: code and kind of the target, first, lowest and highest action of the control table."""
    targets = reduce(DataFrame.unionByName, [tables[t].select(F.lit(t).alias("_type"), F.col("id").alias("_id"), F.col("code").alias("target_code")) for t in (*STRUCTURES, "pump") if "code" in tables[t].columns])
    pairs = encoded.sort_pairs(encoded.parse_pairs(F.col("action_table")))
    actions = F.transform("_pairs", lambda p: p["y"])
    found = tables["table_control"].withColumn("_pairs", pairs).join(targets, (F.col("target_type") == F.col("_type")) & (F.col("target_id") == F.col("_id")), "left")
    return found.select("id", "target_type", "target_id", "target_code", F.get("_pairs", F.lit(0))["y"].alias("start_action"), F.array_min(actions).alias("min_action"), F.array_max(actions).alias("max_action"), encoded.format_pairs(F.col("_pairs")).alias("sorted_table"))


def isolated_channels(channels: DataFrame, length: str, isolated_type: int = 101) -> DataFrame:
    """Length of isolated channels and of all, in km, and the percentage."""
    apart = F.coalesce(F.sum(F.when(F.col("exchange_type") == isolated_type, F.col(length))), F.lit(0.0))
    total = F.coalesce(F.sum(length), F.lit(0.0))
    return channels.agg(F.round(apart / 1000, 2).alias("isolated_km"), F.round(total / 1000, 2).alias("total_km"), F.coalesce(F.round(apart / F.nullif(total, F.lit(0.0)) * 100, 0), F.lit(0.0)).alias("isolated_percent"))


def used_profiles(channels: DataFrame, sections: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per channel: mean, least and largest depth and width of its cross-sections at the mean initial level.

    depth = level - reference level; width comes from the tabulated profile, clamped at its ends; a section without
    a tabulated profile (shape 6) has no width and takes no part in the width's aggregates.
    """
    levels = with_levels(channels, nodes).select(F.col("id").alias("_c"), ((F.col("level_start") + F.col("level_end")) / 2).alias("_level"))
    table = encoded.parse_pairs(F.col("cross_section_table"))
    found = sections.join(levels, F.col("channel_id") == F.col("_c")).withColumn("_depth", F.col("_level") - F.col("reference_level")).withColumn("_t", table)
    width = F.when(F.col("cross_section_shape") == 6, F.round(interpolate_arrays(F.col("_depth"), F.transform("_t", lambda p: p["x"]), F.transform("_t", lambda p: p["y"])), 2))
    found = found.withColumn("_width", width)
    return found.groupBy("channel_id").agg(*[f(f"_{c}").alias(f"{name}_{c}") for c in ("depth", "width") for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))], F.count("*").alias("n_sections"))


def structure_relations(structures: DataFrame, channels: DataFrame, sections: DataFrame) -> DataFrame:
    """Per structure and side: the lowest and highest reference level of the nearest cross-sections of the channels that
    meet there, with the section that has it. `sections` carries `offset`, its distance from the channel's start, and
    `length`, the channel's; of each channel the section nearest to the structure's node counts."""
    sides = unpivot(structures, ["id"], {"connection_node_id_start": "start", "connection_node_id_end": "end"}, "node_id", "side")
    ends = unpivot(channels, ["id"], {"connection_node_id_start": "start", "connection_node_id_end": "end"}, "_node", "_end").withColumnRenamed("id", "_channel")
    near = sides.join(ends, F.col("node_id") == F.col("_node")).join(sections.withColumnRenamed("id", "section_id"), F.col("_channel") == F.col("channel_id"))
    gap = F.when(F.col("_end") == "start", F.col("offset")).otherwise(F.col("length") - F.col("offset"))
    nearest = first_per_key(near.withColumn("_gap", gap), ["id", "side", "_channel"], [F.col("_gap").asc_nulls_last(), F.col("section_id")])
    known = nearest.where("reference_level IS NOT NULL")
    level, section = F.col("reference_level"), F.col("section_id")
    return known.groupBy("id", "side").agg(
        F.min(level).alias("min_reference"), F.min_by(section, F.struct(level, section)).alias("min_section"),
        F.max(level).alias("max_reference"), F.max_by(section, F.struct(level, -section)).alias("max_section"),
    )


def sections_on_channels(sections: DataFrame, channels: DataFrame) -> DataFrame:
    """`sections` (id, channel_id, x, y, more) with `offset`, how far along their channel (id, line) they are, and `length`,
    the channel's, as structure_relations takes them; null where the channel or its line is missing."""
    named = channels.select(F.col("id").alias("line_id"), "line")
    lengths = channels.select(F.col("id").alias("_c"), line_length(F.col("line")).alias("length"))
    found = positions(sections.withColumnRenamed("channel_id", "line_id"), named).withColumnRenamed("line_id", "channel_id").drop("distance")
    return found.join(lengths, F.col("channel_id") == F.col("_c"), "left").drop("_c")


def wrong_profiles(relations: DataFrame, levels: DataFrame) -> DataFrame:
    """Structure sides whose lowest level is under the lowest reference level beside them and whose node has no bottom.
    levels: (id, side, minimal_level, bottom_level)."""
    return relations.join(levels, ["id", "side"]).where((F.col("minimal_level") < F.col("min_reference")) & F.col("bottom_level").isNull())


def leaking_lines(lines: DataFrame, crossings: DataFrame, level: str | None = None) -> DataFrame:
    """1D2D lines with their highest crossing (obstacle or drainage boundary; ties: the later kind) and whether water leaks
    over the line: its lowest level is under the crossing's, or under the column `level`, the water level to hold.
    crossings: (line_id, kind, crest_level)."""
    top = carry_max(crossings.where("crest_level IS NOT NULL"), ["line_id"], [F.col("crest_level"), F.col("kind")], ["kind", "crest_level"])
    under = [F.coalesce(F.col("dpumax") < F.col(c), F.lit(False)) for c in ("crest_level", level) if c]
    return lines.join(top, F.col("id") == F.col("line_id"), "left").drop("line_id").withColumn("leaks", reduce(lambda a, b: a | b, under))


# Manholes proposed where a node's level differs from its area's, and the least storage of a leaking node.
APART = {"surface_level": 10.0, "bottom_level": -10.0, "calculation_type": 1, "drain_level": 99.0}
LEAST_STORAGE = 10.0


def manhole_proposals(nodes: DataFrame, divergent: DataFrame, leaking: DataFrame) -> DataFrame:
    """Manholes for nodes (id, storage_area) whose level is not that of their area, and for other nodes that lines leak
    from, with the highest crest as drain level. divergent: (id); leaking: (id, crest_level)."""
    apart = divergent.select(F.col("id").alias("_apart")).distinct()
    crests = leaking.groupBy(F.col("id").alias("_leaks")).agg(F.max("crest_level").alias("_crest"))
    found = nodes.join(apart, F.col("id") == F.col("_apart"), "left").join(crests, F.col("id") == F.col("_leaks"), "left").where("_apart IS NOT NULL OR _leaks IS NOT NULL")
    own = F.col("_apart").isNotNull()
    only = lambda name, other: F.when(own, F.lit(APART[name])).otherwise(other).alias(name)
    return found.select(
        "id", only("calculation_type", F.lit(2)), only("drain_level", F.col("_crest")), only("surface_level", F.lit(None)), only("bottom_level", F.lit(None)),
        F.when(own, F.col("storage_area")).otherwise(F.greatest("storage_area", F.lit(LEAST_STORAGE))).alias("storage_area"),
    )


def primary_lines(channels: DataFrame, structures: DataFrame, zoom: str, category: int = 4) -> DataFrame:
    """(kind, id, is_primary): channels of the primary category, and structures with both nodes on such channels."""
    named = channels.select(F.lit("channel").alias("kind"), "id", F.coalesce(F.col(zoom) == category, F.lit(False)).alias("is_primary"))
    ends = {"connection_node_id_start": "start", "connection_node_id_end": "end"}
    nodes = unpivot(channels.where(F.col(zoom) == category), ["id"], ends, "_node", "_side").where("_node IS NOT NULL").select("_node").distinct()
    sides = unpivot(structures, ["kind", "id"], ends, "node_id", "side").join(nodes, F.col("node_id") == F.col("_node"), "left")
    return named.unionByName(sides.groupBy("kind", "id").agg(F.bool_and(F.col("_node").isNotNull()).alias("is_primary")))


def bank_levels(sections: DataFrame, levels: DataFrame, raised: DataFrame, minimum: float = 0.1) -> DataFrame:
    """New bank level of every cross-section: the higher of water and reference level plus the minimum, not under the
    highest crest that crosses its channel. levels: (channel_id, level); raised: (channel_id, crest_level)."""
    crest = raised.groupBy("channel_id").agg(F.max("crest_level").alias("_crest"))
    found = sections.join(levels, "channel_id", "left").join(crest, "channel_id", "left")
    new = F.round(F.greatest(F.greatest("level", "reference_level") + minimum, "_crest"), 2)
    return found.select("id", "channel_id", "bank_level", new.alias("new_bank_level"), F.round(new - F.col("bank_level"), 2).alias("bank_level_diff"))


def hydraulic_check(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per line: level difference, flow direction and slope in cm per km at the end of the rain, as magnitudes.
    lines: (id, node_1, node_2, length, q, u); nodes: (id, level_start, level_end)."""
    side = lambda p: nodes.select(F.col("id").alias(f"_{p}"), F.round("level_start", 5).alias(f"start_{p}"), F.round("level_end", 5).alias(f"end_{p}"))
    found = lines.join(side("up"), F.col("node_1") == F.col("_up"), "left").join(side("down"), F.col("node_2") == F.col("_down"), "left")
    diff = F.col("end_up") - F.col("end_down")
    slope = diff * 100 / F.nullif(F.col("length") * 0.001, F.lit(0.0))
    return found.select(
        "id", F.round(F.abs(diff), 5).alias("level_difference"), F.when(F.col("q") < 0, -1).otherwise(1).alias("direction"), F.round(F.abs(slope), 5).alias("slope_cm_km"),
        F.abs("q").alias("q"), F.abs("u").alias("u"), (F.round("start_up", 2) != F.round("start_down", 2)).alias("on_level_limit"),
    )


def flowline_statistics(series: DataFrame, lines: DataFrame, marks: Mapping[str, int]) -> DataFrame:
    """Per line: q and u at the marked steps and their signed extremes over all steps but the last; lines between 1D and
    2D (kcu 51, 52) change sign. series: (line_id, t_idx, q, u); lines: (id, kcu)."""
    last = series.agg(F.max("t_idx").alias("_last"))
    every = series.join(F.broadcast(last))  # one row
    inner = F.col("t_idx") < F.col("_last")
    at = [F.max(F.when(F.col("t_idx") == t, F.col(v))).alias(f"{v}_{name}") for name, t in marks.items() for v in ("q", "u")]
    top = [F.max_by(F.when(inner, F.col(v)), F.when(inner, F.struct(F.abs(v), -F.col("t_idx")))).alias(f"{v}_max") for v in ("q", "u")]
    wide = every.groupBy("line_id").agg(*at, *top)
    mixed = F.col("kcu").isin(51, 52)
    digits = {"q": 5, "u": 3}
    values = [c for c in wide.columns if c != "line_id"]
    turned = [F.round(F.when(mixed, -F.col(c)).otherwise(F.col(c)), 5 if c.endswith("_max") else digits[c[0]]).alias(c) for c in values]
    kind = F.when(mixed, "1d2d").when(F.col("kcu").isin(100, 101), "2d").otherwise("1d")
    return lines.join(wide, F.col("id") == F.col("line_id"), "left").select("id", kind.alias("kind"), *turned)


def water_balance(areas: DataFrame, nodes: DataFrame, channels: DataFrame, water: DataFrame) -> DataFrame:
    """Per drainage area: modelled water surface (nodes and channels) against the mapped one, difference and percentage.
    nodes: (area_id, storage_area); channels and water: (area_id, area), already overlaid."""
    total = lambda df, v, to: df.groupBy("area_id").agg(F.round(F.sum(v), 0).alias(to))
    found = areas.select("area_id")
    for df, v, to in ((nodes, "storage_area", "node_area"), (channels, "area", "channel_area"), (water, "area", "water_area")):
        found = found.join(total(df, v, to), "area_id", "left").withColumn(to, F.coalesce(to, F.lit(0.0)))
    found = found.withColumn("model_area", F.col("node_area") + F.col("channel_area")).withColumn("difference", F.col("model_area") - F.col("water_area"))
    share = F.when(F.col("difference") == F.col("water_area"), 0.0).when(F.col("water_area") == 0, 100.0).otherwise(F.round(F.col("difference") / F.nullif(F.col("water_area"), F.lit(0.0)) * 100, 1))
    return found.withColumn("difference_percent", share)


def grid_flags(cells: DataFrame, dem: float = 50.0, water: float = 95.0, building: float = 99.0) -> DataFrame:
    """Why a cell's level is replaced: too little ground, too much water, too many buildings, the last named winning;
    null for cells that keep theirs. cells: (id, cell_area, dem_area, water_area, building_area)."""
    percent = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.nullif(F.col("cell_area"), F.lit(0.0)) * 100
    reason = F.when(percent("building_area") > building, "building").when(percent("water_area") > water, "water").when(percent("dem_area") < dem, "dem")
    return cells.withColumn("replace", reason)
