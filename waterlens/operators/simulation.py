"""Inputs of a simulation from the tables of a model: table controls, laterals, boundaries, aggregation settings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoded import parse_pairs

# Names that the model's tables and the simulation do not share.
MEASURED = {"waterlevel": "s1"}
FLOW_VARIABLES = {"waterlevel": "water_level", "wet_cross-section": "wet_cross_section"}
ONE_VALUE = ("set_crest_level", "set_pump_capacity")
TWO_VALUES = "set_discharge_coefficients"


def _named(column: Column, names: Mapping[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), column), column)


def table_controls(controls: DataFrame, measures: DataFrame, tables: DataFrame, group: int | None, duration: int) -> DataFrame:
    """One row for each control of a group: id, node, variable, operator, structure_type, structure_id, type, values, duration.

    controls: (id, control_type, control_id, control_group_id, measure_group_id); measures: (id, measure_group_id,
    object_type, object_id), of which the last connection node of a group is where it measures; tables: (id, action_table,
    action_type, target_id, target_type, measure_variable). An action table lists `measured;action` joined by #; discharge
    coefficients take the action's first number twice. The operator is always >. Without a group there are no controls.
    Rows of an unknown action type, or of a table that is not there, have null values; other kinds than table controls are
    refused by `refused_controls`.
    """
    chosen = controls.where(F.col("control_group_id") == F.lit(group)) if group is not None else controls.limit(0)
    nodes = measures.where("object_type = 'v2_connection_nodes'").groupBy(F.col("measure_group_id").alias("_m")).agg(F.max_by("object_id", "id").alias("node"))
    entry = lambda e: F.split(e, ";")
    number = lambda t: t.try_cast("double")
    first = lambda e: number(F.get(F.split(F.get(entry(e), 1), " "), 0))
    rows = F.split("action_table", "#")
    one = F.transform(rows, lambda e: F.array(number(F.get(entry(e), 0)), number(F.get(entry(e), 1))))
    two = F.transform(rows, lambda e: F.array(number(F.get(entry(e), 0)), first(e), first(e)))
    values = F.when(F.col("action_type").isin(*ONE_VALUE), one).when(F.col("action_type") == TWO_VALUES, two)
    known = tables.select(F.col("id").alias("_t"), "target_type", "target_id", "action_type", _named(F.col("measure_variable"), MEASURED).alias("variable"), values.alias("values"))
    found = chosen.where("control_type = 'table'").join(nodes, F.col("measure_group_id") == F.col("_m"), "left").join(known, F.col("control_id") == F.col("_t"), "left")
    return found.select(
        "id", "node", "variable", F.lit(">").alias("operator"), F.col("target_type").alias("structure_type"), F.col("target_id").alias("structure_id"),
        F.col("action_type").alias("type"), "values", F.lit(duration).alias("duration"),
    )


def refused_controls(controls: DataFrame, group: int) -> DataFrame:
    """Controls of a group that are no table controls, which a simulation does not take."""
    return controls.where((F.col("control_group_id") == group) & F.coalesce(F.col("control_type") != "table", F.lit(True)))


def laterals(given: DataFrame, duration: int) -> DataFrame:
    """(id, connection_node, values, units, offset) of laterals (id, connection_node_id, timeseries of `minute,flow` lines):
    seconds and flows up to the first time beyond the duration, which is held at it. Lines without two numbers are left out."""
    steps = F.transform(parse_pairs(F.col("timeseries")), lambda p: F.struct((F.floor(p["x"]) * 60).alias("t"), p["y"].alias("q")))
    rows = given.select("id", "connection_node_id", steps.alias("_s"))
    beyond = F.array_position(F.transform("_s", lambda s: s["t"] > duration), True)
    kept = F.when(beyond > 0, F.slice("_s", 1, F.greatest(beyond, F.lit(1)).cast("int"))).otherwise(F.col("_s"))
    values = F.transform(kept, lambda s: F.array(F.least(s["t"], F.lit(duration)).cast("double"), s["q"]))
    return rows.select("id", F.col("connection_node_id").alias("connection_node"), values.alias("values"), F.lit("m3/s").alias("units"), F.lit(0).alias("offset"))


def boundaries(given: DataFrame) -> DataFrame:
    """(id, type, interpolate, values) of boundary conditions (id, timeseries of `time,value` lines)."""
    values = F.transform(parse_pairs(F.col("timeseries")), lambda p: F.array(p["x"], p["y"]))
    return given.select("id", F.lit("1D").alias("type"), F.lit(True).alias("interpolate"), values.alias("values"))


def aggregations(given: DataFrame) -> DataFrame:
    """(name, flow_variable, method, interval) of aggregation settings (var_name, flow_variable, aggregation_method, timestep)."""
    return given.select(F.col("var_name").alias("name"), _named(F.col("flow_variable"), FLOW_VARIABLES).alias("flow_variable"), F.col("aggregation_method").alias("method"), F.col("timestep").cast("int").alias("interval"))
