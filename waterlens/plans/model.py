"""Checks and analyses of a whole network model, whose tables are made of the data tables by plain SQL.

The definitions of the model's tables run on both engines; the oracles write each check out anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network
from ..session import table
from .registry import query

_SOURCES = ("customer", "supplier", "part", "nation")
_LINE = "connection_node_id_start, {end} AS connection_node_id_end"
MODEL: dict[str, str] = {
    "connection_node": "SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS DOUBLE) / 4 END AS initial_water_level FROM {customer}",
    "channel": """SELECT s_suppkey AS id, concat('c', s_suppkey) AS code, s_suppkey * 2 AS connection_node_id_start, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey * 2 + s_suppkey % 4 END AS connection_node_id_end,
        100 + s_suppkey % 2 AS exchange_type, CAST(s_suppkey % 7 AS DOUBLE) * 125 AS meters FROM {supplier}""",
    "cross_section_location": """SELECT p_partkey AS id, p_partkey % 150 AS channel_id, CASE WHEN p_partkey % 19 <> 0 THEN CAST(p_partkey % 4 AS DOUBLE) / 2 - 1 END AS reference_level,
        CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN 1 ELSE 6 END AS cross_section_shape, concat('0,0', chr(10), '0.5,2', chr(10), '2,4') AS cross_section_table FROM {part}""",
    "weir": """SELECT s_suppkey AS id, concat('w', s_suppkey) AS code, s_suppkey AS connection_node_id_start, CASE WHEN s_suppkey % 11 = 0 THEN s_suppkey ELSE s_suppkey + 1 END AS connection_node_id_end,
        CASE WHEN s_suppkey % 8 = 0 THEN CAST(15 AS DOUBLE) ELSE CAST(s_suppkey % 6 AS DOUBLE) / 4 END AS crest_level, CASE WHEN s_suppkey % 9 <> 0 THEN 5 END AS cross_section_shape FROM {supplier}""",
    "orifice": """SELECT s_suppkey AS id, concat('o', s_suppkey) AS code, s_suppkey + 3 AS connection_node_id_start, CASE WHEN s_suppkey % 23 = 0 THEN s_suppkey + 3 ELSE s_suppkey + 5 END AS connection_node_id_end,
        CAST(s_suppkey % 6 AS DOUBLE) / 8 AS crest_level, CAST(s_suppkey % 3 AS DOUBLE) AS discharge_coefficient_positive, CAST(1 AS DOUBLE) AS discharge_coefficient_negative, CASE WHEN s_suppkey % 10 <> 0 THEN 5 END AS cross_section_shape FROM {supplier}""",
    "culvert": """SELECT s_suppkey AS id, concat('d', s_suppkey) AS code, s_suppkey + 7 AS connection_node_id_start, CASE WHEN s_suppkey % 29 = 0 THEN s_suppkey + 7 ELSE s_suppkey + 9 END AS connection_node_id_end,
        CAST(s_suppkey % 5 AS DOUBLE) / 8 AS invert_level_start, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 3 AS DOUBLE) / 8 END AS invert_level_end, CAST(1 AS DOUBLE) AS discharge_coefficient_positive,
        CAST(s_suppkey % 2 AS DOUBLE) AS discharge_coefficient_negative, CASE WHEN s_suppkey % 12 <> 0 THEN 5 END AS cross_section_shape FROM {supplier}""",
    "pipe": "SELECT s_suppkey AS connection_node_id_start, s_suppkey AS connection_node_id_end FROM {supplier} WHERE s_suppkey < 0",
    "pump": "SELECT n_nationkey AS id, n_nationkey + 2 AS connection_node_id, CAST(n_nationkey % 4 AS DOUBLE) / 4 AS start_level FROM {nation}",
    "pump_map": "SELECT n_nationkey AS pump_id, n_nationkey + 2 + n_nationkey % 3 AS connection_node_id_end FROM {nation}",
    "surface": "SELECT p_partkey AS id FROM {part} WHERE p_partkey % 7 <> 0",
    "surface_map": """SELECT p_partkey + p_partkey % 2 AS id, CASE WHEN p_partkey % 31 <> 0 THEN p_partkey END AS surface_id, CASE WHEN p_partkey % 37 = 0 THEN -1 ELSE p_partkey % 800 + 1 END AS connection_node_id,
        CASE WHEN p_partkey % 41 = 0 THEN CAST(100 AS DOUBLE) ELSE CAST(p_partkey % 50 AS DOUBLE) END AS percentage FROM {part} WHERE p_partkey % 5 <> 0""",
    "boundary_condition_1d": "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 = 0 THEN -5 ELSE n_nationkey + 1 END AS connection_node_id FROM {nation}",
    "table_control": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'weir' ELSE 'orifice' END AS target_type, CASE WHEN s_suppkey % 14 = 0 THEN -1 ELSE s_suppkey END AS target_id,
        concat(s_suppkey % 9, ',1.5', chr(10), '10,', s_suppkey % 4, '.25', CASE WHEN s_suppkey % 30 = 0 THEN repeat(concat(chr(10), '11,1.0'), 200) ELSE '' END) AS action_table FROM {supplier}""",
}


def tables(spark, d) -> dict:
    given = {name: table(spark, d, name) for name in _SOURCES}
    return {name: spark.sql(sql, **given) for name, sql in MODEL.items()}


_WITH = "WITH " + ",\n".join(f"{name} AS ({sql.format(**{s: s for s in _SOURCES})})" for name, sql in MODEL.items())
_LEVELS = "LEFT JOIN connection_node a ON a.id = t.connection_node_id_start LEFT JOIN connection_node b ON b.id = t.connection_node_id_end"


def _rule(name: str, message: str, where: str, joins: str = "") -> str:
    return f"SELECT '{name}' AS table_name, t.id AS id, {message} AS error FROM {name} t {joins} WHERE {where}"


_LA, _LB = "a.initial_water_level", "b.initial_water_level"
_TWO = f"concat('WARNING: initial water level at start and end node are not equal ', {_LA}, ', ', {_LB})"
_ENDS = " UNION ALL ".join(
    [f"SELECT connection_node_id_{side} AS n FROM {name}" for name in ("channel", "pipe", "weir", "orifice", "culvert") for side in ("start", "end")]
    + ["SELECT connection_node_id FROM pump", "SELECT connection_node_id_end FROM pump_map"]
)
_FLOWS = "t.discharge_coefficient_positive <> 0 AND t.discharge_coefficient_negative <> 0"
_RULES = [
    _rule("surface_map", "'ERROR: impervious surface map refers to non-existent node'", "t.connection_node_id NOT IN (SELECT id FROM connection_node)"),
    _rule("surface", "'WARNING: surface is not in mapping table'", "t.id NOT IN (SELECT surface_id FROM surface_map WHERE surface_id IS NOT NULL)"),
    _rule("surface_map", "'WARNING: surface map is not in surface layer'", "t.id NOT IN (SELECT id FROM surface)"),
    _rule("connection_node", "'WARNING: connection node without impervious surface'", "t.id IN (SELECT connection_node_id FROM surface_map WHERE surface_id NOT IN (SELECT id FROM surface))"),
    _rule("channel", "'ERROR: channel without cross section location'", "NOT EXISTS (SELECT 1 FROM cross_section_location x WHERE x.channel_id = t.id)"),
    _rule("cross_section_location", "'ERROR: cross section location has no definition shape'", "cross_section_shape IS NULL"),
    *[_rule(n, f"'ERROR: {n} has no definition shape'", "cross_section_shape IS NULL") for n in ("culvert", "weir", "orifice")],
    _rule("boundary_condition_1d", "'WARNING: 1d boundary without connection node'", "c.id IS NULL", "LEFT JOIN connection_node c ON c.id = t.connection_node_id"),
    _rule("cross_section_location", "'ERROR: cross section location without reference level'", "reference_level IS NULL"),
    _rule("connection_node", "'WARNING: connection node without initial waterlevel'", "initial_water_level IS NULL"),
    _rule("connection_node", "'ERROR: node without connection'", f"t.id NOT IN (SELECT n FROM ({_ENDS}) WHERE n IS NOT NULL)"),
    _rule("pump", "'WARNING: start level for pump station not close to initial waterlevel'", "abs(c.initial_water_level - t.start_level) > 0.05", "LEFT JOIN connection_node c ON c.id = t.connection_node_id"),
    _rule("pump", "'ERROR: pumpstation from and to the same connection node'", "m.connection_node_id_end = t.connection_node_id", "JOIN pump_map m ON m.pump_id = t.id"),
    *[_rule(n, f"'ERROR: {n} from and to the same connection node'", "t.connection_node_id_start = t.connection_node_id_end") for n in ("weir", "orifice", "culvert")],
    _rule("weir", f"concat('WARNING: start level ', t.crest_level, ' not close to initial waterlevel ', {_LA}, ', ', {_LB})", f"abs({_LA} - t.crest_level) > 0.05 AND abs({_LB} - t.crest_level) > 0.05 AND t.crest_level <> 15", _LEVELS),
    _rule("channel", _TWO, f"{_LA} <> {_LB}", _LEVELS),
    _rule("orifice", _TWO, f"{_LA} <> {_LB} AND {_FLOWS} AND t.crest_level < greatest({_LA}, {_LB})", _LEVELS),
    _rule("culvert", _TWO, f"{_LA} <> {_LB} AND {_FLOWS} AND t.invert_level_end IS NOT NULL AND greatest(t.invert_level_start, t.invert_level_end) < greatest({_LA}, {_LB})", _LEVELS),
    _rule("surface_map", "'WARNING: percentage = 100 and should be 14.4 or 11.5'", "percentage = 100"),
    _rule("table_control", "'ERROR: action_table has more than 1000 characters (model will crash)'", "length(action_table) > 1000"),
]


@query(_WITH + "\n" + "\nUNION ALL ".join(_RULES))
def model_checks(spark, d):
    """Every check of the model in one report."""
    found = network.check_model(tables(spark, d))
    return found.select("table_name", F.col("id").cast("long").alias("id"), "error")


@query(f"""{_WITH}, r AS (
      SELECT t.id, target_type, target_id, CASE target_type WHEN 'weir' THEN w.code ELSE o.code END AS target_code, action_table FROM table_control t
      LEFT JOIN weir w ON target_type = 'weir' AND w.id = target_id LEFT JOIN orifice o ON target_type = 'orifice' AND o.id = target_id),
    p AS (SELECT id, CAST(split_part(x, ',', 1) AS DOUBLE) AS x, CAST(split_part(x, ',', 2) AS DOUBLE) AS y FROM (SELECT id, unnest(string_split(action_table, chr(10))) AS x FROM r)),
    m AS (SELECT id, min(y) AS min_action, max(y) AS max_action, arg_min(y, (x, y)) AS start_action, count(*) AS n_steps FROM p GROUP BY 1)
    SELECT r.id, target_type, target_id, target_code, start_action, min_action, max_action, n_steps FROM r JOIN m USING (id)""")  # fmt: skip
def controlled_structures(spark, d):
    """Target, first, lowest and highest action of every table control."""
    found = network.control_overview(tables(spark, d))
    return found.select("id", "target_type", "target_id", "target_code", "start_action", "min_action", "max_action", F.size(F.split("sorted_table", r"[\n#]")).cast("long").alias("n_steps"))


@query(f"""{_WITH} SELECT round(sum(CASE WHEN exchange_type = 101 THEN meters ELSE 0 END) / 1000, 2) AS isolated_km, round(sum(meters) / 1000, 2) AS total_km,
      round(sum(CASE WHEN exchange_type = 101 THEN meters ELSE 0 END) / sum(meters) * 100, 0) AS isolated_percent FROM channel""")
def isolated_channel_lengths(spark, d):
    """Length of isolated channels and of all, and the percentage."""
    return network.isolated_channels(tables(spark, d)["channel"], "meters")


@query(f"""{_WITH}, x AS (
      SELECT s.channel_id, ({_LA} + {_LB}) / 2 - s.reference_level AS depth, s.cross_section_shape AS shape
      FROM cross_section_location s JOIN channel t ON t.id = s.channel_id {_LEVELS}),
    w AS (SELECT *, CASE WHEN shape = 6 THEN round(CASE WHEN depth <= 0 THEN 0 WHEN depth <= 0.5 THEN depth * 4 WHEN depth <= 2 THEN 2 + (depth - 0.5) / 1.5 * 2 WHEN depth > 2 THEN 4 END, 2) END AS width FROM x)
    SELECT channel_id, round(avg(depth), 6) AS mean_depth, min(depth) AS min_depth, max(depth) AS max_depth, round(avg(width), 6) AS mean_width, min(width) AS min_width, max(width) AS max_width, count(*) AS n_sections FROM w GROUP BY 1""")
def profiles_of_channels(spark, d):
    """Depth and width of the cross-sections of every channel at its initial level."""
    model = tables(spark, d)
    found = network.used_profiles(model["channel"], model["cross_section_location"], model["connection_node"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean_depth", "mean_width")})
