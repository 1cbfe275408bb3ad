"""Checks of structures, ground and paved surface, and the named queries over a network model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network, structures
from ..operators.relational import carry_min
from ..operators.rules import run_rules
from ..session import table
from .model import _LEVELS, _WITH, tables
from .registry import query

_SECTIONS = "sec AS (SELECT id AS section_id, channel_id, reference_level, CAST(id % 9 AS DOUBLE) * 10 AS off FROM cross_section_location)"
_ENDS = "ends AS (SELECT id AS ch, 'start' AS e, connection_node_id_start AS node FROM channel UNION ALL SELECT id, 'end', connection_node_id_end FROM channel)"


def _sides(name: str, start: str, end: str) -> str:
    return " UNION ALL ".join(f"SELECT id, code, '{s}' AS side, connection_node_id_{s} AS node, {level} AS level FROM {name}" for s, level in (("start", start), ("end", end)))


def _wrong(sides: str) -> str:
    """The lowest proposal of each section under a structure, written out."""
    return f"""{_SECTIONS}, {_ENDS}, sides AS ({sides}),
    near AS (SELECT s.*, ch, section_id, reference_level, CASE WHEN e = 'start' THEN off ELSE 100 - off END AS gap FROM sides s JOIN ends USING (node) JOIN sec ON channel_id = ch),
    one AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY code, side, ch ORDER BY gap NULLS LAST, section_id) = 1),
    low AS (SELECT code, side, node, level, min(reference_level) AS reference_level, arg_min(section_id, (reference_level, section_id)) AS section_id FROM one WHERE reference_level IS NOT NULL GROUP BY ALL),
    wrong AS (SELECT section_id, reference_level, code AS structure_code, side AS structure_side, level AS proposed_level FROM low WHERE level < reference_level AND node % 21 <> 0
      QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY level, code, side) = 1)"""


def _model(spark, d):
    """The model, its sections with their place on the channel, and the bottom levels of its nodes."""
    model = tables(spark, d)
    sections = model["cross_section_location"].select("id", "channel_id", "reference_level", ((F.col("id") % 9).cast("double") * 10).alias("offset"), F.lit(100.0).alias("length"))
    nodes = model["connection_node"].select("id", F.when(F.col("id") % 21 == 0, -1.0).alias("bottom_level"))
    return model, sections, nodes


_BED = _sides("culvert", "invert_level_start", "invert_level_end") + " UNION ALL " + _sides("orifice", "crest_level", "crest_level")


@query(f"""{_WITH}, {_wrong(_BED)},
    source AS (SELECT concat('d', id) AS code, CASE id % 3 WHEN 0 THEN 'bed_level_up' WHEN 1 THEN 'width;bed_level_down' END AS a FROM culvert UNION ALL SELECT concat('o', id), 'bottom_level' FROM orifice WHERE id % 2 = 0)
    SELECT w.*, EXISTS (SELECT 1 FROM source s WHERE s.code = structure_code AND (a = 'bottom_level' OR a LIKE CASE structure_side WHEN 'start' THEN '%bed_level_up%' ELSE '%bed_level_down%' END)) AS level_is_assumed FROM wrong w""")
def sections_over_structures(spark, d):
    """Sections over a culvert or orifice beside them, with the proposed level and whether it was assumed."""
    model, sections, nodes = _model(spark, d)
    culverts = structures.wrong_sections(model["culvert"], {"start": "invert_level_start", "end": "invert_level_end"}, model["channel"], sections, nodes)
    orifices = structures.wrong_sections(model["orifice"], {"start": "crest_level", "end": "crest_level"}, model["channel"], sections, nodes)
    text = F.when(F.col("id") % 3 == 0, "bed_level_up").when(F.col("id") % 3 == 1, "width;bed_level_down")
    sources = model["culvert"].select("code", text.alias("assumption")).unionByName(model["orifice"].where("id % 2 = 0").select("code", F.lit("bottom_level").alias("assumption")))
    return structures.with_assumptions(structures.lowest_of_section(culverts.unionByName(orifices)), sources)


@query(f"{_WITH}, {_wrong(_BED)} SELECT w.* FROM wrong w")
def sections_placed(spark, d):
    """Sections over a culvert or orifice beside them, where only points tell how far along a bent channel a section is."""
    model, sections, nodes = _model(spark, d)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    bent = F.array(*[at(F.lit(x), F.lit(y)) for x, y in ((0, 0), (40, 0), (40, 60))])
    first = F.col("offset") <= 40
    points = sections.withColumns({"x": F.when(first, F.col("offset")).otherwise(41.0), "y": F.when(first, -1.0).otherwise(F.col("offset") - 40)}).drop("offset", "length")
    placed = network.sections_on_channels(points, model["channel"].select("id", bent.alias("line")))
    culverts = structures.wrong_sections(model["culvert"], {"start": "invert_level_start", "end": "invert_level_end"}, model["channel"], placed, nodes)
    orifices = structures.wrong_sections(model["orifice"], {"start": "crest_level", "end": "crest_level"}, model["channel"], placed, nodes)
    return structures.lowest_of_section(culverts.unionByName(orifices))


_CONTROLLED = """acts AS (SELECT target_id, CAST(split_part(unnest(string_split(action_table, chr(10))), ',', 2) AS DOUBLE) AS y FROM table_control WHERE target_type = 'weir'),
    lowest AS (SELECT target_id, min(y) AS y FROM acts GROUP BY 1), weirs AS (SELECT w.*, least(w.crest_level, y) AS least_level FROM weir w LEFT JOIN lowest ON target_id = w.id)"""


@query(f"""{_WITH}, {_CONTROLLED}, {_wrong(_sides("weirs", "least_level", "least_level"))}
    SELECT l.id, coalesce(proposed_level, l.reference_level) AS reference_level, structure_code FROM cross_section_location l LEFT JOIN wrong ON section_id = l.id""")
def floors_under_weirs(spark, d):
    """Reference levels after those over a weir's lowest crest, as controlled, are lowered to it."""
    model, sections, nodes = _model(spark, d)
    lowest = network.control_overview(model).where("target_type = 'weir'").groupBy(F.col("target_id").alias("_weir")).agg(F.min("min_action").alias("_low"))
    weirs = model["weir"].join(lowest, F.col("id") == F.col("_weir"), "left").withColumn("least_level", F.least("crest_level", "_low"))
    wrong = structures.wrong_sections(weirs, {"start": "least_level", "end": "least_level"}, model["channel"], sections, nodes)
    updated = structures.with_proposals(model["cross_section_location"], wrong)
    return updated.join(wrong.select(F.col("section_id").alias("id"), "structure_code"), "id", "left").select("id", "reference_level", "structure_code")


_TEXTS = "CASE WHEN p_partkey % 3 = 0 THEN '1 2' WHEN p_partkey % 3 = 1 THEN '1 2 3' END"


@query(f"""
    WITH c AS (SELECT p_partkey AS id, p_size % 4 AS shape, {_TEXTS} AS h, CASE WHEN p_partkey % 5 < 3 THEN '0.5 1' ELSE '0.5 1 4' END AS w FROM part)
    SELECT 'cross_section_location' AS table_name, id, 'WARNING: cross section definition height not used for shape type 1' AS error FROM c WHERE h IS NOT NULL AND shape = 1
    UNION ALL SELECT 'cross_section_location', id, 'ERROR: multiple height and width entries must have the same count' FROM c WHERE len(string_split(h, ' ')) <> len(string_split(w, ' '))""")
def section_entries(spark, d):
    """Heights and widths of tabulated sections: unused or of unequal number."""
    width = F.when(F.col("p_partkey") % 5 < 3, "0.5 1").otherwise("0.5 1 4")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("cross_section_shape"), F.expr(_TEXTS).alias("cross_section_height"), width.alias("cross_section_width"))
    return run_rules({"cross_section_location": rows}, structures.section_entry_rules())


@query("""
    WITH m AS (SELECT max(l_extendedprice / 100) AS v FROM lineitem)
    SELECT v AS highest, v > 400 AS too_high, v IS NULL OR v <= 400 AS fits FROM m""")
def ground_maximum(spark, d):
    """The highest ground against its limit."""
    found = structures.ground_verdict(table(spark, d, "lineitem").select((F.col("l_extendedprice") / 100).alias("value")))
    return found.select("highest", "too_high", F.col("message").endswith("norm").alias("fits"))


@query("""
    WITH g AS (SELECT p_partkey AS id, CAST(p_partkey * 7 % 101 AS INT) AS px, CAST(p_partkey * 13 % 103 AS INT) AS py, CAST(p_size % 12 AS DOUBLE) AS v FROM part),
    b AS (SELECT s_suppkey % 9 / 4.0 AS lv, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS rx, CAST(s_suppkey * 91 % 1009 AS DOUBLE) AS ry FROM supplier),
    l AS (SELECT id, max(lv) AS lv FROM g, b WHERE px * 10 + 5 > rx + 0.25 AND py * 10 + 5 > ry + 0.25 AND (px * 10 + 5 - rx - 0.25) / 60 + (py * 10 + 5 - ry - 0.25) / 45 < 1 GROUP BY 1)
    SELECT g.id, round(CASE WHEN v <> 10 THEN v - lv END, 6) AS depth FROM g LEFT JOIN l USING (id)""")
def dewatering_depths(spark, d):
    """Ground over the level of the area around each pixel."""
    ground = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 101).alias("px"), (F.col("p_partkey") * 13 % 103).alias("py"), (F.col("p_size") % 12).cast("double").alias("value"))
    x, y = (F.col("s_suppkey") * 37 % 1000).cast("double") + 0.25, (F.col("s_suppkey") * 91 % 1009).cast("double") + 0.25
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    areas = table(spark, d, "supplier").select(((F.col("s_suppkey") % 9) / 4).alias("level"), F.array(corner(0.0, 0.0), corner(60.0, 0.0), corner(0.0, 45.0), corner(0.0, 0.0)).alias("ring"))
    return structures.dewatering_depth(ground, areas, "level", 10.0).select("id", F.round("value", 6).alias("depth"))


@query("""
    SELECT *, paved_ha - polder_ha AS difference_ha FROM (SELECT CAST(trunc(sum(p_retailprice) / 10000) AS BIGINT) AS paved_ha FROM part), (SELECT CAST(trunc(sum(abs(s_acctbal)) / 10000) AS BIGINT) AS polder_ha FROM supplier)""")
def paved_area(spark, d):
    """Paved surface against the polder, in whole hectares."""
    polder = table(spark, d, "supplier").select(F.abs("s_acctbal").alias("a"))
    return structures.paved_summary(table(spark, d, "part"), "p_retailprice", polder, "a")


@query(f"""{_WITH} SELECT w.id, w.code, k.id AS control_id, c.id AS channel_id, x.id AS section_id, x.reference_level FROM weir w JOIN table_control k ON k.target_id = w.id AND k.target_type = 'weir'
    LEFT JOIN channel c ON w.connection_node_id_end IN (c.connection_node_id_start, c.connection_node_id_end) OR w.connection_node_id_start IN (c.connection_node_id_start, c.connection_node_id_end)
    LEFT JOIN cross_section_location x ON x.channel_id = c.id""")
def weir_channels(spark, d):
    """Controlled weirs with the sections of the channels at either of their nodes."""
    model = tables(spark, d)
    return structures.control_channels(model["weir"], model["table_control"], "weir", model["channel"], model["cross_section_location"])


@query(f"""{_WITH} SELECT t.id, t.code, min(x.id) AS section_id, arg_min(x.reference_level, x.id) FILTER (WHERE x.id = f) AS reference_level, any_value({"b"}.initial_water_level) AS level_end
    FROM channel t {_LEVELS} LEFT JOIN (SELECT *, min(id) OVER (PARTITION BY channel_id) AS f FROM cross_section_location) x ON x.channel_id = t.id GROUP BY 1, 2""")
def channel_profiles(spark, d):
    """Every channel once, with its first section (by id) and the level of its end node."""
    model = tables(spark, d)
    first = carry_min(model["cross_section_location"].where("channel_id IS NOT NULL"), ["channel_id"], [F.col("id")], ["id", "reference_level"]).select("channel_id", F.col("id").alias("section_id"), "reference_level")
    found = network.with_levels(model["channel"], model["connection_node"])
    return found.join(first, F.col("id") == F.col("channel_id"), "left").select("id", "code", "section_id", "reference_level", "level_end")


_DEFINED = "CAST(w.id * 3 % 150 AS BIGINT)"


@query(f"{_WITH} SELECT p_partkey AS id, p_size AS width FROM part WHERE p_partkey IN (SELECT {_DEFINED} FROM weir w JOIN table_control k ON k.target_id = w.id)")
def definitions_of_controlled(spark, d):
    """Section definitions that controlled weirs use: a semi-join, however many weirs share one."""
    model = tables(spark, d)
    used = model["weir"].join(model["table_control"], F.col("target_id") == model["weir"]["id"], "left_semi").select((F.col("id") * 3 % 150).alias("_used"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("width")).join(used, F.col("id") == F.col("_used"), "left_semi")


@query(f"""{_WITH} SELECT w.id, w.code, {_DEFINED} AS definition_id, p_size AS old_width, p_size * 10 AS new_width FROM weir w JOIN part ON p_partkey = {_DEFINED} JOIN table_control k ON k.target_id = w.id""")
def widened_weirs(spark, d):
    """Controlled weirs with the width of their definition, and ten times that."""
    model = tables(spark, d)
    weirs = model["weir"].select("id", "code", (F.col("id") * 3 % 150).cast("long").alias("definition_id"))
    widths = table(spark, d, "part").select(F.col("p_partkey").alias("_definition"), F.col("p_size").alias("old_width"))
    found = weirs.join(widths, F.col("definition_id") == F.col("_definition")).join(model["table_control"].select("target_id"), F.col("id") == F.col("target_id"))
    return found.select("id", "code", "definition_id", "old_width", (F.col("old_width") * 10).alias("new_width"))


@query(f"{_WITH} SELECT t.id, a.initial_water_level AS level_start FROM channel t {_LEVELS}")
def channel_start_levels(spark, d):
    model = tables(spark, d)
    return network.with_levels(model["channel"], model["connection_node"]).select("id", "level_start")


_KINDS = ("weir", "orifice", "culvert")


@query(f"""{_WITH}, z AS (SELECT *, id % 3 + 2 AS zoom FROM channel), n AS (SELECT connection_node_id_start AS n FROM z WHERE zoom = 4 UNION SELECT connection_node_id_end FROM z WHERE zoom = 4),
    s AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, id, connection_node_id_start AS a, connection_node_id_end AS b FROM {k}" for k in _KINDS)})
    SELECT 'channel' AS kind, id, zoom = 4 AS is_primary FROM z UNION ALL SELECT kind, id, EXISTS (SELECT 1 FROM n WHERE n = a) AND EXISTS (SELECT 1 FROM n WHERE n = b) FROM s""")
def primary_network(spark, d):
    """Channels and structures of the primary network."""
    model = tables(spark, d)
    lines = [model[k].select(F.lit(k).alias("kind"), "id", "connection_node_id_start", "connection_node_id_end") for k in _KINDS]
    return network.primary_lines(model["channel"].withColumn("zoom", F.col("id") % 3 + 2), lines[0].unionByName(lines[1]).unionByName(lines[2]), "zoom")


_LEAKS = """l AS (SELECT id, CAST(id % 200 AS BIGINT) AS node, CAST(id % 10 AS DOUBLE) / 2 AS dpumax, CASE WHEN id % 4 > 0 THEN CAST(id % 9 AS DOUBLE) / 3 END AS held FROM (SELECT p_partkey AS id FROM part)),
    x AS (SELECT CAST(l_partkey AS BIGINT) AS line_id, CASE WHEN l_linenumber % 2 = 0 THEN 'boundary' ELSE 'obstacle' END AS kind, CASE WHEN l_quantity > 5 THEN l_quantity / 12 END AS crest FROM lineitem),
    t AS (SELECT line_id, max(crest) AS crest, max(kind) AS kind FROM (SELECT *, max(crest) OVER (PARTITION BY line_id) AS top FROM x) WHERE crest = top GROUP BY 1),
    f AS (SELECT l.*, kind, crest, coalesce(dpumax < crest, FALSE) OR coalesce(dpumax < held, FALSE) AS leaks FROM l LEFT JOIN t ON line_id = id)"""


def _leaking(spark, d):
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 200).alias("node"), ((F.col("p_partkey") % 10).cast("double") / 2).alias("dpumax"), F.when(F.col("p_partkey") % 4 > 0, (F.col("p_partkey") % 9).cast("double") / 3).alias("held"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "boundary").otherwise("obstacle")
    crossings = table(spark, d, "lineitem").select(F.col("l_partkey").alias("line_id"), kind.alias("kind"), F.when(F.col("l_quantity") > 5, F.col("l_quantity") / 12).alias("crest_level"))
    return network.leaking_lines(lines, crossings, "held")


@query(f"WITH {_LEAKS} SELECT id, kind, round(crest, 6) AS crest_level, leaks FROM f")
def leaks(spark, d):
    """Lines with their highest crossing, and whether water leaks over them."""
    return _leaking(spark, d).select("id", "kind", F.round("crest_level", 6).alias("crest_level"), "leaks")


@query(f"""WITH {_LEAKS}, k AS (SELECT node, round(max(crest), 6) AS crest FROM f WHERE leaks GROUP BY 1),
    n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 25 AS DOUBLE) END AS storage, c_custkey % 8 = 0 AS apart FROM customer)
    SELECT id, CASE WHEN apart THEN 1 ELSE 2 END AS calculation_type, CASE WHEN apart THEN 99.0 ELSE crest END AS drain_level, CASE WHEN apart THEN 10.0 END AS surface_level, CASE WHEN apart THEN -10.0 END AS bottom_level,
      CASE WHEN apart THEN storage ELSE greatest(storage, 10) END AS storage_area FROM n LEFT JOIN k ON node = id WHERE apart OR node IS NOT NULL""")
def manholes_for_leaks(spark, d):
    """Manholes that keep water from leaking, or from nodes that do not share the level of their area."""
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") % 25).cast("double")).alias("storage_area"))
    leaking = _leaking(spark, d).where("leaks").select(F.col("node").alias("id"), "crest_level")
    return network.manhole_proposals(nodes, nodes.where("id % 8 = 0"), leaking).withColumn("drain_level", F.round("drain_level", 6))
