"""Small cases of the structure checks and of variants: nulls, ties, empty tables, nothing found."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from waterlens.operators import structures, variants

CHANNELS = "id LONG, connection_node_id_start LONG, connection_node_id_end LONG"
SECTIONS = "id LONG, channel_id LONG, reference_level DOUBLE, offset DOUBLE, length DOUBLE"
WEIRS = "id LONG, code STRING, connection_node_id_start LONG, connection_node_id_end LONG, crest_level DOUBLE"
BOTH = {"start": "crest_level", "end": "crest_level"}


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def wrong(spark, weirs, bottoms=()):
    channels = spark.createDataFrame([(1, 10, 11), (2, 11, 12)], CHANNELS)
    sections = spark.createDataFrame([(5, 1, 0.5, 0.0, 100.0), (6, 1, 2.0, 90.0, 100.0), (7, 2, 1.0, 10.0, 100.0), (8, 2, None, 95.0, 100.0)], SECTIONS)
    nodes = spark.createDataFrame([(n, -1.0 if n in bottoms else None) for n in (10, 11, 12)], "id LONG, bottom_level DOUBLE")
    return structures.wrong_sections(spark.createDataFrame(weirs, WEIRS), BOTH, channels, sections, nodes)


def test_sections_over_structures(spark):
    # At node 11 the nearest sections are 6 (2.0) and 7 (1.0): the lower one is meant. Node 12 has only a null level.
    weirs = [(1, "a", 11, 12, 0.9), (2, "b", 12, 11, 0.7), (3, "c", 11, None, None)]
    assert rows(wrong(spark, weirs), "section_id", "reference_level", "structure_code", "structure_side", "proposed_level") == [(7, 1.0, "b", "end", 0.7)]
    assert rows(wrong(spark, weirs, (11,)), "section_id") == []
    assert rows(wrong(spark, [(1, "a", 11, 12, 1.0)]), "section_id") == []  # equal is not under
    assert rows(wrong(spark, []), "section_id") == []


def test_assumptions_and_proposals(spark):
    found = wrong(spark, [(1, "a", 11, 12, 0.9)])
    for text, assumed in (("bed_level_up", True), ("bed_level_down", False), ("width;bottom_level", True), (None, False)):
        sources = spark.createDataFrame([("a", text), ("a", text), ("z", "bed_level_up")], "code STRING, assumption STRING")
        assert rows(structures.with_assumptions(found, sources), "section_id", "level_is_assumed") == [(7, assumed)]
    sections = spark.createDataFrame([(7, 1.0), (8, None)], "id LONG, reference_level DOUBLE")
    assert rows(structures.with_proposals(sections, found), "id", "reference_level") == [(7, 0.9), (8, None)]
    excluded = spark.createDataFrame([(7,)], "id LONG")
    assert rows(structures.with_proposals(sections, found, excluded), "id", "reference_level") == [(7, 1.0), (8, None)]


def test_section_entry_rules(spark):
    assert structures.section_entry_rules(strict_parity=True) == []
    table = spark.createDataFrame([(1, 1, "1", "1"), (2, 6, "1 2", "1"), (3, 1, None, "1 2")], "id LONG, cross_section_shape INT, cross_section_height STRING, cross_section_width STRING")
    from waterlens.operators.rules import run_rules

    found = run_rules({"cross_section_location": table}, structures.section_entry_rules())
    assert rows(found, "id", "error") == [(1, structures.HEIGHT_UNUSED), (2, structures.COUNTS_DIFFER)]


def test_ground_and_paved(spark):
    ground = lambda values: structures.ground_verdict(spark.createDataFrame([(v,) for v in values], "value DOUBLE")).collect()[0]
    assert tuple(ground([1.5, None, 400.0]))[:2] == (400.0, False)
    assert tuple(ground([400.5])) == (400.5, True, "Maximale waarde DEM: 400.5 is te hoog")
    assert tuple(ground([]))[:2] == (None, False)
    area = lambda values: spark.createDataFrame([(v,) for v in values], "a DOUBLE")
    assert tuple(structures.paved_summary(area([15000.0, 14999.0, None]), "a", area([9999.0]), "a").collect()[0]) == (2, 0, 2)
    assert tuple(structures.paved_summary(area([]), "a", area([]), "a").collect()[0]) == (0, None, None)


def test_control_channels_keep_structures_without_channels(spark):
    weirs = spark.createDataFrame([(1, "a", 10, 11, 0.0), (2, "b", 90, 91, 0.0), (3, "c", 10, 11, 0.0)], WEIRS)
    controls = spark.createDataFrame([(7, "weir", 1), (8, "weir", 2), (9, "pump", 3)], "id LONG, target_type STRING, target_id LONG")
    channels = spark.createDataFrame([(1, 10, 11), (2, 11, None)], CHANNELS)
    sections = spark.createDataFrame([(5, 1, 0.5, 0.0, 1.0)], SECTIONS)
    found = structures.control_channels(weirs, controls, "weir", channels, sections)
    assert rows(found, "id", "channel_id", "section_id") == [(1, 1, 5), (1, 2, None), (2, None, None)]


def test_updates(spark):
    base = spark.createDataFrame([(1, 10, "x"), (2, 20, "y"), (3, None, None)], "id LONG, n INT, t STRING")
    numbers = spark.createDataFrame([(1, 11), (1, 12), (2, None), (9, 9)], "id LONG, value INT")
    texts = spark.createDataFrame([(3, "z")], "id LONG, value STRING")
    assert rows(variants.apply_updates(base, "id", {"n": numbers, "t": texts}), "id", "n", "t") == [(1, 12, "x"), (2, 20, "y"), (3, None, "z")]


def test_names_and_columns(spark):
    names = ["m #12 x", "m #7", "m #a", "m", None, "m #3#4", "m #12x"]
    found = spark.createDataFrame(list(enumerate(names)), "k INT, name STRING").select("k", variants.revision_number(F.col("name")).alias("n"))
    assert [n for _, n in rows(found, "k", "n")] == [12, 7, 0, 0, 0, 3, 0]
    with pytest.raises(ValueError, match="k"):
        variants.refuse_columns(found, ["k", "z"])
    assert variants.refuse_columns(found, ["z"]) is found


def test_column_findings(spark):
    df = spark.createDataFrame([(1, 5, 9), (2, 0, 9), (3, 9, 9), (4, None, None)], "id LONG, a INT, b INT")
    rules = [{"id": 1, "column": "a", "min": 1}, {"id": 2, "column": "a", "max": 8}, {"id": 3, "column": "a", "less_than": "b"}]
    assert rows(variants.column_findings(df, "id", rules), "id", "invalid") == [(2, "1"), (3, "2;3")]
    rules[2]["or_equal"] = True
    assert rows(variants.column_findings(df, "id", rules), "id", "invalid") == [(2, "1"), (3, "2")]


def test_rules_overview_of_odd_documents(spark):
    texts = ['{"object": "weir", "validation_rules": [{"id": 120, "name": "n", "active": true}, {"id": 2, "name": "off", "active": false}]}', "{", None, "{}"]
    found = variants.rules_overview(spark.createDataFrame([(t,) for t in texts], "text STRING"))
    assert rows(found, "origin", "object", "id", "kind", "name", "description") == [("own", "weir", 120, "validation rules", "n", "")]


def test_scenarios_without_raster(spark):
    scenarios = spark.createDataFrame([(1,), (2,)], "s LONG")
    pixels = spark.createDataFrame([(1, 2.0), (1, None), (7, 1.0)], "s LONG, depth DOUBLE")
    assert rows(variants.scenario_metadata(scenarios, pixels, "s", "depth", 0.5), "s", "max", "volume") == [(1, 2.0, 1.0), (2, None, 0.0)]
