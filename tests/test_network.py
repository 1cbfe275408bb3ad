"""Checks and analyses of a network model on a small one, with each rule broken once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from waterlens.operators import graph, network


@pytest.fixture(scope="module")
def model(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    line = "id long, code string, connection_node_id_start long, connection_node_id_end long"
    return {
        "connection_node": make([(1, 1.0), (2, 1.0), (3, 2.0), (4, None), (5, 1.0), (9, 1.0)], "id long, initial_water_level double"),
        "channel": make([(1, "c1", 1, 2, 100), (2, "c2", 2, 3, 101), (3, "c3", 1, None, 100)], line + ", exchange_type int"),
        "cross_section_location": make([(1, 1, 0.0, 6, "0,0\n0.5,2\n2,4"), (2, 1, 0.75, 6, "0,0\n0.5,2"), (3, 2, None, None, None), (4, 2, 0.5, 1, None)], "id long, channel_id long, reference_level double, cross_section_shape int, cross_section_table string"),
        "weir": make([(1, "w1", 1, 2, 5.0, 5), (2, "w2", 1, 1, 15.0, 5), (3, "w3", 1, 2, 1.01, None)], line + ", crest_level double, cross_section_shape int"),
        "orifice": make([(1, "o1", 1, 3, 0.5, 1.0, 1.0, 5), (2, "o2", 1, 3, 0.5, 0.0, 1.0, 5), (3, "o3", 1, 4, 0.5, 1.0, 1.0, 5)], line + ", crest_level double, discharge_coefficient_positive double, discharge_coefficient_negative double, cross_section_shape int"),
        "culvert": make([(1, "d1", 3, 1, 0.1, 0.2, 1.0, 1.0, 5), (2, "d2", 3, 1, 0.1, None, 1.0, 1.0, 5), (3, "d3", 5, 5, 0.1, 0.2, 1.0, 1.0, 5)], line + ", invert_level_start double, invert_level_end double, discharge_coefficient_positive double, discharge_coefficient_negative double, cross_section_shape int"),
        "pipe": make([], "connection_node_id_start long, connection_node_id_end long"),
        "pump": make([(1, 1, 1.2), (2, 1, 1.04), (3, 4, 7.0)], "id long, connection_node_id long, start_level double"),
        "pump_map": make([(1, 2), (2, 1)], "pump_id long, connection_node_id_end long"),
        "surface": make([(1,), (2,)], "id long"),
        "surface_map": make([(1, 1, 1, 14.4), (2, 7, 5, 100.0), (8, 1, 99, 11.5), (9, None, None, None)], "id long, surface_id long, connection_node_id long, percentage double"),
        "boundary_condition_1d": make([(1, 1), (2, 88)], "id long, connection_node_id long"),
        "table_control": make([(1, "weir", 1, "2,0.5\n1,0.7"), (2, "orifice", 9, "1,1\n" * 300)], "id long, target_type string, target_id long, action_table string"),
    }


def test_every_rule_reports_its_rows(model):
    found = {(r["table_name"], r["id"], r["error"]) for r in network.check_model(model).collect()}
    expected = {
        ("surface_map", 8, "ERROR: impervious surface map refers to non-existent node"), ("surface", 2, "WARNING: surface is not in mapping table"),
        ("surface_map", 8, "WARNING: surface map is not in surface layer"), ("surface_map", 9, "WARNING: surface map is not in surface layer"),
        ("connection_node", 5, "WARNING: connection node without impervious surface"), ("channel", 3, "ERROR: channel without cross section location"),
        ("cross_section_location", 3, "ERROR: cross section location has no definition shape"), ("weir", 3, "ERROR: weir has no definition shape"),
        ("boundary_condition_1d", 2, "WARNING: 1d boundary without connection node"), ("cross_section_location", 3, "ERROR: cross section location without reference level"),
        ("connection_node", 4, "WARNING: connection node without initial waterlevel"), ("connection_node", 9, "ERROR: node without connection"),
        ("pump", 1, "WARNING: start level for pump station not close to initial waterlevel"), ("pump", 2, "ERROR: pumpstation from and to the same connection node"),
        ("weir", 2, "ERROR: weir from and to the same connection node"), ("culvert", 3, "ERROR: culvert from and to the same connection node"),
        ("weir", 1, "WARNING: start level 5.0 not close to initial waterlevel 1.0, 1.0"), ("channel", 2, "WARNING: initial water level at start and end node are not equal 1.0, 2.0"),
        ("orifice", 1, "WARNING: initial water level at start and end node are not equal 1.0, 2.0"), ("culvert", 1, "WARNING: initial water level at start and end node are not equal 2.0, 1.0"),
        ("surface_map", 2, "WARNING: percentage = 100 and should be 14.4 or 11.5"), ("table_control", 2, "ERROR: action_table has more than 1000 characters (model will crash)"),
    }
    assert found == expected


def test_controls_and_isolated_channels(model):
    row = {r["id"]: r for r in network.control_overview(model).collect()}
    assert (row[1]["target_code"], row[1]["start_action"], row[1]["min_action"], row[1]["max_action"]) == ("w1", 0.7, 0.5, 0.7) and row[2]["target_code"] is None
    found = network.isolated_channels(model["channel"].withColumn("m", F.lit(500.0)), "m").first()
    assert tuple(found) == (0.5, 1.5, 33.0)
    assert tuple(network.isolated_channels(model["channel"].where("false").withColumn("m", F.lit(500.0)), "m").first()) == (0.0, 0.0, 0.0)


def test_profiles_by_hand(model):
    found = {r["channel_id"]: r for r in network.used_profiles(model["channel"], model["cross_section_location"], model["connection_node"]).collect()}
    assert (found[1]["min_depth"], found[1]["max_depth"], found[1]["min_width"], found[1]["max_width"]) == (0.25, 1.0, 1.0, 2.67)
    assert (found[2]["mean_depth"], found[2]["mean_width"], found[2]["n_sections"]) == (1.0, None, 2)


def test_structure_relations_take_the_nearest_section(spark, model):
    channels = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 2, 5)], "id long, connection_node_id_start long, connection_node_id_end long")
    sections = spark.createDataFrame([(1, 1, 10.0, 100.0, 0.5), (2, 1, 90.0, 100.0, 0.2), (3, 2, 5.0, 100.0, 0.9), (4, 2, 50.0, 100.0, 0.0), (5, 3, 1.0, 9.0, None)], "id long, channel_id long, offset double, length double, reference_level double")
    found = {(r["id"], r["side"]): r for r in network.structure_relations(model["weir"].where("id = 1"), channels, sections).collect()}
    assert (found[1, "start"]["min_reference"], found[1, "start"]["min_section"]) == (0.5, 1)
    assert (found[1, "end"]["min_reference"], found[1, "end"]["min_section"], found[1, "end"]["max_reference"], found[1, "end"]["max_section"]) == (0.2, 2, 0.9, 3)
    levels = spark.createDataFrame([(1, "start", 0.4, None), (1, "end", 0.1, 0.0)], "id long, side string, minimal_level double, bottom_level double")
    assert [(r["id"], r["side"]) for r in network.wrong_profiles(network.structure_relations(model["weir"].where("id = 1"), channels, sections), levels).collect()] == [(1, "start")]


def test_lines_leak_under_their_highest_crossing(spark):
    lines = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5)], "id long, dpumax double")
    crossings = spark.createDataFrame([(1, "obstacle", 0.4), (1, "boundary", 0.6), (2, "obstacle", 0.5), (2, "obstacle", None)], "line_id long, kind string, crest_level double")
    found = {r["id"]: (r["kind"], r["leaks"]) for r in network.leaking_lines(lines, crossings).collect()}
    assert found == {1: ("boundary", True), 2: ("obstacle", False), 3: (None, False)}


def test_mask_classes(spark):
    members = spark.createDataFrame([(1, False, False), (1, True, True), (2, False, True), (3, False, False)], "component long, valid boolean, active boolean")
    found = {r["component"]: r["class"] for r in graph.classify_components(members, "valid", "active").collect()}
    assert found == {1: "nuisance", 2: "model error", 3: "puddle"}
