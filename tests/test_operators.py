"""Operators that SQL cannot express, edge cases, sources and streaming."""

from __future__ import annotations

import datetime
import sqlite3

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from waterlens.functions import encoded, geometry, nulls
from waterlens.operators import graph, raster, relational, rules, spatial, temporal
from waterlens.plans import catalog
from waterlens.sources import files
from waterlens.sources.sqlite_source import layers, register
from waterlens.streaming import series

FOLDER = "/root/testdata/sf0.001"


def test_entry_gives_rows(spark):
    found = entry.entry(spark)
    assert found.columns == ["table_name", "id", "error"] and found.count() > 0


def test_dump_and_restore_keep_the_content(spark):
    before, after = catalog.queries()["dump_restore_hash"](spark, FOLDER).collect()
    assert before["n_rows"] == after["n_rows"] and before["content"] == after["content"]


def test_content_hash_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    one = files.content_hash(df).first()
    assert one == files.content_hash(df.orderBy(F.desc("k"))).first()
    assert one != files.content_hash(df.distinct()).first()


def test_tiles_equal_the_column_form(spark):
    found = {}
    for row in sorted(catalog.queries()["tile_map"](spark, FOLDER).collect(), key=lambda r: (r["tile"], r["at"])):
        found.setdefault(row["tile"], []).append(row["value"])
    part = spark.read.parquet(f"{FOLDER}/part.parquet").orderBy("p_partkey").collect()
    for tile, data in found.items():
        values = [r["p_retailprice"] for r in part if r["p_partkey"] // 100 == tile]
        assert data == pytest.approx([v - sum(values) / len(values) for v in values], abs=1e-4)  # rounded to four digits


def test_ordered_fill_equals_a_loop(spark):
    rows = [(1, 1, 5.0, False), (1, 2, 1.0, True), (1, 3, 2.0, True), (1, 4, None, True), (1, 5, 9.0, False), (2, 6, 3.0, True)]
    cells = spark.createDataFrame(rows, "g int, k long, v double, r boolean").withColumn("near", F.array(F.col("k") - 1, F.col("k") + 1))
    found = {r["k"]: r["filled"] for r in graph.ordered_fill(cells, "g", "k", "v", "r", "near").collect()}
    assert found[1] == 5.0 and found[2] == 5.0 and found[3] == 5.0 and found[5] == 9.0
    assert found[4] is None or found[4] != found[4]
    assert found[6] is None or found[6] != found[6]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    found = {r["u"]: r["v"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{k: 1 for k in range(2, 41)}, **{k: 100 for k in range(101, 160)}, 301: 300}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rule_expressions_reject_what_they_do_not_know():
    with pytest.raises(ValueError):
        rules.expression({"power": ["a", 2]}, ["a"])
    with pytest.raises(ValueError):
        rules.expression("b", ["a"])


def test_null_semantics(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (3.0, 1.0)], "a double, b double")
    clean = nulls.nan_to_null(df)
    assert [r[0] for r in clean.select(nulls.strict_max(F.col("a"), F.col("b"))).collect()] == [None, None, 3.0]
    assert [r[0] for r in clean.select(nulls.differs_or_null(F.col("a"), F.col("a"))).collect()] == [False, True, False]


def test_encoded_cells(spark):
    df = spark.createDataFrame([("1.5,2\n\n0.5,3\nx,1",), (None,), ("",)], "c string")
    pairs = [r[0] for r in df.select(encoded.parse_pairs(F.col("c"))).collect()]
    assert [tuple(p) for p in pairs[0]] == [(1.5, 2.0), (0.5, 3.0)] and pairs[1] is None and pairs[2] == []
    assert df.select(encoded.format_pairs(encoded.sort_pairs(encoded.parse_pairs(F.col("c"))))).first()[0] == "0.5,3.0\n1.5,2.0"
    tags = spark.createDataFrame([("[1, 2]",), (None,), ("7,x",)], "c string").select(encoded.parse_tags(F.col("c"))).collect()
    assert [r[0] for r in tags] == [[1, 2], [], [7]]


def test_geometry_measures(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3), (0, 0))])
    inside = lambda x, y: geometry.in_ring(F.lit(x), F.lit(y), ring)
    row = spark.range(1).select(geometry.line_length(ring), geometry.ring_area(ring), inside(1.0, 1.0), inside(5.0, 1.0), geometry.segment_distance(*map(F.lit, (2.0, 2.0, 0.0, 0.0, 4.0, 0.0)))).first()
    assert tuple(row) == (14.0, 12.0, True, False, 2.0)


def test_keyed_operators_take_empty_tables_and_null_keys(spark):
    child = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, parent int")
    parent = spark.createDataFrame([(5,), (None,)], "pk int")
    assert sorted(map(tuple, relational.fk_cleanup(child, "parent", parent, "pk").collect()), key=repr) == [(1, 5), (2, None), (3, None)]
    empty = child.where("false")
    assert relational.first_per_key(empty, ["id"], [F.col("parent")]).count() == 0
    assert relational.with_new_ids(empty, "n", ["id"]).count() == 0
    assert relational.outer_compare(child, empty, "id").where("in_both = 'A'").count() == 3


def test_nearest_finds_far_points_once(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 0.0)], "k int, lx double, ly double")
    right = spark.createDataFrame([(7, 50.0, 0.0), (8, 1.0, 0.0), (9, 1.0, 0.0)], "r int, rx double, ry double")
    found = {r["k"]: (r["r"], r["distance"]) for r in spatial.nearest(left, right, "k", ["r"], 2.0, rounds=8).collect()}
    assert found == {1: (8, 1.0), 2: (7, 40.0)}


def test_series_without_a_hit(spark):
    dry = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.0)], "k string, i int, rain double")
    assert tuple(temporal.rain_window(dry, ["k"], "i", "rain").first()) == ("a", None, None, None, None)
    assert temporal.first_after(dry, ["k"], "i", "i", F.lit(9)).first()["first_after"] == 0
    assert temporal.asof_nearest(dry, ["k"], F.lit(50), "i", 30, "rain").first()["value_found"] is None


def test_depth_keeps_no_data(spark):
    level = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "k int, value double")
    ground = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 4.0)], "k int, value double")
    assert {r["k"]: r["value"] for r in raster.depth(level, ground, ["k"]).collect()} == {1: 1.5, 2: None, 3: 0.0}


def test_sqlite_tables_are_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "model.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE weir (fid INTEGER PRIMARY KEY, code TEXT, crest_level REAL, geom BLOB)")
        db.execute("CREATE TABLE gpkg_contents (x TEXT)")
        db.executemany("INSERT INTO weir VALUES (?, ?, ?, ?)", [(k, f"w{k}", k / 2, b"\x00\x01") for k in range(1, 101)])
        db.execute("CREATE TABLE unused (fid INTEGER PRIMARY KEY)")
    assert layers(path) == ["unused", "weir"]
    register(spark)
    read = lambda t: spark.read.format("sqlite").option("path", path).option("table", t).option("partitions", 4).load()
    weir = read("weir")
    assert weir.dtypes == [("fid", "bigint"), ("code", "string"), ("crest_level", "double"), ("geom", "binary")]
    assert weir.count() == 100 and weir.agg(F.sum("crest_level")).first()[0] == 2525.0
    assert read("unused").count() == 0


def test_domain_documents_and_delimited_text(spark, tmp_path):
    path = tmp_path / "domains.xml"
    path.write_text("<all><value><column_name>kind</column_name><code>1</code><name>weir</name></value><value><column_name>kind</column_name><code>2</code></value></all>")
    rows = files.read_domains(spark, str(path), "value").collect()
    assert sorted(map(tuple, rows), key=repr) == [("kind", "1", "weir"), ("kind", "2", None)]
    df = spark.createDataFrame([(1, 2.5), (2, None)], "k int, v double")
    files.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), "k int, v double").collect())) == [(1, 2.5), (2, None)]


def test_snapping_joins_chains_and_equal_points(spark):
    points = spark.createDataFrame([(3, 0.0, 0.0), (1, 0.9, 0.0), (2, 1.8, 0.0), (4, 9.0, 9.0), (5, 9.0, 9.0)], "id long, x double, y double")
    found = {r["id"]: (r["node"], r["x"]) for r in graph.snap(points, 1.0).collect()}
    assert found == {1: (1, 0.9), 2: (1, 0.9), 3: (1, 0.9), 4: (4, 9.0), 5: (4, 9.0)}


def test_streams(spark, tmp_path):
    begin = datetime.datetime(2024, 1, 1)
    rows = [("a", begin + datetime.timedelta(minutes=20 * k), float(k % 5)) for k in range(30)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "user string, ts timestamp, value double").coalesce(1).write.parquet(source)

    def run(build, name):
        stream = build(spark.readStream.schema("user string, ts timestamp, value double").parquet(source))
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    totals = run(lambda s: series.window_totals(s, "user", "ts", "value"), "totals")
    assert totals and all(r["n"] == 3 for r in totals)
    changes = run(lambda s: series.control_changes(s, "user", "ts", "value", [(0.0, 1.0), (3.0, 2.0)]), "changes")
    assert [(r["ts"], r["action"]) for r in sorted(changes, key=lambda r: r["ts"])] == [(rows[k][1], 1.0 if k % 5 == 0 else 2.0) for k in range(24) if k % 5 in (0, 3)]  # what the watermark has passed


def test_controls_take_readings_in_order_over_batches(spark, tmp_path):
    begin = datetime.datetime(2024, 1, 1)
    at = lambda m: begin + datetime.timedelta(minutes=m)
    batches = [[("a", at(0), 5.0), ("a", at(60), 1.0), ("b", at(10), None)], [("a", at(30), 1.0), ("a", at(90), 5.0), ("b", at(20), 9.0)], [("a", at(600), 5.0), ("b", at(15), 1.0)], [("c", at(20_000), 1.0)], [("c", at(40_000), 1.0)]]
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "user string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(source))
        for f in source.glob("part-*"):
            if not f.name.startswith("part-x"):
                f.rename(source / f"part-x{k}.parquet")
    stream = spark.readStream.schema("user string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = series.control_changes(stream, "user", "ts", "value", [(0.0, 1.0), (3.0, 2.0)]).writeStream.format("memory").queryName("ordered").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted((r["user"], r["ts"], r["action"]) for r in spark.table("ordered").collect())
    assert found == [("a", at(0), 2.0), ("a", at(30), 1.0), ("a", at(90), 2.0), ("b", at(15), 1.0), ("b", at(20), 2.0), ("c", at(20_000), 1.0)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # a and b are forgotten
