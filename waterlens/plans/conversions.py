"""Conversions and repairs over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encoded, text
from ..operators import graph
from ..operators import relational as rel
from ..session import table
from ..sources import files
from .registry import query


@query("""
    SELECT l_orderkey, arg_min(l_linenumber, (l_extendedprice, l_linenumber)) AS l_linenumber, arg_min(l_partkey, (l_extendedprice, l_linenumber)) AS l_partkey,
      min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1""")
def first_per_key(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rel.first_per_key(lines, ["l_orderkey"], [F.col("l_extendedprice").asc_nulls_last(), F.col("l_linenumber")])


@query("""
    SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS l_linenumber, arg_max(l_suppkey, (l_extendedprice, -l_linenumber)) AS l_suppkey,
      max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1""")
def last_per_key_carry(spark, d):
    return rel.carry_max(table(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_extendedprice"), -F.col("l_linenumber")], ["l_linenumber", "l_suppkey", "l_extendedprice"])


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NOT NULL THEN l_partkey END AS l_partkey FROM lineitem
    LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 25) ON p_partkey = l_partkey""")
def fk_cleanup(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rel.fk_cleanup(lines, "l_partkey", table(spark, d, "part").where("p_size < 25"), "p_partkey")


def _updated(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    patch = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("fresh"))
    excluded = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return rel.case_update(customers, patch, "c_custkey", "c_acctbal", "fresh", excluded)


_UPDATED = """
    u AS (SELECT c_custkey, coalesce(CAST(n AS DOUBLE), c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN (
      SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1) ON o_custkey = c_custkey)"""


@query(f"WITH {_UPDATED} SELECT * FROM u")
def case_update(spark, d):
    return _updated(spark, d)


@query(f"WITH {_UPDATED} SELECT u.c_custkey, c.c_acctbal AS old_value, u.c_acctbal AS new_value FROM u JOIN customer c USING (c_custkey) WHERE u.c_acctbal IS DISTINCT FROM c.c_acctbal")
def backup_diff(spark, d):
    return rel.diff_against(_updated(spark, d), table(spark, d, "customer"), "c_custkey", "c_acctbal")


@query("""
    SELECT CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') = 0 THEN 'closed' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'open'
      WHEN min(o_totalprice) <= 0 THEN 'inconsistent' ELSE 'mixed' END AS state, count(*) AS n_orders, count(DISTINCT o_orderpriority) = 1 AS one_priority FROM orders""")
def state_detect(spark, d):
    kind = F.when(F.count_if(F.col("o_orderstatus") == "O") == 0, "closed").when(F.count_if(F.col("o_orderstatus") == "F") == 0, "open").when(F.min("o_totalprice") <= 0, "inconsistent").otherwise("mixed")
    return table(spark, d, "orders").agg(kind.alias("state"), F.count("*").alias("n_orders"), (F.countDistinct("o_orderpriority") == 1).alias("one_priority"))


@query("""
    SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1) s USING (o_custkey)
    JOIN customer ON c_custkey = o_custkey""")
def single_child_transfer(spark, d):
    return rel.only_child_takes(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey", "c_mktsegment").select("o_orderkey", "o_custkey", "c_mktsegment")


@query("""
    WITH e AS (SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',' || CAST(l_linenumber AS VARCHAR), chr(10) ORDER BY l_linenumber) AS cell FROM lineitem GROUP BY 1),
    p AS (SELECT l_orderkey, unnest(string_split(cell, chr(10))) AS r FROM e),
    v AS (SELECT l_orderkey, CAST(split_part(r, ',', 1) AS BIGINT) AS x, CAST(split_part(r, ',', 2) AS BIGINT) AS y FROM p)
    SELECT l_orderkey, string_agg(x || ',' || y, chr(10) ORDER BY x, y) AS sorted_cell, min(x) AS x_min, max(x) AS x_max, arg_min(y, (x, y)) AS y_first, CAST(count(*) AS INTEGER) AS n_pairs
    FROM v GROUP BY 1""")
def parse_encoded_list(spark, d):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat_ws(",", F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")).alias("r")))), lambda s: s["r"])
    cells = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(rows, "\n").alias("cell"))
    cells = cells.withColumn("pairs", encoded.sort_pairs(encoded.parse_longs(F.col("cell"), "\n", ",")))
    xs = F.transform("pairs", lambda p: p["x"])
    return cells.select("l_orderkey", encoded.format_pairs(F.col("pairs")).alias("sorted_cell"), F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"), F.get("pairs", F.lit(0))["y"].alias("y_first"), F.size("pairs").alias("n_pairs"))


@query("""
    WITH t AS (SELECT s_suppkey, unnest([s_nationkey % 5, s_suppkey % 7, 99]) AS code, generate_subscripts([1, 2, 3], 1) AS pos FROM supplier)
    SELECT s_suppkey, string_agg(r_name, ',' ORDER BY pos) AS names, CAST(count(r_name) AS INTEGER) AS n_known FROM t LEFT JOIN region ON r_regionkey = code GROUP BY 1""")
def tags_to_descriptions(spark, d):
    cell = F.concat(F.lit("["), F.concat_ws(", ", (F.col("s_nationkey") % 5).cast("string"), (F.col("s_suppkey") % 7).cast("string"), F.lit("99")), F.lit("]"))
    region = table(spark, d, "region").agg(F.map_from_entries(F.collect_list(F.struct(F.col("r_regionkey").cast("long"), "r_name"))).alias("known"))  # a code list: five rows
    tagged = table(spark, d, "supplier").select("s_suppkey", encoded.parse_tags(cell).alias("tags")).join(F.broadcast(region))
    names = encoded.tag_names(F.col("tags"), F.col("known"))
    return tagged.select("s_suppkey", F.array_join(names, ",").alias("names"), F.size(names).alias("n_known"))


@query("""
    WITH dom AS (SELECT n_regionkey AS code, arg_min(n_name, n_nationkey) AS label FROM nation WHERE n_regionkey < 4 GROUP BY 1)
    SELECT s_suppkey, label AS meaning FROM supplier LEFT JOIN dom ON s_nationkey % 6 = code""")
def domain_decode(spark, d):
    coded = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 6).alias("code"))
    return rel.lookup(coded, "code", table(spark, d, "nation").where("n_regionkey < 4"), "n_regionkey", "n_name", [F.col("n_nationkey")], "meaning").select("s_suppkey", "meaning")


@query("""
    SELECT c_custkey, 'NL.99.customer.' || coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CAST(c_custkey AS VARCHAR)) AS identifier,
      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'REALISED' END AS status FROM customer""")
def identifier_template(spark, d):
    code = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.identifier("NL.99", "customer", code, F.col("c_custkey")).alias("identifier"), text.domain_value(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], "REALISED").alias("status"))


@query("""
    SELECT l_orderkey, l_linenumber, 'start' AS side, l_partkey AS node_id FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'end', l_suppkey FROM lineitem""")
def unpivot_endpoints(spark, d):
    return rel.unpivot(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"l_partkey": "start", "l_suppkey": "end"}, "node_id", "side")


@query("""
    SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, CAST(NULL AS DOUBLE) AS crest_level, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders""")
def schema_template(spark, d):
    return rel.conform(table(spark, d, "orders"), {"o_orderkey": "long", "o_custkey": "int", "crest_level": "double", "o_orderdate": "date"})


@query("SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (ORDER BY s_nationkey, s_suppkey) + 1000 AS BIGINT) AS new_id FROM supplier")
def sequential_ids(spark, d):
    return rel.with_new_ids(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "new_id", ["s_nationkey", "s_suppkey"], 1000)


@query("""
    WITH p AS (SELECT r_name || '' AS a, r_name || '/' || n_name AS b, r_name || '/' || n_name || '/' || c_mktsegment AS c
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    u AS (SELECT a AS path, 1 AS depth, NULL AS parent FROM p UNION ALL SELECT b, 2, a FROM p UNION ALL SELECT c, 3, b FROM p)
    SELECT path, depth, parent, count(*) AS n_rows FROM u GROUP BY ALL""")
def group_tree(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return graph.prefix_paths(joined, ["r_name", "n_name", "c_mktsegment"])


@query("SELECT p_partkey, p_name, p_brand, p_size, round(p_retailprice, 1) AS p_retailprice FROM part")
def dump_restored(spark, d):
    """The rows that a dump with rounded numbers gives back."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return files.restore(files.dump(parts, 1), parts.schema)


@query()
def dump_restore_hash(spark, d):
    parts = table(spark, d, "part")
    back = files.restore(files.dump(parts), parts.schema)
    one, two = files.content_hash(files.round_numbers(parts)), files.content_hash(back)
    return one.select(F.lit("before").alias("side"), "*").unionByName(two.select(F.lit("after").alias("side"), "*"))


@query("""
    SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49
    EXCEPT SELECT l_suppkey FROM lineitem WHERE l_discount = 0 AND l_tax = 0""")
def set_operations(spark, d):
    lines = table(spark, d, "lineitem")
    side = lambda condition: lines.where(condition).select("l_suppkey")
    return side("l_returnflag = 'R'").intersect(side("l_quantity > 49")).subtract(side("l_discount = 0 AND l_tax = 0"))


@query("""
    SELECT event_id, CASE WHEN s IS NULL THEN 'max' WHEN s % 3600 < 60 THEN CAST(s // 3600 AS VARCHAR) || 'h' WHEN s < 3600 THEN CAST(s % 3600 // 60 AS VARCHAR) || 'min'
      ELSE CAST(s // 3600 AS VARCHAR) || 'h' || CAST(s % 3600 // 60 AS VARCHAR) || 'min' END AS label
    FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_id % 700 * 60 END AS s FROM events)""")
def time_labels(spark, d):
    seconds = F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 700 * 60)
    return table(spark, d, "events").select("event_id", text.time_label(seconds).alias("label"))
