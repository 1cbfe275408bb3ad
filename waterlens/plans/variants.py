"""Variants, updates, rule tables and scenario batches over the data tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import spatial, variants
from ..session import table
from .registry import query
from .shapes import _CUSTOMERS, _SUPPLIERS, _places


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 7 AS INT) ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE c_acctbal END AS c_acctbal FROM customer""")
def combined_updates(spark, d):
    """Updates of several columns in one job."""
    base = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    types = base.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_custkey") % 7).alias("value"))
    levels = base.where("c_custkey % 4 = 0").select("c_custkey", F.lit(0.5).alias("value"))
    return variants.apply_updates(base, "c_custkey", {"c_nationkey": types, "c_acctbal": levels})


@query("""
    SELECT n_nationkey, count(s_suppkey) AS n_suppliers, coalesce(round(sum(s_acctbal), 2), 0) AS balance FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY 1""")
def hooked_variant(spark, d):
    """A variant made by hooks in SQL over the tables of the base model."""
    hooks = [("nation", "SELECT * FROM {nation} WHERE n_regionkey <> 2"), ("supplier", "SELECT * FROM {supplier} WHERE s_acctbal > 0"),
             ("totals", "SELECT n_nationkey, count(s_suppkey) AS n_suppliers, coalesce(round(sum(s_acctbal), 2), 0) AS balance FROM {nation} LEFT JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY 1")]
    return variants.run_hooks(spark, {n: table(spark, d, n) for n in ("nation", "supplier")}, hooks)["totals"]


@query("""
    SELECT o_custkey, max(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 97 END) AS revision FROM orders GROUP BY 1""")
def newest_revisions(spark, d):
    """The highest revision of each model, from the names of its folders; a name without a number is revision 0."""
    name = F.when(F.col("o_orderkey") % 5 == 0, F.lit("model revision")).otherwise(F.concat(F.lit("model #"), (F.col("o_orderkey") % 97).cast("string"), F.lit(" final")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max(variants.revision_number(name)).alias("revision"))


@query("""
    SELECT 'validation rules' AS kind, r_name AS object, n_nationkey * 6 AS id, n_name AS name, coalesce(CASE WHEN n_nationkey % 3 > 0 THEN n_name END, '') AS description, CASE WHEN n_nationkey % 4 = 0 OR n_nationkey * 6 >= 100 THEN 'own' ELSE 'shared' END AS origin
    FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 5 <> 0
    UNION ALL SELECT 'general rules', r_name, n_nationkey * 7, n_name, '', CASE WHEN n_nationkey * 7 >= 100 THEN 'own' ELSE 'shared' END FROM nation JOIN region ON r_regionkey = n_regionkey""")
def rules_of_documents(spark, d):
    """Rule documents in JSON, one for each layer, as a table of rules."""
    n = F.col("n_nationkey").cast("long")
    general = F.struct((n * 7).alias("id"), F.col("n_name").alias("result_variable"))
    check = F.struct((n * 6).alias("id"), F.col("n_name").alias("name"), F.when(n % 3 > 0, F.col("n_name")).alias("description"), F.when(n % 4 == 0, "own").otherwise("basic").alias("validation_rule_set"), (n % 5 != 0).alias("active"))
    layers = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(general).alias("general_rules"), F.collect_list(check).alias("validation_rules"))
    documents = layers.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.to_json(F.struct(F.col("r_name").alias("object"), "general_rules", "validation_rules")).alias("text"))
    return variants.rules_overview(documents).select("kind", "object", "id", "name", "description", "origin")


@query("""
    SELECT p_partkey, concat_ws(';', CASE WHEN p_size < 3 OR p_size > 45 THEN '6' END, CASE WHEN p_retailprice > 1500 THEN '10' END, CASE WHEN p_size * 30 >= p_retailprice THEN '33' END) AS invalid
    FROM part WHERE p_size < 3 OR p_size > 45 OR p_retailprice > 1500 OR p_size * 30 >= p_retailprice""")
def ranges_checked(spark, d):
    """Rows that break value ranges or comparisons of columns, with the ids of the rules."""
    rows = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") * 30).alias("low"))
    rules = [{"id": 6, "column": "p_size", "min": 3, "max": 45}, {"id": 10, "column": "p_retailprice", "max": 1500}, {"id": 33, "column": "low", "less_than": "p_retailprice"}]
    return variants.column_findings(rows, "p_partkey", rules)


_SCENARIOS = "s AS (SELECT CAST(a.range * 9 + b.range * 3 + c.range AS BIGINT) AS scenario, ['dry', 'mean', 'wet'][b.range + 1] AS soil FROM range(2) a, range(3) b, range(3) c)"


@query(f"""
    WITH {_SCENARIOS}, p AS (SELECT CAST(l_orderkey % 17 AS BIGINT) AS k, greatest(l_quantity - l_tax * 100 - 3, 0) AS v FROM lineitem)
    SELECT scenario, soil, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, coalesce(round(sum(v) * 0.25, 2), 0) AS volume FROM s LEFT JOIN p ON k = scenario GROUP BY 1, 2""")
def scenario_batch(spark, d):
    """Depth rasters of all scenarios of a batch: one plan for all, statistics and volume for each; one has no raster."""
    axis = lambda n, name: spark.range(n).withColumnRenamed("id", name)
    scenarios = axis(18, "scenario").withColumn("soil", F.element_at(F.array(*map(F.lit, ("dry", "mean", "wet"))), (F.expr("scenario div 3 % 3") + 1).cast("int")))
    pixels = table(spark, d, "lineitem").select((F.col("l_orderkey") % 17).alias("scenario"), F.greatest(F.col("l_quantity") - F.col("l_tax") * 100 - 3, F.lit(0.0)).alias("depth"))
    found = variants.scenario_metadata(scenarios, pixels, "scenario", "depth", 0.25)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")}).withColumn("volume", F.round("volume", 2))


@query(f"""
    WITH {_CUSTOMERS}, {_SUPPLIERS} SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM a JOIN b ON lx = rx AND ly = ry GROUP BY 1""")
def equal_nearest(spark, d):
    """Nearest partners that have the same coordinates."""
    left, right = _places(table(spark, d, "customer"), "c_custkey", "lx", "ly"), _places(table(spark, d, "supplier"), "s_suppkey", "rx", "ry")
    found = spatial.nearest(left, right, "c_custkey", ["s_suppkey"], 64.0)
    return found.where("distance = 0").select("c_custkey", "s_suppkey")


@query("""
    SELECT c_custkey, 0 AS part, 3 AS n_points FROM customer UNION ALL SELECT c_custkey, 1, 2 FROM customer WHERE c_custkey % 2 = 0""")
def line_parts(spark, d):
    """The lines of collections, one row each; their polygons are left out."""
    point = lambda dx: F.struct((F.col("c_custkey") + dx).cast("double").alias("x"), F.lit(0.0).alias("y"))
    part = lambda kind, n: F.struct(F.lit(kind).alias("kind"), F.array(*[point(k) for k in range(n)]).alias("points"))
    held = F.when(F.col("c_custkey") % 2 == 0, F.array(part("line", 3), part("polygon", 4), part("line", 2))).otherwise(F.array(part("polygon", 4), part("line", 3)))
    found = table(spark, d, "customer").select("c_custkey", F.posexplode(geometry.parts_of_kind(held, "line")).alias("part", "_p"))
    return found.select("c_custkey", "part", F.size("_p.points").alias("n_points"))


@query("""
    SELECT user_id, strftime(max(to_timestamp(event_id * 3600) AT TIME ZONE 'Europe/Amsterdam'), '%Y-%m-%d %H:%M:%S') AS last_local FROM events GROUP BY 1""")
def local_times(spark, d):
    """The last time of each user in local time, over summer and winter time."""
    moment = F.timestamp_seconds(F.col("event_id") * 3600)
    return table(spark, d, "events").groupBy("user_id").agg(F.date_format(F.max(F.from_utc_timestamp(moment, "Europe/Amsterdam")), "yyyy-MM-dd HH:mm:ss").alias("last_local"))
