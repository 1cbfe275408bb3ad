"""Time-series analyses over `events`: the user is the element, value the level, event_type the variable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import temporal
from ..session import table
from .registry import query

def _events(spark, d) -> DataFrame:
    """Events with their second since 1970."""
    events = table(spark, d, "events")
    return events.withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))


_EVENTS = "e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"


@query(f"""
    WITH {_EVENTS}, m AS (SELECT user_id, (min(sec) + max(sec)) // 2 AS mid FROM e GROUP BY 1),
    o AS (SELECT e.user_id, sec, value, abs(sec - mid) AS off, row_number() OVER (PARTITION BY e.user_id ORDER BY abs(sec - mid), sec, event_id) AS rn FROM e JOIN m ON e.user_id = m.user_id)
    SELECT user_id, CASE WHEN off <= 86400 THEN sec END AS t_found, CASE WHEN off <= 86400 THEN value END AS value_found FROM o WHERE rn = 1""")
def asof_tolerance(spark, d):
    events = _events(spark, d)
    middle = events.groupBy(F.col("user_id").alias("u")).agg(F.expr("(min(sec) + max(sec)) div 2").alias("mid"))
    series = events.join(middle, F.col("user_id") == F.col("u"))
    once = series.groupBy("user_id", "sec", "mid").agg(F.min_by("value", "event_id").alias("value"))
    return temporal.asof_nearest(once, ["user_id"], F.col("mid"), "sec", 86400, "value")


@query("""
    SELECT user_id, arg_max(value - 50, (abs(value - 50), -event_id)) AS value_at_max FROM events WHERE value IS NOT NULL GROUP BY 1""")
def argmax_over_time(spark, d):
    series = table(spark, d, "events").where("value IS NOT NULL").select("user_id", "event_id", (F.col("value") - 50).alias("flow"))
    return temporal.signed_extreme(series, ["user_id"], "flow", "event_id")


@query("""
    SELECT event_type, arg_max(user_id, (value, -event_id)) AS value_at_max FROM events WHERE value IS NOT NULL GROUP BY 1""")
def value_at_level_max(spark, d):
    series = table(spark, d, "events").where("value IS NOT NULL")
    return temporal.value_at_max(series, ["event_type"], F.col("user_id"), F.col("value"), F.col("event_id"))


@query("""
    SELECT user_id, min(event_id) FILTER (WHERE value > 90) AS first_wet, max(event_id) FILTER (WHERE value > 90) AS last_wet,
      min(event_id) FILTER (WHERE value > 90) - min(event_id) AS dry_before, max(event_id) - max(event_id) FILTER (WHERE value > 90) AS dry_after FROM events GROUP BY 1""")
def rain_window(spark, d):
    return temporal.rain_window(table(spark, d, "events"), ["user_id"], "event_id", "value", 90.0)


@query(f"""
    WITH {_EVENTS}, n AS (SELECT user_id, sec, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) - 1 AS idx, min(sec) OVER (PARTITION BY user_id) + 5 * 86400 AS lim FROM e)
    SELECT user_id, CAST(coalesce(min(idx) FILTER (WHERE sec > lim), 0) AS BIGINT) AS first_after FROM n GROUP BY 1""")
def first_index_after(spark, d):
    window = Window.partitionBy("user_id")
    numbered = _events(spark, d).select("user_id", "sec", (F.row_number().over(window.orderBy("sec", "event_id")) - 1).cast("long").alias("idx"), (F.min("sec").over(window) + 5 * 86400).alias("lim"))
    return temporal.first_after(numbered, ["user_id"], "sec", "idx", F.col("lim"))


@query(f"""
    WITH {_EVENTS}, l AS (SELECT max(sec) AS last FROM e)
    SELECT event_type, round(avg(value), 6) AS mean_value, count(*) AS n_values FROM e, l WHERE sec >= last - 86400 AND sec < last GROUP BY 1""")
def last_day_mean(spark, d):
    events = _events(spark, d)
    last = events.agg(F.max("sec").alias("last"))  # one row
    series = events.join(F.broadcast(last))
    return temporal.slice_mean(series, ["event_type"], "sec", F.col("last") - 86400, F.col("last"), "value").select("event_type", F.round("mean_value", 6).alias("mean_value"), "n_values")


@query(f"""
    WITH {_EVENTS}, h AS (SELECT event_type, sec // 3600 AS hour, arg_min(value, (sec, event_id)) AS first_value FROM e GROUP BY 1, 2)
    SELECT event_type, CAST(hour AS BIGINT) AS hour, first_value FROM h""")
def hourly_sampling(spark, d):
    hourly = _events(spark, d).groupBy("event_type", F.expr("sec div 3600").alias("hour"))
    return hourly.agg(F.min_by("value", F.struct("sec", "event_id")).alias("first_value"))


@query(f"""
    WITH {_EVENTS}, g AS (SELECT user_id, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS step FROM e)
    SELECT user_id, round(avg(step) / 60, 4) AS mean_step_minutes, count(step) AS n_steps FROM g GROUP BY 1""")
def mean_time_step(spark, d):
    step = F.col("sec") - F.lag("sec").over(Window.partitionBy("user_id").orderBy("sec", "event_id"))
    return _events(spark, d).select("user_id", step.alias("step")).groupBy("user_id").agg(F.round(F.avg("step") / 60, 4).alias("mean_step_minutes"), F.count("step").alias("n_steps"))


@query("""
    WITH s AS (SELECT user_id % 50 AS element, event_id % 4 AS t, sum(value) AS v FROM events GROUP BY 1, 2)
    SELECT element, round(t0, 4) AS start, round(t1, 4) AS rain, round(t2, 4) AS settled, round(t1 - t0, 4) AS start_to_rain, round(t2 - t1, 4) AS rain_to_settled
    FROM (SELECT element, max(v) FILTER (WHERE t = 0) AS t0, max(v) FILTER (WHERE t = 1) AS t1, max(v) FILTER (WHERE t = 2) AS t2 FROM s WHERE t < 3 GROUP BY 1)""")
def level_differences(spark, d):
    series = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("element"), (F.col("event_id") % 4).alias("t")).agg(F.sum("value").alias("v"))
    found = temporal.level_differences(series, "element", "t", "v", {"start": 0, "rain": 1, "settled": 2})
    return found.select("element", *[F.round(c, 4).alias(c) for c in found.columns if c != "element"])


RAINS, WATERS, PERIODS = ("spike", "block"), ("dry", "mean", "wet"), (10, 100, 1000)


@query("""
    SELECT CAST(n_nationkey AS BIGINT) AS area, n_name || '_' || r || '_' || g || '_T' || p AS scenario, r AS rain, g AS groundwater, CAST(p AS INTEGER) AS period
    FROM nation, (VALUES ('spike'), ('block')) a(r), (VALUES ('dry'), ('mean'), ('wet')) b(g), (VALUES (10), (100), (1000)) c(p)""")
def scenario_cross(spark, d):
    """Every area with every rain, groundwater and period."""
    areas = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("area"), "n_name", F.explode(F.array(*map(F.lit, RAINS))).alias("rain"))
    every = areas.select("*", F.explode(F.array(*map(F.lit, WATERS))).alias("groundwater")).select("*", F.explode(F.array(*map(F.lit, PERIODS))).alias("period"))
    return every.select("area", F.concat("n_name", F.lit("_"), "rain", F.lit("_"), "groundwater", F.lit("_T"), F.col("period").cast("string")).alias("scenario"), "rain", "groundwater", "period")


@query("""
    WITH n AS (SELECT p_partkey, lower(p_name) || ' T' || CASE p_partkey % 3 WHEN 0 THEN '10' WHEN 1 THEN '100' ELSE '1000' END || CASE WHEN p_partkey % 2 = 0 THEN ' SPIKE' ELSE ' block' END AS name FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(name, 'T1000') THEN 1000 WHEN regexp_matches(name, 'T100($|[^0])') THEN 100 WHEN regexp_matches(name, 'T10($|[^0])') THEN 10 END AS period,
      CASE WHEN lower(name) LIKE '%spike%' THEN 'spike' WHEN lower(name) LIKE '%block%' THEN 'block' END AS rain FROM n""")
def name_classification(spark, d):
    ending = F.when(F.col("p_partkey") % 3 == 0, "10").when(F.col("p_partkey") % 3 == 1, "100").otherwise("1000")
    names = table(spark, d, "part").select("p_partkey", F.concat(F.lower("p_name"), F.lit(" T"), ending, F.when(F.col("p_partkey") % 2 == 0, " SPIKE").otherwise(" block")).alias("name"))
    period = reduce(lambda w, p: w.when(F.col("name").rlike(f"T{p}(?!0)"), p), PERIODS[1:], F.when(F.col("name").rlike(f"T{PERIODS[0]}(?!0)"), PERIODS[0]))
    rain = reduce(lambda w, r: w.when(F.lower("name").contains(r), r), RAINS[1:], F.when(F.lower("name").contains(RAINS[0]), RAINS[0]))
    return names.select("p_partkey", period.alias("period"), rain.alias("rain"))
