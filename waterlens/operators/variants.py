"""Changes and variants of a model as single plans: combined updates, hooks in SQL, revisions, rule tables, scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES_SCHEMA = """object STRING, general_rules ARRAY<STRUCT<id: BIGINT, result_variable: STRING, description: STRING>>,
    validation_rules ARRAY<STRUCT<id: BIGINT, name: STRING, description: STRING, validation_rule_set: STRING, active: BOOLEAN>>"""
OWN_RULES_FROM = 100


def apply_updates(df: DataFrame, key: str, patches: Mapping[str, DataFrame]) -> DataFrame:
    """`df` with several columns updated in one join: patches are (key, value) by column. A key that a patch has twice
    takes the largest value; a null value changes nothing."""
    parts = [p.select(F.col(key).alias("_key"), *[(F.col("value") if c == column else F.lit(None)).cast(dict(df.dtypes)[c]).alias(f"_{c}") for c in patches]) for column, p in patches.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    merged = union.groupBy("_key").agg(*[F.max(f"_{c}").alias(f"_{c}") for c in patches])
    found = df.join(merged, F.col(key) == F.col("_key"), "left")
    return found.select(*[F.coalesce(f"_{c}", c).alias(c) if c in patches else c for c in df.columns])


def run_hooks(spark: SparkSession, tables: Mapping[str, DataFrame], hooks: Sequence[tuple[str, str]]) -> dict[str, DataFrame]:
    """Tables of a variant: each hook replaces a table by trusted SQL over the tables so far, named as {table}."""
    done = dict(tables)
    for name, sql in hooks:
        done[name] = spark.sql(sql, **done)
    return done


def revision_number(name: Column) -> Column:
    """The number behind the first # of a name, up to a blank; 0 without one."""
    return F.coalesce(F.regexp_extract(name, r"^[^#]*#(\d+)(?:[ #]|$)", 1).try_cast("long"), F.lit(0))


def refuse_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """`df`, or an error if it has any of these columns."""
    clash = [c for c in df.columns if c in set(names)]
    if clash:
        raise ValueError(f"columns that may not be here: {', '.join(clash)}")
    return df


def rules_overview(documents: DataFrame, text: str = "text", own_set: str = "own", shared_set: str = "shared") -> DataFrame:
    """The general rules and the active validation rules of rule documents in JSON, one row each, with whose they
    are: `own_set` for rules of that set and for ids from OWN_RULES_FROM on, else `shared_set`."""
    parsed = documents.select(F.from_json(text, RULES_SCHEMA).alias("_o")).select("_o.*")
    own = lambda also: F.when(also | (F.col("r.id") >= OWN_RULES_FROM), own_set).otherwise(shared_set)
    describe = F.coalesce("r.description", F.lit("")).alias("description")
    general = parsed.select("object", F.explode("general_rules").alias("r")).select(own(F.lit(False)).alias("origin"), "object", "r.id", F.lit("general rules").alias("kind"), F.col("r.result_variable").alias("name"), describe)
    checks = parsed.select("object", F.explode("validation_rules").alias("r")).where("r.active").select(own(F.coalesce(F.col("r.validation_rule_set") == own_set, F.lit(False))).alias("origin"), "object", "r.id", F.lit("validation rules").alias("kind"), "r.name", describe)
    return general.unionByName(checks)


def column_findings(df: DataFrame, key: str, rules: Sequence[Mapping]) -> DataFrame:
    """Rows that break rules, with the ids of those as text joined by ;.

    A rule has an id and a column, and either bounds (min, max, both included, each optional) or `less_than`, another
    column that must be larger (`or_equal`: or equal). A null breaks no rule.
    """

    def broken(rule: Mapping) -> Column:
        value = F.col(rule["column"])
        if "less_than" in rule:
            other = F.col(rule["less_than"])
            return value > other if rule.get("or_equal") else value >= other
        low = value < rule["min"] if "min" in rule else F.lit(False)
        return low | (value > rule["max"]) if "max" in rule else low

    marks = F.array_compact(F.array(*[F.when(broken(r), F.lit(str(r["id"]))) for r in rules]))
    return df.select(key, F.array_join(marks, ";").alias("invalid")).where("invalid <> ''")


def scenario_metadata(scenarios: DataFrame, pixels: DataFrame, key: str, depth: str, pixel_area: float) -> DataFrame:
    """Statistics and volume of the depth raster of every scenario; those without a raster stay, with nulls and no volume."""
    found = pixels.groupBy(F.col(key).alias("_key")).agg(
        F.min(depth).alias("min"), F.max(depth).alias("max"), F.avg(depth).alias("mean"), F.stddev_pop(depth).alias("std"), (F.sum(depth) * pixel_area).alias("volume")
    )
    return scenarios.join(found, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
