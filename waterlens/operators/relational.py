"""Relational operators of the checks and conversions: keyed choices, repairs, patches, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import differs
from ..session import cut


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order. Ranked per key, so a key's rows stay in one task but spill."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).where("_at = 1").drop("_at")


def carry_max(df: DataFrame, keys: Sequence[str], by: Sequence[Column], carried: Sequence[str]) -> DataFrame:
    """Columns of the row with the largest `by`, combined on the map side: no sort, safe for keys of any size."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*carried), F.struct(*by)).alias("_row")).select(*keys, "_row.*")


def carry_min(df: DataFrame, keys: Sequence[str], by: Sequence[Column], carried: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*carried), F.struct(*by)).alias("_row")).select(*keys, "_row.*")


def flag_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """`is_duplicated` for every row of a repeated key, `occurrence` in the given order from 1."""
    window = Window.partitionBy(*keys)
    return df.withColumn("is_duplicated", F.count("*").over(window) > 1).withColumn("occurrence", F.row_number().over(window.orderBy(*order)))


def fk_cleanup(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """`child` with the foreign key null where no parent has it."""
    ids = parent.select(F.col(pk).alias("_pk")).where("_pk IS NOT NULL").distinct()
    found = child.join(ids, F.col(fk) == F.col("_pk"), "left")
    return found.select(*[F.col("_pk").cast(dict(child.dtypes)[fk]).alias(fk) if c == fk else c for c in child.columns])


def case_update(df: DataFrame, patch: DataFrame, key: str, column: str, new: str, excluded: DataFrame | None = None) -> DataFrame:
    """`df` with `column` from the patch where it has the key, but not for excluded keys."""
    fresh = patch.select(F.col(key).alias("_key"), F.col(new).alias("_new"))
    if excluded is not None:
        fresh = fresh.join(excluded.select(F.col(key).alias("_key")), "_key", "left_anti")
    merged = df.join(fresh, F.col(key) == F.col("_key"), "left")
    return merged.select(*[F.coalesce("_new", column).alias(c) if c == column else c for c in df.columns])


def diff_against(df: DataFrame, backup: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of both whose values differ, with both values; nulls count as values."""
    old = backup.select(F.col(key).alias("_key"), F.col(column).alias("old_value"))
    both = df.join(old, F.col(key) == F.col("_key")).where(differs(F.col(column), F.col("old_value")))
    return both.select(key, "old_value", F.col(column).alias("new_value"))


def mode_outliers(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows whose value differs from the most frequent one of their group (ties: the smallest); null differs."""
    modes = df.groupBy(group).agg(F.mode(F.col(value), True).alias("mode_value"))
    return df.join(modes, group).where(F.coalesce(F.col(value) != F.col("mode_value"), F.lit(True)))


def only_child_takes(child: DataFrame, fk: str, parent: DataFrame, pk: str, column: str) -> DataFrame:
    """Children that are the only one of their parent, with the parent's value."""
    single = child.groupBy(fk).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return child.join(single, fk).join(parent.select(F.col(pk).alias("_pk"), column), F.col(fk) == F.col("_pk")).drop("_pk")


def several_parents(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Children that occur with more than one parent, and how many."""
    return df.groupBy(child).agg(F.countDistinct(parent).alias("n_parents")).where("n_parents > 1")


def outer_compare(a: DataFrame, b: DataFrame, key: str, labels: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Full outer join on the key: every column of both with a suffix, and `in_both` as A, B or AB."""
    left = a.select(F.col(key).alias("_a"), *[F.col(c).alias(f"{c}_{labels[0]}") for c in a.columns if c != key])
    right = b.select(F.col(key).alias("_b"), *[F.col(c).alias(f"{c}_{labels[1]}") for c in b.columns if c != key])
    side = F.when(F.col("_b").isNull(), labels[0]).when(F.col("_a").isNull(), labels[1]).otherwise("".join(labels))
    return left.join(right, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), side.alias("in_both"), *[c for c in left.columns if c != "_a"], *[c for c in right.columns if c != "_b"])


def lookup(df: DataFrame, column: str, table: DataFrame, key: str, value: str, order: Sequence[Column], to: str) -> DataFrame:
    """`to` by a lookup table; a key that it has twice gives its first value, one that it lacks null."""
    once = carry_min(table.where(F.col(key).isNotNull()), [key], order, [value]).select(F.col(key).alias("_key"), F.col(value).alias(to))
    return df.join(once, F.col(column) == F.col("_key"), "left").drop("_key")


def any_key_join(df: DataFrame, left: Sequence[str], other: DataFrame, key: str) -> DataFrame:
    """Rows joined where the other side's key equals any of the columns: an equi-join over the unpivoted columns; a
    pair that meets twice stays once."""
    keys = F.array_distinct(F.array(*left))
    return df.withColumn("_key", F.explode(keys)).where("_key IS NOT NULL").join(other, F.col("_key") == F.col(key)).drop("_key")


def unpivot(df: DataFrame, keep: Sequence[str], columns: Mapping[str, str], to: str, kind: str) -> DataFrame:
    """Long form of several columns: one row per column, with its label."""
    parts = F.array(*[F.struct(F.lit(label).alias(kind), F.col(c).alias(to)) for c, label in columns.items()])
    return df.select(*keep, F.explode(parts).alias("_part")).select(*keep, "_part.*")


def conform(df: DataFrame, schema: Mapping[str, str], required: Sequence[str] = ()) -> DataFrame:
    """Exactly the columns of a template, cast; missing ones are null, as is what cannot be cast. A missing column that
    is required is an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df.select(*[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()])


def to_number(column: Column, fill: float | None = None, kind: str = "double") -> Column:
    """A text as a number; what is none becomes null, or `fill`."""
    number = column.try_cast("double")
    return (number if fill is None else F.coalesce(number, F.lit(fill))).cast(kind)


def to_date(column: Column, patterns: Sequence[str] = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")) -> Column:
    """A text as a timestamp by the first pattern that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(column, F.lit(p)) for p in patterns])


def drop_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` without rows whose listed columns are all null."""
    return df.na.drop(how="all", subset=list(columns))


def with_column_at(df: DataFrame, position: int, name: str, value: Column) -> DataFrame:
    """`df` with a new column at a position (from 0)."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*columns[:position], value.alias(name), *columns[position:])


def by_family(df: DataFrame, code: str, families: Mapping[str, str], origin: str = "family") -> DataFrame:
    """Rows whose code begins with the prefix of a family, with its name: the longest prefix that fits."""
    longest = sorted(families.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    name = F.coalesce(*[F.when(F.col(code).startswith(prefix), F.lit(family)) for prefix, family in longest])
    return df.withColumn(origin, name).where(F.col(origin).isNotNull())


def missing_children(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """Parents that no child points to."""
    return parent.join(child.select(F.col(fk).alias("_fk")), F.col(pk) == F.col("_fk"), "left_anti")


def with_new_ids(df: DataFrame, column: str, order: Sequence[str], start: int = 0) -> DataFrame:
    """Sequential ids after `start`. Rows are counted per range partition first, so no task sees all of them."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_of"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_nth", nth).join(F.broadcast(before), F.col("_part") == F.col("_of")).withColumn(column, F.col("_before") + F.col("_nth") + start).select(*df.columns, column)


def until_limit(steps: Column, limit: Column) -> Column:
    """The ascending steps up to the first that reaches the limit, which is held at it."""
    before = F.filter(F.transform(steps, lambda x, k: F.struct(x.alias("x"), F.when(k > 0, F.get(steps, k - 1)).alias("last"))), lambda s: s["last"].isNull() | (s["last"] < limit))
    return F.transform(before, lambda s: F.least(s["x"], limit))


def largest_of_text(column: Column, separator: str = " ") -> Column:
    """The largest of the numbers in a text; null without any."""
    return F.array_max(F.transform(F.split(column, separator), lambda x: x.try_cast("double")))


def with_both_ends(edges: DataFrame, nodes: DataFrame, key: str, columns: Sequence[str], start: str, end: str) -> DataFrame:
    """`edges` with the columns of the nodes at both ends, as column_start and column_end; null where a node is missing."""
    for side in (start, end):
        found = nodes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        edges = edges.join(found, F.col(side) == F.col("_key"), "left").drop("_key")
    return edges


def with_overall_max(df: DataFrame, columns: list[str], name: str, key: str | None = None) -> DataFrame:
    """`df` with the largest value of several columns together: over all rows, or over those of the same `key`.

    Nulls are passed over; a null key has a largest value of its own. The maximum is an aggregate that is combined before
    it is shuffled, so that a hot key costs one row a task.
    """
    highest = F.max(F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])).alias(name)
    if key is None:
        return df.crossJoin(F.broadcast(df.agg(highest)))  # one row
    found = df.groupBy(F.col(key).alias("_key")).agg(highest)
    return df.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def renamed_with_defaults(df: DataFrame, names: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """The columns of `names` under their new names, nulls filled by the defaults of the new names."""
    return df.select(*[(F.coalesce(F.col(old), F.lit(defaults[new])) if new in defaults else F.col(old)).alias(new) for old, new in names.items()])
