"""Rule engines: check rules over tables, comparison rules from JSON, and the fix report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import change_text

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Rule:
    """A check: which rows of a table break it, and the message they get (text, or SQL for one with values in it)."""

    table: str
    key: str
    broken: Callable[[DataFrame, Tables], DataFrame]
    message: str
    is_sql: bool = False


def where(condition: str) -> Callable[[DataFrame, Tables], DataFrame]:
    """Rows for which a condition on their own columns holds."""
    return lambda df, tables: df.where(condition)


def without(other: str, own_key: str, key: str) -> Callable[[DataFrame, Tables], DataFrame]:
    """Rows whose key the other table lacks; a null key is lacking too."""
    return lambda df, tables: df.join(tables[other].select(F.col(key).alias("_k")), F.col(own_key) == F.col("_k"), "left_anti")


def run_rules(tables: Tables, rules: Sequence[Rule]) -> DataFrame:
    """(table_name, id, error) of every rule's rows, all rules in one plan."""
    parts = [
        rule.broken(tables[rule.table], tables).select(
            F.lit(rule.table).alias("table_name"), F.col(rule.key).cast("long").alias("id"),
            (F.expr(rule.message) if rule.is_sql else F.lit(rule.message)).alias("error"),
        )
        for rule in rules
    ]
    if not parts:
        raise ValueError("no rules")
    return reduce(DataFrame.unionByName, parts)


def expression(tree, columns: Sequence[str]) -> Column:
    """A column from a JSON tree: a number, a column name, or {operator: [operands]}.

    Operators: add, subtract, multiply, divide (null for a zero divisor), abs, min and max (null if one is null).
    """
    if isinstance(tree, bool) or tree is None:
        raise ValueError(f"not an operand: {tree!r}")
    if isinstance(tree, (int, float)):
        return F.lit(float(tree))
    if isinstance(tree, str):
        if tree not in columns:
            raise ValueError(f"unknown column {tree!r}")
        return F.col(tree)
    ((operator, operands),) = tree.items()
    values = [expression(t, columns) for t in operands]
    if operator == "abs":
        return F.abs(values[0])
    known = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    combine: dict[str, Callable[[], Column]] = {
        "add": lambda: reduce(lambda a, b: a + b, values),
        "subtract": lambda: reduce(lambda a, b: a - b, values),
        "multiply": lambda: reduce(lambda a, b: a * b, values),
        "divide": lambda: reduce(lambda a, b: a / F.nullif(b, F.lit(0.0)), values),
        "min": lambda: F.when(known, F.least(*values)),
        "max": lambda: F.when(known, F.greatest(*values)),
    }
    if operator not in combine:
        raise ValueError(f"unknown operator {operator!r}")
    return combine[operator]()


def apply_comparisons(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """A compared frame (with in_both) with the columns of its comparison rules and the count of each priority.

    numeric: {"type": "numeric", "name", "left", "right", "threshold", "priority"}: right minus left, null as 0 on one
    side, 0 under the threshold. category: {"type": "category", "name", "left", "right", "priority"}: change text for
    rows of both sides. Each adds name and priority_name; counts are n_info, n_warning and n_critical.
    """
    columns, marks = list(df.columns), []
    for rule in rules:
        name, mark = rule["name"], f"priority_{rule['name']}"
        if rule["type"] == "numeric":
            left, right = expression(rule["left"], columns), expression(rule["right"], columns)
            change = F.coalesce(right, F.lit(0.0)) - F.coalesce(left, F.lit(0.0))
            df = df.withColumn(name, F.when(left.isNull() & right.isNull(), None).when(F.abs(change) < rule["threshold"], 0.0).otherwise(change))
            broken = F.abs(name) > 0
        elif rule["type"] == "category":
            left, right = F.col(rule["left"]), F.col(rule["right"])
            df = df.withColumn(name, F.when(F.length("in_both") > 1, change_text(left, right)))
            broken = (F.length("in_both") > 1) & ~left.eqNullSafe(right)
        else:
            raise ValueError(f"unknown comparison {rule['type']!r}")
        df = df.withColumn(mark, F.when(broken, rule["priority"]).otherwise(""))
        marks.append(F.col(mark))
    for level in ("info", "warning", "critical"):
        count = reduce(lambda a, b: a + b, [(m == level).cast("long") for m in marks], F.lit(0).cast("long"))
        df = df.withColumn(f"n_{level}", count)
    return df


def compare_statistics(df: DataFrame, by: Sequence[str], value_a: str, value_b: str) -> DataFrame:
    """Per group: rows on each side and on both, sums of both sides and their difference (empty sums are 0)."""
    in_a, in_b = F.col("in_both").isin("A", "AB"), F.col("in_both").isin("B", "AB")
    total = lambda c, side: F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count_if(in_a).alias("count_a"), F.count_if(in_b).alias("count_b"), F.count_if(in_a & in_b).alias("count_both"),
        total(value_a, in_a).alias("sum_a"), total(value_b, in_b).alias("sum_b"), (total(value_b, in_b) - total(value_a, in_a)).alias("sum_difference"),
    )


def fix_report(findings: DataFrame, fixes: DataFrame) -> DataFrame:
    """One row per object: its messages and its fixes, each `;`-joined in order of rule id.

    findings: (ids array, rule_id, message); fixes: (rule_id, fix). A rule without a fix adds no fix text.
    """
    each = findings.select(F.explode("ids").alias("id"), "rule_id", "message").join(fixes, "rule_id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("rule_id", "message", "fix")))
    text = lambda part: F.array_join(F.filter(F.transform("_all", lambda r: r[part]), lambda v: v.isNotNull()), ";")
    return each.groupBy("id").agg(ordered.alias("_all")).select("id", F.size("_all").cast("long").alias("n_rules"), text("message").alias("messages"), text("fix").alias("fixes"))


def change_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """`df` with the difference to the previous row of its key: the base of rules on ascending profiles."""
    return df.withColumn("step", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def _compared(tree: Mapping, columns: Sequence[str]) -> tuple[Column, Column]:
    """The value of {function: {left, right, skipna}} and whether exactly one of both sides is null (null beside a number)."""
    ((function, operands),) = tree.items()

    def side(given) -> tuple[Column, bool]:
        return (_compared(given, columns)[0], True) if isinstance(given, Mapping) else (expression(given, columns), isinstance(given, str))

    (left, left_varies), (right, right_varies) = side(operands["left"]), side(operands["right"])
    pick = {"minimum": F.least, "maximum": F.greatest}
    if function in pick:
        value = pick[function](left, right)
        value = value if operands.get("skipna") else F.when(left.isNotNull() & right.isNotNull(), value)
    elif function in ("difference", "add", "multiply"):
        value = {"difference": left - right, "add": left + right, "multiply": left * right}[function]
    else:
        raise ValueError(f"unknown function {function!r}")
    return value, left.isNull() != right.isNull() if left_varies and right_varies else F.lit(None).cast("boolean")


def compare_attributes(df: DataFrame, rules: Sequence[Mapping], threshold: float = 1e-5, priority: str = "critical") -> DataFrame:
    """A compared frame (with in_both) with name, name_change_NaN and name_priority of its comparison rules.

    numeric: {"name", "type", "function", "threshold", "priority"}, the function a tree of difference, add, minimum, maximum
    and multiply over columns and numbers; a result under the threshold is 0, and null if an operand is, but for skipna.
    category: {"name", "type", "left", "right", "priority"}, for rows of both sides only. Threshold and priority have
    defaults.
    """
    columns, added = df.columns, {}
    for rule in rules:
        name, level = rule["name"], rule.get("priority", priority)
        if rule["type"] == "numeric":
            value, turned = _compared(rule["function"], columns)
            value = F.when(F.abs(value) < rule.get("threshold", threshold), 0.0).otherwise(value)
            added |= {name: value, f"{name}_change_NaN": turned, f"{name}_priority": F.when(F.abs(value) > 0, level).otherwise("")}
        elif rule["type"] == "category":
            left, right, both = F.col(rule["left"]), F.col(rule["right"]), F.col("in_both").isin("AB", "both")
            added |= {name: F.when(both, change_text(left, right)), f"{name}_priority": F.when(both & ~left.eqNullSafe(right), level)}
        else:
            raise ValueError(f"unknown comparison {rule['type']!r}")
    return df.withColumns(added)


def attribute_report(layer: DataFrame, key: str, fixes: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, attribute, validation_sum, fixes) of the invalid rows of a layer, per attribute that a fix names.

    layer: key, invalid_critical and invalid_non_critical, ids joined by ;. fixes: (position, attribute, validation_ids,
    fix_id, fix_type, description); rules: (id, error_type, message). Texts are C or W with id and message of the broken
    rules, and AF or MF with id and description of the fixes, each in the order of the fixes and of their ids.
    """
    ids = F.array_distinct(F.split(F.concat_ws(";", F.nullif(F.col("invalid_critical"), F.lit("")), F.nullif(F.col("invalid_non_critical"), F.lit(""))), ";"))
    broken = layer.select(key, F.explode(ids).alias("_id")).select(key, F.trim("_id").try_cast("long").alias("_id")).where("_id IS NOT NULL")
    wanted = fixes.select("position", "attribute", "fix_id", "fix_type", "description", F.posexplode("validation_ids").alias("_nth", "_of"))
    text = F.concat(F.when(F.col("error_type") == "critical", "C").otherwise("W"), F.col("id").cast("string"), F.lit(":"), F.col("message"))
    known = wanted.join(rules.select(F.col("id").alias("_rule"), text.alias("_text")), F.col("_of") == F.col("_rule"), "left")
    fix = F.concat(F.when(F.col("fix_type") == "automatic", "AF").otherwise("MF"), F.col("fix_id").cast("string"), F.lit(":"), F.col("description"))
    each = broken.join(known, F.col("_id") == F.col("_of")).groupBy(key, "attribute").agg(
        F.array_sort(F.collect_list(F.struct("position", "_nth", "_text"))).alias("_texts"), F.array_sort(F.collect_set(F.struct("position", fix.alias("fix")))).alias("_fixes"),
    )
    joined = lambda c, part: F.array_join(F.transform(c, lambda r: r[part]), ";")
    return each.select(key, "attribute", joined("_texts", "_text").alias("validation_sum"), joined("_fixes", "fix").alias("fixes"))


def by_attribute(report: DataFrame, layer: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """One row per object of an attribute report: validation_sum, fixes and the value of every attribute; the value is
    null where the attribute has no fix."""
    own = lambda c, a: F.max(F.when(F.col("attribute") == a, F.col(c))).alias(f"{c}_{a}")
    wide = report.groupBy(key).agg(*[own(c, a) for a in attributes for c in ("validation_sum", "fixes")])
    values = layer.select(F.col(key).alias("_key"), *[F.col(a) for a in attributes if a in layer.columns])
    held = [F.when(F.col(f"fixes_{a}").isNotNull(), F.col(a)).alias(a) for a in attributes if a in layer.columns]
    return wide.join(values, F.col(key) == F.col("_key")).select(*wide.columns, *held)
