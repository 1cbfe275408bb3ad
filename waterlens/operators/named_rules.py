"""Rules that use each other's results: a graph of named results compiled into one plan.

A document lists general rules, which give a named result, and validation rules, whose result is true or false. A rule is a
function with inputs; an input names a column, another rule's result or gives a value. Rules may stand in any order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RuleError(ValueError):
    """A rule that cannot be compiled: an unknown function or input, a name given twice, or results that wait for each other."""


def _compare(sign):
    return lambda left, right, tolerance=0.0: sign(left, right, tolerance)


#: Functions of columns by name: arguments are columns.
FUNCTIONS = {
    "sum": lambda **of: sum(of.values(), F.lit(0.0)),
    "difference": lambda left, right: left - right,
    "multiply": lambda left, right: left * right,
    "divide": lambda left, right: left / F.nullif(right, F.lit(0.0)),
    "less": _compare(lambda a, b, t: a < b + t),
    "at_most": _compare(lambda a, b, t: a <= b + t),
    "greater": _compare(lambda a, b, t: a > b - t),
    "at_least": _compare(lambda a, b, t: a >= b - t),
    "equal": _compare(lambda a, b, t: F.abs(a - b) <= t),
    "between": lambda value, low, high: (value >= low) & (value <= high),
    "outside": lambda value, low, high: (value < low) | (value > high),
    "exists": lambda value: value.isNotNull(),
    "either": lambda left, right: left | right,
    "both": lambda left, right: left & right,
    "negated": lambda value: ~value,
    "if_else": lambda test, then, otherwise: F.when(test, then).otherwise(otherwise),
    "smallest": lambda **of: F.least(*of.values()),
    "largest": lambda **of: F.greatest(*of.values()),
}


def in_order(rules: Sequence[Mapping], known: Sequence[str]) -> list[Mapping]:
    """The rules so that each comes after those whose results it uses."""
    by_name: dict[str, Mapping] = {}
    for rule in rules:
        if rule["name"] in by_name or rule["name"] in known:
            raise RuleError(f"{rule['name']} is given twice")
        by_name[rule["name"]] = rule
    needs: dict[str, set[str]] = {}
    for name, rule in by_name.items():
        used = {i for i in rule["inputs"].values() if isinstance(i, str)}
        if unknown := used - by_name.keys() - set(known):
            raise RuleError(f"{name} uses {sorted(unknown)}, which nothing gives")
        needs[name] = used & by_name.keys()
    try:
        return [by_name[n] for n in TopologicalSorter(needs).static_order()]
    except CycleError as error:
        raise RuleError(f"rules wait for each other: {' <- '.join(error.args[1])}") from error


def expressions(rules: Sequence[Mapping], known: Sequence[str]) -> dict[str, Column]:
    """Each rule's result as a column over the known ones; results in between are columns of the same plan."""
    found: dict[str, Column] = {}
    for rule in in_order(rules, known):
        function = FUNCTIONS.get(rule["function"])
        if function is None:
            raise RuleError(f"{rule['name']}: no function {rule['function']!r}")
        of = {k: (found[v] if v in found else F.col(f"`{v}`")) if isinstance(v, str) else F.lit(v) for k, v in rule["inputs"].items()}
        try:
            found[rule["name"]] = function(**of)
        except TypeError as error:
            raise RuleError(f"{rule['name']}: {error}") from error
    return found


def ends_on(df: DataFrame, key: str, lines: DataFrame, nodes: str, result: str) -> DataFrame:
    """A result of topology: `result`, how many line ends (lines: start_node, end_node) lie on the node `nodes` of each row."""
    ends = lines.select(F.explode(F.array("start_node", "end_node")).alias("_node")).where("_node IS NOT NULL").groupBy("_node").agg(F.count("*").alias(result))
    return df.join(ends, F.col(nodes) == F.col("_node"), "left").drop("_node").na.fill(0, [result])


def with_results(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """`df` with every rule's result. Results are added level by level, so each is computed once however many use it."""
    ordered, made = in_order(rules, df.columns), set(df.columns)
    while ordered:
        ready = [r for r in ordered if all(not isinstance(i, str) or i in made for i in r["inputs"].values())]
        df = df.withColumns(expressions(ready, df.columns))
        made |= {r["name"] for r in ready}
        ordered = [r for r in ordered if r not in ready]
    return df


def findings(df: DataFrame, key: str, general: Sequence[Mapping], checks: Sequence[Mapping]) -> DataFrame:
    """(key, valid, invalid, ignored): per row the ids of validation rules that hold, fail, or could not be told for a null
    input, each joined by ;. A check has an id, a name, a function and inputs, and may name a `filter`, a result that must
    be true for it to apply; active checks only."""
    active = [c for c in checks if c.get("active", True)]
    full = with_results(df, [*general, *[{k: v for k, v in c.items() if k != "filter"} for c in active]])
    applies = lambda c: F.coalesce(F.col(f"`{c['filter']}`"), F.lit(False)) if c.get("filter") else F.lit(True)
    marks = lambda test: F.array_join(F.array_compact(F.array(*[F.when(applies(c) & test(F.col(f"`{c['name']}`")), F.lit(str(c["id"]))) for c in active])), ";")
    if not active:
        return full.select(key, *[F.lit("").alias(c) for c in ("valid", "invalid", "ignored")])
    return full.select(key, marks(lambda r: F.coalesce(r, F.lit(False))).alias("valid"), marks(lambda r: F.coalesce(~r, F.lit(False))).alias("invalid"), marks(lambda r: r.isNull()).alias("ignored"))
