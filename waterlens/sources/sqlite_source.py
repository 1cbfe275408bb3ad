"""A Spark data source for tables of SQLite files (GeoPackage layers among them), read in ranges of rowid.

    register(spark)
    spark.read.format("sqlite").option("path", file).option("table", "weir").option("partitions", 8).load()

Comparisons, IN lists, null tests and text prefixes, suffixes and parts that a query filters by are handed to the database,
so only rows that pass leave the file. `columns` names the columns to read, and `bbox` (xmin,ymin,xmax,ymax) keeps rows whose
geometry's box meets it, by the layer's rtree index. Tables without a rowid are read in one part. The file must be at the
same place for driver and executors; geometry stays binary (see `geometry_bytes`). With `log` each part adds a line to that
file: its SQL and the rows it gave.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

_TYPES = (("INT", "long"), ("REAL", "double"), ("DOUB", "double"), ("FLOA", "double"), ("NUM", "double"), ("BLOB", "binary"), ("POINT", "binary"), ("LINE", "binary"), ("POLYGON", "binary"), ("GEOM", "binary"), ("BOOL", "long"))
_SIGNS = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def layers(path: str) -> list[str]:
    """The tables of a file, its own bookkeeping left out."""
    with _open(path) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
    return [n for n in names if not n.startswith(("sqlite_", "gpkg_", "rtree_"))]


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed down to it. Without this setting, which Spark asks for, the
    option pushdown=false reads without."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)


def condition(rule: Filter) -> tuple[str, list] | None:
    """SQL and its values for a filter; None for one that the database cannot decide as Spark does."""
    if isinstance(rule, Not):
        inner = condition(rule.child)
        return inner and (f"NOT ({inner[0]})", inner[1])
    if len(rule.attribute) != 1:
        return None
    name = _quoted(rule.attribute[0])
    plain = lambda v: isinstance(v, int | float | str) and v == v
    if isinstance(rule, IsNull):
        return f"{name} IS NULL", []
    if isinstance(rule, IsNotNull):
        return f"{name} IS NOT NULL", []
    if type(rule) in _SIGNS and plain(rule.value):
        return f"{name} {_SIGNS[type(rule)]} ?", [rule.value]
    if isinstance(rule, In) and rule.value and all(map(plain, rule.value)):
        return f"{name} IN ({', '.join('?' * len(rule.value))})", list(rule.value)
    if isinstance(rule, StringStartsWith):
        return f"substr({name}, 1, ?) = ?", [len(rule.value), rule.value]
    if isinstance(rule, StringEndsWith) and rule.value:
        return f"substr({name}, -?) = ?", [len(rule.value), rule.value]
    if isinstance(rule, StringContains):
        return f"instr({name}, ?) > 0", [rule.value]
    return None


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']!r}")
        kind = lambda t: next((to for part, to in _TYPES if part in t.upper()), "string")
        kinds = {c[1].lower(): kind(c[2] or "") for c in columns}
        wanted = [n.strip().lower() for n in self.options["columns"].split(",")] if "columns" in self.options else list(kinds)
        if missing := [n for n in wanted if n not in kinds]:
            raise ValueError(f"no columns {missing} in {self.options['table']!r}")
        return ", ".join(f"`{n}` {kinds[n]}" for n in wanted)

    def reader(self, schema) -> DataSourceReader:
        return (SqliteReader if self.options.get("pushdown", "true") == "true" else WholeReader)(self.options, schema)


class WholeReader(DataSourceReader):
    """Reads without filters."""

    def __init__(self, options, schema):
        self.path, self.table, self.log = options["path"], options["table"], options.get("log")
        self.parts = int(options.get("partitions", 4))
        self.columns = [f.name for f in schema.fields]
        self.rules: list[str] = []
        self.values: list = []
        if options.get("bbox"):
            self._within(*map(float, options["bbox"].split(",")))

    def _within(self, xmin: float, ymin: float, xmax: float, ymax: float) -> None:
        with _open(self.path) as db:
            index = db.execute("SELECT name FROM sqlite_master WHERE name LIKE ? ESCAPE '!'", (f"rtree!_{self.table}!_%",)).fetchall()
            names = sorted(n for (n,) in index if not n.endswith(("_node", "_parent", "_rowid")))
        if not names:
            raise ValueError(f"{self.table!r} has no rtree index")
        self.rules.append(f"rowid IN (SELECT id FROM {_quoted(names[0])} WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)")
        self.values += [xmin, xmax, ymin, ymax]

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without rowid
                return [Range(None, None)]
        if low is None:
            return [Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = ", ".join(map(_quoted, self.columns)) or "NULL"
        rules, values = list(self.rules), list(self.values)
        if partition.low is not None:
            rules.append("rowid >= ? AND rowid < ?")
            values += [partition.low, partition.high]
        sql = f"SELECT {names} FROM {_quoted(self.table)}" + (f" WHERE {' AND '.join(rules)}" if rules else "")
        n = 0
        with _open(self.path) as db:
            for row in db.execute(sql, values):
                n += 1
                yield row
        if self.log:
            with open(self.log, "a") as log:
                log.write(f"{sql}\t{n}\n")


class SqliteReader(WholeReader):
    """Reads with what of a query's filters the database can decide."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for rule in filters:
            found = condition(rule)
            if found is None:
                yield rule
            else:
                self.rules.append(found[0])
                self.values += found[1]
