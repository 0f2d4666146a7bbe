"""Tables of SQLite files as a Spark data source, read by ranges of row ids.

`spark.read.format("sqlite").option("table", t).load(path)` gives a partition for each range. Each task opens
the file read-only and reads inside one transaction; the state of the file and of its log is taken when the
scan is planned and looked at again around each range, so all ranges come from one state or the read fails
and can be tried again. A schema given with `.schema(...)` is the columns that are read; comparisons with
constants go into the file's own query where spark.sql.python.filterPushdown.enabled is set (and, without
`table`, the option pushdown); Spark still applies them.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith
from pyspark.sql.types import StructType

#: Rows of a range at least.
RANGE = 50_000
_KINDS = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
_TESTS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_TAKES = {"long": (int,), "integer": (int,), "double": (int, float), "string": (str, int, float), "binary": (bytes,), "boolean": (int,)}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(path: str) -> sqlite3.Connection:
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True, isolation_level=None)


def _state(path: str) -> tuple:
    """Change counter of the file's header, and how far its log goes."""
    with open(path, "rb") as file:
        counter = file.read(100)[24:28]
    log = path + "-wal"
    return counter, (os.path.getsize(log), os.stat(log).st_mtime_ns) if os.path.exists(log) and os.path.getsize(log) else None


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None, state: tuple):
        self.low, self.high, self.state = low, high, state


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, rows: int):
        self.path, self.table, self.schema, self.rows = path, table, schema, rows
        self.where, self.values = [], []

    def _told(self, f: Filter) -> tuple[str, list] | None:
        """A filter as SQL that lets every row pass that Spark would; None if there is none."""
        inner = f.child if isinstance(f, Not) else f
        name = _quoted(inner.attribute[0]) if len(getattr(inner, "attribute", ())) == 1 else None
        if name is None or isinstance(f, Not) and not isinstance(inner, IsNull | IsNotNull | EqualTo):
            return None
        plain = lambda v: isinstance(v, int | float | str) and not isinstance(v, bool | date)
        if isinstance(inner, IsNull | IsNotNull):
            # a value of another type than the column's reads as null, so only values can be asked for
            return (f"{name} IS NOT NULL", []) if isinstance(inner, IsNotNull) != isinstance(f, Not) else None
        if isinstance(f, Not):
            return None
        if type(inner) in _TESTS and plain(inner.value):
            # texts that hold numbers compare as texts in Spark, so numbers that stand in a text column pass
            return (f"({name} {_TESTS[type(inner)]} ? OR typeof({name}) NOT IN ('text'))", [inner.value]) if isinstance(inner.value, str) else (f"{name} {_TESTS[type(inner)]} ?", [inner.value])
        if isinstance(inner, In) and inner.value and all(plain(v) and not isinstance(v, str) for v in inner.value):
            return f"{name} IN ({', '.join('?' * len(inner.value))})", list(inner.value)
        if isinstance(inner, StringStartsWith):
            return f"(substr({name}, 1, ?) = ? OR typeof({name}) NOT IN ('text'))", [len(inner.value), inner.value]
        return None

    def partitions(self) -> list[_Range]:
        state = _state(self.path)
        with closing(_opened(self.path)) as base:
            try:
                low, high, n = base.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [_Range(None, None, state)]  # a table without row ids, or a view, is one range
        if low is None:
            return [_Range(0, 0, state)]
        parts = max(1, min(1000, n // self.rows))
        edges = [low + (high + 1 - low) * k // parts for k in range(parts + 1)]
        return [_Range(a, b, state) for a, b in zip(edges, edges[1:], strict=False) if a < b]

    def read(self, partition: _Range) -> Iterator[tuple]:
        kinds = [_TAKES.get(f.dataType.typeName(), (str,)) for f in self.schema]
        text = [f.dataType.typeName() == "string" for f in self.schema]
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where, values = [*where, "rowid >= ?", "rowid < ?"], [*values, partition.low, partition.high]
        columns = ", ".join(_quoted(f.name) for f in self.schema) or "1"
        with closing(_opened(self.path)) as base:
            base.execute("BEGIN")
            rows = base.execute(f"SELECT {columns} FROM {_quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values)
            if _state(self.path) != partition.state:
                raise RuntimeError(f"{self.path} has changed since the scan was planned")
            for row in rows:
                yield tuple((str(x) if is_text else x) if isinstance(x, kind) else None for x, kind, is_text in zip(row, kinds, text, strict=True)) if kinds else ()


class _Pushed(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if told := self._told(f):
                self.where.append(told[0])
                self.values += told[1]
        return filters


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with closing(_opened(self.options["path"])) as base:
            told = base.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not told:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return ", ".join(f"`{name}` {next((k for part, k in _KINDS if part in kind.upper()), 'string')}" for _, name, kind, *_ in told)

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _Pushed if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["path"], self.options["table"], schema, int(self.options.get("rows", RANGE)))


def table(spark: SparkSession, path: str, name: str, columns: str | None = None, rows: int = RANGE) -> DataFrame:
    """A table of a file, or the given columns of it (as a DDL schema). The file must be reachable from every executor.

    Values of another type than their column's are null; numbers in a text column are read as text.
    """
    spark.dataSource.register(SqliteSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    reader = spark.read.format("sqlite").options(table=name, rows=str(rows), pushdown=pushdown)
    return (reader.schema(columns) if columns else reader).load(path)
