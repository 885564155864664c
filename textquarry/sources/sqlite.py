"""SRC-07: SQLite tables as a data source, with filters pushed down and partitions by ranges of rowid.

The file is opened read-only with the standard sqlite3, so every executor must see it under the same path (a shared mount)."""

from __future__ import annotations

import json
import math
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _kind(declared: str) -> T.DataType:
    """The type of a column by what its declaration holds, after SQLite's own rules of affinity; booleans are told apart."""
    d = (declared or "").upper()
    if "BOOL" in d:
        return T.BooleanType()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return T.StringType()


#: What a column may hold to count as a value of its type; anything else is null.
_HELD = {T.BooleanType: (int,), T.LongType: (int,), T.DoubleType: (int, float), T.StringType: (str,), T.BinaryType: (bytes,)}
_ARROW = {T.BooleanType: pa.bool_(), T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}
_TYPEOF = {T.BooleanType: "'integer'", T.LongType: "'integer'", T.DoubleType: "'integer', 'real'", T.StringType: "'text'", T.BinaryType: "'blob'"}
#: What a condition may compare with.
_SIGNS = ("=", "<>", ">", ">=", "<", "<=")
Condition = tuple[str, str, object]


class _Rows(D.InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


def condition(kind: type, column: str, sign: str, value: object) -> tuple[str, list] | None:
    """SQL that holds for all rows for which `column sign value` holds in Spark, perhaps for more; None if there is none."""
    c = _name(column)
    fits = lambda v: isinstance(v, _HELD[kind]) and not (isinstance(v, float) and not math.isfinite(v)) and not (isinstance(v, int) and abs(v) >= 1 << 63)
    if sign == "is null":
        return f"({c} IS NULL OR typeof({c}) NOT IN ({_TYPEOF[kind]}))", []
    if sign == "is not null":
        return f"{c} IS NOT NULL", []
    if kind is T.BooleanType:
        return (f"{c} <> 0" if value else f"{c} = 0", []) if sign == "=" and isinstance(value, bool) else None
    if sign == "in":
        values = [v for v in value if v is not None]
        return (f"{c} IN ({', '.join('?' * len(values))})", values) if len(values) <= 500 and all(map(fits, values)) else None
    if not fits(value):
        return None
    if kind is T.StringType and sign == "starts with":
        return f"substr({c}, 1, length(?)) = ?", [value, value]
    if kind is T.StringType and sign == "contains":
        return f"instr({c}, ?) > 0", [value]
    return (f"{c} {sign} ?", [value]) if sign in _SIGNS else None


def _column(column: str, sign: str, value: object) -> Column:
    c = F.col(f"`{column}`")
    plain = {
        "=": lambda: c == F.lit(value), "<>": lambda: c != F.lit(value), ">": lambda: c > F.lit(value), ">=": lambda: c >= F.lit(value), "<": lambda: c < F.lit(value), "<=": lambda: c <= F.lit(value),
        "in": lambda: c.isin(list(value)), "is null": c.isNull, "is not null": c.isNotNull, "starts with": lambda: c.startswith(value), "contains": lambda: c.contains(value),
    }
    return plain[sign]()


class SqliteReader(D.DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, parts: int, where: list[Condition] = ()) -> None:
        self.path, self.table, self.fields, self.parts = path, table, schema.fields, parts
        kinds = {f.name: type(f.dataType) for f in schema.fields}
        got = [x for c, sign, v in where if (x := condition(kinds[c], c, sign, v))]
        self.where, self.values = [x[0] for x in got], [v for x in got for v in x[1]]

    def partitions(self) -> list[_Rows]:
        con = _open(self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a view, or a table without rowid
            return [_Rows(None, None)]
        finally:
            con.close()
        if low is None:
            return [_Rows(0, 0)]
        n = min(self.parts, high - low + 1)
        cuts = [low + (high - low + 1) * i // n for i in range(n + 1)]
        return [_Rows(a, b) for a, b in zip(cuts, cuts[1:])]

    def query(self, part: _Rows) -> tuple[str, list]:
        where, values = list(self.where), list(self.values)
        if part.low is not None:
            where.append("rowid >= ? AND rowid < ?")
            values += [part.low, part.high]
        columns = ", ".join(_name(f.name) for f in self.fields)
        return f"SELECT {columns} FROM {_name(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        con = _open(self.path)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        try:
            rows = con.execute(*self.query(part))
            kinds = [type(f.dataType) for f in self.fields]
            while some := rows.fetchmany(10_000):
                cols = []
                for kind, col in zip(kinds, zip(*some, strict=True), strict=True):
                    col = [v if isinstance(v, _HELD[kind]) else None for v in col]
                    cols.append(pa.array([None if v is None else v != 0 for v in col] if kind is T.BooleanType else [None if v is None else float(v) for v in col] if kind is T.DoubleType else col, _ARROW[kind]))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in self.fields])
        finally:
            con.close()


class SqliteSource(D.DataSource):
    """Format `sqlite` with options path, table, parts (8) and where (conditions as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        con = _open(self.options["path"])
        rows = con.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        con.close()
        if not rows:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(r[1], _kind(r[2])) for r in rows])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("parts", 8)), json.loads(self.options.get("where", "[]")))


def table(spark: SparkSession, path: str, name: str, parts: int = 8, where: list[Condition] = ()) -> DataFrame:
    """SRC-07: a table of a SQLite file. Columns have the type of their declaration; what is of another type (SQLite
    allows it) is null. Conditions (column, sign, value) are pushed down: SQLite leaves out what it can, by its indexes where there are any,
    and Spark applies them again. The signs are = <> > >= < <=, in, is null, is not null, starts with and contains. They are options of
    the source and not taken from later filters, as Spark 4.1 keeps what was pushed for one query of a Python source for the next one."""
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("table", name).option("parts", parts).option("where", json.dumps(list(where))).load(path)
    for c in where:
        df = df.filter(_column(*c))
    return df
