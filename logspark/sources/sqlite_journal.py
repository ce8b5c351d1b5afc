"""SQLite event journals as a Spark data source: ranges of rowid are read in parallel, and followed as they grow.

    spark.dataSource.register(SqliteJournal)
    spark.read.format("sqlite_journal").option("path", files).load()

Options: path (files, separated by commas, that driver and executors can open), part ('rows', 'codes'
or 'last'), from_row (rows after it), date_from and date_to (days, tested by SQLite), newest (so many
of the latest rows of each file), rows_per_partition, and for streams starting ('earliest', or
'latest' to skip the rows that a file has when it is first seen at the start of the stream).
Filters on columns of numbers (comparisons, lists, nulls and their negations) are tested by SQLite, on
every column that a row has; so is a date, as units (lgd.date_units).
SQLite reads a write-ahead log beside the file, and rowids tell what is new, so growth needs no sizes.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not

NAME = "sqlite_journal"
#: Columns of EventLog; those that some releases have not are 0 there.
ROW_COLUMNS = {
    "rowID": "long", "severity": "long", "date": "long", "connectID": "long", "session": "long", "transactionStatus": "long", "transactionID": "long", "userCode": "long", "appCode": "long",
    "eventCode": "long", "comment": "string", "dataPresentation": "string", "metadataCodes": "string", "computerCode": "long", "workServerCode": "long", "primaryPortCode": "long",
}
OPTIONAL = ("computerCode", "workServerCode", "primaryPortCode")
CODE_TABLES = {
    "UserCodes": "user", "ComputerCodes": "computer", "AppCodes": "app", "EventCodes": "event", "MetadataCodes": "metadata", "WorkServerCodes": "server", "PrimaryPortCodes": "port",
}
SCHEMAS = {
    "rows": "path string, size long, " + ", ".join(f"{c} {k}" for c, k in ROW_COLUMNS.items()), "codes": "path string, kind string, code long, name string, uuid string", "last": "path string, last long",
}
#: Days from 0001-01-01 on, in units of 100 microseconds.
DAY_UNITS = 86_400 * 10_000

#: Tests of SQLite for filters of one value.
COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def sql_test(f: Filter) -> tuple[str, list] | None:
    """A filter on a column of numbers as a test of SQLite and its values; None for others."""
    if isinstance(f, Not):
        inner = sql_test(f.child)
        return (f"NOT ({inner[0]})", inner[1]) if inner else None
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if ROW_COLUMNS.get(column) != "long":
        return None
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
    if isinstance(f, In):
        return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
    return (f"{column} {COMPARED[type(f)]} ?", [f.value]) if type(f) in COMPARED else None


@dataclass
class Rows(InputPartition):
    path: str
    after: int
    upto: int
    newest: int = 0


def _open(path: str) -> sqlite3.Connection:
    out = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=3)
    out.execute("PRAGMA query_only = ON")
    return out


def _tables(db: sqlite3.Connection) -> set[str]:
    return {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}


def last_row(path: str) -> int:
    """The greatest rowid of a journal, 0 if it has none or is no journal yet."""
    if not os.path.exists(path):
        return 0
    with closing(_open(path)) as db:
        return db.execute("SELECT coalesce(max(rowID), 0) FROM EventLog").fetchone()[0] if "EventLog" in _tables(db) else 0


def _uuid(value: object) -> str:
    return str(uuid.UUID(bytes_le=value)) if isinstance(value, bytes) and len(value) == 16 else str(value or "")


class _Options:
    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}.get
        self.paths = [p.strip().removeprefix("file://") for p in get("path", "").split(",") if p.strip()]
        self.part, self.after, self.newest = get("part", "rows"), int(get("from_row", "0")), int(get("newest", "0"))
        self.each, self.latest = int(get("rows_per_partition", "100000")), get("starting", "earliest") == "latest"
        self.pushed: list[tuple[str, list]] = []
        self.start, self.end = (date.fromisoformat(d) if (d := get(k)) else None for k in ("date_from", "date_to"))

    def ranges(self, path: str, after: int, upto: int) -> list[Rows]:
        if self.newest:
            return [Rows(path, after, upto, self.newest)] if upto > after else []
        return [Rows(path, at, min(at + self.each, upto)) for at in range(after, upto, self.each)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        with closing(_open(part.path)) as db:
            if self.part == "codes":
                yield from self._codes(db, part.path)
                return
            have = {r[1].lower() for r in db.execute("PRAGMA table_info(EventLog)")}
            columns = ", ".join("0" if c in OPTIONAL and c.lower() not in have else c for c in ROW_COLUMNS)
            tests, values = ["rowID > ?", "rowID <= ?"], [part.after, part.upto]
            if self.start:
                tests, values = [*tests, "date >= ?"], [*values, (self.start.toordinal() - 1) * DAY_UNITS]
            if self.end:
                tests, values = [*tests, "date < ?"], [*values, self.end.toordinal() * DAY_UNITS]
            # a column that a release has not is 0 in its rows
            absent = {c for c in OPTIONAL if c.lower() not in have}
            for test, given in self.pushed:
                column = next(c for c in ROW_COLUMNS if c in test.replace("(", " ").split())
                tests, values = [*tests, test.replace(column, "0") if column in absent else test], [*values, *given]
            order = f"DESC LIMIT {part.newest}" if part.newest else "ASC"
            found = db.execute(f"SELECT {columns} FROM EventLog WHERE {' AND '.join(tests)} ORDER BY rowID {order}", values)
            size = os.path.getsize(part.path)
            while rows := found.fetchmany(5_000):
                arrays = [pa.array([part.path] * len(rows)), pa.array([size] * len(rows), pa.int64())]
                for (_, kind), column in zip(ROW_COLUMNS.items(), zip(*rows, strict=True), strict=True):
                    arrays.append(pa.array(column, pa.int64()) if kind == "long" else pa.array([None if x is None else str(x) for x in column], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "size", *ROW_COLUMNS])

    def _codes(self, db: sqlite3.Connection, path: str) -> Iterator[pa.RecordBatch]:
        there = _tables(db)
        for table, kind in CODE_TABLES.items():
            if table not in there:
                continue
            known = "uuid" if any(r[1].lower() == "uuid" for r in db.execute(f"PRAGMA table_info({table})")) else "NULL"
            found = db.execute(f"SELECT code, coalesce(name, ''), {known} FROM {table}")
            while rows := found.fetchmany(5_000):
                columns = [pa.array([path] * len(rows), pa.string()), pa.array([kind] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([_uuid(r[2]) for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "kind", "code", "name", "uuid"])


class _Reader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """What SQLite tests itself; the rest is Spark's. Of the newest rows only those count that are among them, so nothing is tested before."""
        if self.options.part != "rows" or self.options.newest:
            return filters
        tests = [(f, sql_test(f)) for f in filters]
        self.options.pushed = [t for _, t in tests if t]
        return [f for f, t in tests if not t]

    def partitions(self) -> list[Rows]:
        o = self.options
        if o.part != "rows":
            return [Rows(p, 0, 0) for p in o.paths if os.path.exists(p)]
        return [r for p in o.paths for r in o.ranges(p, o.after, last_row(p))]

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        if self.options.part == "last":
            yield pa.RecordBatch.from_pydict({"path": [partition.path], "last": [last_row(partition.path)]})
            return
        yield from self.options.read(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the last rowid of each file; a file that got shorter is read from its start."""

    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        o = self.options
        return {p: last_row(p) if o.latest else o.after for p in o.paths}

    def latestOffset(self) -> dict:
        return {p: last_row(p) for p in self.options.paths}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        parts = []
        for path, upto in end.items():
            after = start.get(path, 0)
            parts += self.options.ranges(path, 0 if upto < after else after, upto)
        return parts

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        yield from self.options.read(partition)

    def commit(self, end: dict) -> None:
        pass


class SqliteJournal(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[_Options(self.options).part]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Options(self.options))


def read_journal(spark: SparkSession, paths: list[str], **options: object) -> DataFrame:
    """Rows of journals (or, with part, their codes or last rowids)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteJournal)
    return spark.read.format(NAME).options(path=",".join(paths), **{k: str(v) for k, v in options.items()}).load()


def stream_journal(spark: SparkSession, paths: list[str], **options: object) -> DataFrame:
    """New rows of journals as they are written."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteJournal)
    return spark.readStream.format(NAME).options(path=",".join(paths), **{k: str(v) for k, v in options.items()}).load()
