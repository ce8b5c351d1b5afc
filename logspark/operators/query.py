"""The interactive query: search box, filter specifications, facets, sorts, limits, saved profiles."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields
from datetime import date, datetime, time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.dates import date_range, micros_of_day
from logspark.operators.eventlog import transaction_millis
from logspark.operators.techlog import is_active, status_text
from logspark.schema import LGD_SEVERITIES, TECHLOG_FACET_EVENTS

__all__ = ["FilterSpec", "parse_search", "search_predicate", "predicate", "facets", "facet_search", "event_counts", "loaded_range", "sort_keys", "sorted_rows", "top_rows", "without_ids", "details", "grid", "LGD_SEVERITIES"]

# Names of fields in the search box, and columns that a bare word searches.
TECHLOG_FIELDS = {
    "user": "User", "usr": "User", "пользователь": "User", "event": "Event", "событие": "Event", "process": "ProcessName", "процесс": "ProcessName",
    "pid": "ProcessId", "spid": "Spid", "thread": "OSThread", "osthread": "OSThread", "поток": "OSThread", "app": "Application", "приложение": "Application",
    "context": "Context", "контекст": "Context", "sql": "Sql", "status": "status", "статус": "status", "session": "SessionId", "сеанс": "SessionId",
}
EVENTLOG_FIELDS = {
    "user": "User", "usr": "User", "пользователь": "User", "event": "Event", "событие": "Event", "app": "Application", "приложение": "Application",
    "comp": "Computer", "компьютер": "Computer", "server": "Server", "сервер": "Server", "level": "Severity", "уровень": "Severity", "meta": "Metadata",
    "метаданные": "Metadata", "data": "Data", "данные": "Data", "file": "FileName", "файл": "FileName", "comment": "Comment", "комментарий": "Comment",
    "session": "Session", "сеанс": "Session",
}
TECHLOG_ANY = ["Event", "User", "Application", "ProcessName", "ProcessId", "Spid", "OSThread", "SessionId", "Context", "Sql", "Descr", "Locks", "Url", "Method"]
EVENTLOG_ANY = ["Event", "User", "Application", "Metadata", "Comment", "Severity", "DataPresentation", "Computer", "Server", "Session", "Tran", "FileName"]
# Events of each group, steps of the least duration and of the row limit.
EVENT_GROUPS = {
    "errors": lambda e: e.startswith("EXCP") | (e == "QERR"),
    "locks": lambda e: e.isin("TLOCK", "TDEADLOCK", "TTIMEOUT"),
    "dbms": lambda e: e.isin("DBMSSQL", "SDBL", "DBPOSTGRS", "DBORACLE", "DBV8DBENG"),
    "calls": lambda e: e.isin("CALL", "SCALL", "RUNMETH"),
    "long": lambda e: e == "LONGDURATIONINFO",
}
MIN_DURATION_STEPS = (10, 100, 1000, 5000, 10000)
LIMITS = (1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000)


# ------------------------------------------------------------------- search


def parse_search(text: str) -> list[tuple[bool, str | None, str]]:
    """(negated, field prefix or None, word) of each token; tokens stand between spaces, commas and semicolons."""
    out = []
    for token in re.split(r"[ ,;\r\n\t]+", text or ""):
        token = token.strip("\"'")
        negated = False
        for mark in ("NOT:", "НЕ:", "!", "-"):
            if token.upper().startswith(mark) and len(token) >= len(mark):
                negated, token = True, token[len(mark) :]
                break
        if token:
            prefix, colon, word = token.partition(":")
            out.append((negated, prefix.lower() if colon and word else None, word if colon and word else token))
    return out


def _has(c: Column, word: str) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word.lower()))


def search_predicate(text: str, kind: str, any_columns: list[str] | None = None, field_names: dict[str, str] | None = None, properties: str | None = None) -> Column:
    """All tokens of the search box must hold; kind is 'techlog' or 'eventlog'.

    An unknown prefix searches any field for the whole token in the technical log, and for the part
    after the colon in the event log.
    """
    names = field_names if field_names is not None else (TECHLOG_FIELDS if kind == "techlog" else EVENTLOG_FIELDS)
    columns = any_columns if any_columns is not None else (TECHLOG_ANY if kind == "techlog" else EVENTLOG_ANY)
    status = kind == "techlog" and any_columns is None

    def anywhere(word: str) -> Column:
        parts = [_has(F.col(c), word) for c in columns]
        if status:
            parts.append(_has(status_text(), word))
            properties_column = properties or "Properties"
            parts.append(F.exists(F.map_values(properties_column), lambda v: _has(v, word)))
        return reduce(lambda a, b: a | b, parts)

    def one(negated: bool, prefix: str | None, word: str) -> Column:
        if prefix is None:
            found = anywhere(word)
        elif prefix in names:
            found = _has(status_text() if names[prefix] == "status" else F.col(names[prefix]), word)
        else:
            found = anywhere(f"{prefix}:{word}" if kind == "techlog" else word)
        return ~F.coalesce(found, F.lit(False)) if negated else F.coalesce(found, F.lit(False))

    return reduce(lambda a, b: a & b, [one(*token) for token in parse_search(text)], F.lit(True))


# ------------------------------------------------------------------ filters


@dataclass
class FilterSpec:
    """A saved query on either log; empty members do not restrict. Values compare without case."""

    kind: str = "techlog"
    search: str = ""
    event: str | None = None
    event_group: str | None = None
    excluded_events: list[str] = field(default_factory=list)
    status: str | None = None
    status_excluded: bool = False
    excluded_processes: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    excluded_levels: list[str] = field(default_factory=list)
    min_duration_ms: float | None = None
    date_from: date | None = None
    date_to: date | None = None
    time_from: time | datetime | None = None
    time_to: time | datetime | None = None
    include: dict[str, list[str]] = field(default_factory=dict)
    exclude: dict[str, list[str]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({k: v.isoformat() if isinstance(v, (date, time)) else v for k, v in asdict(self).items()}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> FilterSpec:
        """Unknown members are ignored; times with a date are exact bounds."""
        raw = {k: v for k, v in json.loads(text).items() if k in {f.name for f in fields(cls)}}
        for name in ("date_from", "date_to"):
            if raw.get(name):
                raw[name] = date.fromisoformat(raw[name][:10])
        for name in ("time_from", "time_to"):
            if raw.get(name):
                raw[name] = datetime.fromisoformat(raw[name]) if len(raw[name]) > 15 else time.fromisoformat(raw[name])
        return cls(**raw)


def _in(c: str | Column, values: list[str]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.coalesce(c, F.lit(""))).isin([v.lower() for v in values])


def _time_bound(bound: time | datetime, lower: bool, when: Column) -> Column:
    if isinstance(bound, datetime):
        return when >= F.lit(bound) if lower else when <= F.lit(bound)
    micros = ((bound.hour * 60 + bound.minute) * 60 + bound.second) * 1_000_000 + bound.microsecond
    return micros_of_day(when) >= micros if lower else micros_of_day(when) <= micros


def predicate(spec: FilterSpec, **search_options) -> Column:
    """The filter as one Column: all clauses must hold."""
    when, clauses = F.col("DateTime"), []
    if spec.search.strip():
        clauses.append(search_predicate(spec.search, spec.kind, **search_options))
    if spec.event:
        clauses.append(_in("Event", [spec.event]))
    if spec.event_group:
        clauses.append(EVENT_GROUPS[spec.event_group](F.upper("Event")))
    if spec.excluded_events:
        clauses.append(~_in("Event", spec.excluded_events))
    if spec.status:
        same = _in(status_text(), [spec.status])
        clauses.append(~same if spec.status_excluded else same)
    if spec.excluded_processes:
        clauses.append(~_in("ProcessName", spec.excluded_processes))
    if spec.levels:
        clauses.append(_in("Severity", spec.levels))
    if spec.excluded_levels:
        clauses.append(~_in("Severity", spec.excluded_levels))
    if spec.min_duration_ms is not None:
        clauses.append((F.col("DurationMs") if spec.kind == "techlog" else transaction_millis()) >= spec.min_duration_ms)
    start, end = date_range(spec.date_from, spec.date_to)
    if start:  # bounds on the column itself, so that they reach the files' statistics
        clauses.append((when >= F.lit(datetime.combine(start, time()))) & (when < F.date_add(F.lit(end), 1).cast("timestamp")))
    if spec.time_from is not None:
        clauses.append(_time_bound(spec.time_from, True, when))
    if spec.time_to is not None:
        clauses.append(_time_bound(spec.time_to, False, when))
    clauses += [_in(c, values) for c, values in spec.include.items() if values]
    clauses += [~_in(c, values) for c, values in spec.exclude.items() if values]
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


# ------------------------------------------------------------------- facets

TECHLOG_FACETS, EVENTLOG_FACETS = ["User", "Application", "ProcessId", "Spid", "OSThread"], ["User", "Application", "Metadata", "Event"]


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, n: how often each value occurs, without case (shown as its least spelling); blanks are left out."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f"))
    long = long.select("f.field", "f.value").filter(F.trim(F.coalesce("value", F.lit(""))) != "")
    return long.groupBy("field", F.lower("value").alias("key")).agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n")).drop("key")


def facet_search(counted: DataFrame, text: str) -> DataFrame:
    return counted.filter(_has(F.col("value"), text))


def event_counts(rows: DataFrame, known: list[str] | None = None, column: str = "Event") -> DataFrame:
    """event, n for every event that occurs, and 0 for known ones that do not."""
    spark = rows.sparkSession
    present = rows.groupBy(F.col(column).alias("event")).agg(F.count(F.lit(1)).alias("n"))
    catalog = spark.createDataFrame([(e,) for e in (known if known is not None else TECHLOG_FACET_EVENTS)], "event string")
    return present.join(catalog, "event", "full").select("event", F.coalesce("n", F.lit(0)).alias("n"))


def loaded_range(rows: DataFrame, column: str = "DateTime") -> DataFrame:
    return rows.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------------- sorts

# The orders offered for each log, and the keys they stand for.
SORT_PRESETS = {
    "newest": [("DateTime", True)], "oldest": [("DateTime", False)], "longest": [("Duration", True)], "longest-newest": [("Duration", True), ("DateTime", True)],
    "event-longest": [("Event", False), ("Duration", True)], "user": [("User", False), ("DateTime", True)], "severity": [("Severity", False), ("DateTime", True)],
    "event": [("Event", False), ("DateTime", True)], "active": [("IsActiveOperation", True), ("Duration", True)], "metadata": [("Metadata", False)],
}
TECHLOG_PRESETS = ["newest", "oldest", "longest", "longest-newest", "event-longest", "user"]
EVENTLOG_PRESETS = ["newest", "oldest", "severity", "event", "user"]


def sort_keys(keys: list[tuple[str, bool]], types: dict[str, str], date_column: str = "DateTime", extra: list[str] | None = None) -> list[Column]:
    """Sort columns of (name, descending) keys: texts without case, nulls lowest, newest first among equals, then extra columns."""
    out = []
    for name, descending in keys:
        if name == "IsActiveOperation":
            c = is_active()
        elif name == "DurationMs" and "DurationMs" not in types:
            c = transaction_millis()
        else:
            c = F.lower(name) if types.get(name) == "string" else F.col(name)
        out.append(c.desc_nulls_last() if descending else c.asc_nulls_first())
    return [*out, F.col(date_column).desc_nulls_last(), *[F.col(c).asc() for c in extra or []]]


def push_key(keys: list[tuple[str, bool]], name: str) -> list[tuple[str, bool]]:
    """A newly chosen key goes first; choosing the first again turns its direction."""
    if keys and keys[0][0] == name:
        return [(name, not keys[0][1]), *keys[1:]]
    return [(name, False), *[k for k in keys if k[0] != name]]


def sorted_rows(rows: DataFrame, keys: list[tuple[str, bool]] | str = "newest", **options) -> DataFrame:
    keys = SORT_PRESETS[keys] if isinstance(keys, str) else keys
    return rows.orderBy(*sort_keys(keys, dict(rows.dtypes), **options))


def top_rows(rows: DataFrame, keys: list[tuple[str, bool]] | str, limit: int | None, **options) -> DataFrame:
    """The first rows in order (a top-k, deterministic with a total order); limit None returns all."""
    ordered = sorted_rows(rows, keys, **options)
    return ordered.limit(limit) if limit else ordered


def without_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def details(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, pos, name, value: each row as a list of its fields."""
    items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    return rows.select(key, F.explode(items).alias("d")).select(key, "d.pos", "d.name", "d.value")


# Columns that each log shows.
TECHLOG_GRID = ["DateFormatted", "DurationFormatted", "Event", "ProcessName", "ProcessId", "Spid", "OSThread", "User", "Application", "SessionId", "Context"]
EVENTLOG_GRID = ["DateFormatted", "Event", "Severity", "User", "Application", "Computer", "Metadata", "Data", "DataPresentation", "Comment", "Tran", "TransactionStatus", "Session", "FileName"]


def grid(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(*(TECHLOG_GRID if kind == "techlog" else EVENTLOG_GRID))
