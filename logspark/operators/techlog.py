"""Technical log records: header, key=value pairs, promotion of known keys to columns.

The header is read with built-in functions, so that conditions on date, duration, event and level
can be tested before the rest of a record is. The pairs of the others are read in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.functions import scan
from logspark.functions.ids import record_id, techlog_scope
from logspark.functions.text import format_micros, lookup
from logspark.plans.catalog import process_of, techlog_name_date
from logspark.schema import TECHLOG_EVENTS, TECHLOG_SCHEMA

HEADER = r"^(\d{2}):(\d{2})\.(\d+)-(\d+),([^,\r\n]+),(\d+)"
#: Longer records are cut to so many characters, with a note as their description.
MAX_RECORD, CUT_NOTE = 262_144, "\ndescr='... [TRUNCATED MASSIVE BLOCK TO 256KB]'"

#: Keys of each column in order of preference (lower case; ':' in keys reads as '_').
PROMOTED = {
    "User": ["usr", "user", "username", "p_user", "p_usr", "t_user"],
    "Application": ["t_applicationname", "app"],
    "ConnectId": ["t_connectid", "connectid"],
    "ClientId": ["t_clientid", "clientid"],
    "Spid": ["spid", "dbpid", "dbmsserverpid", "serverpid", "dbpid_1c"],
    "OSThread": ["osthread"],
    "LongInfoName": ["longinfoname"],
    "LongInfoWait": ["longinfowait"],
    "SessionId": ["sessionid"],
    "Context": ["context"],
    "Sql": ["sql"],
    "Locks": ["locks"],
    "WaitConnections": ["waitconnections"],
    "LkSrc": ["lksrc"],
    "Descr": ["descr"],
    "Rows": ["rows"],
    "InBytes": ["inbytes"],
    "OutBytes": ["outbytes"],
    "Method": ["method"],
    "Url": ["uri", "url"],
}
PROCESS_KEYS, PID_KEYS = ["p_processname", "processname"], ["p_processid", "processid"]
NUMBERS = ("LongInfoWait", "Rows", "InBytes", "OutBytes")
MULTILINE = ("Context", "Sql", "Descr", "Locks")


def _promoted(found: dict[str, tuple[str, str]], keys: list[str]) -> str:
    """The first value of keys that is not empty, '' if there is none; the pairs tried for it are taken out."""
    for key in keys:
        value = found.pop(key, ("", ""))[1]
        if value:
            return value
    return ""


def _pairs(wanted: set[str]):
    """Rows of headers with body, process and pid to rows with those of the promoted columns that are wanted, and Properties."""
    rest = "Properties" in wanted
    # a pair that a promoted column takes is no property, so properties need all of them
    promoted = {n: keys for n, keys in PROMOTED.items() if rest or n in wanted}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            body, process, pid = (batch.column(names.index(n)).to_pylist() for n in ("body", "process", "pid"))
            out: dict[str, list] = {n: [] for n in (*promoted, "ProcessName", "ProcessId", *(["Properties"] if rest else []))}
            for text, own_process, own_pid in zip(body, process, pid, strict=True):
                found = scan.pairs(text) if text else {}
                own_process, own_pid = own_process or "", own_pid or ""
                for name, keys in promoted.items():
                    value = _promoted(found, keys)
                    out[name].append(value if name in NUMBERS else scan.lines(value) if name in MULTILINE else scan.flat(value))
                inline = _promoted(found, PROCESS_KEYS) if own_process in ("", "default") else ""
                out["ProcessName"].append(inline or own_process)
                out["ProcessId"].append(own_pid or _promoted(found, PID_KEYS))
                if rest:
                    out["Properties"].append([(key, scan.flat(value)) for key, value in found.values()])
            head = [n for n in names if n not in ("body", "process", "pid")]
            columns = [batch.column(names.index(n)) for n in head]
            columns += [pa.array(v, pa.map_(pa.string(), pa.string()) if n == "Properties" else pa.string()) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*head, *out])

    return pairs


def is_active() -> Column:
    return (F.upper("Event") == "LONGDURATIONINFO") | (F.coalesce("LongInfoName", F.lit("")) != "") | F.col("LongInfoWait").isNotNull()


def status_text() -> Column:
    return F.when(is_active(), "Выполняется").otherwise("Завершено")


def empty_event() -> Column:
    """No duration, level 0 and nothing to say."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (F.coalesce("Duration", F.lit(0)) == 0) & (F.coalesce("Level", F.lit(0)) == 0) & blank("Context") & blank("Sql") & blank("Locks") & blank("Descr")


def file_place(records: DataFrame) -> DataFrame:
    """hour, process and pid from the file's path (and from modified, if it is there): see the catalogue's rules."""
    process, pid = process_of(F.col("file"))
    modified = F.col("modified") if "modified" in records.columns else None
    return records.withColumns({"hour": techlog_name_date(F.col("file"), modified), "process": process, "pid": pid})


def read_headers(records: DataFrame) -> DataFrame:
    """id, DateTime, Duration, DurationMs, Event, Level, process, pid and body of records (raw, hour, process, pid); others than records are dropped.

    The id is that of the whole text; a body beyond MAX_RECORD is cut, with a note.
    """
    part = lambda i: F.regexp_extract("raw", HEADER, i)
    rows = records.filter(F.col("raw").rlike(HEADER))
    micros = F.rpad(F.substring(part(3), 1, 6), 6, "0").cast("long") + (part(1).cast("long") * 60 + part(2).cast("long")) * 1_000_000
    duration, event = part(4).cast("long"), F.trim(part(5))
    raw = F.when(F.length("raw") > MAX_RECORD, F.concat(F.substring("raw", 1, MAX_RECORD), F.lit(CUT_NOTE))).otherwise(F.col("raw"))
    return rows.select(
        record_id(F.col("raw"), techlog_scope(F.col("process"), F.col("pid"), F.col("hour"))).alias("id"), F.timestamp_micros(F.unix_micros("hour") + micros).alias("DateTime"), duration.alias("Duration"),
        F.round(duration / 1000.0, 3).alias("DurationMs"), lookup(F.upper(event), {e: e for e in TECHLOG_EVENTS}, event).alias("Event"), part(6).cast("int").alias("Level"), "process", "pid",
        F.regexp_replace(raw, HEADER, "").alias("body"),
    )


#: Columns that other columns of the result are made of, and those that a record's header gives.
_SOURCES = {"DateFormatted": ("DateTime",), "DurationSec": ("Duration",), "DurationFormatted": ("Duration",), "SessionId": ("SessionId", "ClientId")}
HEADER_COLUMNS = ("id", "DateTime", "Duration", "DurationMs", "Event", "Level", "DateFormatted", "DurationSec", "DurationFormatted")


def decode_techlog(records: DataFrame, empty: bool = False, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """TECHLOG_SCHEMA rows of records (raw, hour, process, pid), or the given columns of them; others than records are dropped.

    where is a condition on the columns of the header (DateTime, Duration, DurationMs, Event,
    Level), tested before the rest of a record is read. Missing texts are '', missing numbers null.
    Rows without content (see empty_event) are left out unless empty is true; of a row with a duration
    or a level the header alone tells that it has content. Only what the columns need is read:
    those of the header need no body.
    """
    names = list(columns) if columns is not None else [f.name for f in TECHLOG_SCHEMA]
    rows = read_headers(records)
    if where is not None:
        rows = rows.filter(where)
    content = (F.coalesce("Duration", F.lit(0)) > 0) | (F.coalesce("Level", F.lit(0)) > 0)
    wanted = {source for n in names for source in _SOURCES.get(n, (n,))}
    if not wanted - set(HEADER_COLUMNS):
        rows = rows.withColumn("body", F.when(F.lit(not empty) & ~content, F.col("body")))
    if not empty:
        wanted |= set(MULTILINE)
    if wanted - set(HEADER_COLUMNS):
        head = T.StructType([f for f in rows.schema if f.name not in ("process", "pid", "body")])
        rest = "Properties" in wanted
        made = [T.StructField(n, T.StringType()) for n in (*[n for n in PROMOTED if rest or n in wanted], "ProcessName", "ProcessId")]
        made += [T.StructField("Properties", T.MapType(T.StringType(), T.StringType()))] if rest else []
        rows = rows.mapInArrow(_pairs(wanted), T.StructType([*head, *made]))
    if not empty:
        rows = rows.filter(content | ~empty_event())
    out = {
        "DateFormatted": F.date_format("DateTime", "yyyy-MM-dd HH:mm:ss.SSS"), "DurationSec": F.round(F.col("Duration") / 1e6, 6), "DurationFormatted": format_micros(F.col("Duration")),
        "SessionId": F.coalesce(F.nullif("SessionId", F.lit("")), "ClientId"),
    }
    out |= {n: F.col(n).try_cast("long") for n in NUMBERS}
    return rows.select(*[out.get(n, F.col(n)).alias(n) for n in names])
