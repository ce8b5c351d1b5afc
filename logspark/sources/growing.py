"""Growing text logs as a Spark data source: byte ranges are read in parallel, and files are followed as they grow.

    spark.dataSource.register(GrowingLog)
    spark.readStream.format("growing_log").option("path", folder).option("kind", "techlog").load()

Options: path (files and folders, separated by commas, that driver and executors can open: local
paths or URIs), resolver (see files.Files), glob, kind ('techlog', 'eventlog' or 'json'), starting ('latest' skips what
files hold when the stream begins; files that appear later are read from their start), tail_bytes (only so many bytes
from the end) and range_bytes. An offset is a byte of each file, always at a record's start: a record that is
still being written is held back until it is complete. With it goes what stands at the file's start and before that byte: a
file that was replaced, by a shorter or a longer one, is read anew. A trigger lists the files and opens
those whose size or time has changed.

Conditions on DateTime (from a record's header; of technical logs with the hour in the file's name) are pushed into the reader:
a range that begins more than two hours after the last wanted date, or that ends so long before the first one,
is left after a look at one record, and reading stops where the log has passed the last wanted date by two hours.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from logspark.functions import scan
from logspark.sources.files import HEAD, TAIL, Files

NAME, SCHEMA = "growing_log", "file string, size long, at long, DateTime timestamp, raw string"
_MARK = rb"(?m)^(?:\xef\xbb\xbf)?"
STARTS = {"techlog": _MARK + rb"\s*\d{2}:\d{2}\.\d+-\d+,", "eventlog": _MARK + rb"\s*\{(?:\d{14}|[1-8]),", "json": rb"(?m)^[^\r\n]"}
GLOBS = {"techlog": "*.log", "eventlog": "*.lgp", "json": "*.json*"}
STEP = 1 << 20
#: Records of parallel transactions may be written so much later than others.
LATE = timedelta(hours=2)


def record_date(kind: str, path: str, raw: str) -> datetime | None:
    """The date in a record's header; of a technical log, within the hour that the file's name (yymmddhh) gives."""
    try:
        if kind == "eventlog" and (m := re.match(r"\s*\{(\d{14}),", raw)):
            return datetime.strptime(m[1], "%Y%m%d%H%M%S").replace(tzinfo=UTC)
        if kind == "techlog" and (m := re.match(r"\s*(\d{2}):(\d{2})\.(\d+)-", raw)) and (hour := re.search(r"(\d{8})[^/]*$", path)):
            return datetime.strptime(hour[1], "%y%m%d%H").replace(tzinfo=UTC) + timedelta(minutes=int(m[1]), seconds=int(m[2]), microseconds=int(m[3][:6].ljust(6, "0")))
    except ValueError:
        pass
    return None


@dataclass
class Span:
    """Wanted dates: first to last, or before or after them if they themselves aren't wanted."""

    first: datetime | None = None
    last: datetime | None = None
    after: bool = False
    before: bool = False
    known: bool = False  # only records with a date

    def add(self, f: Filter) -> bool:
        """Whether the filter is one on DateTime, and taken over."""
        if getattr(f, "attribute", None) != ("DateTime",):
            return False
        if isinstance(f, IsNotNull):
            self.known = True
            return True
        if type(f) not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) or not isinstance(f.value, datetime):
            return False
        value, self.known = f.value.astimezone(UTC) if f.value.tzinfo else f.value.replace(tzinfo=UTC), True
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and (self.first is None or (value, isinstance(f, GreaterThan)) > (self.first, self.after)):
            self.first, self.after = value, isinstance(f, GreaterThan)
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and (self.last is None or (value, not isinstance(f, LessThan)) < (self.last, not self.before)):
            self.last, self.before = value, isinstance(f, LessThan)
        return True

    def has(self, when: datetime | None) -> bool:
        if when is None:
            return not self.known
        low = self.first is None or when > self.first or (when == self.first and not self.after)
        return low and (self.last is None or when < self.last or (when == self.last and not self.before))

    def passed(self, when: datetime | None) -> bool:
        return self.last is not None and when is not None and when > self.last + LATE

    def ahead(self, when: datetime | None) -> bool:
        return self.first is not None and when is not None and when < self.first - LATE


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    limit: int  # records end here at the latest


def next_start(files: Files, path: str, pattern: re.Pattern, at: int, limit: int) -> int:
    """The first record start from byte `at` on, limit if there is none before it."""
    with files.open(path) as f:
        held, base = b"", max(at - 1, 0)
        f.seek(base)
        first = base == at or f.read(1) in b"\r\n"
        base = at
        while base + len(held) < limit:
            held += f.read(min(STEP, limit - base - len(held)))
            # a start needs a line of its own, and enough of it to be recognised
            for m in pattern.finditer(held):
                begin = m.start() + len(m[0]) - len(m[0].lstrip())
                if begin or first:
                    return base + begin
            if not held or base + len(held) >= limit:
                break
            cut = held.rfind(b"\n") + 1
            base, held, first = base + cut, held[cut:], first or cut > 0
    return limit


def complete_end(files: Files, path: str, size: int, kind: str, floor: int = 0) -> int:
    """The end of the last complete record after floor: the size, or the start of a record that is still being written; floor if there is none."""
    pattern = re.compile(STARTS[kind])
    back, last = min(STEP, size - floor), None
    with files.open(path) as f:
        while size > floor and last is None:
            f.seek(size - back)
            tail = f.read(back)
            at = 0 if back >= size - floor else tail.find(b"\n") + 1
            for m in pattern.finditer(tail, at):
                last = size - back + m.start() + len(m[0]) - len(m[0].lstrip())
            if back >= size - floor:
                break
            back = min(back * 4, size - floor)
        if last is None:
            return floor if size > floor else size
        f.seek(last)
        record = f.read(size - last)
    if kind == "eventlog":
        text = record.decode("utf-8", "replace").strip().rstrip(",")
        done = text.endswith("}") and scan.depth(text) == 0
    else:
        done = record.endswith(b"\n")
    return size if done else last


class _Options:
    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}.get
        self.roots = [p.strip() for p in get("path", "").split(",") if p.strip()]
        self.kind, self.files = get("kind", "techlog"), Files(get("resolver", ""))
        self.glob, self.latest = get("glob", GLOBS[self.kind]), get("starting", "earliest") == "latest"
        self.tail, self.each = int(get("tail_bytes", "0")), int(get("range_bytes", str(32 << 20)))
        self.span = Span()

    def ranges(self, path: str, start: int, end: int) -> list[Range]:
        return [Range(path, at, min(at + self.each, end), end) for at in range(start, end, self.each)]

    def _date_at(self, path: str, at: int, limit: int) -> datetime | None:
        if at >= limit:
            return None
        with self.files.open(path) as f:
            f.seek(at)
            return record_date(self.kind, path, f.read(min(64, limit - at)).decode("utf-8", "replace").lstrip("\ufeff"))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Records that start within the range, each up to the next start, and whose dates are wanted."""
        pattern, span = re.compile(STARTS[self.kind]), self.span
        at = next_start(self.files, part.path, pattern, part.start, part.limit)
        if at >= part.end:
            return
        if span.passed(self._date_at(part.path, at, part.limit)):
            return
        stop = next_start(self.files, part.path, pattern, part.end, part.limit) if part.end < part.limit else part.limit
        if span.ahead(self._date_at(part.path, stop, part.limit)):
            return
        size, held = self.files.size(part.path), b""
        with self.files.open(part.path) as f:
            f.seek(at)
            while at + len(held) < stop:
                held += f.read(min(STEP, stop - at - len(held)))
                starts = [m.start() + len(m[0]) - len(m[0].lstrip()) for m in pattern.finditer(held)]
                last = at + len(held) >= stop
                # without a further start the last record may go on
                ends = [*starts[1:], len(held)] if last else starts[1:]
                if not ends:
                    continue
                records, past = [], False
                for a, b in zip(starts, ends, strict=False):
                    when = record_date(self.kind, part.path, held[a : a + 64].decode("utf-8", "replace"))
                    if past := span.passed(when):
                        break
                    if span.has(when):
                        records.append((at + a, when, held[a:b].decode("utf-8", "replace").replace("\r", "").strip("\n\ufeff")))
                if records:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.path] * len(records)), pa.array([size] * len(records), pa.int64()), pa.array([r[0] for r in records], pa.int64()), pa.array([r[1] for r in records], pa.timestamp("us", "UTC")), pa.array([r[2] for r in records])],
                        names=["file", "size", "at", "DateTime", "raw"],
                    )
                if past:
                    return
                at, held = at + ends[-1], held[ends[-1] :]


class _Reader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on DateTime are the reader's work, all others Spark's."""
        return [f for f in filters if not self.options.span.add(f)]

    def partitions(self) -> list[Range]:
        o = self.options
        return [r for f in sorted(o.files.list(o.roots, o.glob), key=lambda f: f.path) for r in o.ranges(f.path, max(0, f.size - o.tail) if o.tail else 0, f.size)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from self.options.read(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets: by path, end (a byte), n and head (how many bytes at the start, and their digest), tail (the digest of what stands before end)."""

    def __init__(self, options: _Options):
        self.options = options
        self.known: dict[str, tuple] = {}  # by path: what listing told, the entry, up to where no record start was found

    def _entry(self, path: str, end: int) -> dict:
        files, n = self.options.files, min(HEAD, end)
        return {"end": end, "n": n, "head": files.digest(path, 0, n), "tail": files.digest(path, max(0, end - TAIL), min(TAIL, end))} if end else {"end": 0, "n": 0, "head": "", "tail": ""}

    def _same(self, path: str, entry: dict, size: int) -> bool:
        """Whether a file is still the one of the entry, at most grown."""
        files, end = self.options.files, entry["end"]
        return size >= end and (not end or (files.digest(path, 0, entry["n"]) == entry["head"] and files.digest(path, max(0, end - TAIL), min(TAIL, end)) == entry["tail"]))

    def _offsets(self) -> dict:
        o, now = self.options, {}
        for f in o.files.list(o.roots, o.glob):
            told, entry, empty = self.known.get(f.path, (None, None, 0))
            if told != f:
                floor = max(entry["end"], empty) if entry and self._same(f.path, entry, f.size) else 0
                end = complete_end(o.files, f.path, f.size, o.kind, floor)
                # a line that has begun may yet turn out to be a start
                empty = max(0, f.size - STEP) if end == floor and end < f.size else 0
                end = entry["end"] if entry and end == floor and floor else end
                entry = self._entry(f.path, end)
            now[f.path] = (f, entry, empty)
        self.known = now
        return {path: entry for path, (_, entry, _) in sorted(now.items())}

    def initialOffset(self) -> dict:
        return self._offsets() if self.options.latest else {}

    def latestOffset(self) -> dict:
        return self._offsets()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, upto in end.items():
            before = start.get(path)
            if before == upto:
                continue
            same = before is not None and self._same(path, before, upto["end"])
            out += self.options.ranges(path, before["end"] if same else 0, upto["end"])
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.options.read(partition)

    def commit(self, end: dict) -> None:
        pass


class GrowingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Options(self.options))


def read_log(spark: SparkSession, path: str, kind: str, **options: object) -> DataFrame:
    """All records of the files (with tail_bytes, those of their ends): file, size, at, DateTime, raw. Filters on DateTime reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GrowingLog)
    return spark.read.format(NAME).options(path=path, kind=kind, **{k: str(v) for k, v in options.items()}).load()


def stream_log(spark: SparkSession, path: str, kind: str, **options: object) -> DataFrame:
    """New records of the files as they are completed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format(NAME).options(path=path, kind=kind, **{k: str(v) for k, v in options.items()}).load()


def tail_bytes(limit: int | None) -> int:
    """How much of a large file a live preview of `limit` records reads: 800 bytes a record, 10 to 100 MB; 50 MB without a limit."""
    return min(max(limit * 800, 10 << 20), 100 << 20) if limit else 50 << 20
