"""A column store or a search index as a Spark data source, for tables and streams.

    delivery.shaped(rows, target, ...).write.format("log_sink").options(target=..., url=...).mode("append").save()
    delivery.shaped(stream, target, ...).writeStream.format("log_sink").options(...).start()

Rows are (id, body: a JSON object, index: null for the column store). A task sends them in chunks; one that fails
is sent again after pauses that double. A chunk for the column store carries a token of its ids and rows for the index
their ids, so a chunk or a task that is sent again doubles nothing. Each task reports what it sent and what was
refused; on commit the reports are added up, and rows refused beyond `refused` (of all, 0 unless given) fail the write. Options: target
('clickhouse' or 'elastic'), url, database, table, user, password, chunk_rows, attempts, pause (seconds), refused, and
report (a folder): there a commit leaves write.json or batch-N.json with the sums, an abort aborted.json.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from logspark.sinks import delivery

NAME, SCHEMA = "log_sink", "id string, body string, index string"
#: Refused rows of a task that its report names.
NAMED = 20


@dataclass
class Sent(WriterCommitMessage):
    rows: int = 0
    refused: int = 0
    chunks: int = 0
    repeated: int = 0
    named: list = field(default_factory=list)  # (id, reason) of some rows refused


class _Sink:
    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}.get
        self.target, self.url, self.report = get("target", "clickhouse"), get("url", ""), get("report", "")
        if self.target not in ("clickhouse", "elastic"):
            raise ValueError("target is 'clickhouse' or 'elastic'")
        self.table, self.user, self.password = f"{get('database', 'logs')}.{get('table', 'events')}", get("user", "default"), get("password", "")
        self.chunk, self.attempts, self.pause, self.allowed = int(get("chunk_rows", str(delivery.CHUNK_ROWS))), int(get("attempts", "4")), float(get("pause", "0.5")), int(get("refused", "0"))

    def _post(self, sent: Sent, url: str, body: bytes, headers: dict[str, str]) -> bytes:
        for attempt in range(self.attempts):
            try:
                return delivery.post(url, body, headers)
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                # what the server calls a fault of ours stays one
                if (isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code not in (408, 429)) or attempt + 1 == self.attempts:
                    raise
                sent.repeated += 1
                time.sleep(self.pause * 2**attempt)
        raise RuntimeError("no attempt was allowed")

    def _send(self, sent: Sent, rows: list[dict]) -> None:
        if self.target == "clickhouse":
            options = {"query": f"INSERT INTO {self.table} FORMAT JSONEachRow", "input_format_skip_unknown_fields": 1, "input_format_null_as_default": 1, "insert_deduplication_token": delivery.chunk_token([r["id"] for r in rows])}
            self._post(sent, f"{delivery.server_url(self.url)}/?{urllib.parse.urlencode(options)}", "\n".join(r["body"] for r in rows).encode(), {"X-ClickHouse-User": self.user, "X-ClickHouse-Key": self.password})
            sent.rows += len(rows)
        else:
            lines = "".join(json.dumps({"index": {"_index": r["index"], "_id": r["id"]}}) + "\n" + r["body"] + "\n" for r in rows)
            answer = json.loads(self._post(sent, f"{self.url.rstrip('/')}/_bulk", lines.encode(), {"Content-Type": "application/x-ndjson"}) or b"{}")
            items = [next(iter(item.values())) for item in answer.get("items", [])]
            bad = [(x.get("_id"), str(x.get("error", x.get("status")))[:200]) for x in items if x.get("status", 200) >= 300]
            sent.rows, sent.refused = sent.rows + len(rows) - len(bad), sent.refused + len(bad)
            sent.named += bad[: NAMED - len(sent.named)]
        sent.chunks += 1

    def write(self, batches: Iterator[pa.RecordBatch]) -> Sent:
        sent, waiting = Sent(), []
        for batch in batches:
            waiting += batch.to_pylist()
            while len(waiting) >= self.chunk:
                self._send(sent, waiting[: self.chunk])
                waiting = waiting[self.chunk :]
        if waiting:
            self._send(sent, waiting)
        return sent

    def tell(self, name: str, messages: list[Sent | None]) -> None:
        """Add up the tasks' reports; leave the sums in the report folder."""
        known = [m for m in messages if m is not None]
        sums = {k: sum(getattr(m, k) for m in known) for k in ("rows", "refused", "chunks", "repeated")} | {"tasks": len(known), "named": [x for m in known for x in m.named][:NAMED]}
        if self.report:
            where = self.report if "://" in self.report else f"file://{self.report}"
            system, folder = fs.FileSystem.from_uri(where)
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{name}.json") as f:
                f.write(json.dumps(sums).encode())
        if name != "aborted" and sums["refused"] > self.allowed:
            raise RuntimeError(f"{sums['refused']} of {sums['rows'] + sums['refused']} rows were refused: {sums['named'][:3]}")


class _Writer(DataSourceArrowWriter):
    def __init__(self, sink: _Sink):
        self.sink = sink

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        return self.sink.write(iterator)

    def commit(self, messages: list[Sent | None]) -> None:
        self.sink.tell("write", messages)

    def abort(self, messages: list[Sent | None]) -> None:
        self.sink.tell("aborted", messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, sink: _Sink):
        self.sink = sink

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        return self.sink.write(iterator)

    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        self.sink.tell(f"batch-{batchId}", messages)

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        self.sink.tell("aborted", messages)


class LogSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("log_sink appends")
        return _Writer(_Sink(self.options))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(_Sink(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSink)
