"""Delivery of rows to column stores, search indexes, NDJSON files and spreadsheets."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logspark.functions.dates import json_date_text
from logspark.functions.ids import index_name

CHUNK_ROWS = 5_000
XML_BAD = re.compile("[^\t\n\r\x20-퟿-�]")
#: Column types of the store.
CLICKHOUSE_TYPES = {"string": "String", "bigint": "Nullable(Int64)", "int": "UInt32", "double": "Float64", "timestamp": "Nullable(DateTime64(3))", "map<string,string>": "Map(String, String)"}


def server_url(url: str) -> str:
    """A base address: http unless given, port 8123 (8443 with https) unless given, no slash at the end."""
    url = (url or "").strip().rstrip("/") or "localhost"
    if "://" not in url:
        url = f"http://{url}"
    parts = urllib.parse.urlsplit(url)
    return url if parts.port else f"{url}:{8443 if parts.scheme == 'https' else 8123}"


def ping(url: str, user: str = "default", password: str = "") -> str:
    """The version of the column store at url; raises if it does not answer."""
    return post(server_url(url), b"SELECT version()", {"X-ClickHouse-User": user, "X-ClickHouse-Key": password}).decode().strip()


def json_rows_body(rows: DataFrame, pretty: bool = False) -> Column:
    """A compact (or indented) JSON object with nulls written and dates as 'yyyy-MM-dd HH:mm:ss.fff'; the date is also given under its legacy name."""
    columns = [json_date_text(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in rows.schema]
    if "DateTime" in rows.columns:
        columns.append(json_date_text(F.col("DateTime")).alias("Date"))
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def json_rows(rows: DataFrame, pretty: bool = False) -> DataFrame:
    return rows.select("id", json_rows_body(rows, pretty).alias("body"))


def shaped(rows: DataFrame, prefix: str | None = None, separation: str = "Day", index_id: str | None = None) -> DataFrame:
    """Rows as log_sink takes them: id, body, and the index of each row's own date if a prefix is given. Works on streams as well."""
    index = F.lit(None).cast("string") if prefix is None else index_name(prefix, F.col("DateTime"), separation, index_id)
    return rows.select("id", json_rows_body(rows).alias("body"), index.alias("index"))


def chunk_token(ids: list[str]) -> str:
    return hashlib.sha256("".join(f"{i}\n" for i in ids).encode()).hexdigest()


def post(url: str, body: bytes, headers: dict[str, str]) -> bytes:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    with urllib.request.urlopen(request, timeout=60) as answer:  # errors raise, and Spark retries the task
        return answer.read()


def _deliver(rows: DataFrame, send: Callable[[list[str], list[str]], int]) -> int:
    """Send rows in id order within each partition, in chunks of CHUNK_ROWS; the number of rows delivered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = 0
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), CHUNK_ROWS):
                sent += send(ids[at : at + CHUNK_ROWS], bodies[at : at + CHUNK_ROWS])
        yield pa.RecordBatch.from_pydict({"sent": [sent]})

    return json_rows(rows).sortWithinPartitions("id").mapInArrow(run, "sent long").agg(F.sum("sent")).first()[0] or 0


def clickhouse_ddl(schema: T.StructType, database: str, table: str) -> list[str]:
    """The database and a MergeTree table with a column for every field, partitioned by month."""
    columns = ", ".join(f"`{f.name}` {CLICKHOUSE_TYPES.get(f.dataType.simpleString(), 'String')}" for f in schema)
    return [f"CREATE DATABASE IF NOT EXISTS {database}", f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) ENGINE = MergeTree PARTITION BY toYYYYMM(assumeNotNull(DateTime)) ORDER BY (Event, assumeNotNull(DateTime), id)"]


def write_clickhouse(rows: DataFrame, url: str, database: str, table: str, user: str = "default", password: str = "", create: bool = True) -> int:
    """Insert rows over HTTP; a chunk's token is made of its ids, so a repeated delivery is recognised."""
    base, headers = server_url(url), {"X-ClickHouse-User": user, "X-ClickHouse-Key": password}
    if create:
        for statement in clickhouse_ddl(rows.schema, database, table):
            post(base, statement.encode(), headers)

    def send(ids: list[str], bodies: list[str]) -> int:
        options = {"query": f"INSERT INTO {database}.{table} FORMAT JSONEachRow", "input_format_skip_unknown_fields": 1, "input_format_null_as_default": 1, "insert_deduplication_token": chunk_token(ids)}
        post(f"{base}/?{urllib.parse.urlencode(options)}", "\n".join(bodies).encode(), headers)
        return len(ids)

    return _deliver(rows, send)


def ensure_index(url: str, index: str) -> None:
    """Create an index unless it is there."""
    try:
        urllib.request.urlopen(urllib.request.Request(f"{url.rstrip('/')}/{index}", method="HEAD"), timeout=60).close()
    except urllib.error.HTTPError as e:
        if e.code != 404:
            raise
        urllib.request.urlopen(urllib.request.Request(f"{url.rstrip('/')}/{index}", method="PUT"), timeout=60).close()


def write_elastic(rows: DataFrame, url: str, prefix: str, separation: str = "Day", index_id: str | None = None, ensure: bool = False) -> tuple[int, int]:
    """Bulk upserts keyed by id into the index of each row's own date, in one pass; (rows indexed, rows refused), and an error if any is refused."""
    named = rows.withColumn("__index", index_name(prefix, F.col("DateTime"), separation, index_id))
    if ensure:
        for row in named.select("__index").distinct().toLocalIterator():  # as many as days, months or hours
            ensure_index(url, row["__index"])
    bodies = named.select("__index", "id", json_rows_body(rows).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = refused = 0
        for batch in batches:
            items = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for at in range(0, len(items), CHUNK_ROWS):
                lines = "".join(json.dumps({"index": {"_index": index, "_id": i}}) + "\n" + b + "\n" for index, i, b in items[at : at + CHUNK_ROWS])
                answer = json.loads(post(f"{url.rstrip('/')}/_bulk", lines.encode(), {"Content-Type": "application/x-ndjson"}) or b"{}")
                failed = sum(1 for item in answer.get("items", []) if next(iter(item.values())).get("status", 200) >= 300)
                done, refused = done + len(items[at : at + CHUNK_ROWS]) - failed, refused + failed
        yield pa.RecordBatch.from_pydict({"done": [done], "refused": [refused]})

    sent = bodies.sortWithinPartitions("__index", "id").mapInArrow(run, "done long, refused long").agg(F.sum("done"), F.sum("refused")).first()
    done, refused = sent[0] or 0, sent[1] or 0
    if refused:
        raise RuntimeError(f"{refused} of {done + refused} rows were not indexed")
    return done, refused


def write_ndjson(rows: DataFrame, path: str, records_per_file: int = 100_000, by_index: str | None = None, separation: str = "Day", mode: str = "append") -> None:
    """JSON lines, at most records_per_file a file, without rows whose Event is blank; by_index adds a folder for each index."""
    kept = rows.filter(F.trim(F.coalesce("Event", F.lit(""))) != "")
    dates = [f.name for f in kept.schema if isinstance(f.dataType, T.TimestampType)]
    shown = kept.withColumns({d: json_date_text(F.col(d)) for d in dates}) if dates else kept
    if by_index:
        shown = shown.withColumn("index", index_name(by_index, F.to_timestamp("DateTime"), separation))
    writer = shown.write.mode(mode).option("maxRecordsPerFile", records_per_file).option("ignoreNullFields", "false")
    (writer.partitionBy("index") if by_index else writer).json(path)


def write_pretty(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Indented JSON objects, one after the other, as text files."""
    json_rows(rows, pretty=True).select("body").write.mode(mode).text(path)


class Ring:
    """NDJSON dumps in a ring of slots, as a sink for micro-batches: rows go to the newest slot until it is full, then to free ones, then they take the place of the oldest.

    A slot is full at max_records rows or max_bytes (by size, count or either, as policy says). Running
    sums over a batch deal its rows to as many slots as they fill. A row takes the larger one of its
    shares of the limits, so no slot is beyond either by more than a row. Of a batch
    that fills more slots than the ring has, the last ones stay, as if it had come row by row.
    Rows without Event are left out.

    A batch's share of a slot is a folder, slot-NUMBER-ROWS-batchN. The manifest beside the ring names the
    folders that count, and is replaced in one step when all folders of a batch are in place:
    read() never sees half a batch. Folders that no longer count are deleted then.
    """

    def __init__(self, path: str, slots: int = 30, max_records: int = 100_000, max_bytes: int = 0, total_bytes: int = 0, policy: str = "SizeOrRecordCount"):
        self.path, self.slots, self.records, self.policy = path.rstrip("/"), slots, max_records, policy
        # without a limit of its own a slot has its share of the total, 5 MB at least; 16 MB without a total
        self.bytes = max_bytes or (max(5 << 20, total_bytes // slots) if total_bytes else 16 << 20)

    def full(self, size: int, rows: int) -> bool:
        by_size, by_rows = size >= self.bytes, rows >= self.records
        return by_size if self.policy == "Size" else by_rows if self.policy == "RecordCount" else by_size or by_rows

    def _load(self, size: Column | int, rows: Column | int, larger: Callable = max):
        """What rows of so many bytes take of a slot, which holds bytes * records in all."""
        if self.policy == "Size":
            return size * self.records
        return rows * self.bytes if self.policy == "RecordCount" else larger(size * self.records, rows * self.bytes)

    def manifest(self, spark: SparkSession) -> list[dict]:
        """The folders that count, in the order in which they were filled: folder, slot, rows, bytes, batch."""
        fs, root = _files(spark, f"{self.path}.manifest")
        if not fs.exists(root):
            return []
        stream = fs.open(root)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, spark: SparkSession, parts: list[dict]) -> None:
        """Replace the manifest in one step."""
        fs, new = _files(spark, f"{self.path}.manifest.new")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(_files(spark, f"{self.path}.manifest")[1]), overwrite)

    def read(self, spark: SparkSession, schema: T.StructType | str) -> DataFrame:
        """The rows of all slots."""
        parts = self.manifest(spark)
        return spark.read.schema(schema).json([f"{self.path}/{p['folder']}" for p in parts]) if parts else spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, root = _files(spark, self.path)
        kept = json_rows(batch.filter(F.trim(F.coalesce("Event", F.lit(""))) != ""))
        sized = kept.select("id", "body", (F.octet_length("body") + 1).cast("long").alias("size"))
        # a batch that is delivered again takes its own place
        before = [p for p in self.manifest(spark) if p["batch"] != number]
        last = before[-1]["slot"] if before else None
        own = [p for p in before if p["slot"] == last]
        size, rows = sum(p["bytes"] for p in own), sum(p["rows"] for p in own)
        if last is None or self.full(size, rows):
            size = rows = 0
            last = None
        capacity = self.bytes * self.records
        load = self._load(F.col("size"), F.lit(1), F.greatest)
        # a running sum: partitions' sums are few, and what stands before a row in its partition is added to them
        placed = sized.repartitionByRange(spark.sparkContext.defaultParallelism, "id", "body").sortWithinPartitions("id", "body").select("body", "size", load.alias("load"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
        folder = f"{self.path}/.batch{number}"
        placed.write.mode("overwrite").parquet(f"{folder}/rows")
        placed = spark.read.schema(placed.schema).parquet(f"{folder}/rows")
        sums = placed.groupBy("part").agg(F.sum("load").alias("load"))
        ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("part", F.coalesce(F.sum("load").over(ahead), F.lit(0)).alias("ahead"))  # a row for each partition
        upto = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        start = F.lit(self._load(size, rows)) + F.col("ahead") + F.coalesce(F.sum("load").over(upto), F.lit(0))
        dealt = placed.join(F.broadcast(sums), "part").select("body", "size", F.floor(start / F.lit(capacity)).cast("long").alias("k"))
        counts = {r["k"]: (r["n"], r["size"]) for r in dealt.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
        if counts:
            dealt.select("k", "body").write.mode("overwrite").partitionBy("k").text(f"{folder}/slots")
        used = list(dict.fromkeys(p["slot"] for p in before))  # oldest first
        for k in sorted(counts):
            if k == 0 and last is not None:
                slot = last
            else:
                free = [s for s in range(self.slots) if s not in used]
                slot = free[0] if free else used[0]
                before = [p for p in before if p["slot"] != slot]
            used = [s for s in used if s != slot] + [slot]
            name = f"slot-{slot}-{counts[k][0]}-batch{number}" + (f"-{k}" if k else "")
            fs.delete(_files(spark, f"{self.path}/{name}")[1], True)
            fs.rename(_files(spark, f"{folder}/slots/k={k}")[1], _files(spark, f"{self.path}/{name}")[1])
            before.append({"folder": name, "slot": slot, "rows": counts[k][0], "bytes": counts[k][1], "batch": number})
        self._swap(spark, before)
        counted = {p["folder"] for p in before}
        for found in fs.listStatus(root) if fs.exists(root) else []:
            if found.getPath().getName() not in counted:
                fs.delete(found.getPath(), True)


def _files(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def retain(spark: SparkSession, path: str, limit: int = 30, total_bytes: int = 0, stale_ms: int = 120_000) -> list[str]:
    """Delete the oldest dumps (json and jsonl files) of a folder beyond `limit` files and total_bytes, keeping one, and temporary files older than stale_ms; the names that went."""
    fs, root = _files(spark, path)
    entries = [(f.getModificationTime(), f.getPath(), f.getLen()) for f in fs.listStatus(root) if f.isFile()]
    now = int(spark.sparkContext._jvm.System.currentTimeMillis())
    gone = [p for at, p, _ in entries if p.getName().endswith(".tmp") and now - at > stale_ms]
    dumps = sorted(((at, p, n) for at, p, n in entries if p.getName().lower().endswith((".json", ".jsonl"))), key=lambda e: (e[0], e[1].getName()))
    while len(dumps) > limit or (total_bytes and len(dumps) > 1 and sum(n for _, _, n in dumps) > total_bytes):
        gone.append(dumps.pop(0)[1])
    for p in gone:
        fs.delete(p, False)
    return [p.getName() for p in gone]


def write_xlsx(rows: DataFrame, path: str, columns: list[str], text_of: dict[str, list[str]] | None = None, sheet: str = "Log") -> int:
    """A spreadsheet of inline strings for a person to read: rows stream through the driver one by one. text_of names columns that show the first non-empty of several."""
    chosen = [F.coalesce(*[F.nullif(F.col(x).cast("string"), F.lit("")) for x in (text_of or {}).get(c, [c])]).alias(c) for c in columns]
    cell = lambda v, style: f'<c t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(XML_BAD.sub("", v))}</t></is></c>'
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/styles.xml", '<?xml version="1.0"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            out.write(f"<row>{''.join(cell(c, 1) for c in columns)}</row>".encode())
            for row in rows.select(*chosen).toLocalIterator(prefetchPartitions=True):
                out.write(f"<row>{''.join(cell(v or '', 0) for v in row)}</row>".encode("utf-8", "replace"))
                n += 1
            out.write(b"</sheetData></worksheet>")
    return n
