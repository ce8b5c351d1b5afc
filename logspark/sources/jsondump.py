"""Tolerant reading of JSON dumps: lines, arrays, wrappers, pretty-printed objects, UTF-8 and UTF-16.

Files of any shape and size are cut at braces by Spark's own line reader (so on any file system), and
their splits are read in parallel. Where a split begins inside a string, or how deep, is a function of
what stands before it: every split is first read for what it does to either state, these
functions are composed in the order of splits, and then each split gives its records, knowing what
crosses its ends. A record that lies over splits is put together from their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.functions import scan
from logspark.functions.dates import json_date
from logspark.functions.plan import computed_once
from logspark.schema import EVENTLOG_SCHEMA, TECHLOG_SCHEMA
from logspark.sources import framing

REQUIRED = {"eventlog": ["id", "DateFormatted"], "techlog": ["id", "DateFormatted", "Duration", "Event", "Level"]}


def _schema(kind: str) -> T.StructType:
    """The record as written: dates as texts, the legacy names beside the current ones."""
    base = EVENTLOG_SCHEMA if kind == "eventlog" else TECHLOG_SCHEMA
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in base] + [T.StructField("Date", T.StringType())])


def _columns(kind: str) -> list[Column]:
    base = EVENTLOG_SCHEMA if kind == "eventlog" else TECHLOG_SCHEMA
    out = []
    for f in base:
        if f.name == "DateTime":
            out.append(json_date(F.coalesce(F.nullif("r.DateTime", F.lit("")), "r.Date")).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            out.append(json_date(F.nullif(f"r.{f.name}", F.lit(""))).alias(f.name))
        else:
            out.append(F.col(f"r.{f.name}").alias(f.name))
    return out


def records_of(text: Column, kind: str) -> Column:
    """The record objects of a text, at the top, in arrays, or wrapped, however deep."""

    return _records(text, REQUIRED[kind])


def _records(text: Column, required: list[str]) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: scan.records(t, required), na_action="ignore")

    return found(text)


def parse_objects(objects: DataFrame, kind: str) -> DataFrame:
    """Records of texts (column value) that are JSON objects; objects without a record's required members are left out.

    A member named both id and Id is read once: names are matched by case in the text itself.
    """
    second = r'"Id"\s*:\s*"(?:[^"\\]++|\\.)*+"'
    text = F.when(F.col("value").contains('"Id"'), F.regexp_replace(F.regexp_replace("value", rf",\s*{second}", ""), rf"{second}\s*,", "")).otherwise(F.col("value"))
    # extracted once, and filtered on the result
    rows = computed_once(objects.select("value"), r=F.from_json(text, _schema(kind), {"mode": "PERMISSIVE"}))
    known = [F.col(f"r.{name}").isNotNull() for name in REQUIRED[kind]]
    rows = rows.filter(F.col("r").isNotNull() & F.array_min(F.array(*known)))
    return rows.select(*_columns(kind))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _objects(lines: pd.Series) -> pd.Series:
    return lines.map(scan.objects, na_action="ignore")


def parse_lines(lines: DataFrame, kind: str) -> DataFrame:
    """Records of lines (column value), each on one line: array brackets and commas around objects are no hindrance, one line may hold several, other lines are skipped."""
    value = F.regexp_replace("value", r"^[\s\x{FEFF}\[,]+|[\s\],]+$", "")
    # a line may be dear to make, so it is made once for the tests and the parser
    rows = computed_once(lines.select("value"), value=value).filter(F.col("value").startswith("{"))
    # only lines on which an object seems to follow another one go to the scanner
    several = F.when(F.col("value").rlike(r"\}[\s\],]*[\[\s]*\{"), F.col("value"))
    rows = rows.withColumn("objects", _objects(several))
    return parse_objects(rows.select(F.explode(F.coalesce("objects", F.array("value"))).alias("value")), kind)


def read_json_lines(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """NDJSON of any size: lines are split and read in parallel."""
    return parse_lines(spark.read.option("recursiveFileLookup", "true").text(paths), kind)


def read_pretty(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """Pretty-printed objects, alone, in sequence or in an array: a line that is a brace alone opens an object, one that closes it ends it."""
    lines = framing.read_lines(spark, paths)
    starts = F.col("line").rlike(r"^(\s*\[\s*)?\s*\{\s*$") & (F.length(F.regexp_extract("line", r"^(\s*)", 1)) <= 4)
    framed = framing.frame(lines, starts)
    return parse_objects(framed.select(F.regexp_replace("raw", r"(?s)^[\s\[]+|[\s,\]]+$", "").alias("value")), kind)


def _whole_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value: the text of each file, UTF-8 or UTF-16 by its mark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    head = F.hex(F.substring("content", 1, 2))
    body = F.when(head == "FFFE", F.decode(F.expr("substring(content, 3)"), "UTF-16LE")).when(head == "FEFF", F.decode(F.expr("substring(content, 3)"), "UTF-16BE")).otherwise(F.decode("content", "UTF-8"))
    return files.select(F.regexp_replace(body, r"^\x{FEFF}", "").alias("value"))


def read_whole(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """Any shape, for files that fit in memory: UTF-8 or UTF-16 by their mark, records at the top, in arrays, or inside wrapper objects (as search hits are)."""
    return parse_objects(_whole_texts(spark, paths).select(F.explode(records_of(F.col("value"), kind)).alias("value")), kind)


# --- any shape

#: Splits of which what crosses their ends is broadcast; more are met by a shuffle.
BROADCAST_SPLITS = 20_000
_FACTS = "file string, split long, in_string boolean, after boolean, least int, starts array<int>, opened array<int>, wide boolean"
_ENDS = "file string, split long, string boolean, depth int, into int, out int, begun long, ends long"


def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, split, at, value: what stands between opening braces, in order; all but a file's first piece follow one."""
    rows = spark.read.option("recursiveFileLookup", "true").option("lineSep", "{").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str, dict]]:
    """((file, split), text, row) of pieces, each with the brace before it. Pieces of a split are neighbours."""
    before = None
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = dict(zip(names, row, strict=True))
            key = (found["file"], found["split"])
            first = key != before and not found["split"]
            before = key
            text = found["value"].decode("utf-8", "replace")
            yield key, text if first else "{" + text, found


def _facts(required: list[str]):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ways, wide, out = None, [], False, []

        def done() -> None:
            for begin, w in ways:
                out.append((*key, begin, w.in_string, w.least, w.starts, list(w.opened), wide))

        for now, text, _ in _texts(batches):
            if now != key:
                done()
                # a text begins outside of a string; of other splits that isn't known yet
                key, wide = now, False
                ways = [(b, scan.JsonSplit(required, b)) for b in ((False, True) if now[1] else (False,))]
            wide = wide or "\x00" in text
            for _, w in ways:
                w.feed(text)
        done()
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()]
        names = [c.split()[0] for c in _FACTS.split(", ")]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return facts


def _ends(required: int):
    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        splits: dict[int, dict] = {}
        for r in rows.itertuples(index=False):
            splits.setdefault(int(r.split), {})[bool(r.in_string)] = (bool(r.after), int(r.least), list(map(int, r.starts)), list(map(int, r.opened)))
        found = scan.crossing_records(sorted(splits.items()), required)
        return pd.DataFrame([(rows["file"].iloc[0], *f) for f in found], columns=[c.split()[0] for c in _ENDS.split(", ")])

    return ends


def _parts(required: list[str]):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """file, begun, split, value: whole records (begun null), and parts of those that have begun in split `begun`."""
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "begun", "split", "value"])
        key, reader, info = None, None, {}

        def done() -> list[tuple]:
            if reader is None:
                return []
            reader.finish()
            ready = [(key[0], None, key[1], text) for text in reader.whole]
            return ready + [(key[0], begun, key[1], text) for begun, text in ((info["begun"], reader.head), (info["ends"], reader.tail)) if text is not None]

        for now, text, row in _texts(batches):
            if now != key:
                if out := done():
                    yield batch(out)
                key, info = now, row
                reader = scan.JsonRecords(required, row["string"], row["depth"], row["into"], row["out"])
            reader.feed(text)
            if len(reader.whole) >= 10_000:
                yield batch([(key[0], None, key[1], text) for text in reader.whole])
                reader.whole = []
        if out := done():
            yield batch(out)

    return parts


def record_texts(spark: SparkSession, paths: str | list[str], required: list[str]) -> DataFrame:
    """value: the outermost objects that have all required members (not null), of files in any shape.

    Objects may follow one another with anything between them, lie in arrays and in other objects,
    and be larger than a split. A line break ends a string that lacks its quote; an object that is
    never closed is no record, those within it are. UTF-16 (known by its zero bytes) is read as whole files.
    """
    pieces = _pieces(spark, paths)
    facts = pieces.mapInArrow(_facts(required), _FACTS)
    ends = facts.filter("NOT wide").groupBy("file").applyInPandas(_ends(len(required)), _ENDS)
    known = ends.limit(BROADCAST_SPLITS + 1).collect()
    if len(known) <= BROADCAST_SPLITS:
        rows = pieces.join(F.broadcast(spark.createDataFrame(known, _ENDS)), ["file", "split"])  # pieces keep their order
    else:
        rows = pieces.join(ends, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "at")
    found = rows.mapInArrow(_parts(required), "file string, begun long, split long, value string")
    joined = found.filter("begun IS NOT NULL").groupBy("file", "begun").agg(F.array_sort(F.collect_list(F.struct("split", "value"))).alias("parts"))
    texts = found.filter("begun IS NULL").select("value").unionByName(joined.select(F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value")))
    wide = [r["file"] for r in facts.filter("wide").select("file").distinct().collect()]
    return texts.unionByName(_whole_texts(spark, wide).select(F.explode(_records(F.col("value"), required)).alias("value"))) if wide else texts


def read_any(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """Records of files in any shape and of any size."""
    return parse_objects(record_texts(spark, paths, REQUIRED[kind]), kind)


def read_dump(spark: SparkSession, paths: str | list[str], kind: str, shape: str = "any") -> DataFrame:
    """Records of dumps. shape 'any' finds them wherever they are; 'lines' (a line holds whole records), 'pretty' and 'whole' (small files) read each byte once."""
    return {"any": read_any, "lines": read_json_lines, "pretty": read_pretty, "whole": read_whole}[shape](spark, paths, kind)
