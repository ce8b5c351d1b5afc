"""Multi-line records from text files of any size.

Spark reads lines in splits; a line belongs to the split in which it begins. Lines keep the order
of their split, so a record is found within (file, split), whose size Spark bounds. Only lines
before a split's first record start belong to a record of an earlier split, and one row per split
tells which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TECHLOG_START = r"^\s*\d{2}:\d{2}\.\d+-\d+,"
EVENTLOG_START = r"^\s*\{\d{14},"
DICTIONARY_START = r"^\s*\{[1-8],"


def read_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """file, size, split, at, line: at orders the lines of a (file, split)."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(paths)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"^\x{FEFF}|\r$", "").alias("line"),
    )


def balance(text: Column) -> Column:
    """Opening minus closing braces outside double quotes; an open quote counts as one opening more."""
    bare = F.regexp_replace(text, '"[^"]*+"', "")
    open_quote = F.when(F.instr(bare, '"') > 0, 1).otherwise(0)
    bare = F.substring_index(bare, '"', 1)
    return F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit(""))) - (F.length(bare) - F.length(F.replace(bare, F.lit("}"), F.lit("")))) + open_quote


def frame(lines: DataFrame, start: str | Column, complete: Column | None = None) -> DataFrame:
    """file, size, split, at (of the first line), raw, complete: one row per record, with the lines up to the next start.

    start is a pattern or a condition on `line`. Blank lines are dropped. Lines before a file's
    first start are dropped. complete is a condition on `raw` (true if not given): a record that is
    still being written is not complete.
    """
    starts = F.col("line").rlike(start) if isinstance(start, str) else start
    lines = lines.filter(F.trim(F.regexp_replace("line", r"\s+", " ")) != "").withColumn("head", F.when(starts, F.col("at")))
    within = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("own", F.max("head").over(within))
    # one row per split: its last start, carried to the splits after it that begin inside a record
    splits = lines.groupBy("file", "split").agg(F.max("head").alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("carried", F.last("last", ignorenulls=True).over(before)).withColumn("from_split", F.last(F.when(F.col("last").isNotNull(), F.col("split")), ignorenulls=True).over(before))
    lines = lines.join(splits.drop("last"), ["file", "split"])
    owner, owner_split = F.coalesce("own", "carried"), F.when(F.col("own").isNotNull(), F.col("split")).otherwise(F.col("from_split"))
    lines = lines.select("file", "size", owner_split.alias("split"), owner.alias("at"), F.struct(F.col("split").alias("s"), F.col("at").alias("a"), "line").alias("part"))
    records = lines.filter(F.col("at").isNotNull()).groupBy("file", "size", "split", "at").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    records = records.select("file", "size", "split", "at", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("raw"))
    return records.withColumn("complete", F.lit(True) if complete is None else complete)


def read_techlog_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of *.log files: file, size, split, at, raw, complete."""
    return frame(read_lines(spark, paths, "*.log"), TECHLOG_START)


def read_eventlog_records(spark: SparkSession, paths: str | list[str], keep_incomplete: bool = True) -> DataFrame:
    """Records of *.lgp files; one whose braces or quotes are still open is not complete."""
    records = frame(read_lines(spark, paths, "*.lgp"), EVENTLOG_START, balance(F.col("raw")) <= 0)
    return records if keep_incomplete else records.filter("complete")


def read_dictionary_entries(spark: SparkSession, paths: str | list[str], glob: str = "*.lgf") -> DataFrame:
    """Entries of dictionary files. Dictionary rows inside journals can be read with glob='*.lgp'."""
    return frame(read_lines(spark, paths, glob), DICTIONARY_START)
