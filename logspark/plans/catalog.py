"""Which files a query reads: discovery, infobases, pruning by the dates in file names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logspark.functions.plan import shared_folder
from logspark.sources.files import Files

JSON_NAMES = r"(?i)\.(json|jsonl|ndjson)$"


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, size, modified of files under root, as Spark lists them; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


_LISTED = "path string, size long, changed long, folder boolean, real string"


def _children(resolver: str):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is right under each folder (path, real); links back to a folder above are left out."""
        files = Files(resolver)
        for batch in batches:
            rows = []
            for path, real in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, folders = files.children(path)
                rows += [(f.path, f.size, f.changed, False, "") for f in found]
                for folder in folders:
                    leads = files.real(folder)
                    if not f"{real.rstrip('/')}/".startswith(f"{leads.rstrip('/')}/"):
                        rows.append((folder, 0, 0, True, leads))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _LISTED.split(", ")])

    return listed


def list_tree(spark: SparkSession, root: str, depth: int = 16, resolver: str = "", skip: str = r"(?i)/(1Cv8FTxt|snccntx[^/]*)$") -> DataFrame:
    """path, size, modified of the files under root, down to `depth` folders below it; contents are not read.

    Folders are listed level by level, those of a level by tasks, so a wide tree takes as long as its
    depth. A link to a folder above is not followed, and depth bounds all others; folders that match
    skip, and those that can't be read, are left out. Each level is a table in the shared folder.
    """
    folder = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    level = spark.createDataFrame([(root.rstrip("/") or "/", Files(resolver).real(root))], "path string, real string")
    parts, n = [], 1
    for k in range(depth + 1):
        listed = level.repartition(min(n, 32 * spark.sparkContext.defaultParallelism)).mapInArrow(_children(resolver), _LISTED)
        listed.write.parquet(f"{folder}/level-{k}")
        parts.append(f"{folder}/level-{k}")
        level = spark.read.schema(_LISTED).parquet(parts[-1]).filter(F.col("folder") & ~F.col("path").rlike(skip)).select("path", "real")
        n = level.count()
        if not n:
            break
    found = spark.read.schema(_LISTED).parquet(*parts).filter("NOT folder")
    return found.select("path", "size", F.timestamp_micros(F.expr("changed div 1000")).alias("modified"))


def refreshed(files: DataFrame, resolver: str = "") -> DataFrame:
    """files (path, size, modified) with the present size and time of the newest journal of each folder: the one that is written to may be listed with an old size."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Files(resolver)
        for batch in batches:
            found = [known.info(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f and f.size for f in found], pa.int64()), pa.array([f and f.changed for f in found], pa.int64())], names=["path", "now_size", "now_changed"])

    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    newest = files.filter(F.lower("path").endswith(".lgp")).groupBy(folder.alias("folder")).agg(F.max_by("path", F.lower("path")).alias("path")).select("path")
    now = newest.mapInArrow(looked_up, "path string, now_size long, now_changed long")
    others = [c for c in files.columns if c not in ("size", "modified")]
    joined = files.join(now, "path", "left")
    return joined.select(*others, F.coalesce("now_size", "size").alias("size"), F.coalesce(F.timestamp_micros(F.expr("now_changed div 1000")), "modified").alias("modified")).select(*files.columns)


def find_techlog(files: DataFrame, newer_than: str | None = None, service: bool = False) -> DataFrame:
    """Of a listing: *.log if there are any, else *.txt, else JSON dumps. A service leaves out names of less than eight characters before the extension."""
    rank = F.when(F.col("path").rlike(r"(?i)\.log$"), 0).when(F.col("path").rlike(r"(?i)\.txt$"), 1).when(F.col("path").rlike(JSON_NAMES), 2)
    ranked = files.withColumn("rank", rank).filter("rank IS NOT NULL")
    if service:
        ranked = ranked.filter(F.length(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)) >= 8)
    best = ranked.agg(F.min("rank").alias("rank"))
    chosen = ranked.join(F.broadcast(best), "rank", "left_semi").drop("rank")  # one row
    return chosen.filter(F.col("modified") >= newer_than) if newer_than else chosen


def find_eventlog(files: DataFrame, name: str | None = None) -> DataFrame:
    """Journals (.lgd, then .lgp) outside full-text and temporary folders, with their directory and infobase folder; only those of one file name, if there are any."""
    skip = r"(?i)/(1Cv8FTxt|snccntx[^/]*)/"
    found = files.filter(F.col("path").rlike(r"(?i)\.(lgd|lgp)$") & ~F.col("path").rlike(skip))
    if name:
        exact = F.lower(F.regexp_extract("path", r"([^/]+)$", 1)) == name.lower()
        there = files.filter(exact).agg(F.count(F.lit(1)).alias("n"))
        found = files.filter(exact).unionByName(found.join(F.broadcast(there), F.col("n") == 0).drop("n"))  # one row
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    base = F.when(folder.rlike(r"(?i)/1Cv8Log$"), F.regexp_extract(folder, r"([^/]+)/[^/]+$", 1)).otherwise(F.regexp_extract(folder, r"([^/]+)$", 1))
    return found.withColumns({"directory": folder, "base": base})


def given_journal(path: str) -> tuple[str, bool]:
    """What one given file stands for: (path, whether it is a folder to search). An index file stands for its journal, a dictionary for its folder, others for themselves."""
    folder, _, name = path.rpartition("/")
    if name.lower().endswith(".lgx"):
        return path[:-4] + ".lgp", False
    return (folder, True) if name.lower() == "1cv8.lgf" else (path, False)


def newest_first(files: DataFrame, day: str = "day") -> DataFrame:
    """Files in the order in which they are read: latest day first, then by path without case."""
    return files.orderBy(F.col(day).desc_nulls_last(), F.lower("path"))


def nearest_dictionary(files: DataFrame, dictionaries: DataFrame, levels: int = 4) -> DataFrame:
    """files (path, directory) with dictionary: one in the same directory, in its 1Cv8Log, anywhere below, or in the nearest of up to `levels` ancestors or an ancestor's 1Cv8Log.

    Each directory is looked up once. Joins are by sorting: how large listings are is not known from what Spark
    estimates of them, so none is broadcast.
    """
    owners = dictionaries.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("holder"), F.col("path").alias("dictionary"))
    at = owners.groupBy("holder").agg(F.min("dictionary").alias("dictionary"))
    held = F.split("holder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(held) - 1), lambda k: F.array_join(F.slice(held, 1, k), "/"))
    below = at.filter(F.size(held) > 1).select(F.explode(above).alias("holder"), "dictionary").groupBy("holder").agg(F.min("dictionary").alias("dictionary"))
    parts = F.split("directory", "/")
    up = lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - k), "/")
    tried = lambda k: F.array(F.struct((2 * k).alias("rank"), up(k).alias("holder")), F.struct((2 * k + 1).alias("rank"), F.concat(up(k), F.lit("/1Cv8Log")).alias("holder")))
    ups = F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.lit(levels), F.size(parts) - 1)), tried))
    directories = files.select("directory").distinct()
    climbed = directories.select("directory", F.explode(ups).alias("u")).select("directory", (F.col("u.rank") * 2).alias("rank"), "u.holder").join(at.hint("merge"), "holder")
    # below comes after the own directory and its 1Cv8Log, and before the first ancestor
    inside = directories.select("directory", F.lit(3).alias("rank"), F.col("directory").alias("holder")).join(below.hint("merge"), "holder")
    nearest = climbed.unionByName(inside).groupBy("directory").agg(F.min_by("dictionary", "rank").alias("dictionary"))
    return files.join(nearest.hint("merge"), "directory", "left").select("path", *[c for c in files.columns if c != "path"], "dictionary")


#: Names of processes in files and folders.
PROCESSES = r"(rphost|rmngr|ragent|1cv8c?|crserver|ras|common|tlock|excp)"


def process_of(path: Column) -> tuple[Column, Column]:
    """(process, pid) of a log's path: from its name, else from the nearest of four folders named like one (a folder a_b is process a, pid b), else the folder's name."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    named = F.regexp_extract(stem, rf"(?i){PROCESSES}", 1)
    folders = F.slice(F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), 1, 4)
    pair = lambda name, pid: F.struct(name.alias("process"), pid.alias("pid"))
    of = F.transform(
        folders,
        lambda d: F.when(F.contains(d, F.lit("_")), pair(F.substring_index(d, "_", 1), F.regexp_replace(d, "^[^_]*_", ""))).when(d.rlike(rf"(?i)^{PROCESSES}$"), pair(F.lower(d), F.lit(""))),
    )
    near = F.get(F.filter(of, lambda x: x.isNotNull()), F.lit(0))
    folder = F.coalesce(F.nullif(F.get(folders, F.lit(0)), F.lit("")), F.lit("rphost"))
    process = F.when(named != "", F.lower(named)).otherwise(F.coalesce(near["process"], folder))
    return process, F.when(named != "", F.regexp_extract(stem, rf"(?i){PROCESSES}_(\d+)", 2)).otherwise(F.coalesce(near["pid"], F.lit("")))


def infobases(registry: DataFrame) -> DataFrame:
    """guid, name of a cluster registry's texts (column value): the first name of a guid."""
    guid = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    pattern = rf'\{{({guid}),"((?:[^"]|"")*)"'
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), 1).alias("guid"), F.regexp_extract_all("value", F.lit(pattern), 2).alias("name"))
    rows = registry.select(F.posexplode(pairs).alias("pos", "p")).select("pos", F.lower("p.guid").alias("guid"), F.replace("p.name", F.lit('""'), F.lit('"')).alias("name"))
    return rows.groupBy("guid").agg(F.min_by("name", "pos").alias("name"))


def named_infobases(bases: DataFrame, wanted: str) -> DataFrame:
    names = [n.strip().lower() for n in wanted.split(",") if n.strip()]
    return bases.filter(F.lower("name").isin(names)) if names else bases


def techlog_name_date(path: Column, modified: Column | None = None) -> Column:
    """YYMMDDHH or YYMMDD in the name, or YYMMDD of the folder; else the hour of the last change, or null if that is not given."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    hour, day, folder = F.regexp_extract(name, r"(?<!\d)(\d{8})(?!\d)", 1), F.regexp_extract(name, r"(?<!\d)(\d{6})(?!\d)", 1), F.regexp_extract(path, r"(?<!\d)(\d{6})(?!\d)[^/]*/[^/]+$", 1)
    found = [F.try_to_timestamp(F.nullif(hour, F.lit("")), F.lit("yyMMddHH")), *[F.try_to_timestamp(F.nullif(d, F.lit("")), F.lit("yyMMdd")) for d in (day, folder)]]
    return F.coalesce(*found, *([] if modified is None else [F.date_trunc("HOUR", modified)]))


def eventlog_name_date(path: Column, modified: Column | None = None) -> Column:
    """20YYMMDD in the name; else the day of the last change, or null if that is not given."""
    named = F.try_to_timestamp(F.nullif(F.regexp_extract(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<!\d)(20\d{6})", 1), F.lit("")), F.lit("yyyyMMdd"))
    return F.coalesce(named, *([] if modified is None else [modified])).cast("date")


def recent_files(files: DataFrame, today: date, start: date | None = None, end: date | None = None, archive: bool = False, day: str = "day") -> DataFrame:
    """Technical log files to read: those of the wanted days, or (without any, and without the archive) of yesterday and today; all of them if that leaves none. Undated files stay."""
    if archive and not (start or end):
        return files
    low, high = (start, end) if start or end else (date.fromordinal(today.toordinal() - 1), None)
    d = F.col(day).cast("date")
    wanted = d.isNull() | ((d >= F.lit(low) if low else F.lit(True)) & (d <= F.lit(high) if high else F.lit(True)))
    found = files.agg(F.count_if(wanted).alias("__n"))
    return files.join(F.broadcast(found)).filter(wanted | (F.col("__n") == 0)).drop("__n")  # one row


def prune_by_date(files: DataFrame, start: date | Column | None, end: date | Column | None, by: list[str] | None = None, day: str = "day") -> DataFrame:
    """Files that may hold days from start to end: a file covers its day up to the next file's day in its group.

    Undated files stay. by lists the grouping columns (the directory); without it all files are one
    group, and all stay if none covers the range.
    """
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy(day)
    dated = files.filter(F.col(day).isNotNull())
    # the next day that differs, so that files of one day end together
    days = dated.select(*(by or []), day).distinct().withColumn("until", F.coalesce(F.lead(day).over(order), F.lit("9999-12-31").cast("date")))
    dated = dated.join(days, [*(by or []), day])
    lo, hi = (x if isinstance(x, Column) or x is None else F.lit(x) for x in (start, end))
    covers = F.lit(True)
    if hi is not None:
        covers = covers & (F.col(day) <= hi)
    if lo is not None:
        covers = covers & (F.col("until") >= lo)
    dated = dated.withColumn("covers", covers)
    if not by:
        dated = dated.withColumn("covers", F.col("covers") | ~F.max("covers").over(Window.partitionBy(F.lit(1))))
    kept = dated.filter("covers").select(*files.columns)
    return kept.unionByName(files.filter(F.col(day).isNull()))


def latest_of_each(files: DataFrame, by: str = "directory", day: str = "day") -> DataFrame:
    """The files of each directory's last day; undated files stay."""
    last = files.groupBy(by).agg(F.max(day).alias("last"))
    return files.join(last, by).filter(F.col(day).isNull() | (F.col(day) == F.col("last"))).drop("last")
