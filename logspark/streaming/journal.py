"""An event log from bytes to a sink: every micro-batch is framed, decoded, enriched and delivered with the dictionary of its own time.

What a batch needs of earlier ones lies in tables under a folder in shared storage, one part for each batch,
and a batch that runs again (after a failure or a restart) overwrites its own parts and nothing else:

- pins: which version of the dictionary the batch took; a batch that runs again takes the same
- versions: the dictionaries, each written once
- entries: dictionary rows that were found in journals; they hold from their place on, in later batches too
- users: the last known user of each session that the batch has touched, null where the session has ended
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators import eventlog
from logspark.sources import growing

#: A record's place within its base: hours of its file's name since 2000, then the byte.
_AT_BITS = 44
_ENTRIES = "base string, at long, raw string, batch long"
_USERS = "base string, Session string, User string, UserUuid string, batch long"


def place(file: Column, at: Column) -> Column:
    """Where a record stands among those of its base: journals are named by the time at which they begin (yyyymmdd, hours and more may follow)."""
    digits = F.rpad(F.regexp_extract(file, r"(\d{8,14})[^/]*$", 1), 10, "0")
    hours = F.floor(F.unix_timestamp(F.try_to_timestamp(digits, F.lit("yyyyMMddHH"))) / 3600) - 262_968
    return F.coalesce(hours, F.lit(0)) * F.lit(1 << _AT_BITS) + at


def base_of(file: Column) -> Column:
    """The folder that holds a journal's folder."""
    return F.regexp_extract(file, r"([^/]+)/[^/]+/[^/]+$", 1)


class JournalPlan:
    """A foreachBatch function. load gives the dictionary (base, kind, code, name, uuid), stamp tells its state: when it differs from the batch before, load is called again."""

    def __init__(self, folder: str, load: Callable[[], DataFrame], stamp: Callable[[], object], deliver: Callable[[DataFrame, int], None], base: Callable[[Column], Column] = base_of, empty: bool = True):
        self.folder, self.load, self.stamp, self.deliver, self.base, self.empty = folder.rstrip("/"), load, stamp, deliver, base, empty

    def _path(self, spark: SparkSession, name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, spark: SparkSession, name: str) -> bool:
        fs, path = self._path(spark, name)
        return fs.exists(path)

    def dictionary(self, spark: SparkSession, number: int) -> DataFrame:
        """The batch's dictionary: the one it is pinned to, else the present one, to which it is pinned then."""
        pin = f"pins/batch={number}"
        if self._exists(spark, f"{pin}/_SUCCESS"):
            version = spark.read.text(f"{self.folder}/{pin}").first()[0]
        else:
            version = hashlib.sha256(repr(self.stamp()).encode()).hexdigest()[:24]
            if not self._exists(spark, f"versions/{version}/_SUCCESS"):
                self.load().select("base", "kind", "code", "name", "uuid").write.mode("overwrite").parquet(f"{self.folder}/versions/{version}")
            spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{pin}")
        return spark.read.parquet(f"{self.folder}/versions/{version}")

    def _earlier(self, spark: SparkSession, name: str, schema: str, number: int, own: bool = False) -> DataFrame:
        """What batches up to this one (without it, unless own) have left."""
        if not self._exists(spark, name):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}").filter(F.col("batch") <= number if own else F.col("batch") < number)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(self.base(F.col("file")).alias("base"), place(F.col("file"), F.col("at")).alias("seq"), "file", "size", "DateTime", "raw")
        records, entries = eventlog.inline_entries(rows)
        entries.select("base", F.col("seq").alias("at"), "raw").write.mode("overwrite").parquet(f"{self.folder}/entries/batch={number}")
        known = self._earlier(spark, "entries", _ENTRIES, number, own=True).drop("batch")
        dims = eventlog.with_versions(self.dictionary(spark, number), known)
        decoded = eventlog.decode_eventlog(records, dims)
        made = f"{self.folder}/decoded/batch={number}"
        decoded.write.mode("overwrite").parquet(made)
        decoded = spark.read.schema(decoded.schema).parquet(made)
        carried = self._with_users(decoded, number)
        self.deliver(carried if self.empty else carried.filter(~eventlog.empty_transaction()), number)
        fs, path = self._path(spark, f"decoded/batch={number}")
        fs.delete(path, True)

    def _with_users(self, decoded: DataFrame, number: int) -> DataFrame:
        """Rows with the users of their sessions, those of earlier batches included; what is known after them is written."""
        spark = decoded.sparkSession
        touched = decoded.filter((F.coalesce("Session", F.lit("")) != "") & (F.col("Session") != "0")).select("base", "Session").distinct()
        before = self._earlier(spark, "users", _USERS, number).join(touched, ["base", "Session"], "left_semi")
        before = before.groupBy("base", "Session").agg(F.max_by(F.struct("User", "UserUuid"), "batch").alias("u")).filter("u.User IS NOT NULL")
        ahead = before.select("base", "Session", F.lit(-1).cast("long").alias("seq"), F.lit("").alias("Event"), F.col("u.User").alias("User"), F.col("u.UserUuid").alias("UserUuid"))
        both = decoded.withColumn("seq", F.col("seq").cast("long")).unionByName(ahead, allowMissingColumns=True)
        carried = eventlog.carry_session_user(both)
        ends = F.lower("Event").contains("завершение")
        last = carried.join(touched, ["base", "Session"], "left_semi").groupBy("base", "Session").agg(F.max_by(F.struct("User", "UserUuid", ends.alias("ends")), "seq").alias("l"))
        gone = F.col("l.ends") | eventlog.unknown_user(F.col("l.User"))
        users = last.select("base", "Session", F.when(~gone, F.col("l.User")).alias("User"), F.when(~gone, F.col("l.UserUuid")).alias("UserUuid"))
        users.write.mode("overwrite").parquet(f"{self.folder}/users/batch={number}")
        return carried.filter("seq >= 0")

    def compact(self, spark: SparkSession, number: int) -> None:
        """Between batches: the users known up to batch `number` as one part, so that reading them does not grow with the number of batches."""
        users = self._earlier(spark, "users", _USERS, number, own=True)
        merged = users.groupBy("base", "Session").agg(F.max_by(F.struct("User", "UserUuid"), "batch").alias("u")).filter("u.User IS NOT NULL").select("base", "Session", "u.*")
        merged.write.mode("overwrite").parquet(f"{self.folder}/users.new")
        fs, root = self._path(spark, "users")
        for part in fs.listStatus(root):
            name = part.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) < number:
                fs.delete(part.getPath(), True)
        fs.delete(self._path(spark, f"users/batch={number}")[1], True)
        fs.rename(self._path(spark, "users.new")[1], self._path(spark, f"users/batch={number}")[1])


def stream_journal(spark: SparkSession, path: str, plan: JournalPlan, every: str | None = None, **options: object):
    """Start a query over the journals of a folder: every trigger interval, or all that is there now. Its checkpoint lies beside the plan's tables."""
    rows = growing.stream_log(spark, path, "eventlog", **options)
    writer = rows.writeStream.foreachBatch(plan).option("checkpointLocation", f"{plan.folder}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
