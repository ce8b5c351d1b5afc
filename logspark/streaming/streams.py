"""Structured Streaming over growing log folders: parse, enrich, deduplicate, collapse, deliver."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logspark.functions.ids import record_id
from logspark.operators.eventlog import unknown_user
from logspark.schema import EVENTLOG_SCHEMA, NO_NAME


def stream_ndjson(spark: SparkSession, path: str, schema: T.StructType = EVENTLOG_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """New NDJSON dump files of a folder as they arrive; offsets live in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stream_texts(spark: SparkSession, path: str, glob: str = "*.log", files_per_trigger: int = 100) -> DataFrame:
    """New log files whole, for logs that are rotated before they are read: file, modified, raw records of each file."""
    from logspark.sources.framing import TECHLOG_START

    files = spark.readStream.option("wholetext", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).format("text").load(path)
    parts = F.split(F.regexp_replace("value", r"\r", ""), rf"(?m)(?={TECHLOG_START})")
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.posexplode(parts).alias("seq", "raw"))
    return rows.filter(F.col("raw").rlike(TECHLOG_START)).withColumn("raw", F.regexp_replace("raw", r"\n$", ""))


def deduplicated(rows: DataFrame, horizon: str = "1 day", key: str = "id", when: str = "DateTime") -> DataFrame:
    """Rows whose key was not seen within the horizon of event time."""
    return rows.withWatermark(when, horizon).dropDuplicatesWithinWatermark([key])


def collapsed(rows: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """One row per MetadataUuid, Event, user and window once its window has passed, with the count of repeats; rows without MetadataUuid have their id as key."""
    key = F.when(F.coalesce("MetadataUuid", F.lit("")) == "", F.col("id")).otherwise("")
    window = F.window("DateTime", f"{seconds} seconds")
    first = F.min(F.struct("DateTime", "id", "User", "Session")).alias("first")
    grouped = rows.withWatermark("DateTime", late).groupBy(window, "MetadataUuid", "Event", F.coalesce("UserUuid", "User").alias("who"), key.alias("single"))
    out = grouped.agg(first, F.sum("RepeatCount").alias("RepeatCount"))
    return out.select(F.col("first.id").alias("id"), F.col("first.DateTime").alias("DateTime"), "Event", "MetadataUuid", F.col("first.User").alias("User"), F.col("first.Session").alias("Session"), F.col("RepeatCount").cast("int").alias("RepeatCount"))


ENRICHED = "id string, base string, Session string, DateTime timestamp, Event string, User string, UserUuid string"


def with_session_user(rows: DataFrame, horizon: str = "1 day", keep_ms: int = 86_400_000) -> DataFrame:
    """Rows (base, Session, DateTime, id, Event, User, UserUuid) whose unknown user is the session's last known one.

    One small state a session: it is set by a known user, forgotten when the session ends or keep_ms
    of event time after its last row. Rows of a micro-batch are taken in order of DateTime and id;
    rows later than the horizon are still enriched, by what is known then.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["DateTime", "id"], kind="stable").reset_index(drop=True)
        user, event = rows["User"].fillna(""), rows["Event"].fillna("").str.lower()
        has = ~(user.isin(["", NO_NAME, "1"]) | user.str.startswith("User #"))
        ends = event.str.contains("завершение", regex=False)
        epoch = ends.cumsum().shift(fill_value=0)  # rows up to an end share what they know
        seen = has.groupby(epoch).cumsum() > 0
        carried = rows[["User", "UserUuid"]].where(has).groupby(epoch).ffill()
        first = ~seen & (epoch == 0) & (known[0] is not None)
        for i, column in enumerate(("User", "UserUuid")):
            rows[column] = rows[column].where(has | ~seen, carried[column]).where(has | ~first, known[i])
        last = int(epoch.iloc[-1]) + int(ends.iloc[-1])
        inside = has & (epoch == last)
        if inside.any():
            at = inside[inside].index[-1]
            known = (rows.at[at, "User"], rows.at[at, "UserUuid"])
        elif last > 0:
            known = (None, None)
        if known[0]:
            state.update(known)
            last = int(pd.Timestamp(rows["DateTime"].max()).timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_ms)
        elif state.exists:
            state.remove()
        yield rows[["id", "base", "Session", "DateTime", "Event", "User", "UserUuid"]]

    columns = rows.withWatermark("DateTime", horizon).select("id", "base", "Session", "DateTime", "Event", "User", "UserUuid")
    return columns.groupBy("base", "Session").applyInPandasWithState(run, ENRICHED, "user string, uuid string", "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated_last(rows: DataFrame, last: int = 500_000, key: str = "id", parts: int = 64) -> DataFrame:
    """Rows whose key is not among the last ones seen: each of `parts` parts of the keys remembers its last / parts, first in, first out.

    Unlike deduplicated, the horizon is a number of rows, so that a pause in a log forgets nothing.
    """
    each = max(1, last // parts)
    schema = rows.schema

    def run(part: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = list(state.get[0]) if state.exists else []
        have = set(known)
        for batch in batches:
            fresh = ~batch["__key"].isin(have) & ~batch["__key"].duplicated()
            added = batch.loc[fresh, "__key"].tolist()
            known += added
            have.update(added)
            yield batch.loc[fresh, schema.names]
        state.update((known[-each:],))

    hashed = rows.select("*", F.xxhash64(key).alias("__key"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("__part"))
    return hashed.groupBy("__part").applyInPandasWithState(run, schema, "known array<bigint>", "append", GroupStateTimeout.NoTimeout)


def reloaded(load: Callable[[], DataFrame], stamp: Callable[[], object]) -> Callable[[], DataFrame]:
    """A function that gives load()'s table (a dictionary), read again whenever stamp() (its last change) differs: call it once a micro-batch."""
    held: list = []

    def get() -> DataFrame:
        now = stamp()
        if not held or held[0] != now:
            held[:] = [now, load()]
        return held[1]

    return get


def fan_out(sinks: dict[str, Callable[[DataFrame, int], None]], dead_letter: str | None = None, attempts: int = 3, pause: float = 1.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: every sink gets the batch; one that fails `attempts` times (after pauses that double) leaves the batch as JSON under dead_letter, and the stream goes on (without dead_letter it fails)."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, sink in sinks.items():
                for attempt in range(attempts):
                    try:
                        sink(batch, number)
                        break
                    except Exception:
                        if attempt + 1 < attempts:
                            time.sleep(pause * 2**attempt)
                            continue
                        if dead_letter is None:
                            raise
                        batch.write.mode("overwrite").json(f"{dead_letter}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return deliver


def start(rows: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run a stream into a foreachBatch function: every trigger interval, or all that is there now."""
    writer = rows.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def identified(rows: DataFrame, scope: str = "file") -> DataFrame:
    return rows.withColumn("id", record_id(F.col("raw"), F.col(scope)))


__all__ = ["stream_ndjson", "stream_texts", "deduplicated", "deduplicated_last", "reloaded", "collapsed", "with_session_user", "fan_out", "start", "identified", "unknown_user"]
