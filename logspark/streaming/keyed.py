"""Stream operators whose state is kept by key, entry by entry: what a batch writes grows with the batch, not with what is remembered.

They need the RocksDB state store (use_rocksdb sets it for the queries that a session starts from then on).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logspark.schema import NO_NAME

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _LastKeys(StatefulProcessor):
    """Remembers the last `each` keys of a part, first in, first out: a map of keys to places, one of places to keys, and the next place."""

    def __init__(self, each: int, columns: list[str], ttl_ms: int | None):
        self.each, self.columns, self.ttl = each, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        key, place = T.StructType([T.StructField("key", T.LongType())]), T.StructType([T.StructField("place", T.LongType())])
        self.places = handle.getMapState("places", key, place, self.ttl)
        self.ring = handle.getMapState("ring", place, key, self.ttl)
        self.next = handle.getValueState("next", place)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else 0
        begun = at
        for batch in rows:
            fresh = []
            # by place: names that begin with an underscore don't arrive
            for k in batch.iloc[:, len(self.columns)].tolist():
                new = not self.places.containsKey((k,))
                fresh.append(new)
                if new:
                    slot = at % self.each
                    if at >= self.each and self.ring.containsKey((slot,)):
                        old = self.ring.getValue((slot,))
                        # a key that expired and came again has a later place
                        if self.places.containsKey(old) and self.places.getValue(old)[0] == at - self.each:
                            self.places.removeKey(old)
                    self.ring.updateValue((slot,), (k,))
                    self.places.updateValue((k,), (at,))
                    at += 1
            yield batch.iloc[:, : len(self.columns)].set_axis(self.columns, axis=1)[pd.Series(fresh, index=batch.index)]
        if at != begun:
            self.next.update((at,))

    def close(self) -> None:
        pass


def deduplicated_last(rows: DataFrame, last: int = 500_000, key: str = "id", parts: int = 64, ttl_ms: int | None = None) -> DataFrame:
    """Rows whose key is not among the last ones seen: each of `parts` parts of the keys remembers its last / parts, first in, first out, and with ttl_ms none for longer than that (of processing time).

    A new key writes three entries of state, a known one none. A null key is a key. A query with an expiry
    looks at the clock for ever: start it with an interval, not for what is there now.
    """
    each = max(1, last // parts)
    hashed = rows.select("*", F.xxhash64(key).alias("__key"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("__part"))
    processor = _LastKeys(each, rows.schema.names, ttl_ms)
    return hashed.groupBy("__part").transformWithStateInPandas(processor, rows.schema, "append", "processingTime" if ttl_ms else "none")


class _SessionUser(StatefulProcessor):
    """Remembers the last known user of a session, until the session ends or ttl_ms after the last change."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.user = handle.getValueState("user", T.StructType([T.StructField("user", T.StringType()), T.StructField("uuid", T.StringType())]), self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.user.get()) if self.user.exists() else None
        before = known
        batch = pd.concat(list(rows)).sort_values(["DateTime", "id"], kind="stable").reset_index(drop=True)
        users, uuids = [], []
        for user, uid, event in zip(batch["User"], batch["UserUuid"], batch["Event"], strict=True):
            text = user or ""
            if text not in ("", NO_NAME, "1") and not text.startswith("User #"):
                known = (user, uid)
            users.append(known[0] if known else user)
            uuids.append(known[1] if known else uid)
            if "завершение" in (event or "").lower():
                known = None
        batch["User"], batch["UserUuid"] = users, uuids
        if known is None and before is not None:
            self.user.clear()
        elif known is not None and known != before:
            self.user.update(known)
        yield batch

    def close(self) -> None:
        pass


def with_session_user(rows: DataFrame, keep_ms: int | None = 86_400_000) -> DataFrame:
    """Rows (id, base, Session, DateTime, Event, User, UserUuid) whose unknown user is the session's last known one.

    One entry of state a session, written when its user changes and gone when the session ends or
    keep_ms (of processing time; never if None) after the last change. A query with an expiry looks at the clock for
    ever: start it with an interval, not for what is there now. Rows of a micro-batch are taken in order of DateTime and id.
    """
    columns = rows.select("id", "base", "Session", "DateTime", "Event", "User", "UserUuid")
    return columns.groupBy("base", "Session").transformWithStateInPandas(_SessionUser(keep_ms), columns.schema, "append", "processingTime" if keep_ms else "none")
