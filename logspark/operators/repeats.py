"""Duplicate suppression and the collapse of repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row per key, the first in order. The rows travel once and are combined before the shuffle."""
    columns = rows.columns
    kept = rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*columns), F.col(order)).alias("r"))
    return kept.select(*[F.col("r")[c].alias(c) for c in columns])


def without_known(rows: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among the known ones (a left anti join)."""
    return rows.join(known.select(key), key, "left_anti")


def collapse_repeats(rows: DataFrame, seconds: int = 60, order: str = "seq") -> DataFrame:
    """Rows of equal MetadataUuid, Event, user and time window become the first of them with their RepeatCount summed.

    The user is UserUuid, or User where that is null. Rows without MetadataUuid pass through. The
    sum of RepeatCount stays what it was.
    """
    columns = rows.columns
    loose = F.coalesce("MetadataUuid", F.lit("")) == ""
    keys = [F.col("MetadataUuid").alias("k1"), F.col("Event").alias("k2"), F.coalesce("UserUuid", "User").alias("k3"), F.floor(F.unix_seconds("DateTime") / seconds).alias("k4")]
    grouped = rows.filter(~loose).groupBy(*keys).agg(F.min_by(F.struct(*columns), F.col(order)).alias("r"), F.sum("RepeatCount").alias("total"))
    grouped = grouped.select(*[F.col("total").cast("int").alias(c) if c == "RepeatCount" else F.col("r")[c].alias(c) for c in columns])
    return grouped.unionByName(rows.filter(loose))
