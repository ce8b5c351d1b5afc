"""Plan helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns added, each evaluated once a row.

    Projections and filters above would otherwise take the expressions over, one copy for each
    reference; a generator of one element is as far as the optimizer moves them.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__once")
    kept = [c for c in rows.columns if c not in columns]
    return rows.select("*", made).select(*kept, *[F.col("__once")[n].alias(n) for n in columns])


def utc(c: Column) -> Column:
    """A timestamp; one without zone is read in the session's zone."""
    return c.cast("timestamp")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if they come in fewer partitions: for work that costs far more than moving its input, such as parsing one small file."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors keep tables: spark.checkpoint.dir; where it is unset, a new folder of this machine, if Spark runs on this machine alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")
