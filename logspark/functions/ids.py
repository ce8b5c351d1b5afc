"""Content-addressed record ids, delivery tokens and index names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def record_id(raw: Column, scope: Column | None = None) -> Column:
    """32 hex digits of sha-256 over a scope flag, the scope, LF and the trimmed text without CR: equal texts of a scope are one record."""
    text = F.regexp_replace(F.replace(F.coalesce(raw, F.lit("")), F.lit("\r"), F.lit("")), r"^\s+|\s+$", "")
    scope = F.lit(None).cast("string") if scope is None else scope
    flag = F.when(scope.isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    body = F.concat(flag, F.encode(F.coalesce(scope, F.lit("")), "UTF-8"), F.encode(F.lit("\n"), "UTF-8"), F.encode(text, "UTF-8"))
    return F.substring(F.sha2(body, 256), 1, 32)


def techlog_scope(process: Column, pid: Column, hour: Column) -> Column:
    return F.concat_ws("|", F.coalesce(process, F.lit("")), F.coalesce(pid, F.lit("")), F.date_format(hour, "yyyyMMddHH"))


def chunk_tokens(rows: DataFrame, id_column: str, chunk: int, by: list[str] | None = None) -> DataFrame:
    """One row per chunk of at most `chunk` ids in id order: chunk, n, token.

    The token is sha-256 of the chunk's ids, an LF after each, so that a repeated delivery of the
    same rows is recognised. Chunks are ranges of the ids: rows are dealt by range and numbered
    within their range, without any task that sees them all.
    """
    by = by or []
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*by, id_column).repartitionByRange(n, *by, id_column).withColumn("__part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("__part", *by).orderBy(id_column)) - 1
    numbered = dealt.withColumn("chunk", F.floor(place / chunk))
    ids = F.array_sort(F.collect_list(id_column))
    grouped = numbered.groupBy(*by, "__part", "chunk").agg(ids.alias("ids"))
    return grouped.select(*by, F.col("__part").alias("part"), "chunk", F.size("ids").alias("n"), ids_token("ids").alias("token"))


SEPARATIONS = {"Day": "yyyyMMdd", "Month": "yyyyMM", "Hour": "yyyyMMddHH"}


def index_name(prefix: str, date: Column, separation: str = "Day", index_id: str | None = None) -> Column:
    """prefix[_id]_{day, month, hour or all}."""
    head = prefix if not index_id else f"{prefix}_{index_id}"
    tail = F.date_format(date, SEPARATIONS[separation]) if separation in SEPARATIONS else F.lit("all")
    return F.concat_ws("_", F.lit(head), tail)


def ids_token(listed: str | Column) -> Column:
    """The delivery token of an array of ids: sha-256 of the ids, an LF after each."""
    return F.sha2(F.concat(F.array_join(listed, "\n"), F.lit("\n")), 256)
