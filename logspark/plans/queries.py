"""Driver queries over the given tables, with SQL that computes the same from the columns.

The tables hold no logs, so log texts are rendered from `events` inside each query and parsed back.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from contextlib import closing
from datetime import date, datetime, time

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logspark.functions import ids, text
from logspark.functions.dates import hex_number, json_date, json_date_text, ticks_date
from logspark.functions.plan import shared_folder, spread
from logspark.operators import eventlog, lgd, query, repeats, techlog
from logspark.plans import catalog
from logspark.sinks import delivery
from logspark.sources import framing, growing, jsondump, sqlite_journal

Q, SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in rows.dtypes])


# ------------------------------------------------------------ rendered logs

#: Event types as names of the technical log.
NAMES = {"click": "CALL", "view": "DBMSSQL", "purchase": "SDBL", "error": "EXCP", "signup": "TLOCK", "login": "SESN", "logout": "CONN"}
NAME_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " ELSE 'SCALL' END"
MICROS_SQL = "CAST(round(value * 100) AS BIGINT) * 10"


def _micros() -> Column:
    return F.round(F.col("value") * 100).cast("long") * 10


def _event_name() -> Column:
    return text.lookup(F.col("event_type"), NAMES, F.lit("SCALL"))


def techlog_texts(events: DataFrame) -> DataFrame:
    """One technical log record per event: raw, hour, process, pid."""
    events = spread(events)
    ts = F.col("ts")
    head = F.concat(F.date_format(ts, "mm:ss.SSSSSS"), F.lit("-"), _micros().cast("string"), F.lit(","), _event_name(), F.lit(","), (F.col("user_id") % 6).cast("string"))
    pairs = F.concat(
        F.lit(",process=rphost,p:processName=Base"), (F.col("user_id") % 7).cast("string"), F.lit(",Usr=user"), F.col("user_id").cast("string"), F.lit(",SessionID="), F.col("event_id").cast("string"),
        F.lit(",OSThread="), (F.col("event_id") % 64).cast("string"), F.lit(",Context='Form "), F.col("event_type"), F.lit(", line\n\tit''s '"), F.lit(',Sql="SELECT ""'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"""'), F.lit(",Rows="), F.get_json_object("props", "$.k"),
    )
    return events.select(F.concat(head, pairs).alias("raw"), F.date_trunc("HOUR", ts).alias("hour"), F.lit("rphost").alias("process"), (F.col("user_id") % 5 + 9000).cast("string").alias("pid"))


def techlog_rows(spark: SparkSession, sf_dir: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    return techlog.decode_techlog(techlog_texts(_t(spark, sf_dir, "events")), where=where, columns=columns)


@register(f"""
    SELECT SessionId AS "SessionId", ts AS "DateTime", micros AS "Duration", round(micros / 1000.0, 3) AS "DurationMs", name AS "Event", CAST(user_id % 6 AS INTEGER) AS "Level",
           'user' || user_id AS "User", CAST(user_id % 5 + 9000 AS VARCHAR) AS "ProcessId", CAST(SessionId AS BIGINT) % 64 AS thread, 'Form ' || event_type || ', line' || chr(10) || '  it''s' AS "Context",
           'SELECT "' || props || '"' AS "Sql", CAST(json_extract_string(props, '$.k') AS BIGINT) AS "Rows", 'Base' || (user_id % 7) AS base
    FROM (SELECT *, CAST(event_id AS VARCHAR) AS SessionId, {MICROS_SQL} AS micros, {NAME_SQL} AS name FROM events)""")
def techlog_parse_roundtrip(spark, sf_dir):
    rows = techlog_rows(spark, sf_dir)
    return rows.select(
        "SessionId", "DateTime", "Duration", "DurationMs", "Event", "Level", "User", "ProcessId", F.col("OSThread").cast("long").alias("thread"), "Context", "Sql", "Rows",
        F.element_at("Properties", "p_processName").alias("base"),
    )


@register(f"""
    SELECT grp, count(*) AS n, sum(micros) AS total FROM (
        SELECT {MICROS_SQL} AS micros, unnest([CASE WHEN name LIKE 'EXCP%' OR name = 'QERR' THEN 'errors' END, CASE WHEN name IN ('TLOCK', 'TDEADLOCK', 'TTIMEOUT') THEN 'locks' END,
            CASE WHEN name IN ('DBMSSQL', 'SDBL', 'DBPOSTGRS', 'DBORACLE', 'DBV8DBENG') THEN 'dbms' END, CASE WHEN name IN ('CALL', 'SCALL', 'RUNMETH') THEN 'calls' END, CASE WHEN name = 'LONGDURATIONINFO' THEN 'long' END]) AS grp
        FROM (SELECT *, {NAME_SQL} AS name FROM events)) WHERE grp IS NOT NULL GROUP BY grp""")
def techlog_event_groups(spark, sf_dir):
    rows = techlog_rows(spark, sf_dir, columns=["Event", "Duration"])
    marks = F.array(*[F.when(test(F.col("Event")), name) for name, test in query.EVENT_GROUPS.items()])
    marked = rows.select("Duration", F.explode(marks).alias("grp")).filter("grp IS NOT NULL")
    return marked.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("Duration").alias("total"))


@register(f"""
    SELECT event_id, micros / 1000.0 AS ms FROM (SELECT *, {MICROS_SQL} AS micros FROM events)
    WHERE micros / 1000.0 >= 10 AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00'""")
def techlog_min_duration_filter(spark, sf_dir):
    spec = query.FilterSpec(min_duration_ms=10, date_from=date(2024, 1, 3), date_to=date(2024, 1, 10))
    return techlog_rows(spark, sf_dir, query.predicate(spec), ["SessionId", "DurationMs"]).select(F.col("SessionId").cast("long").alias("event_id"), F.col("DurationMs").alias("ms"))


@register(f"""
    SELECT event_id, ts, {MICROS_SQL} AS micros, {NAME_SQL} AS name FROM events ORDER BY micros DESC, ts DESC, event_id LIMIT 100""")
def techlog_longest_topn(spark, sf_dir):
    rows = techlog_rows(spark, sf_dir).withColumn("event_id", F.col("SessionId").cast("long"))
    return query.top_rows(rows, "longest", 100, extra=["event_id"]).select("event_id", F.col("DateTime").alias("ts"), F.col("Duration").alias("micros"), F.col("Event").alias("name"))


@register("""
    SELECT event_id, event_type = 'error' OR value > 90 AS active, CASE WHEN event_type = 'error' OR value > 90 THEN 'Выполняется' ELSE 'Завершено' END AS status FROM events""")
def techlog_active_status(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "longdurationinfo").otherwise("CALL").alias("Event"), F.lit("").alias("LongInfoName"), F.when(F.col("value") > 90, F.col("event_id")).alias("LongInfoWait")
    )
    return rows.select("event_id", techlog.is_active().alias("active"), techlog.status_text().alias("status"))


@register("""
    SELECT event_id, CASE WHEN d < 1000 THEN d || ' μs' WHEN d < 1000000 THEN printf('%.2f', d / 1000.0) || ' ms' WHEN d < 60000000 THEN printf('%.2f', d / 1000000.0) || ' s'
           ELSE (d // 60000000) || 'm ' || printf('%.1f', (d % 60000000) / 1000000.0) || 's' END AS shown
    FROM (SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id % 1000 WHEN 1 THEN (event_id % 99990) * 10 + 1000 WHEN 2 THEN (event_id % 5000) * 10000 + 1000000 ELSE (event_id % 5000) * 100000 + 60000000 END AS BIGINT) AS d FROM events)""")
def techlog_duration_format(spark, sf_dir):
    e = F.col("event_id")
    micros = F.when(e % 4 == 0, e % 1000).when(e % 4 == 1, (e % 99990) * 10 + 1000).when(e % 4 == 2, (e % 5000) * 10_000 + 1_000_000).otherwise((e % 5000) * 100_000 + 60_000_000)
    return _t(spark, sf_dir, "events").select("event_id", text.format_micros(micros.cast("long")).alias("shown"))


@register("""
    SELECT o_orderkey, CASE WHEN s <= 0 THEN '0 B' WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f', s / 1024.0) || ' KB' WHEN s < 1073741824 THEN printf('%.2f', s / 1048576.0) || ' MB' ELSE printf('%.2f', s / 1073741824.0) || ' GB' END AS shown
    FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 1024 WHEN 1 THEN (o_orderkey % 1000 + 1) * 1024 WHEN 2 THEN (o_orderkey % 1000 + 1) * 1048576 ELSE (o_orderkey % 100 + 1) * 1073741824 END AS s FROM orders)""")
def file_size_format(spark, sf_dir):
    k = F.col("o_orderkey")
    size = F.when(k % 4 == 0, k % 1024).when(k % 4 == 1, (k % 1000 + 1) * 1024).when(k % 4 == 2, (k % 1000 + 1) * 1048576).otherwise((k % 100 + 1) * F.lit(1073741824))
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.format_size(size).alias("shown"))


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, nations and parts as dictionary entries of one infobase."""
    c, n, p = (_t(spark, sf_dir, t) for t in ("customer", "nation", "part"))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    entry = lambda kind, key, name: F.concat(F.lit("{" + str(kind) + ',0,'), quoted(name), F.lit(","), key.cast("string"), F.lit("}"))
    rows = c.select(F.col("c_custkey").alias("at"), entry(1, F.col("c_custkey") + 1, F.col("c_name")).alias("raw"))
    rows = rows.unionByName(n.select(F.col("n_nationkey").cast("long").alias("at"), entry(3, F.col("n_nationkey") + 1, F.col("n_name")).alias("raw")))
    rows = rows.unionByName(p.select(F.col("p_partkey").alias("at"), entry(5, F.col("p_partkey") + 1, F.col("p_name")).alias("raw")))
    return eventlog.decode_dictionary(rows)


def eventlog_texts(events: DataFrame) -> DataFrame:
    """One event log record per event: base, seq, raw."""
    events = spread(events)
    e, u, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    s = lambda c: c.cast("string")
    hexes = F.concat(F.lit("{"), F.lower(F.hex(F.floor((F.unix_micros(F.date_trunc("SECOND", ts)) + F.lit(62_135_596_800_000_000)) / 100).cast("long"))), F.lit(","), F.lower(F.hex(e + 1)), F.lit("}"))
    raw = F.concat(
        F.lit("{"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit(","), F.when(e % 3 == 0, "C").when(e % 3 == 1, "U").otherwise("R"), F.lit(",\n"), hexes, F.lit(","), s(u), F.lit(",0,"), s(u % 25 + 1), F.lit(","), s(e), F.lit(",0,"),
        F.when(F.col("event_type") == "error", "E").otherwise("I"), F.lit(',"say ""'), F.col("event_type"), F.lit('"", {x} ",'), F.when(e % 5 == 0, F.concat(F.lit("{"), s(u), F.lit(","), s(u + 1), F.lit("}"))).otherwise(s(e % 50)), F.lit(',{"N",'), s(u),
        F.lit('},"<?>; a'), s(u), F.lit('; ",0,0,0,'), s(e), F.lit(",0}"),
    )
    return events.select(F.lit("").alias("base"), e.alias("seq"), raw.alias("raw"))


@register("""
    SELECT e.event_id AS seq, date_trunc('second', ts) AS "DateTime", CASE WHEN user_id = 0 THEN '' ELSE coalesce(c.c_name, 'User #' || user_id) END AS "User", coalesce(n.n_name, 'App #' || (user_id % 25 + 1)) AS "Application",
           CASE e.event_id % 3 WHEN 0 THEN 'Зафиксирована' WHEN 1 THEN 'Не завершена' ELSE 'Отменена' END AS "TransactionStatus", date_trunc('second', ts) AS "TransactionDate", e.event_id + 1 AS "TransactionNumber",
           CASE WHEN event_type = 'error' THEN 'Ошибка' ELSE 'Информация' END AS "Severity", 'say "' || event_type || '", {x}' AS "Comment", CAST(user_id AS VARCHAR) AS "Data", 'a' || user_id AS "DataPresentation", CAST(e.event_id AS VARCHAR) AS "Session",
           CASE WHEN e.event_id % 5 = 0 THEN concat_ws(', ', CASE WHEN user_id <> 0 THEN coalesce(p1.p_name, 'Meta #' || user_id) END, coalesce(p2.p_name, 'Meta #' || (user_id + 1))) WHEN e.event_id % 50 = 0 THEN '' ELSE coalesce(p3.p_name, 'Meta #' || (e.event_id % 50)) END AS "Metadata"
    FROM events e LEFT JOIN customer c ON c.c_custkey + 1 = user_id LEFT JOIN nation n ON n.n_nationkey = user_id % 25
    LEFT JOIN part p1 ON p1.p_partkey + 1 = user_id LEFT JOIN part p2 ON p2.p_partkey = user_id LEFT JOIN part p3 ON p3.p_partkey + 1 = e.event_id % 50""")
def eventlog_parse_roundtrip(spark, sf_dir):
    columns = ["DateTime", "User", "Application", "TransactionStatus", "TransactionDate", "TransactionNumber", "Severity", "Comment", "Data", "DataPresentation", "Session", "Metadata"]
    return eventlog.decode_eventlog(eventlog_texts(_t(spark, sf_dir, "events")), _dims(spark, sf_dir), columns=columns).select("seq", *columns)


@register("""
    SELECT event_id AS seq, date_trunc('second', ts) AS "DateTime", 'say "' || event_type || '", {x}' AS "Comment", coalesce(n_name, 'App #' || (user_id % 25 + 1)) AS "Application" FROM events LEFT JOIN nation ON n_nationkey = user_id % 25
    WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-03 00:00:00' AND date_trunc('second', ts) < TIMESTAMP '2024-01-11 00:00:00'""")
def eventlog_date_range(spark, sf_dir):
    """Records of a range of days: others are left out by their headers, before they are split into fields."""
    where = query.predicate(query.FilterSpec(kind="eventlog", date_from=date(2024, 1, 3), date_to=date(2024, 1, 10)))
    return eventlog.decode_eventlog(eventlog_texts(_t(spark, sf_dir, "events")), _dims(spark, sf_dir), where=where, columns=["DateTime", "Comment", "Application"]).select("seq", "DateTime", "Comment", "Application")


@register("""
    SELECT user_id % 6 AS base, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, min(date_trunc('second', ts)) AS first, max(date_trunc('second', ts)) AS last FROM events
    WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-05 06:00:00' AND date_trunc('second', ts) < TIMESTAMP '2024-01-09 00:00:00' GROUP BY 1""")
def eventlog_files_date_range(spark, sf_dir):
    """Journals of six infobases as files, in the order of time; a range of dates is pushed into their reader."""
    events = _t(spark, sf_dir, "events")
    texts = eventlog_texts(events).join(events.select(F.col("event_id").alias("seq"), (F.col("user_id") % 6).alias("k"), "ts"), "seq")
    folder = f"{shared_folder(spark)}/journals-{uuid.uuid4().hex}"
    lines = texts.repartition(6, "k").sortWithinPartitions("k", F.date_trunc("SECOND", "ts")).select("k", F.concat("raw", F.lit(",")).alias("value"))
    lines.write.partitionBy("k").text(folder)
    log = growing.read_log(spark, folder, "eventlog", glob="*.txt").filter("DateTime >= timestamp'2024-01-05 06:00:00' AND DateTime < timestamp'2024-01-09 00:00:00'")
    base = F.regexp_extract("file", r"k=(\d+)", 1).cast("long")
    rows = eventlog.decode_eventlog(log.select(base.cast("string").alias("base"), F.col("at").alias("seq"), "file", "size", "DateTime", "raw"), _dims(spark, sf_dir).limit(0), columns=["DateTime", "Session"])
    return rows.groupBy(F.col("base").cast("long").alias("base")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("Session").cast("long")).alias("ids"), F.min("DateTime").alias("first"), F.max("DateTime").alias("last"))


@register("""
    WITH m AS (SELECT n_nationkey + 1 AS code, n_nationkey * 37 AS pos, 'First ' || n_name AS name FROM nation UNION ALL SELECT n_nationkey + 1, n_nationkey * 91 + 2000, 'Second ' || n_name FROM nation),
    e AS (SELECT event_id AS seq, event_id % 50 AS code, event_id % 5 = 0 AS several FROM events)
    SELECT e.seq, CASE WHEN e.code = 0 THEN '' ELSE coalesce((SELECT arg_max(name, pos) FROM m WHERE m.code = e.code AND m.pos <= e.seq), p_name, 'Meta #' || e.code) END AS "Metadata"
    FROM e LEFT JOIN part ON p_partkey + 1 = e.code WHERE NOT several""")
def eventlog_dictionary_versions(spark, sf_dir):
    """Dictionary rows within a journal rename codes from their place on: what stands before keeps the old name."""
    entry = lambda word: F.concat(F.lit('{5,0,"' + word), "n_name", F.lit('",'), (F.col("n_nationkey") + 1).cast("string"), F.lit("},"))
    k = F.col("n_nationkey").cast("long")
    nations, nothing = _t(spark, sf_dir, "nation"), F.concat(F.lit('{5,0,"",'), (k + 1).cast("string"), F.lit("},"))  # a row without a name changes nothing
    inline = nations.select((k * 37).alias("seq"), entry("First ").alias("raw")).unionByName(nations.select((k * 91 + 2000).alias("seq"), entry("Second ").alias("raw"))).unionByName(nations.select((k * 91 + 3000).alias("seq"), nothing.alias("raw")))
    texts = eventlog_texts(_t(spark, sf_dir, "events").filter("event_id % 5 <> 0")).unionByName(inline.withColumn("base", F.lit("")))
    records, entries = eventlog.inline_entries(texts)
    dims = eventlog.with_versions(_dims(spark, sf_dir), entries.withColumnRenamed("seq", "at"))
    return eventlog.decode_eventlog(records, dims, columns=["Metadata"]).select("seq", "Metadata")


@register("""
    SELECT l_orderkey AS "order", string_agg(p_name, ', ' ORDER BY l_linenumber, l_partkey) AS names, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey <> 0 GROUP BY l_orderkey""")
def eventlog_composite_metadata(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").filter("l_partkey <> 0").groupBy(F.col("l_orderkey").alias("order"))
    lists = lines.agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    lists = lists.select("order", F.lit("").alias("base"), F.transform("l", lambda x: x["l_partkey"].cast("string")).alias("codes"))
    dims = _t(spark, sf_dir, "part").select(F.lit("").alias("base"), F.lit("metadata").alias("kind"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), F.lit("").alias("uuid"))
    return eventlog.names_of_list(lists, dims, "order", "codes").select("order", "names", F.size("codes").cast("long").alias("n"))


@register("""
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '(без объектной ссылки)' WHEN 1 THEN 'Ссылка: ' || o_orderstatus || ' ' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
        WHEN 2 THEN o_orderpriority || ' "q", x' WHEN 3 THEN CASE WHEN o_custkey % 2 = 1 THEN 'Истина' ELSE 'Ложь' END WHEN 4 THEN CAST(o_custkey AS VARCHAR) ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS data
    FROM (SELECT *, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)""")
def eventlog_reference_decode(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    data = (
        F.when(k % 6 == 0, '{"U"}').when(k % 6 == 1, F.concat(F.lit('{"R",7:'), F.md5(k.cast("string").cast("binary")), F.lit("}"))).when(k % 6 == 2, F.concat(F.lit('{"S","'), F.col("o_orderpriority"), F.lit(' ""q"", x"}')))
        .when(k % 6 == 3, F.concat(F.lit('{"B",'), (c % 2).cast("string"), F.lit("}"))).when(k % 6 == 4, F.concat(F.lit('{"N",'), c.cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"D",'), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("}")))
    )
    return _t(spark, sf_dir, "orders").select("o_orderkey", eventlog.decode_data(data, F.col("o_orderstatus")).alias("data"))


@register("""
    SELECT event_id, CASE WHEN ms < 1000 THEN regexp_replace(printf('%.1f', ms * 1.0), '\\.0$', '') || ' ms' WHEN ms < 60000 THEN printf('%.2f', ms / 1000.0) || ' s' WHEN ms < 3600000 THEN (ms // 60000) || 'm ' || printf('%.1f', (ms % 60000) / 1000.0) || 's' ELSE (ms // 3600000) || 'h ' || ((ms % 3600000) // 60000) || 'm' END AS shown, CAST(ms AS DOUBLE) AS ms
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 999 + 1 WHEN 1 THEN (event_id % 5000) * 10 + 1000 WHEN 2 THEN (event_id % 30000) * 100 + 60000 ELSE (event_id % 50) * 60000 + 3600000 END AS ms FROM events)""")
def eventlog_transaction_time(spark, sf_dir):
    e = F.col("event_id")
    ms = F.when(e % 4 == 0, e % 999 + 1).when(e % 4 == 1, (e % 5000) * 10 + 1000).when(e % 4 == 2, (e % 30_000) * 100 + 60_000).otherwise((e % 50) * 60_000 + 3_600_000)
    start = F.date_trunc("SECOND", "ts")
    units = F.lower(F.hex(((F.unix_micros(start) + F.lit(62_135_596_800_000_000)) / 100).cast("long")))
    rows = _t(spark, sf_dir, "events").select("event_id", ticks_date(hex_number(units)).alias("TransactionDate"), F.timestamp_micros(F.unix_micros(start) + ms * 1000).alias("DateTime"))
    return rows.select("event_id", eventlog.transaction_display().alias("shown"), eventlog.transaction_millis().alias("ms"))


@register("""
    SELECT event_id FROM events WHERE NOT (event_type IN ('click', 'view') AND user_id % 3 = 0 AND value < 50)""")
def empty_transaction_filter(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "Транзакция. Начало").when(F.col("event_type") == "view", "Транзакция. Фиксация").otherwise("Данные. Проведение")
    rows = _t(spark, sf_dir, "events").select(
        "event_id", kind.alias("Event"), F.when(F.col("user_id") % 3 == 0, " ").otherwise("note").alias("Comment"), F.lit("").alias("Data"), F.lit(None).cast("string").alias("DataPresentation"),
        F.lit("").alias("Metadata"), F.when(F.col("value") < 50, "Информация").otherwise("Ошибка").alias("Severity"),
    )
    return rows.filter(~eventlog.empty_transaction()).select("event_id")


@register("""
    WITH e AS (SELECT event_id, user_id // 3 AS session, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS ends, CASE WHEN event_type = 'click' THEN 'user' || user_id END AS known FROM events),
         p AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM e)
    SELECT event_id, coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY session, epoch ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'User #1') AS "User" FROM p""")
def session_user_carry_forward(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(
        F.lit("b").alias("base"), F.col("event_id").alias("seq"), F.concat(F.lit("s"), F.floor(F.col("user_id") / 3).cast("string")).alias("Session"),
        F.when(F.col("event_type") == "error", "Сеанс. Завершение").otherwise("Данные. Проведение").alias("Event"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("user"), F.col("user_id").cast("string"))).otherwise("User #1").alias("User"), F.lit("").alias("UserUuid"),
    )
    return eventlog.carry_session_user(rows).select(F.col("seq").alias("event_id"), "User")


@register("""
    SELECT min(event_id) AS first_id, event_type AS "Event", user_id, count(*) AS repeats, arg_min(value, event_id) AS first_value FROM events WHERE user_id % 5 <> 0 GROUP BY event_type, user_id, time_bucket(INTERVAL '3600 seconds', ts)
    UNION ALL SELECT event_id, event_type, user_id, 1, value FROM events WHERE user_id % 5 = 0""")
def collapse_repeats(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.when(F.col("user_id") % 5 == 0, "").otherwise("m").alias("MetadataUuid"), F.col("event_type").alias("Event"), F.col("user_id").cast("string").alias("UserUuid"),
        F.lit("").alias("User"), F.col("ts").alias("DateTime"), F.lit(1).alias("RepeatCount"), "value", "user_id",
    )
    out = repeats.collapse_repeats(rows, 3600)
    return out.select(F.col("seq").alias("first_id"), "Event", "user_id", F.col("RepeatCount").cast("long").alias("repeats"), F.col("value").alias("first_value"))


@register("""
    SELECT doc_id, substr(sha256(chr(1) || source || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 1, 32) AS id FROM documents""")
def record_id_hash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", ids.record_id(F.col("text"), F.col("source")).alias("id"))


@register("""
    SELECT min(doc_id) AS doc_id FROM documents GROUP BY lang, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))""")
def dedup_by_record_id(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), ids.record_id(F.col("text"), F.col("lang")).alias("id"))
    return repeats.first_of_each(rows).select(F.col("seq").alias("doc_id"))


@register("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 95)")
def skip_known_ids(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    return repeats.without_known(rows, rows.filter("event_type = 'error' AND value > 95"), "user_id").select("event_id")


@register(r"""
    SELECT page_id, CASE WHEN length(s) > 1000 THEN substr(s, 1, 1000) || '... [TRUNCATED: ' || length(s) || ' -> 1000 chars]' ELSE s END AS flat
    FROM (SELECT page_id, regexp_replace(replace(html, chr(10), ' '), '[\x00-\x08\x0a-\x1f\x7f-\x9f]', '', 'g') AS s FROM pages)""")
def sanitize_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.sanitize_text(F.col("html"), 1000).alias("flat"))


@register(r"""
    SELECT doc_id, CASE WHEN length(s) > 2000 THEN substr(s, 1, 2000) || '... [TRUNCATED: ' || length(s) || ' -> 2000 chars]' ELSE s END AS clean
    FROM (SELECT doc_id, trim(replace(text, chr(9), '  '), ' ' || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM documents)""")
def sanitize_multiline(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.sanitize_multiline(F.col("text"), 2000).alias("clean"))


@register("""
    SELECT doc_id, 'see ' || substr(repeat(md5(text), n), 1, 24) || '... [Двоичные данные Base64: ' || (32 * n) || ' симв.] end' AS cut FROM (SELECT doc_id, text, 7 + doc_id % 5 AS n FROM documents)""")
def truncate_base64(spark, sf_dir):
    run = F.expr("repeat(md5(text), cast(7 + doc_id % 5 as int))")
    return _t(spark, sf_dir, "documents").select("doc_id", text.truncate_base64(F.concat(F.lit("see "), run, F.lit(" end"))).alias("cut"))


@register(r"""
    SELECT doc_id, CASE WHEN length(s) > 400 THEN substr(s, 1, 400) || '…' ELSE s END AS line FROM (SELECT doc_id, regexp_replace(trim(text, chr(9) || chr(10) || chr(13)), '[\r\n\t]+', ' ', 'g') AS s FROM documents)""")
def single_line_preview(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.single_line(F.col("text")).alias("line"))


@register("""
    SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(lang), 'the') OR contains(lower(source), 'the')) AND NOT (contains(lower(text), 'license') OR contains(lower(lang), 'license') OR contains(lower(source), 'license'))""")
def search_tokens_and_not(spark, sf_dir):
    found = query.search_predicate("The, !LICENSE", "eventlog", any_columns=["text", "lang", "source"], field_names={})
    return _t(spark, sf_dir, "documents").filter(found).select("doc_id")


@register("SELECT conv_id, turn FROM conversations WHERE contains(lower(role), 'assist') AND NOT contains(lower(text), 'ou') AND contains(lower(role), 'ant')")
def search_field_scoped(spark, sf_dir):
    found = query.search_predicate('role:Assist -text:ou "ROLE:ant"', "eventlog", any_columns=["text"], field_names={"role": "role", "text": "text"})
    return _t(spark, sf_dir, "conversations").filter(found).select("conv_id", "turn")


@register("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') AND c_nationkey NOT IN (3, 5)")
def value_set_include_exclude(spark, sf_dir):
    spec = query.FilterSpec(include={"c_mktsegment": ["Building", "machinery"]}, exclude={"nation": ["3", "5"]})
    rows = _t(spark, sf_dir, "customer").withColumns({"DateTime": F.lit(None).cast("timestamp"), "nation": F.col("c_nationkey").cast("string")})
    return rows.filter(query.predicate(spec)).select("c_custkey")


@register("SELECT event_id FROM events WHERE CAST(ts AS TIME) >= TIME '08:30:00' AND CAST(ts AS TIME) <= TIME '17:05:30'")
def time_of_day_filter(spark, sf_dir):
    spec = query.FilterSpec(time_from=time(8, 30), time_to=time(17, 5, 30))
    return _t(spark, sf_dir, "events").withColumnRenamed("ts", "DateTime").filter(query.predicate(spec)).select("event_id")


@register("""
    SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY ALL UNION ALL SELECT 'props', props, count(*) FROM events GROUP BY ALL""")
def facet_counts(spark, sf_dir):
    return query.facets(_t(spark, sf_dir, "events"), ["event_type", "user_id", "props"])


@register(f"""
    SELECT coalesce(e.event, k.event) AS event, coalesce(n, 0) AS n FROM (SELECT {NAME_SQL} AS event, count(*) AS n FROM events GROUP BY 1) e
    FULL JOIN (SELECT unnest(['CALL', 'DBMSSQL', 'QERR', 'TDEADLOCK']) AS event) k ON e.event = k.event""")
def facet_known_with_zero(spark, sf_dir):
    return query.event_counts(_t(spark, sf_dir, "events").select(_event_name().alias("Event")), ["CALL", "DBMSSQL", "QERR", "TDEADLOCK"])


@register("SELECT min(ts) AS first, max(ts) AS last, count(*) AS n FROM events")
def loaded_range(spark, sf_dir):
    return query.loaded_range(_t(spark, sf_dir, "events"), "ts")


@register("SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate FROM orders ORDER BY lower(o_orderpriority), lower(o_orderstatus) DESC, o_orderdate DESC, o_orderkey LIMIT 500")
def multi_key_sort_topn(spark, sf_dir):
    keys = query.push_key([("o_orderstatus", True)], "o_orderpriority")
    rows = query.top_rows(_t(spark, sf_dir, "orders"), keys, 500, date_column="o_orderdate", extra=["o_orderkey"])
    return rows.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")


@register("""
    SELECT event_id, ms FROM (SELECT event_id, ts, CASE WHEN user_id % 2 = 0 THEN value END AS ms FROM events) ORDER BY ms ASC NULLS FIRST, ts DESC, event_id LIMIT 300""")
def null_first_duration_sort(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("ms", F.when(F.col("user_id") % 2 == 0, F.col("value")))
    return query.top_rows(rows, [("ms", False)], 300, date_column="ts", extra=["event_id"]).select("event_id", "ms")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal file for every (customer, day) of orders, in one directory per nation-like bucket."""
    orders = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("d"), F.to_date("o_orderdate").alias("day"))
    folder = F.concat(F.lit("/logs/base"), F.col("d").cast("string"), F.lit("/1Cv8Log"))
    files = orders.distinct().select(folder.alias("directory"), F.concat(folder, F.lit("/"), F.date_format("day", "yyyyMMdd"), F.lit("000000.lgp")).alias("path"))
    return files.withColumn("day", catalog.eventlog_name_date(F.col("path")))


FILES_SQL = "SELECT DISTINCT '/logs/base' || (o_custkey % 20) || '/1Cv8Log' AS directory, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'"


@register(f"""
    WITH f AS ({FILES_SQL}), n AS (SELECT *, lead(day) OVER (PARTITION BY directory ORDER BY day) AS until FROM f)
    SELECT directory, day FROM n WHERE day <= DATE '2001-03-20' AND coalesce(until, DATE '9999-12-31') >= DATE '2001-03-10'""")
def file_date_pruning(spark, sf_dir):
    files = _files(spark, sf_dir).filter("day IS NOT NULL")
    return catalog.prune_by_date(files, date(2001, 3, 10), date(2001, 3, 20), by=["directory"]).select("directory", "day")


@register(f"SELECT directory, max(day) AS day FROM ({FILES_SQL}) GROUP BY directory")
def latest_day_per_directory(spark, sf_dir):
    return catalog.latest_of_each(_files(spark, sf_dir).filter("day IS NOT NULL")).select("directory", "day")


@register("SELECT 'events_prod_' || strftime(ts, '%Y%m%d') AS index, 'events_' || strftime(ts, '%Y%m%d%H') AS hourly, count(*) AS n FROM events GROUP BY ALL")
def index_name_partition(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    rows = events.select(ids.index_name("events", F.col("ts"), "Day", "prod").alias("index"), ids.index_name("events", F.col("ts"), "Hour").alias("hourly"))
    return rows.groupBy("index", "hourly").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT user_id, event_id // 1000 AS chunk, count(*) AS n, sha256(string_agg(lpad(CAST(event_id AS VARCHAR), 12, '0'), chr(10) ORDER BY event_id) || chr(10)) AS token FROM events GROUP BY user_id, event_id // 1000")
def dedup_token(spark, sf_dir):
    """Tokens of chunks: the rows of a user within 1,000 ids, so that no chunk grows with the table."""
    rows = _t(spark, sf_dir, "events").select("user_id", F.expr("event_id div 1000").alias("chunk"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"))
    listed = rows.groupBy("user_id", "chunk").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return listed.select("user_id", "chunk", F.size("ids").cast("long").alias("n"), ids.ids_token("ids").alias("token"))


@register("SELECT event_id AS k, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS shown, date_trunc('millisecond', ts) AS back FROM events")
def json_date_codec(spark, sf_dir):
    shown = json_date_text(F.col("ts"))
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("k"), shown.alias("shown"), json_date(shown).alias("back"))


@register("""
    SELECT CAST(event_id AS VARCHAR) AS id, event_type AS "Event", CAST(value AS VARCHAR) AS "Comment" FROM (SELECT event_id, event_type, CAST(round(value * 100) AS BIGINT) AS value FROM events) WHERE event_id % 10 <> 3""")
def json_dump_tolerant(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    record = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.lit("2024-01-01 00:00:00").alias("DateFormatted"), F.col("event_type").alias("Event"), F.round(F.col("value") * 100).cast("long").cast("string").alias("Comment")))
    line = F.when(F.col("event_id") % 10 == 3, F.expr("'{broken ' || event_id")).when(F.col("event_id") % 10 == 4, F.concat(F.lit("["), record, F.lit(","))).when(F.col("event_id") % 10 == 5, F.concat(F.lit("  "), record, F.lit("]"))).otherwise(record)
    return jsondump.parse_lines(e.select(line.alias("value")), "eventlog").select("id", "Event", "Comment")


@register("SELECT key, value, count(*) AS n FROM (SELECT 'k' AS key, json_extract_string(props, '$.k') AS value FROM events) GROUP BY ALL")
def props_to_map_facet(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_by_ids(spark, sf_dir):
    gone = _t(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return query.without_ids(_t(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey")


@register("SELECT n_nationkey, unnest([0, 1]) AS pos, unnest(['n_name', 'n_regionkey']) AS name, unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation")
def detail_unpivot(spark, sf_dir):
    return query.details(_t(spark, sf_dir, "nation"), "n_nationkey", ["n_name", "n_regionkey"])


@register("""
    SELECT r_name AS region, n_name AS nation, o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join_counts(spark, sf_dir):
    l, o, c, n, r = (_t(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return rows.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), cents.alias("cents"))


@register(f"""
    SELECT "user", event, count(*) AS n FROM (SELECT 'user' || user_id AS "user", {NAME_SQL} AS event FROM events) GROUP BY ALL""")
def techlog_framed_files(spark, sf_dir):
    """Records as lines of files, framed and decoded again: the framer sees a file per pid and splits of 500 records."""
    texts = techlog_texts(_t(spark, sf_dir, "events").filter("event_id IS NOT NULL"))
    numbered = texts.withColumn("n", F.row_number().over(Window.partitionBy("pid", "hour").orderBy("raw")))
    lines = numbered.select("pid", "hour", F.posexplode(F.split("raw", "\n")).alias("i", "line"), "n")
    lines = lines.select(
        F.concat_ws("/", F.lit("rphost_x"), "pid", F.date_format("hour", "yyMMddHH")).alias("file"), F.lit(0).cast("long").alias("size"), F.floor((F.col("n") * 2 + F.col("i")) / 7).alias("split"), (F.col("n") * 10 + F.col("i")).alias("at"), "line", "hour", "pid"
    )
    places = lines.select("file", "hour", "pid").distinct()
    framed = framing.frame(lines.select("file", "size", "split", "at", "line"), framing.TECHLOG_START).join(places, "file")
    rows = techlog.decode_techlog(framed.withColumn("process", F.lit("rphost")))
    return rows.groupBy(F.col("User").alias("user"), F.col("Event").alias("event")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ SQLite journals

_UNITS = "CAST((epoch_us(date_trunc('second', ts)) + 62135596800000000) // 100 AS BIGINT)"


def journal_rows(events: DataFrame) -> DataFrame:
    """Events as rows of the SQLite journals of three infobases."""
    e, u = F.col("event_id"), F.col("user_id")
    lists = F.when(e % 4 == 1, u.cast("string")).when(e % 4 == 2, F.concat(F.lit("["), u.cast("string"), F.lit(", "), (u + 1).cast("string"), F.lit("]"))).when(e % 4 == 3, "word").otherwise("")
    units = F.floor((F.unix_micros(F.date_trunc("SECOND", "ts")) + F.lit(62_135_596_800_000_000)) / 100).cast("long")
    return events.select(
        F.concat(F.lit("/logs/Base"), (u % 3).cast("string"), F.lit("/1Cv8Log/1Cv8.lgd")).alias("path"), F.lit(2048).cast("long").alias("size"), e.alias("rowID"), (e % 5).alias("severity"), units.alias("date"), u.alias("connectID"),
        F.when(u % 7 != 0, e).alias("session"), (e % 5).alias("transactionStatus"), F.when(e % 3 != 0, e).alias("transactionID"), (u + 1).alias("userCode"), (u % 30).alias("appCode"), (e % 4).alias("eventCode"), F.col("event_type").alias("comment"),
        F.col("event_type").alias("dataPresentation"), lists.alias("metadataCodes"), F.lit(0).cast("long").alias("computerCode"), F.lit(9).cast("long").alias("workServerCode"), (u % 2).alias("primaryPortCode"), "ts",
    )


def journal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, p = (_t(spark, sf_dir, t) for t in ("customer", "nation", "part"))
    row = lambda kind, code, name: (F.lit(kind).alias("kind"), code.cast("long").alias("code"), name.alias("name"))
    rows = c.select(*row("user", F.col("c_custkey") + 1, F.col("c_name"))).unionByName(n.select(*row("app", F.col("n_nationkey") + 1, F.col("n_name")))).unionByName(p.select(*row("metadata", F.col("p_partkey"), F.col("p_name"))))
    rows = rows.unionByName(n.filter("n_nationkey < 2").select(*row("event", F.col("n_nationkey") + 1, F.when(F.col("n_nationkey") == 0, "_$Transaction$_.Begin").otherwise("_$Data$_.Post"))))
    paths = F.explode(F.array(*[F.lit(f"/logs/Base{k}/1Cv8Log/1Cv8.lgd") for k in range(3)])).alias("path")
    return rows.select(paths, "kind", "code", "name", F.lit("").alias("uuid"))


@register(f"""
    SELECT 'Base' || (user_id % 3) AS base, e.event_id AS seq, 'lgd_' || e.event_id || '_' || {_UNITS} || '_' || substr(sha256(chr(1) || 'Base' || (user_id % 3) || chr(10) || 'lgd'), 1, 8) AS id, date_trunc('second', ts) AS "DateTime",
           coalesce(c.c_name, CASE WHEN user_id = 0 THEN '<Не указан>' ELSE 'User #' || (user_id + 1) END) AS "User", CASE WHEN user_id % 30 = 0 THEN '' ELSE coalesce(n.n_name, 'App #' || (user_id % 30)) END AS "Application",
           CASE e.event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Транзакция. Начало' WHEN 2 THEN 'Данные. Проведение' ELSE 'Event #3' END AS "Event",
           CASE e.event_id % 4 WHEN 0 THEN '' WHEN 1 THEN coalesce(p1.p_name, 'Meta #' || user_id) WHEN 2 THEN coalesce(p1.p_name, 'Meta #' || user_id) || ', ' || coalesce(p2.p_name, 'Meta #' || (user_id + 1)) ELSE 'word' END AS "Metadata",
           CASE e.event_id % 5 WHEN 0 THEN '-' WHEN 1 THEN 'X' WHEN 2 THEN 'R' WHEN 3 THEN 'InProc' ELSE '4' END || CASE WHEN e.event_id % 3 <> 0 THEN '(' || e.event_id || ')' ELSE '' END AS "Tran",
           CASE e.event_id % 5 WHEN 0 THEN 'Информация' WHEN 1 THEN 'Предупреждение' WHEN 2 THEN 'Ошибка' WHEN 3 THEN 'Примечание' ELSE 'Уровень 4' END AS "Severity",
           CASE WHEN user_id % 7 <> 0 THEN CAST(e.event_id AS VARCHAR) ELSE '' END AS "Session", CASE WHEN e.event_id % 5 <> 0 THEN date_trunc('second', ts) END AS "TransactionDate", CASE WHEN e.event_id % 3 <> 0 THEN e.event_id ELSE 0 END AS "TransactionNumber",
           'Server #9' AS "Server", CASE WHEN user_id % 2 = 1 THEN '1' ELSE '' END AS "MainPort", '2.0 КБ' AS "FileSizeFormatted"
    FROM events e LEFT JOIN customer c ON c.c_custkey = user_id LEFT JOIN nation n ON n.n_nationkey + 1 = user_id % 30 LEFT JOIN part p1 ON p1.p_partkey = user_id LEFT JOIN part p2 ON p2.p_partkey = user_id + 1""")
def lgd_decode(spark, sf_dir):
    rows = lgd.decode_journal(journal_rows(_t(spark, sf_dir, "events")), journal_codes(spark, sf_dir))
    return rows.select("base", "seq", "id", "DateTime", "User", "Application", "Event", "Metadata", "Tran", "Severity", "Session", "TransactionDate", "TransactionNumber", "Server", "MainPort", "FileSizeFormatted")


@register("SELECT event_id AS seq, user_id % 3 AS base, date_trunc('second', ts) AS \"DateTime\" FROM events ORDER BY event_id DESC, base LIMIT 200")
def lgd_newest(spark, sf_dir):
    rows = lgd.decode_newest(journal_rows(_t(spark, sf_dir, "events")), journal_codes(spark, sf_dir), 200)
    return rows.select("seq", F.substring("base", 5, 1).cast("long").alias("base"), "DateTime")


def _written_journals(rows: DataFrame, codes: DataFrame, folder: str) -> list[str]:
    """SQLite files of journal rows and their codes, a task for each file; their paths. Inserts replace, so a task may run again."""

    def run(batches):
        for batch in batches:
            named = "kind" in batch.schema.names
            for path in set(batch.column("path").to_pylist()):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                own = batch.filter(pc.equal(batch.column("path"), path)).to_pylist()
                with closing(sqlite3.connect(path, timeout=60)) as db, db:
                    if named:
                        for table, kind in sqlite_journal.CODE_TABLES.items():
                            db.execute(f"CREATE TABLE IF NOT EXISTS {table} (code INTEGER PRIMARY KEY, name TEXT, uuid TEXT)")
                            db.executemany(f"INSERT OR REPLACE INTO {table} VALUES (?, ?, ?)", [(r["code"], r["name"], r["uuid"]) for r in own if r["kind"] == kind])
                    else:
                        columns = list(sqlite_journal.ROW_COLUMNS)
                        db.execute("CREATE TABLE IF NOT EXISTS EventLog (rowID INTEGER PRIMARY KEY, " + ", ".join(f"{c} {'INTEGER' if sqlite_journal.ROW_COLUMNS[c] == 'long' else 'TEXT'}" for c in columns[1:]) + ")")
                        db.executemany(f"INSERT OR REPLACE INTO EventLog VALUES ({', '.join('?' * len(columns))})", [tuple(r[c] for c in columns) for r in own])
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    placed = F.regexp_replace("path", "^/logs", folder).alias("path")
    for table in (rows.select(placed, *sqlite_journal.ROW_COLUMNS), codes.select(placed, "kind", "code", "name", "uuid")):
        table.repartition("path").mapInArrow(run, "n long").agg(F.sum("n")).first()
    return [f"{folder}/Base{k}/1Cv8Log/1Cv8.lgd" for k in range(3)]


@register("""
    SELECT 'Base' || (user_id % 3) AS base, e.event_id AS seq, date_trunc('second', ts) AS "DateTime", coalesce(c.c_name, CASE WHEN user_id = 0 THEN '<Не указан>' ELSE 'User #' || (user_id + 1) END) AS "User",
           CASE e.event_id % 4 WHEN 0 THEN '' WHEN 1 THEN coalesce(p1.p_name, 'Meta #' || user_id) WHEN 2 THEN coalesce(p1.p_name, 'Meta #' || user_id) || ', ' || coalesce(p2.p_name, 'Meta #' || (user_id + 1)) ELSE 'word' END AS "Metadata"
    FROM events e LEFT JOIN customer c ON c.c_custkey = user_id LEFT JOIN part p1 ON p1.p_partkey = user_id LEFT JOIN part p2 ON p2.p_partkey = user_id + 1
    WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-05 06:00:00' AND date_trunc('second', ts) < TIMESTAMP '2024-01-09 00:00:00' AND e.event_id % 5 <> 2""")
def lgd_files_date_range(spark, sf_dir):
    """Journals of three infobases written as SQLite files; a range of dates and a severity are tested by SQLite."""
    folder = f"{shared_folder(spark).removeprefix('file://')}/lgd-{uuid.uuid4().hex}"
    paths = _written_journals(journal_rows(_t(spark, sf_dir, "events")), journal_codes(spark, sf_dir), folder)
    units = [lgd.date_units(datetime(2024, 1, 5, 6)), lgd.date_units(datetime(2024, 1, 9))]
    rows = sqlite_journal.read_journal(spark, paths).filter((F.col("date") >= units[0]) & (F.col("date") < units[1]) & (F.col("severity") != 2))
    return lgd.decode_journal(rows, sqlite_journal.read_journal(spark, paths, part="codes")).select("base", "seq", "DateTime", "User", "Metadata")


# --------------------------------------------------- event log: bases, layouts


@register("""
    SELECT 'b' || (event_id % 2) AS base, event_id // 2 AS seq, concat_ws(', ', CASE WHEN user_id <> 0 THEN coalesce(CASE WHEN event_id % 2 = 1 THEN '1:' ELSE '' END || p1.p_name, 'Meta #' || user_id) END,
           coalesce(CASE WHEN event_id % 2 = 1 THEN '1:' ELSE '' END || p2.p_name, 'Meta #' || (user_id + 1))) AS "Metadata"
    FROM events LEFT JOIN part p1 ON p1.p_partkey + 1 = user_id LEFT JOIN part p2 ON p2.p_partkey = user_id""")
def eventlog_metadata_of_bases(spark, sf_dir):
    """Lists of metadata in two infobases whose records have the same numbers, and whose codes have other names."""
    events, dims = _t(spark, sf_dir, "events"), _dims(spark, sf_dir)
    texts = eventlog_texts(events.withColumns({"__e": F.col("event_id"), "event_id": F.col("event_id") * 5}))
    texts = texts.select(F.concat(F.lit("b"), (F.col("seq") / 5 % 2).cast("long").cast("string")).alias("base"), F.expr("seq div 10").alias("seq"), "raw")
    both = dims.withColumn("base", F.lit("b0")).unionByName(dims.withColumns({"base": F.lit("b1"), "name": F.concat(F.lit("1:"), "name")}))
    return eventlog.decode_eventlog(texts, both, columns=["Metadata"]).select("base", "seq", "Metadata")


@register("""
    SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN concat_ws(', ', CASE WHEN user_id <> 0 THEN coalesce(n1.name, p1.p_name, 'Meta #' || user_id) END, coalesce(n2.name, p2.p_name, 'Meta #' || (user_id + 1)))
           WHEN event_id % 50 = 0 THEN '' ELSE coalesce(n3.name, p3.p_name, 'Meta #' || (event_id % 50)) END AS "Metadata"
    FROM events LEFT JOIN part p1 ON p1.p_partkey + 1 = user_id LEFT JOIN part p2 ON p2.p_partkey = user_id LEFT JOIN part p3 ON p3.p_partkey + 1 = event_id % 50
    LEFT JOIN (SELECT n_nationkey AS k, 'Inline ' || n_name AS name FROM nation) n1 ON n1.k + 1 = user_id LEFT JOIN (SELECT n_nationkey AS k, 'Inline ' || n_name AS name FROM nation) n2 ON n2.k = user_id
    LEFT JOIN (SELECT n_nationkey AS k, 'Inline ' || n_name AS name FROM nation) n3 ON n3.k + 1 = event_id % 50""")
def eventlog_inline_dictionary(spark, sf_dir):
    """Dictionary rows within a journal rename codes of the dictionary."""
    entry = F.concat(F.lit('{5,0,"Inline '), "n_name", F.lit('",'), (F.col("n_nationkey") + 1).cast("string"), F.lit("},"))
    inline = _t(spark, sf_dir, "nation").select(F.lit("").alias("base"), F.col("n_nationkey").cast("long").alias("seq"), entry.alias("raw"))
    records, entries = eventlog.inline_entries(eventlog_texts(_t(spark, sf_dir, "events")).unionByName(inline))
    dims = eventlog.with_inline(_dims(spark, sf_dir), entries.withColumnRenamed("seq", "at"))
    return eventlog.decode_eventlog(records, dims, columns=["Metadata"]).select("seq", "Metadata")


@register("""
    SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'acc' || user_id ELSE 'DOM\\u' || user_id END WHEN 1 THEN 'Фоновое задание' ELSE 'User #' || (user_id + 5000000) END AS "User",
           CASE event_id % 3 WHEN 0 THEN 'Сеанс. Аутентификация' WHEN 1 THEN 'Event #9' ELSE 'Event #8' END AS "Event",
           CASE event_id % 3 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'acc' || user_id ELSE 'DOM\\u' || user_id END WHEN 1 THEN '' ELSE CAST(user_id AS VARCHAR) END AS "Data",
           CASE event_id % 3 WHEN 0 THEN 'Пользователь ОС: DOM\\u' || user_id ELSE '' END AS "DataPresentation", CASE WHEN event_id % 3 = 2 THEN '' ELSE '77' END AS "Connection", CAST(event_id AS VARCHAR) AS "Session" FROM events""")
def eventlog_accounts_and_layouts(spark, sf_dir):
    """Authentication names its account, a background job its user; every third record has the old layout, without a connection."""
    e, u = F.col("event_id"), F.col("user_id")
    head = F.concat(F.lit("{"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(",N,{0,0},"))
    own = F.when(u % 2 == 0, F.concat(F.lit(',{2,{"S","acc'), u.cast("string"), F.lit('"}}'))).otherwise("")
    auth = F.concat(head, F.lit('0,0,1,77,1,I,"",0,{"P",{1,{"S","DOM\\u'), u.cast("string"), F.lit('"}}'), own, F.lit('},"",0,0,0,'), e.cast("string"), F.lit(",0}"))
    job = F.concat(head, F.lit('0,0,2,77,9,I,"",0,{"U"},"",0,0,0,'), e.cast("string"), F.lit(",0}"))
    old = F.concat(head, (u + 5_000_000).cast("string"), F.lit(',0,1,8,I,"",0,{"N",'), u.cast("string"), F.lit('},"",0,0,0,'), e.cast("string"), F.lit("}"))
    rows = _t(spark, sf_dir, "events").select(F.lit("").alias("base"), e.alias("seq"), F.when(e % 3 == 0, auth).when(e % 3 == 1, job).otherwise(old).alias("raw"))
    entries = spark.createDataFrame([(1, '{3,"1CV8C",1}'), (2, '{3,"BackgroundJob",2}'), (3, '{4,"_$Session$_.Authentication",1}')], "at long, raw string")
    columns = ["User", "Event", "Data", "DataPresentation", "Connection", "Session"]
    return eventlog.decode_eventlog(rows, eventlog.decode_dictionary(entries), columns=columns).select("seq", *columns)


# ------------------------------------------------------------ discovery


@register("""
    SELECT lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS guid, n_name || ' "x"' AS name
    FROM (SELECT *, md5(n_name) AS h FROM nation) WHERE n_name IN ('FRANCE', 'GERMANY', 'NATION_1', 'NATION_2') OR n_nationkey < 7""")
def infobases_registry(spark, sf_dir):
    """A cluster registry for each region, read back: guid and name, the first of a guid."""
    h = F.md5(F.col("n_name").cast("binary"))
    guid = F.upper(F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    entry = F.concat(F.lit("{"), guid, F.lit(',"'), "n_name", F.lit(' ""x"""'), F.lit(',"later",{0}}'))
    nations = _t(spark, sf_dir, "nation")
    texts = nations.groupBy("n_regionkey").agg(F.concat_ws(",\n", F.collect_list(entry)).alias("value"))
    wanted = nations.filter(F.col("n_name").isin("FRANCE", "GERMANY", "NATION_1", "NATION_2") | (F.col("n_nationkey") < 7)).select(F.concat("n_name", F.lit(' "x"')).alias("name"))
    return catalog.infobases(texts).join(wanted, "name", "left_semi").select("guid", "name")


@register("""
    SELECT '/r/s' || (c_custkey % 50) || '/base/1Cv8Log/' || c_custkey || '.lgp' AS path, CASE c_custkey % 50 % 5 WHEN 0 THEN '/r/s' || (c_custkey % 50) || '/base/1Cv8Log/1Cv8.lgf' WHEN 1 THEN '/r/s' || (c_custkey % 50) || '/base/1Cv8.lgf'
           WHEN 2 THEN '/r/s' || (c_custkey % 50) || '/base/1Cv8Log/old/1Cv8.lgf' WHEN 3 THEN '/r/s' || (c_custkey % 50) || '/1Cv8Log/1Cv8.lgf' ELSE '/r/1Cv8.lgf' END AS dictionary FROM customer""")
def dictionary_resolution(spark, sf_dir):
    k = F.col("c_custkey") % 50
    home = F.concat(F.lit("/r/s"), k.cast("string"))
    journals = _t(spark, sf_dir, "customer").select(F.concat(home, F.lit("/base/1Cv8Log")).alias("directory"), F.concat(home, F.lit("/base/1Cv8Log/"), F.col("c_custkey").cast("string"), F.lit(".lgp")).alias("path"))
    place = F.when(k % 5 == 0, "/base/1Cv8Log").when(k % 5 == 1, "/base").when(k % 5 == 2, "/base/1Cv8Log/old").when(k % 5 == 3, "/1Cv8Log")
    found = _t(spark, sf_dir, "customer").select(F.concat(home, place, F.lit("/1Cv8.lgf")).alias("path")).filter("path IS NOT NULL").distinct()
    dictionaries = found.unionByName(_t(spark, sf_dir, "region").select(F.lit("/r/1Cv8.lgf").alias("path")).distinct())
    return catalog.nearest_dictionary(journals, dictionaries).select("path", "dictionary")


@register("""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'rphost' WHEN 1 THEN 'rmngr' WHEN 2 THEN 'common' WHEN 3 THEN 'Desktop' WHEN 4 THEN 'my' ELSE '1cv8' END AS process,
           CASE event_id % 6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 4 THEN 'p_1' ELSE '' END AS pid,
           CASE event_id % 6 WHEN 3 THEN NULL WHEN 4 THEN date_trunc('day', ts) ELSE date_trunc('hour', ts) END AS hour FROM events""")
def process_and_hour_from_path(spark, sf_dir):
    e, u = F.col("event_id") % 6, F.col("user_id").cast("string")
    stamp, day = F.date_format("ts", "yyMMddHH"), F.date_format("ts", "yyMMdd")
    path = (
        F.when(e == 0, F.concat(F.lit("/l/rphost_"), u, F.lit("/"), stamp, F.lit(".log"))).when(e == 1, F.concat(F.lit("/l/x/RMNGR_"), u, F.lit("_"), stamp, F.lit(".log"))).when(e == 2, F.concat(F.lit("/l/COMMON/d/"), stamp, F.lit(".log")))
        .when(e == 3, F.lit("/l/Desktop/x.log")).when(e == 4, F.concat(F.lit("/l/my_p_1/"), day, F.lit("/x.log"))).otherwise(F.concat(F.lit("/a_b/l/1cv8."), stamp, F.lit(".log")))
    )
    rows = techlog.file_place(_t(spark, sf_dir, "events").select("event_id", path.alias("file")))
    return rows.select("event_id", "process", "pid", "hour")


@register("""
    WITH f AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'short' ELSE 'longer_name' END || o_orderkey AS stem FROM orders)
    SELECT '/l/' || stem || '.log' AS path FROM f WHERE length(stem) >= 8 AND (day >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 1 OR day IS NULL)""")
def recent_techlog_files(spark, sf_dir):
    """What a service reads without the archive: files of the last two days with names of eight characters or more."""
    k = F.col("o_orderkey")
    stem = F.concat(F.when(k % 3 == 0, "short").otherwise("longer_name"), k.cast("string"))
    orders = _t(spark, sf_dir, "orders")
    today = orders.agg(F.max(F.to_date("o_orderdate"))).first()[0]
    files = orders.select(F.concat(F.lit("/l/"), stem, F.lit(".log")).alias("path"), F.to_date("o_orderdate").alias("day"))
    return catalog.recent_files(catalog.find_techlog(files, service=True), today).select("path")


# ------------------------------------------------------------ dumps


@register(f"""
    SELECT CAST(event_id AS VARCHAR) AS session, date_trunc('millisecond', ts) AS "DateTime", {MICROS_SQL} AS "Duration", {NAME_SQL} AS "Event", 'Base' || (user_id % 7) AS base FROM events""")
def json_dump_roundtrip(spark, sf_dir):
    """Decoded records as dump lines, read back: dates with milliseconds, nulls, properties."""
    lines = delivery.json_rows(techlog_rows(spark, sf_dir)).select(F.col("body").alias("value"))
    return jsondump.parse_lines(lines, "techlog").select(F.col("SessionId").alias("session"), "DateTime", "Duration", "Event", F.element_at("Properties", "p_processName").alias("base"))


@register("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS \"Event\", props AS \"Comment\" FROM events")
def json_files_of_any_shape(spark, sf_dir):
    """Dump files in which records follow one another on a line, lie in arrays over many lines, or within objects: nothing is lost."""
    e = F.col("event_id")
    record = F.to_json(F.struct(e.cast("string").alias("id"), F.lit("2024-01-01 00:00:00").alias("DateFormatted"), F.col("event_type").alias("Event"), F.col("props").alias("Comment")))
    three = _t(spark, sf_dir, "events").groupBy(F.expr("event_id div 3").alias("g")).agg(F.sort_array(F.collect_list(record)).alias("r"))
    line, array = F.array_join("r", ""), F.concat(F.lit("[\n  "), F.array_join("r", ",\n  "), F.lit("\n],"))
    inside = F.concat(F.lit('{"took": 1, "hits": {"hits": [{"_source": '), F.array_join("r", '}, {"_source": '), F.lit("}]}}"))
    g = F.col("g")
    folder = f"{shared_folder(spark)}/dumps-{uuid.uuid4().hex}"
    three.select(F.when(g % 3 == 0, line).when(g % 3 == 1, array).otherwise(inside).alias("value")).write.text(folder)
    return jsondump.read_dump(spark, folder, "eventlog").select("id", "Event", "Comment")


@register("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS \"Event\" FROM events WHERE event_id % 4 <> 3")
def json_wrapped_records(spark, sf_dir):
    """Records inside arrays and wrapper objects, up to twelve deep; objects that lack a member are none."""
    e = F.col("event_id")
    record = F.to_json(F.struct(e.cast("string").alias("id"), F.when(e % 4 != 3, "2024-01-01 00:00:00").alias("DateFormatted"), F.col("event_type").alias("Event")))
    wrapped = F.when(e % 4 == 0, record).when(e % 4 == 1, F.concat(F.lit('{"meta": {"a": "}"}, "data": ['), record, F.lit("]}"))).otherwise(F.concat(F.lit('{"w":' * 12), record, F.lit("}" * 12)))
    texts = spread(_t(spark, sf_dir, "events")).select(F.explode(jsondump.records_of(wrapped, "eventlog")).alias("value"))
    return jsondump.parse_objects(texts, "eventlog").select("id", "Event")


@register(f"""
    SELECT event_id, {NAME_SQL} AS event, {MICROS_SQL} AS micros FROM events ORDER BY lower({NAME_SQL}), micros DESC, ts DESC, event_id LIMIT 150""")
def event_longest_preset(spark, sf_dir):
    rows = techlog_rows(spark, sf_dir).withColumn("event_id", F.col("SessionId").cast("long"))
    return query.top_rows(rows, "event-longest", 150, extra=["event_id"]).select("event_id", F.col("Event").alias("event"), F.col("Duration").alias("micros"))
