"""Rows of SQLite event journals, decoded by their seven code tables."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.dates import ticks_date
from logspark.functions.ids import record_id
from logspark.functions.text import CYRILLIC_UNITS, format_size, lookup, sanitize_text
from logspark.operators.eventlog import empty_transaction, event_alias, kind_sizes, names_of_list
from logspark.schema import APP_TYPES, EVENTLOG_SCHEMA, LGD_SEVERITIES, NO_NAME

#: Transaction states as marks and as texts.
TRANSACTION_MARKS = {0: "-", 1: "X", 2: "R", 3: "InProc"}
TRANSACTION_TEXTS = {0: "Вне транзакции", 1: "Отменена", 2: "Зафиксирована", 3: "В процессе"}
#: Code columns of a row, the kind of their table, and what stands before a code without a name.
CODES = {"userCode": ("user", "User #"), "appCode": ("app", "App #"), "eventCode": ("event", "Event #"), "computerCode": ("computer", "Comp #"), "workServerCode": ("server", "Server #"), "primaryPortCode": ("port", "")}


def date_units(when: datetime) -> int:
    """A date as journals hold it: units of 100 microseconds since 0001-01-01 (UTC)."""
    return ((when.replace(tzinfo=when.tzinfo or UTC) - datetime(1, 1, 1, tzinfo=UTC)) // timedelta(microseconds=100))


def base_of(path: Column) -> Column:
    """The infobase's folder: the one that holds 1Cv8Log, or that of the file."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder.rlike(r"(?i)(^|/)1Cv8Log$"), F.regexp_extract(folder, r"([^/]+)/[^/]+$", 1)).otherwise(F.regexp_extract(folder, r"([^/]+)$", 1))


def _met(rows: DataFrame, dims: DataFrame, kind: str, column: str, made: dict[str, str], is_small: bool) -> DataFrame:
    """rows with what the entries of a kind have for the codes in a column. Few entries are broadcast; others are met by sorting, and rows without a code are dealt over all tasks."""
    entries = dims.filter(F.col("kind") == kind).select("path", F.col("code").cast("string").alias("__key"), *[F.col(c).alias(n) for c, n in made.items()])
    key = F.col(column).cast("string")
    if not is_small:
        key = F.coalesce(key, F.concat(F.lit("none "), F.pmod(F.xxhash64("rowID"), F.lit(4096)).cast("string")))
    return rows.withColumn("__key", key).join(F.broadcast(entries) if is_small else entries.hint("merge"), ["path", "__key"], "left").drop("__key")


def metadata_names(rows: DataFrame, dims: DataFrame, is_small: bool) -> DataFrame:
    """rows with Metadata: the name of a code, or the names of a list of codes ('[1, 2]'); one code that is no number stands for itself."""
    codes = F.filter(F.split(F.coalesce("metadataCodes", F.lit("")), r"[ ,\[\]]+"), lambda x: x != "")
    number = F.trim(F.coalesce("metadataCodes", F.lit(""))).rlike(r"^[+-]?\d+$")
    rows = rows.withColumns({"__codes": codes, "__one": F.when(number, F.trim("metadataCodes").try_cast("long").cast("string"))})
    meta = dims.filter("kind = 'metadata'").select(F.col("path").alias("base"), "kind", F.col("code").cast("string").alias("code"), "name", "uuid")
    several = (F.size("__codes") > 1) & ~number
    single = _met(rows.filter(~several), dims, "metadata", "__one", {"name": "__name"}, is_small)
    shown = F.when(F.col("__one").isNotNull(), F.coalesce("__name", F.concat(F.lit("Meta #"), F.col("__one")))).otherwise(F.coalesce("metadataCodes", F.lit("")))
    single = single.withColumn("Metadata", shown).select(*rows.columns, "Metadata")
    many = names_of_list(rows.filter(several).withColumn("base", F.col("path")), meta, "rowID", "__codes", skipped=("",), is_small=is_small).withColumnRenamed("names", "Metadata")
    return single.unionByName(many.select(*single.columns)).drop("__codes", "__one")


def decode_journal(rows: DataFrame, dims: DataFrame, empty: bool = True) -> DataFrame:
    """EVENTLOG_SCHEMA rows (and base, seq, the rowid) of journal rows; dims has path, kind, code, name and uuid.

    Codes without a name show their number; user 1 without one is NO_NAME. A date of 0 or null is
    null. With empty false, begins and commits of transactions that say nothing are left out.
    """
    counts, small = kind_sizes(dims, {"metadata", *(kind for kind, _ in CODES.values())})
    rows = metadata_names(rows, dims, "metadata" in small or "metadata" not in counts)
    for column, (kind, _) in CODES.items():
        made = {"name": f"{kind}_name"} | ({"uuid": "user_uuid"} if kind == "user" else {})
        if kind in counts:
            rows = _met(rows, dims, kind, column, made, kind in small)
        else:
            rows = rows.withColumns({n: F.lit(None).cast("string") for n in made.values()})
    code = lambda c: F.coalesce(F.col(c), F.lit(0))
    other = lambda c, mark: F.when(code(c) > 0, F.concat(F.lit(mark), F.col(c).cast("string"))).otherwise("")
    named = {kind: F.coalesce(f"{kind}_name", other(column, mark)) for column, (kind, mark) in CODES.items()}
    user = F.coalesce(F.nullif("user_name", F.lit("")), F.when(code("userCode") == 1, NO_NAME).otherwise(other("userCode", "User #")))
    state = F.coalesce("transactionStatus", F.lit(0))
    mark, number = lookup(state, TRANSACTION_MARKS, state.cast("string")), F.col("transactionID").cast("string")
    size = F.coalesce("size", F.lit(0)).cast("long")
    when = ticks_date(F.col("date"))
    severity = F.coalesce("severity", F.lit(0))
    tag = F.substring(record_id(F.lit("lgd"), base_of(F.col("path"))), 1, 8)
    out = {
        "id": F.concat_ws("_", F.lit("lgd"), F.col("rowID").cast("string"), F.coalesce("date", F.lit(0)).cast("string"), tag), "DateTime": when, "DateFormatted": F.coalesce(F.date_format(when, "yyyy-MM-dd HH:mm:ss"), F.lit("")),
        "Event": sanitize_text(event_alias(named["event"])), "User": sanitize_text(user), "UserUuid": F.coalesce("user_uuid", F.lit("")), "Metadata": F.col("Metadata"), "MetadataUuid": F.lit(""),
        "Tran": F.concat(mark, F.coalesce(F.concat(F.lit("("), number, F.lit(")")), F.lit(""))), "TransactionDate": F.when(state != 0, when), "TransactionNumber": F.coalesce("transactionID", F.lit(0)),
        "Application": named["app"], "Comment": sanitize_text(F.col("comment")), "Severity": lookup(severity, LGD_SEVERITIES, F.concat(F.lit("Уровень "), severity.cast("string"))),
        "Data": sanitize_text(F.col("dataPresentation")), "DataPresentation": sanitize_text(F.col("dataPresentation")), "Computer": sanitize_text(named["computer"]), "Server": sanitize_text(named["server"]),
        "Connection": F.coalesce(F.col("connectID").cast("string"), F.lit("")), "MainPort": named["port"], "AddPort": F.lit(""), "Session": F.coalesce(F.col("session").cast("string"), F.lit("")),
        "TransactionStatus": lookup(state, TRANSACTION_TEXTS, mark), "AppTypeName": lookup(named["app"], APP_TYPES), "FileName": F.regexp_extract("path", r"([^/]*)$", 1), "FileSize": size,
        "FileSizeFormatted": format_size(size, CYRILLIC_UNITS), "RepeatCount": F.lit(1),
    }
    made = rows.select(base_of(F.col("path")).alias("base"), F.col("rowID").alias("seq"), *[out[f.name].cast(f.dataType).alias(f.name) for f in EVENTLOG_SCHEMA])
    return made if empty else made.filter(~empty_transaction())


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The n latest rows of decoded journals, newest first."""
    return rows.orderBy(F.desc("seq"), "base").limit(n)


def decode_newest(rows: DataFrame, dims: DataFrame, n: int) -> DataFrame:
    """The n latest rows of journals, decoded, newest first: they are chosen before anything is looked up, and only entries that they name are kept."""
    top = rows.orderBy(F.desc("rowID"), base_of(F.col("path"))).limit(n)
    lists = F.split(F.coalesce("metadataCodes", F.lit("")), r"[ ,\[\]]+")
    codes = [F.struct(F.lit(kind).alias("kind"), F.col(column).cast("long").alias("code")) for column, (kind, _) in CODES.items()]
    named = F.concat(F.array(*codes), F.transform(lists, lambda x: F.struct(F.lit("metadata").alias("kind"), x.try_cast("long").alias("code"))))
    needed = top.select("path", F.explode(named).alias("c")).select("path", "c.*").distinct()  # bounded by the rows
    return newest(decode_journal(top, dims.join(F.broadcast(needed), ["path", "kind", "code"], "left_semi")), n)
