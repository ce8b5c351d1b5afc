"""Event log records: tokens, code dictionaries, decoded columns, session users, noise filter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logspark.functions import scan
from logspark.functions.dates import hex_number, log_date, ticks_date
from logspark.functions.ids import record_id
from logspark.functions.plan import computed_once
from logspark.functions.text import clean_presentation, format_millis, format_size, lookup, sanitize_multiline, sanitize_text, truncate_base64, unquote
from logspark.schema import APP_TYPES, DICTIONARY_KINDS, EVENTLOG_SCHEMA, NO_NAME, SEVERITIES, SYSTEM_EVENTS, TRANSACTION_STATUS

#: Dictionaries with at most this many entries are broadcast.
BROADCAST_ENTRIES = 200_000
NO_REFERENCE = "(без объектной ссылки)"
BACKGROUND_USER = "Фоновое задание"


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize(raw: pd.Series) -> pd.Series:
    """The fields of one brace record, trimmed: commas inside quotes and nested braces do not split."""
    return raw.map(scan.fields, na_action="ignore")


def _entries(entries: DataFrame, base: Column | None) -> DataFrame:
    """base, at, kind, code, name, uuid of dictionary entries, as they stand."""
    rows = entries.select((F.lit("") if base is None else base).alias("base"), "at", "raw")
    rows = computed_once(rows, t=tokenize(F.col("raw"))).drop("raw")
    size = F.size("t")
    middle = F.transform(F.slice("t", 2, F.greatest(size - 2, F.lit(0))), lambda x: unquote(x))
    uuid = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|^[0-9a-fA-F]{32}$"
    named = F.filter(middle, lambda x: ~x.rlike(uuid) & ~x.rlike(r"^\d+$"))
    kind = lookup(F.element_at("t", 1), {str(k): v for k, v in DICTIONARY_KINDS.items()}, F.lit(None).cast("string"))
    name = F.when(kind.isin("port", "addport"), F.get(middle, F.lit(0))).otherwise(F.get(named, F.lit(0)))
    rows = rows.filter(size >= 3).select(
        "base", "at", kind.alias("kind"), F.regexp_replace(F.element_at("t", -1), r"[^\w-]", "").alias("code"), name.alias("name"),
        F.get(F.filter(middle, lambda x: x.rlike(uuid)), F.lit(0)).alias("uuid"),
    )
    return rows.filter("kind IS NOT NULL")


def decode_dictionary(entries: DataFrame, base: Column | None = None) -> DataFrame:
    """base, kind, code, name, uuid: one row per code.

    The code is an entry's last token, the name its first that is no uuid and no number. Later
    entries win, but an empty name never replaces one; user 1 without a name is NO_NAME. entries
    has raw and an order column `at`.
    """
    rows = _entries(entries, base)
    has = F.coalesce("name", F.lit("")) != ""
    grouped = rows.groupBy("base", "kind", "code").agg(F.max_by(F.when(has, F.col("name")), F.when(has, F.col("at"))).alias("name"), F.max_by("uuid", F.when(F.col("uuid").isNotNull(), F.col("at"))).alias("uuid"))
    unnamed = F.when((F.col("kind") == "user") & (F.col("code") == "1"), NO_NAME).otherwise("")
    return grouped.select("base", "kind", "code", F.coalesce("name", unnamed).alias("name"), F.coalesce("uuid", F.lit("")).alias("uuid"))


def inline_entries(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(journal records, dictionary entries met among them) of brace records with raw."""
    entry = F.col("raw").rlike(r"^\s*\{[1-8],")
    return records.filter(~entry), records.filter(entry)


def with_versions(dims: DataFrame, entries: DataFrame) -> DataFrame:
    """Versions of dictionary entries: dims (the dictionary at the journal's start: at is null) and, from their place `at` on, entries found in it (base, at, raw).

    at counts like the records' seq. A version without a name or uuid keeps the one before it. Codes are
    independent, so each is a small window of its own.
    """
    both = dims.select("base", F.lit(None).cast("long").alias("at"), "kind", "code", F.nullif("name", F.lit("")).alias("name"), F.nullif("uuid", F.lit("")).alias("uuid"))
    new = _entries(entries, F.col("base")).select("base", F.col("at").cast("long").alias("at"), "kind", "code", F.nullif("name", F.lit("")).alias("name"), F.nullif("uuid", F.lit("")).alias("uuid"))
    upto = Window.partitionBy("base", "kind", "code").orderBy(F.asc_nulls_first("at")).rowsBetween(Window.unboundedPreceding, 0)
    kept = lambda c: F.last(c, ignorenulls=True).over(upto)
    unnamed = F.when((F.col("kind") == "user") & (F.col("code") == "1"), NO_NAME).otherwise("")
    return both.unionByName(new).select("base", "at", "kind", "code", F.coalesce(kept("name"), unnamed).alias("name"), F.coalesce(kept("uuid"), F.lit("")).alias("uuid"))


def with_inline(dims: DataFrame, entries: DataFrame) -> DataFrame:
    """dims with the names of entries found in journals (base, at, raw): these are newer, and win where they have a name."""
    new = decode_dictionary(entries, F.col("base"))
    both = dims.withColumn("newer", F.lit(0)).unionByName(new.withColumn("newer", F.lit(1)))
    known = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col("newer"))).alias(c)
    return both.groupBy("base", "kind", "code").agg(known("name"), known("uuid")).select("base", "kind", "code", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("uuid", F.lit("")).alias("uuid"))


#: Parts into which the facts of a hot code are dealt where the dictionary is too large to be broadcast, and how many copies of its entries that may make.
SALTS, SALTED_ENTRIES = 16, 2_000_000
#: What the decoded columns take from dictionaries: slots of codes, and "list" for the metadata codes.
NEEDS = {
    "User": ("user", "app", "event"), "UserUuid": ("user",), "Computer": ("computer",), "Application": ("app",), "AppTypeName": ("app",), "Event": ("event",), "Server": ("server",), "MainPort": ("port",), "AddPort": ("addport",),
    "Metadata": ("list",), "MetadataUuid": ("list",), "Data": ("reference", "list", "event"), "DataPresentation": ("list", "event"),
}


def kind_sizes(dims: DataFrame, kinds: set[str]) -> tuple[dict[str, int], set[str]]:
    """(entries of each kind that has any, those that together can be broadcast): counted, as estimates from compressed files are far too low."""
    counts = {r["kind"]: r["n"] for r in dims.filter(F.col("kind").isin(*kinds)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    small, total = set(), 0
    for kind in sorted(counts, key=lambda k: (counts[k], k)):
        total += counts[kind]
        if total <= BROADCAST_ENTRIES:
            small.add(kind)
    return counts, small


def _versions(dims: DataFrame, kinds: set[str]) -> DataFrame:
    """base, code, kind, versions: what a code stands for, in order."""
    at = F.col("at").cast("long") if "at" in dims.columns else F.lit(None).cast("long")
    version = F.struct(F.coalesce(at, F.lit(-(1 << 63))).alias("at"), "name", "uuid")
    return dims.filter(F.col("kind").isin(*kinds)).groupBy("base", "code", "kind").agg(F.array_sort(F.collect_list(version)).alias("versions"))


def _resolve(rows: DataFrame, dims: DataFrame, codes: dict[str, tuple[str, str]], listed: str, wanted: set[str]) -> DataFrame:
    """rows with {slot}_found, the name and uuid of a slot's code, and items: those of the metadata codes in the column listed, in order.

    codes: the kind and the column of each slot. Only wanted slots (and, if wanted, the list) are looked up. rows have base, seq
    and id, by which they are told apart. A code's version is the last one at or before the record's seq. Kinds of few
    entries are broadcast, and a code of theirs is met in place. Lists and codes of large kinds are unpivoted
    and meet their entries in one join; one more shuffle brings them together again. The other columns travel with a
    record's first code alone, and those that nobody asks for not at all.
    """
    keys = ["base", "seq", "id"]
    kinds = {kind for slot, (kind, _) in codes.items() if slot in wanted} | ({"metadata"} if "list" in wanted else set())
    counts, small = kind_sizes(dims, kinds) if kinds else ({}, set())
    last = lambda versions: F.try_element_at(F.filter(versions, lambda x: x["at"] <= F.col("seq")), F.lit(-1))
    named = "struct<name:string,uuid:string>"
    nothing = F.lit(None).cast(named)

    table = _versions(dims, small).groupBy("base", "code").agg(F.map_from_entries(F.collect_list(F.struct("kind", "versions"))).alias("v")) if small else None
    far = []  # slots that are unpivoted
    for slot, (kind, column) in codes.items():
        if slot not in wanted or kind not in counts:
            rows = rows.withColumn(f"{slot}_found", nothing)
        elif kind in small:
            of_slot = table.select("base", F.col("code").alias("__code"), F.col("v").alias("__v"))
            rows = rows.withColumn("__code", F.nullif(column, F.lit(""))).join(F.broadcast(of_slot), ["base", "__code"], "left")
            version = last(F.try_element_at("__v", F.lit(kind)))
            rows = rows.withColumn(f"{slot}_found", F.when(version.isNotNull(), F.struct(version["name"].alias("name"), version["uuid"].alias("uuid")))).drop("__code", "__v")
        else:
            far.append(slot)
    has_list = "list" in wanted and "metadata" in counts
    if not far and not has_list:
        return rows.withColumn("items", F.transform(listed, lambda c, i: F.struct(i.alias("pos"), F.lit("").alias("slot"), c.alias("code"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("uuid"))))

    fact = lambda slot, kind, pos, code: F.struct(F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), pos.alias("pos"), code.alias("code"))
    each = F.array(*[fact(slot, codes[slot][0], F.lit(0), F.col(codes[slot][1])) for slot in far]) if far else None
    if has_list:
        items = F.transform(listed, lambda c, i: fact("", "metadata", i, c))
        each = items if each is None else F.concat(each, items)
    each = F.filter(each, lambda x: x["code"] != "")
    others = [c for c in rows.columns if c not in keys]
    facts = rows.select(*keys, *others, F.posexplode_outer(each).alias("__i", "__c"))
    facts = facts.select(*keys, *[F.when(F.coalesce("__i", F.lit(0)) == 0, F.col(c)).alias(c) for c in others], "__c.*")
    met = {codes[slot][0] for slot in far} | ({"metadata"} if has_list else set())
    table = _versions(dims, met)
    if met <= small:
        found = facts.join(F.broadcast(table), ["base", "code", "kind"], "left")
    else:
        # equal codes of many records are dealt over tasks as long as copies of the entries are few; beyond, Spark splits the partitions that they make large
        salts = max(1, min(SALTS, SALTED_ENTRIES // sum(counts[kind] for kind in met)))
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = facts.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int")).join(salted.hint("merge"), ["base", "code", "kind", "salt"], "left")
    version = last(F.col("versions"))
    item = F.when(F.col("slot").isNotNull(), F.struct("pos", "slot", "code", version["name"].alias("name"), version["uuid"].alias("uuid")))
    grouped = found.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in others], F.array_sort(F.collect_list(item)).alias("__found"))
    of = lambda slot: F.get(F.filter("__found", lambda x: x["slot"] == slot), F.lit(0))
    if not has_list:
        items = F.transform(listed, lambda c, i: F.struct(i.alias("pos"), F.lit("").alias("slot"), c.alias("code"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("uuid")))
    else:
        items = F.filter("__found", lambda x: x["slot"] == "")
    return computed_once(grouped, **{f"{slot}_found": F.struct(of(slot)["name"].alias("name"), of(slot)["uuid"].alias("uuid")) for slot in far}, items=items).drop("__found")


def names_of_list(rows: DataFrame, dims: DataFrame, key: str | list[str], codes: str, separator: str = ", ", skipped: tuple[str, ...] = ("", "0"), is_small: bool | None = None) -> DataFrame:
    """rows with names and name_uuid of a list of metadata codes: names in list order, skipped codes left out, the first uuid that is not empty.

    key (with base, if it is a column of rows) tells rows apart; they travel once, with their first code.
    Entries that are few (counted here, if is_small doesn't tell) are broadcast.
    """
    keys = list(dict.fromkeys([*([key] if isinstance(key, str) else key), "base"]))
    others = [c for c in rows.columns if c not in keys]
    listed = rows.select(*keys, *others, F.posexplode_outer(codes).alias("pos", "code"))
    listed = listed.select(*keys, "pos", "code", F.when(F.coalesce("pos", F.lit(0)) == 0, F.struct(*others)).alias("__row"))
    is_small = bool(kind_sizes(dims, {"metadata"})[1]) if is_small is None else is_small
    meta = dims.filter("kind = 'metadata'").select("base", "code", "name", "uuid")
    listed = listed.join(F.broadcast(meta) if is_small else meta.hint("merge"), ["base", "code"], "left")
    shown = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Meta #"), F.col("code")))
    item = F.when(~F.col("code").isin(*skipped), F.struct("pos", shown.alias("name"), F.coalesce("uuid", F.lit("")).alias("uuid")))
    grouped = listed.groupBy(*keys).agg(F.first("__row", ignorenulls=True).alias("__row"), F.array_sort(F.collect_list(item)).alias("items"))
    uuid = F.get(F.filter(F.transform("items", lambda x: x["uuid"]), lambda u: u != ""), F.lit(0))
    return grouped.select(
        *[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in rows.columns],
        F.array_join(F.transform("items", lambda x: x["name"]), separator).alias("names"), F.coalesce(uuid, F.lit("")).alias("name_uuid"),
    )


def decode_data(data: Column, reference_name: Column) -> Column:
    """A record's typed value: U undefined, R reference (as a uuid, after its type's name), S, B, N, D; others stay as they are."""
    kind = F.regexp_extract(data, r'^\{"([A-Z])"', 1)
    value = F.regexp_replace(data, r'(?s)^\{"[A-Z]"\s*,?\s*(.*)\}$', "$1")
    ref = F.lower(F.regexp_extract(value, r"([0-9a-fA-F]{32})", 1))
    guid = F.concat_ws("-", ref.substr(1, 8), ref.substr(9, 4), ref.substr(13, 4), ref.substr(17, 4), ref.substr(21, 12))
    day = F.date_format(log_date(value), "yyyy-MM-dd HH:mm:ss")
    return (
        F.when(kind == "U", NO_REFERENCE)
        .when((kind == "R") & (ref != ""), F.concat(F.lit("Ссылка: "), F.when(F.coalesce(reference_name, F.lit("")) != "", F.concat(reference_name, F.lit(" "))).otherwise(""), guid))
        .when(kind == "S", unquote(value))
        .when(kind == "B", F.when(value == "1", "Истина").otherwise("Ложь"))
        .when(kind == "N", value)
        .when(kind == "D", F.coalesce(day, value))
        .otherwise(unquote(data))
    )


def transaction(token: Column) -> tuple[Column, Column]:
    """(time, number) of a {hex time, hex number} token; nulls for {0,0}."""
    first, second = F.regexp_extract(token, r"^\{\s*([0-9a-fA-F]+)\s*,", 1), F.regexp_extract(token, r",\s*([0-9a-fA-F]+)\s*\}$", 1)
    none = (first == "0") & (second == "0")
    return F.when(~none, ticks_date(hex_number(first))), F.when(~none, hex_number(second))


def transaction_millis() -> Column:
    """DateTime less TransactionDate: null without a transaction or if more than a second negative, else not below 0."""
    ms = (F.unix_micros("DateTime") - F.unix_micros("TransactionDate")) / 1000.0
    known = F.col("TransactionDate").isNotNull() & (F.col("TransactionDate") != F.col("DateTime")) & (F.year("TransactionDate") >= 2000) & (ms >= -1000)
    return F.when(known, F.greatest(ms, F.lit(0.0)))


def transaction_display() -> Column:
    return format_millis(transaction_millis())


def event_alias(name: Column) -> Column:
    return lookup(F.lower(name), {k.lower(): v for k, v in SYSTEM_EVENTS.items()}, name)


def empty_transaction() -> Column:
    """Begin or commit of a transaction with no comment, data, presentation or metadata and no severity beyond information."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    edge = F.col("Event").isin(SYSTEM_EVENTS["_$Transaction$_.Begin"], SYSTEM_EVENTS["_$Transaction$_.Commit"], "_$Transaction$_.Begin", "_$Transaction$_.Commit")
    return edge & blank("Comment") & blank("Data") & blank("DataPresentation") & blank("Metadata") & F.coalesce("Severity", F.lit("")).isin("", SEVERITIES["I"], SEVERITIES["N"])


def decode_eventlog(records: DataFrame, dims: DataFrame, scope: Column | None = None, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """EVENTLOG_SCHEMA rows (and base, seq for enrichment) of records: raw, base, seq and optionally file, size, DateTime.

    Texts are '' where the record has none; an unreadable date is null. Records of fewer than nine
    fields or without a date are dropped. seq orders the records of a base and, with their texts, tells them
    apart. dims may hold versions (with_versions): a record is read by those at or before its seq. where is a condition on
    DateTime, tested on the header before a record is split into fields; if records have a column
    DateTime, as those of a growing log do, it reaches the source. With columns, only these (beside base
    and seq) are made, and only codes that they show are looked up.
    """
    wanted = {need for c in (columns or NEEDS) for need in NEEDS.get(c, ())}
    has = set(records.columns)
    if where is not None:
        records = records if "DateTime" in has else records.withColumn("DateTime", log_date(F.regexp_extract("raw", r"^\s*\{(\d{14}),", 1)))
        records = records.filter(where)
    rows = records.filter(F.col("raw").rlike(r"^\s*\{\d{14},")).select(
        "base", "seq", (F.col("file") if "file" in has else F.lit("")).alias("file"), (F.col("size") if "size" in has else F.lit(0)).cast("long").alias("size"),
        record_id(F.col("raw"), F.col("base") if scope is None else scope).alias("id"), "raw",
    )
    rows = computed_once(rows, t=tokenize(F.col("raw"))).drop("raw").filter(F.size("t") >= 9)
    t = lambda i: F.coalesce(F.get("t", i if isinstance(i, Column) else F.lit(i)), F.lit(""))
    letter = r"^[IEWN]$"
    # 8.3 has a connection before the event, 8.1 has not: the one-letter importance tells
    shift = F.when(t(8).rlike(letter), 0).when(t(7).rlike(letter), -1).otherwise(0)
    rows = computed_once(rows, shift=shift)
    at = lambda i: t(F.lit(i) + F.col("shift"))
    when, number = transaction(t(2))
    session = F.coalesce(*[F.nullif(F.regexp_replace(t(i), r"[{}]", ""), F.lit("")) for i in (16, 15, 14)], F.lit(""))
    code = lambda c: F.regexp_replace(c, r"[{}\s]", "")
    fields = [
        log_date(t(0)).alias("DateTime"), F.upper(t(1)).alias("status"), t(2).alias("tran"), when.alias("TransactionDate"),
        number.alias("TransactionNumber"), code(t(3)).alias("user_code"), code(t(4)).alias("computer_code"), code(t(5)).alias("app_code"),
        F.when(F.col("shift") == 0, unquote(t(6))).otherwise("").alias("Connection"), code(at(7)).alias("event_code"), at(8).alias("importance"), unquote(at(9)).alias("comment"),
        F.split(code(at(10)), ",").alias("meta_codes"), at(11).alias("data"), unquote(at(12)).alias("presentation"), code(at(13)).alias("server_code"), code(at(14)).alias("port_code"),
        code(at(15)).alias("addport_code"), session.alias("Session"), F.regexp_extract(at(11), r'^\{"R"\s*,\s*(\d+):', 1).alias("reference_code"),
    ]
    made = rows.select("base", "seq", "file", "size", "id", F.explode(F.array(F.struct(*fields))).alias("r"))  # once a row
    rows = made.select("base", "seq", "file", "size", "id", "r.*")
    rows = rows.withColumn("meta_codes", F.filter("meta_codes", lambda c: ~c.isin("", "0")))
    codes = {kind: (kind, f"{kind}_code") for kind in ("user", "computer", "app", "event", "server", "port", "addport")} | {"reference": ("metadata", "reference_code")}
    rows = _resolve(rows, dims, codes, "meta_codes", wanted)
    rows = rows.withColumns({f"{slot}_name": F.col(f"{slot}_found.name") for slot in codes} | {"user_uuid": F.col("user_found.uuid")})
    shown = F.transform("items", lambda x: F.coalesce(F.nullif(x["name"], F.lit("")), F.concat(F.lit("Meta #"), x["code"])))
    uuids = F.filter(F.transform("items", lambda x: F.coalesce(x["uuid"], F.lit(""))), lambda u: u != "")
    rows = rows.withColumns({"names": F.array_join(shown, ", "), "name_uuid": F.coalesce(F.get(uuids, F.lit(0)), F.lit(""))})

    named = lambda kind, label: F.when(F.col(f"{kind}_code").isin("", "0"), "").otherwise(F.coalesce(F.nullif(f"{kind}_name", F.lit("")), F.concat(F.lit(label), F.col(f"{kind}_code"))))
    user = F.when((F.col("user_code") == "1") & (F.coalesce("user_name", F.lit("")) == "") & F.col("user_name").isNotNull(), NO_NAME).otherwise(named("user", "User #"))
    rows = computed_once(
        rows, Event=event_alias(named("event", "Event #")), App=named("app", "App #"), User=user, UserUuid=F.coalesce("user_uuid", F.lit("")),
        decoded=decode_data(F.col("data"), F.col("reference_name")), shown=clean_presentation(F.col("presentation")),
    )
    no_ref = F.col("decoded") == NO_REFERENCE
    rows = rows.withColumns(
        {
            "shown": F.when(no_ref & (F.col("names") != "") & (F.col("shown") == ""), F.concat(F.lit("Запись регистра: "), F.col("names"))).otherwise(F.col("shown")),
            "decoded": F.when(no_ref & (F.col("names") == ""), "").otherwise(F.col("decoded")),
        }
    )
    rows = _authentication(rows)
    status = F.coalesce(F.nullif(F.regexp_replace("status", "^N$", "-"), F.lit("")), F.lit("-"))
    inner = F.regexp_replace("tran", r"[{}\s]", "")
    unnamed_user = F.col("User").isin("", "1") | F.col("User").startswith("User #")
    text = lambda c: truncate_base64(sanitize_text(F.col(c)))
    out = {
        "DateFormatted": F.coalesce(F.date_format("DateTime", "yyyy-MM-dd HH:mm:ss"), F.lit("")),
        "User": F.when((F.col("App") == "BackgroundJob") & unnamed_user, BACKGROUND_USER).otherwise(sanitize_text(F.col("User"))),
        "Metadata": sanitize_text(F.col("names")), "MetadataUuid": F.col("name_uuid"), "Tran": F.concat(status, F.when(inner == "0,0", "").otherwise(F.concat(F.lit("("), inner, F.lit(")")))),
        "Application": F.col("App"), "Comment": truncate_base64(sanitize_multiline(F.col("comment"))), "Severity": lookup(F.col("importance"), SEVERITIES), "Data": text("decoded"), "DataPresentation": text("shown"),
        "Computer": F.coalesce(F.nullif("computer_name", F.lit("")), "computer_code"), "Server": F.coalesce(F.nullif("server_name", F.lit("")), "server_code"),
        "MainPort": F.coalesce(F.nullif("port_name", F.lit("")), "port_code"), "AddPort": F.coalesce(F.nullif("addport_name", F.lit("")), "addport_code"),
        "TransactionStatus": lookup(F.col("status"), TRANSACTION_STATUS), "AppTypeName": lookup(F.col("App"), APP_TYPES), "FileName": F.regexp_extract("file", r"([^/]*)$", 1),
        "FileSize": F.col("size"), "FileSizeFormatted": format_size(F.col("size")), "RepeatCount": F.lit(1),
    }
    return rows.select("base", "seq", *[out.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in EVENTLOG_SCHEMA if columns is None or f.name in columns])


def _authentication(rows: DataFrame) -> DataFrame:
    """Events about authentication name their account in the data: slot 2 (the platform's user) before slot 1 (the system's)."""
    auth = F.col("Event").contains("Аутентификац") | F.lower("Event").contains("аутентификац")
    account = lambda slot: unquote(F.regexp_extract("data", rf'\{{\s*{slot}\s*,\s*\{{"S"\s*,\s*("(?:[^"]++|"")*+")', 1))
    system, own = account(1), account(2)
    any_text = unquote(F.regexp_extract("data", r'\{"S"\s*,\s*("(?:[^"]++|"")*+")', 1))
    rows = computed_once(rows, os=F.when(auth, system).otherwise(""), acc=F.when(auth, F.coalesce(F.nullif(own, F.lit("")), F.nullif(system, F.lit("")), any_text)).otherwise(""))
    unknown = F.col("User").isin("", NO_NAME, "1") | F.col("User").startswith("User #")
    return rows.withColumns(
        {
            "User": F.when((F.col("acc") != "") & unknown, F.col("acc")).otherwise(F.col("User")),
            "decoded": F.when(F.col("acc") != "", F.col("acc")).otherwise(F.col("decoded")),
            "shown": F.when(F.col("acc") == "", F.col("shown")).when(F.col("os") != "", F.concat(F.lit("Пользователь ОС: "), F.col("os"))).otherwise(F.concat(F.lit("Пользователь: "), F.col("acc"))),
        }
    ).drop("os", "acc")


def unknown_user(user: Column) -> Column:
    return F.coalesce(user, F.lit("")).isin("", NO_NAME, "1") | user.startswith("User #")


def carry_session_user(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Rows without a user take the latest earlier user of their base and session; an event that ends the session forgets it.

    rows has base, Session, Event, User, UserUuid. Rows without a session are left alone. A session
    is one window; it is short-lived, so it fits a task.
    """
    ends = F.lower("Event").contains("завершение")
    inside = (F.coalesce("Session", F.lit("")) != "") & (F.col("Session") != "0")
    before = Window.partitionBy("base", "Session").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    epoch = F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0))
    sessions = rows.filter(inside).withColumn("__epoch", epoch)
    upto = Window.partitionBy("base", "Session", "__epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(~unknown_user(F.col("User")), F.struct("User", "UserUuid"))
    carried = F.last(known, ignorenulls=True).over(upto)
    sessions = sessions.withColumn("__seen", carried).withColumns(
        {"User": F.coalesce(F.col("__seen.User"), "User"), "UserUuid": F.coalesce(F.col("__seen.UserUuid"), "UserUuid")}
    )
    return sessions.drop("__epoch", "__seen").unionByName(rows.filter(~F.coalesce(inside, F.lit(False))))
