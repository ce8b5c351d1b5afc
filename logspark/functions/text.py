"""Text clean-up and display formats as Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FIELD = 65_536
BASE64_RUN, BASE64_HEAD = 200, 24


def unquote(c: Column) -> Column:
    """Strip one pair of double quotes and undo doubled ones; other texts stay."""
    quoted = c.rlike(r'(?s)^".*"$') & (F.length(c) >= 2)
    return F.when(quoted, F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)


def clean_quotes(c: Column) -> Column:
    """Strip one pair of matching single or double quotes."""
    return F.regexp_replace(c, r"""(?s)^(['"])(.*)\1$""", "$2")


def _cut(c: Column, most: int) -> Column:
    note = F.concat(c.substr(1, most), F.lit("... [TRUNCATED: "), F.length(c).cast("string"), F.lit(f" -> {most} chars]"))
    return F.when(F.length(c) > most, note).otherwise(c)


def sanitize_text(c: Column, most: int = MAX_FIELD) -> Column:
    """One line: BOM, NUL, CR and control characters go, LF becomes a space, TAB stays; longer than most is cut with a note. Null is ''."""
    flat = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), r"[\p{Cc}\x{FEFF}&&[^\t]]", "")
    return _cut(flat, most)


def sanitize_multiline(c: Column, most: int = MAX_FIELD) -> Column:
    """Lines stay: CR, BOM and control characters go, TAB becomes two spaces, ends are trimmed. Null is ''."""
    clean = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\t"), F.lit("  ")), r"[\p{Cc}\x{FEFF}&&[^\n]]", "")
    return _cut(F.regexp_replace(clean, r"^\s+|\s+$", ""), most)


def truncate_base64(c: Column, run: int = BASE64_RUN, head: int = BASE64_HEAD) -> Column:
    """Runs of at least `run` base64 characters keep their head and a note of their length."""
    pattern = f"[A-Za-z0-9+/=]{{{run},}}"
    between = F.split(c, pattern)
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)
    noted = F.transform(found, lambda x: F.concat(F.substring(x, 1, head), F.lit("... [Двоичные данные Base64: "), F.length(x).cast("string"), F.lit(" симв.]")))
    rest = F.zip_with(between, noted, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(c.rlike(pattern), F.array_join(rest, "")).otherwise(c)


def single_line(c: Column, most: int = 400) -> Column:
    """CR, LF and TAB runs become one space (none at the ends); longer than most is cut with an ellipsis."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\r\n\t]+|[\r\n\t]+$", ""), r"[\r\n\t]+", " ")
    return F.when(F.length(flat) > most, F.concat(flat.substr(1, most), F.lit("…"))).otherwise(flat)


def clean_presentation(c: Column) -> Column:
    """Parts between semicolons, trimmed, without empty ones and '<?>' marks."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^<\?>", "")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "; ")


def _fixed(c: Column, digits: int) -> Column:
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def format_micros(micros: Column) -> Column:
    """A duration in microseconds: μs, ms, s or minutes and seconds."""
    whole_minutes = F.floor(micros / 60_000_000)
    return (
        F.when(micros < 1_000, F.concat(micros.cast("string"), F.lit(" μs")))
        .when(micros < 1_000_000, F.concat(_fixed(micros / 1_000.0, 2), F.lit(" ms")))
        .when(micros < 60_000_000, F.concat(_fixed(micros / 1_000_000.0, 2), F.lit(" s")))
        .otherwise(F.concat(whole_minutes.cast("string"), F.lit("m "), _fixed((micros - whole_minutes * 60_000_000) / 1_000_000.0, 1), F.lit("s")))
    )


def format_millis(ms: Column) -> Column:
    """A transaction's duration in milliseconds; null is ''."""
    minutes, hours = F.floor(ms / 60_000), F.floor(ms / 3_600_000)
    shown = (
        F.when(ms < 1_000, F.concat(F.regexp_replace(_fixed(ms, 1), r"\.0$", ""), F.lit(" ms")))
        .when(ms < 60_000, F.concat(_fixed(ms / 1_000.0, 2), F.lit(" s")))
        .when(ms < 3_600_000, F.concat(minutes.cast("string"), F.lit("m "), _fixed((ms - minutes * 60_000) / 1_000.0, 1), F.lit("s")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), F.floor((ms - hours * 3_600_000) / 60_000).cast("string"), F.lit("m")))
    )
    return F.coalesce(shown, F.lit(""))


def format_size(size: Column, units: tuple[str, str, str, str] = ("B", "KB", "MB", "GB")) -> Column:
    """A file size; zero, negative and null are 0."""
    kb = 1024.0
    return (
        F.when(F.coalesce(size, F.lit(0)) <= 0, F.lit(f"0 {units[0]}"))
        .when(size < kb, F.concat(size.cast("string"), F.lit(f" {units[0]}")))
        .when(size < kb**2, F.concat(_fixed(size / kb, 1), F.lit(f" {units[1]}")))
        .when(size < kb**3, F.concat(_fixed(size / kb**2, 2), F.lit(f" {units[2]}")))
        .otherwise(F.concat(_fixed(size / kb**3, 2), F.lit(f" {units[3]}")))
    )


CYRILLIC_UNITS = ("Б", "КБ", "МБ", "ГБ")


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """A small fixed table: a CASE expression, or a map literal if it has many texts; other values give default (c itself if not given)."""
    other = c if default is None else default
    if len(table) > 6 and all(isinstance(x, str) for pair in table.items() for x in pair):
        return F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), c), other)
    out = None
    for key, value in table.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out.otherwise(other)
