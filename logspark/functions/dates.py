"""Dates of the log formats as Columns, and the query box's date and time inputs as literals."""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 0001-01-01 to 1970-01-01.
EPOCH_MICROS = 62_135_596_800_000_000


def log_date(digits: Column) -> Column:
    """14 digits as a UTC timestamp; null if they are none."""
    return F.when(digits.rlike(r"^\d{14}$"), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))


def ticks_date(hundred_micros: Column) -> Column:
    """Units of 100 microseconds since 0001-01-01 as a timestamp; null or 0 is null."""
    return F.when(hundred_micros > 0, F.timestamp_micros(hundred_micros * 100 - EPOCH_MICROS))


def hex_number(digits: Column) -> Column:
    return F.when(digits.rlike("^[0-9a-fA-F]{1,15}$"), F.conv(digits, 16, 10).cast("long"))


def json_date(text: Column) -> Column:
    """The JSON form of a date (milliseconds, no zone) or any ISO one, read as UTC; '' and others are null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS")), text.try_cast("timestamp"))


def json_date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")


def micros_of_day(c: Column) -> Column:
    return F.unix_micros(c) - F.unix_micros(F.date_trunc("DAY", c))


# ------------------------------------------------------------- query inputs


def parse_time(text: str) -> time | datetime | None:
    """'16:13', '16.13', '1613', '4', '161350', '16:', fractions up to 7 digits: a time of day; else a full date and time; else None."""
    text = text.strip()
    if not text:
        return None
    fraction = 0
    if m := re.fullmatch(r"(\d{1,2}[:.]\d{1,2}[:.]\d{1,2})\.(\d{1,7})", text):
        text, fraction = m[1], int(m[2].ljust(7, "0")[:6])
    parts = None
    if re.fullmatch(r"\d{1,6}", text):
        if len(text) <= 2:
            parts = [text]
        else:
            padded = text if len(text) % 2 == 0 else "0" + text
            parts = [padded[i : i + 2] for i in range(0, len(padded), 2)]
    elif re.fullmatch(r"\d{1,2}([:.]\d{0,2}){1,2}", text):
        parts = [p or "0" for p in re.split("[:.]", text)]
    if parts and len(parts) <= 3:
        h, m, s = (int(p) for p in [*parts, "0", "0"][:3])
        return time(h, m, s, fraction) if h < 24 and m < 60 and s < 60 else None
    for pattern in ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%Y-%m-%dT%H:%M:%S"):
        try:
            return datetime.strptime(text, pattern)
        except ValueError:
            continue
    return None


def parse_date(text: str) -> date | None:
    for pattern in ("%d.%m.%Y", "%Y-%m-%d", "%d/%m/%Y"):
        try:
            return datetime.strptime(text.strip(), pattern).date()
        except ValueError:
            continue
    return None


def date_range(start: date | None, end: date | None) -> tuple[date | None, date | None]:
    """Swapped if reversed; one bound alone means that day."""
    start, end = (d.date() if isinstance(d, datetime) else d for d in (start, end))
    if start and end:
        return min(start, end), max(start, end)
    return (start or end), (end or start)


def preset(name: str, today: date) -> tuple[date, date] | None:
    """today, yesterday, 3, 7 or 30 days (today included), this month; 'all' gives None."""
    days = {"today": (0, 0), "yesterday": (1, 1), "3days": (2, 0), "7days": (6, 0), "30days": (29, 0)}
    if name in days:
        a, b = days[name]
        return today - timedelta(days=a), today - timedelta(days=b)
    if name == "month":
        return today.replace(day=1), today
    return None


def range_notice(first: datetime | None, last: datetime | None, start: date | None, end: date | None) -> tuple[str, bool]:
    """(text about the loaded range, whether the wanted days leave it)."""
    if first is None or last is None:
        return "", False
    outside = bool(start and start < first.date()) or bool(end and end > last.date())
    return f"{first:%d.%m.%Y %H:%M} - {last:%d.%m.%Y %H:%M}", outside
