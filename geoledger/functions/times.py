"""Instants and intervals. Times are UTC and stored as TIMESTAMP_NTZ, so no session zone can shift them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of a nanosecond clock (the end cut to microseconds) and of the calendar.
NANOS_MIN = datetime(1970, 1, 1)
NANOS_MAX = datetime(2262, 4, 11, 23, 47, 16, 854775)
CALENDAR_MIN = datetime(1, 1, 1)
CALENDAR_MAX = datetime(9999, 12, 31, 23, 59, 59, 999999)
EPOCH = datetime(1970, 1, 1)

_INSTANT = re.compile(
    r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)?"
)


def parse_instant(text: str) -> datetime:
    """RFC 3339 text to a naive UTC datetime, microsecond precision. No offset means UTC."""
    match = _INSTANT.fullmatch(text.strip())
    if not match:
        raise ValueError(f"not an RFC 3339 instant: {text!r}")
    day, clock, fraction, offset = match.groups()
    micros = ((fraction or ".")[1:] + "000000")[:6]
    value = datetime.strptime(f"{day} {clock}.{micros}", "%Y-%m-%d %H:%M:%S.%f")
    if offset and offset not in "Zz":
        sign = 1 if offset[0] == "+" else -1
        hours, minutes = offset[1:].split(":")
        value -= sign * timedelta(hours=int(hours), minutes=int(minutes))
    return value


def to_utc(value: str | datetime) -> datetime:
    """Text, aware or naive datetime to a naive UTC datetime."""
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    if re.fullmatch(r"\d{4}-\d\d-\d\d", value.strip()):
        return datetime.fromisoformat(value.strip())
    return parse_instant(value)


def parse_interval(text: str | None, nanos: bool = True) -> tuple[datetime, datetime]:
    """`a/b`, `../b`, `a/..`, an instant, or nothing to closed UTC bounds.

    Open ends become the bounds of the clock in use. On the nanosecond clock values outside it are moved to
    its bounds; otherwise values keep milliseconds.
    """
    low, high = (NANOS_MIN, NANOS_MAX) if nanos else (CALENDAR_MIN, CALENDAR_MAX)

    def bound(part: str, default: datetime) -> datetime:
        if part.strip() in ("", ".."):
            return default
        value = parse_instant(part)
        if nanos:
            return min(max(value, low), high)
        return value.replace(microsecond=value.microsecond // 1000 * 1000)

    if not isinstance(text, str):
        return low, high
    start, slash, end = text.partition("/")
    return bound(start, low), bound(end if slash else start, high)


def ts_lit(value: str | datetime) -> Column:
    """A UTC timestamp literal that folds to a constant, so comparisons reach the Parquet scan."""
    stamp = to_utc(value)
    # strftime does not pad years below 1000
    return F.lit(f"{stamp.year:04d}-" + stamp.strftime("%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def parse_utc(text: Column) -> Column:
    """RFC 3339 text column to UTC TIMESTAMP_NTZ; null where it does not parse."""
    zoned = text.endswith("Z") | text.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$")
    instant = F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))
    # unix_micros counts from the epoch in UTC whatever the session zone is
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def extract_date(text: Column) -> Column:
    """Calendar day written in an ISO text (its own offset, not converted)."""
    return F.to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def rfc3339(ts: Column) -> Column:
    """UTC timestamp to text ending in Z; a fraction of six digits appears only when it is not zero."""
    # the cast to text ignores the session zone, which formatting functions do not
    text = F.translate(ts.cast("timestamp_ntz").cast("string"), " ", "T")
    seconds, fraction = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    return F.when(F.contains(text, F.lit(".")), F.concat(
        seconds, F.lit("."), F.rpad(fraction, 6, "0"), F.lit("Z"))).otherwise(F.concat(text, F.lit("Z")))


def queue_score(text: Column) -> Column:
    """Primary datetime text to epoch seconds; 0 when absent or unreadable."""
    stamp = parse_utc(text)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), stamp)
    return F.coalesce(micros / F.lit(1_000_000.0), F.lit(0.0))


def trunc_utc(interval: str, ts: Column) -> Column:
    """Start of the calendar step a UTC timestamp lies in; weeks start on Monday. Independent of the session zone."""
    day = ts.cast("date")
    if interval in ("year", "quarter", "month", "week"):
        return F.trunc(day, interval).cast("timestamp_ntz")
    seconds = {
        "day": F.lit(0),
        "hour": F.hour(ts) * 3600,
        "minute": F.hour(ts) * 3600 + F.minute(ts) * 60,
        "second": F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts),
    }[interval]
    return F.timestamp_add("SECOND", seconds, day.cast("timestamp_ntz"))
