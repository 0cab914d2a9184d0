"""Time columns, computed from epoch milliseconds so that no session time zone enters."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

HOUR_MS = 3_600_000
DAY_MS = 86_400_000

# Fixed labels, Sunday first.
WEEKDAY_LABELS = ("日", "月", "火", "水", "木", "金", "土")


def to_ms(moment: datetime) -> int:
    """Epoch milliseconds, floored; a time without zone counts as UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400_000_000 + delta.seconds * 1_000_000 + delta.microseconds) // 1000


def at_ms(ms: int) -> Column:
    """A timestamp literal, which the scan can use for pruning."""
    return F.timestamp_millis(F.lit(ms))


def int_div(value: Column, by: int | Column) -> Column:
    """Whole-number division of non-negative numbers."""
    return F.call_function("div", value, F.lit(by) if isinstance(by, int) else by)


def ts_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def epoch_hour(ts: Column) -> Column:
    return int_div(F.unix_millis(ts), HOUR_MS)


def weekday(ts: Column) -> Column:
    """UTC weekday, 0 = Sunday."""
    return weekday_of_hour(epoch_hour(ts))


def weekday_of_hour(hour: Column) -> Column:
    # 1970-01-01 was a Thursday.
    return F.pmod(int_div(hour, 24) + 4, F.lit(7)).cast("int")


def weekday_label(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(label) for label in WEEKDAY_LABELS]), day.cast("int") + 1)


def utc_date(ts: Column) -> Column:
    return F.date_from_unix_date(int_div(F.unix_millis(ts), DAY_MS).cast("int"))


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def clock(ts: Column) -> Column:
    """``HH:mm:ss`` in UTC."""
    second = F.pmod(int_div(F.unix_millis(ts), 1000), F.lit(86_400))
    return F.concat_ws(
        ":",
        _two(int_div(second, 3600)),
        _two(int_div(F.pmod(second, F.lit(3600)), 60)),
        _two(F.pmod(second, F.lit(60))),
    )


def rfc3339(ts: Column) -> Column:
    """UTC RFC 3339 at millisecond resolution, trailing zeros of the fraction cut."""
    ms = F.pmod(F.unix_millis(ts), F.lit(1000))
    fraction = F.rtrim(F.lpad(ms.cast("string"), 3, "0"), F.lit("0"))
    return F.concat(
        utc_date(ts).cast("string"),
        F.lit("T"),
        clock(ts),
        F.when(ms > 0, F.concat(F.lit("."), fraction)).otherwise(F.lit("")),
        F.lit("Z"),
    )


def hour_label(hour: Column, zone: str = "UTC") -> Column:
    """``HH:00`` of an epoch hour, shown in a time zone."""
    if zone == "UTC":
        return F.concat(_two(F.pmod(hour, F.lit(24))), F.lit(":00"))
    utc = F.timestamp_millis(hour * HOUR_MS)
    # Both sides go through the session zone, which therefore cancels out.
    wall = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(utc, F.current_timezone()).cast("timestamp_ntz"))
    return F.concat(_two(F.hour(wall)), F.lit(":00"))
