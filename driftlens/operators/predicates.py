"""Filters as Column predicates, in forms the Parquet scan can push down."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from driftlens.functions import paths, text, times
from driftlens.schema import ALERT_SOURCE, BUILTIN_SOURCES, Query

# A date, a "T", a time of day with seconds, and an offset; nothing shorter and no other calendar.
RFC3339 = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})")
WHOLE_NUMBER = re.compile(r"[+-]?[0-9]+")


def _utc_day(ms: int) -> Column:
    return F.lit((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)).date())


def since(moment: datetime, dated: bool = False) -> Column:
    """At or after ``moment`` at millisecond resolution; ``dated`` adds the ``dt`` partition filter."""
    ms = times.to_ms(moment)
    test = F.col("ts") >= times.at_ms(ms)
    return (F.col("dt") >= _utc_day(ms)) & test if dated else test


def until(moment: datetime, dated: bool = False) -> Column:
    """At or before ``moment``, inclusive at millisecond resolution."""
    ms = times.to_ms(moment)
    test = F.col("ts") < times.at_ms(ms + 1)
    return (F.col("dt") <= _utc_day(ms)) & test if dated else test


def source_eq(source: str) -> Column:
    return F.col("source") == source


def keyword(needle: str) -> Column:
    """Literal substring of the message, ASCII letters in any case."""
    return text.contains_ascii_nocase(F.col("message"), needle)


def search_predicate(query: Query, dated: bool = False) -> Column:
    """All given conditions together; true for every row when none is given."""
    parts = []
    if query.since is not None:
        parts.append(since(query.since, dated))
    if query.until is not None:
        parts.append(until(query.until, dated))
    if query.source:
        parts.append(source_eq(query.source))
    if query.keyword:
        parts.append(keyword(query.keyword))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def parse_query(params: Mapping[str, str]) -> Query:
    """Search parameters from text; a bad time raises ValueError naming its field."""
    moments: dict[str, datetime] = {}
    for field in ("since", "until"):
        value = params.get(field, "")
        if not value:
            continue
        try:
            if not RFC3339.fullmatch(value):
                raise ValueError(value)
            # Python keeps microseconds; further digits are below the resolution of the table.
            moments[field] = datetime.fromisoformat(re.sub(r"(\.[0-9]{6})[0-9]+", r"\1", value))
        except ValueError:
            raise ValueError(f"invalid {field}: {value}") from None
    asked = params.get("limit", "")
    limit = int(asked) if WHOLE_NUMBER.fullmatch(asked) else 0
    return Query(
        since=moments.get("since"),
        until=moments.get("until"),
        source=params.get("source", ""),
        keyword=params.get("q", ""),
        limit=limit,
    )


def live_filter(df: DataFrame, needle: str) -> DataFrame:
    """Rows whose whole rendered line contains ``needle`` in any case."""
    if not needle:
        return df
    line = text.render_line(times.clock(F.col("ts")), F.col("source"), F.col("message"))
    return df.where(F.lower(line).contains(needle.lower()))


def multi_field_filter(df: DataFrame, needle: str) -> DataFrame:
    """Rows with ``needle`` in the message (any case) or in the source (as written)."""
    needle = needle.strip().lower()
    if not needle:
        return df
    return df.where(F.lower("message").contains(needle) | F.col("source").contains(needle))


def has_message() -> Column:
    return F.col("message") != ""


def not_alert_source() -> Column:
    return F.col("source") != ALERT_SOURCE


def has_path() -> Column:
    """The message names an absolute path."""
    return F.col("message").rlike(paths.FIRST_PATH)


def apply_preset(df: DataFrame, presets: Mapping[str, Mapping], preset_id: str) -> DataFrame:
    """Events the preset would let in.

    Enabled built-in sources only, and of those the ones about the target: file sources by path,
    ``logstream`` by message text. Other sources are not governed by presets and stay.
    """
    if preset_id not in presets:
        raise KeyError(f"unknown preset: {preset_id}")
    preset = presets[preset_id]
    target = preset["target"]
    enabled = [name for name, on in (preset.get("enabled") or {}).items() if on]
    about = F.when(F.col("source") == "logstream", F.col("message").contains(target)).otherwise(
        paths.under_path(paths.extract_path(F.col("message")), target)
    )
    governed = F.col("source").isin(*BUILTIN_SOURCES)
    return df.where(~governed | (F.col("source").isin(*enabled) & about))
