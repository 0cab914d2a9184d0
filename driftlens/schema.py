"""Fixed schemas and the search parameters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
])

LOG_SCHEMA = T.StructType([T.StructField("id", T.LongType()), *EVENT_SCHEMA.fields])

RULE_FIELDS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("min_events", T.IntegerType()),
    T.StructField("window_sec", T.IntegerType()),
    T.StructField("sound", T.BooleanType()),
])

# Rules keep their position in the list: rules sharing an id are tried in that order.
RULE_SCHEMA = T.StructType([T.StructField("rule_no", T.IntegerType()), *RULE_FIELDS.fields])

PRESET_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("enabled", T.MapType(T.StringType(), T.BooleanType())),
    T.StructField("filter", T.StringType()),
])

SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("version_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("content", T.BinaryType()),
])

CHANGES_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("line_no", T.IntegerType()),
]))

BUILTIN_SOURCES = ("fswatch", "watchman", "entr", "logstream")
ALERT_SOURCE = "alert"

# Fixed operating values; results depend on them.
SEARCH_LIMIT, SEARCH_LIMIT_MAX = 200, 5000
STATS_HOURS = 24
HOUR_BUCKETS = 24
TOP_PATHS = 10
TREE_LIMIT = 20_000
TAIL_LINES = 2000
ALERT_HISTORY = 100
DIFF_HISTORY, DIFF_HISTORY_MAX = 50, 500
DIFF_MAX_BYTES = 1 << 20
DIFF_MAX_CELLS = 400_000
RATE_SAMPLES = 60
LATCH_THRESHOLD = 512
RETENTION_DAYS = 30
RULE_MIN_EVENTS, RULE_WINDOW_SEC = 1, 60
RENDER_LENGTH = 2048


@dataclass(frozen=True)
class Query:
    """Search conditions; an unset part does not filter.

    Without a ``limit`` the default number of rows is meant. ``cap`` bounds what may be asked for; there is none by default.
    """

    since: datetime | None = None
    until: datetime | None = None
    source: str = ""
    keyword: str = ""
    limit: int = 0
    cap: int | None = None

    @property
    def row_limit(self) -> int:
        asked = self.limit if self.limit > 0 else SEARCH_LIMIT
        return asked if self.cap is None else min(asked, self.cap)
