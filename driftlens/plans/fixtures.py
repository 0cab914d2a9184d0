"""Adapters that present the driver's test tables as event logs and file snapshots."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftlens.schema import RULE_SCHEMA
from driftlens.sources.settings import DEFAULT_PRESETS

RULES = [
    (0, "burst", "Created burst", "Created", "", "", 5, 3600, True),
    (1, "err", "error lines", "", "", "stderr", 10, 7200, False),
    (2, "one", "each start", "started", "", "", 1, 60, False),
    (3, "lower", "wrong case", "created", "", "", 1, 60, False),
    (4, "src", "entr only", "", "entr", "stdout", 3, 1800, False),
]

def many_rules() -> list[dict]:
    """A rule for each kind of change of each path of the fixture, and two that name no path."""
    paths = [f"/{top}/u{user}/k{kind} {change}" for top in ("log", "tmp", "cache", "folders") for user in range(10)
             for kind in range(5) for change in ("Created", "Updated", "Removed", "Renamed")]
    named = [{"id": path, "name": path, "pattern": path, "source": "entr" if path.endswith("Removed") else ""} for path in paths]
    return [*named, {"id": "k3", "name": "k3", "pattern": "k3", "level": "stderr"}, {"id": "beat", "name": "beat", "pattern": "heartbeat"}]


# The default presets, but for the target of ``temp``, which has no rows here.
PRESETS = {p["id"]: {**p, "target": "/var/tmp"} if p["id"] == "temp" else p for p in DEFAULT_PRESETS}


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# Fixed mapping of the ``events`` table to log rows; times are stored at millisecond resolution.
LOG_COLUMNS = [
    "event_id AS id",
    "date_trunc('MILLISECOND', CAST(ts AS TIMESTAMP)) AS ts",
    """CASE event_type WHEN 'click' THEN 'fswatch' WHEN 'view' THEN 'watchman' WHEN 'purchase' THEN 'entr'
       WHEN 'signup' THEN 'logstream' ELSE 'plugin:sample' END AS source""",
    "CASE WHEN event_id % 50 = 0 THEN 'info' WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS level",
    r"""CASE WHEN event_id % 50 = 0 THEN concat('started (pid ', event_id, ')')
       WHEN event_id % 41 = 0 THEN 'heartbeat'
       WHEN event_id % 37 = 0 THEN ' changed'
       WHEN event_id % 31 = 0 THEN concat('log stream Output: /var/log//svc/../u', user_id % 7, '/')
       ELSE concat('/var/', CASE user_id % 4 WHEN 0 THEN 'log' WHEN 1 THEN 'tmp' WHEN 2 THEN 'cache' ELSE 'folders' END,
         '/u', user_id % 10, '/k', CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5, ' ',
         CASE event_id % 4 WHEN 0 THEN 'Created' WHEN 1 THEN 'Updated' WHEN 2 THEN 'Removed' ELSE 'Renamed' END, ' IsFile')
       END AS message""",
]


def as_log(raw: DataFrame) -> DataFrame:
    """The raw ``events`` rows (batch or stream) with the log schema."""
    return raw.selectExpr(*LOG_COLUMNS)


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(_raw(spark, sf_dir))


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """Time of the last event; the fixed "now" of every test query."""
    ms = _raw(spark, sf_dir).agg(F.unix_millis(F.max("ts").cast("timestamp")).alias("ms")).first().ms
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of files, ten documents after one another in each file; every document's own text is one version.

    After it come the same text, the text with other line ends and a small edit; for some documents also a version with
    a zero byte, one of over a mebibyte in one line, or one without a path.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    doc, body = F.col("doc_id"), F.col("text")
    large = F.repeat(F.replace(body, F.lit("\n"), F.lit(" ")), (F.floor(F.lit(1 << 20) / F.greatest(F.length(body), F.lit(1))) + 1).cast("int"))
    edited = F.concat(F.replace(body, F.lit("the"), F.lit("THE")), F.lit("\nadded line"))
    texts = [
        body, body, F.replace(body, F.lit("\n"), F.lit("\r\n")), edited, F.when(doc % 7 == 3, F.concat(body, F.lit("\0"))),
        F.when(doc % 41 == 5, large), F.when(doc % 11 == 4, F.concat(body, F.lit(" unnamed"))),
    ]
    steps = F.array(*[F.struct(F.lit(n).alias("step"), t.alias("content")) for n, t in enumerate(texts)])
    made = docs.select("doc_id", F.explode(steps).alias("v")).select("doc_id", "v.*").where("content IS NOT NULL")
    version = doc * 8 + F.col("step")
    return made.select(
        F.when(F.col("step") == 6, F.lit("")).otherwise(F.concat(F.lit("/docs/"), F.floor(doc / 10).cast("string"))).alias("path"),
        version.alias("version_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + version).alias("ts"),
        F.col("content").cast("binary").alias("content"),
    )
