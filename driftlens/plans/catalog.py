"""One runnable query per operator, over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftlens.functions import paths, text, times
from driftlens.operators import alerts, diffs, predicates, rate, search, stats, tree
from driftlens.operators.dedup import dedup_window
from driftlens.operators.runs import activity_runs
from driftlens.plans import fixtures
from driftlens.schema import ALERT_HISTORY, DIFF_MAX_BYTES, HOUR_BUCKETS, LOG_SCHEMA, SEARCH_LIMIT_MAX, Query
from driftlens.session import scratch_path
from driftlens.sources import export, logs, settings, snapshots
from driftlens.streaming import flows, folds

QueryFn = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, QueryFn] = {}

DAY_MS = times.DAY_MS
WEEK = 24 * 7
MONTH = 24 * 40
WATERMARK = "1 hour"


def query(fn: QueryFn) -> QueryFn:
    CATALOG[fn.__name__] = fn
    return fn


_LAST_MOMENT: dict[str, datetime] = {}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.log_events(spark, sf_dir)


def _now(spark: SparkSession, sf_dir: str) -> datetime:
    if sf_dir not in _LAST_MOMENT:
        _LAST_MOMENT[sf_dir] = fixtures.as_of(spark, sf_dir)
    return _LAST_MOMENT[sf_dir]


def _rows(df: DataFrame) -> DataFrame:
    """Log rows with a zone-free time for comparison."""
    return df.select("id", F.unix_millis("ts").alias("ts_ms"), "source", "level", "message")


def _rules(spark: SparkSession) -> DataFrame:
    names = fixtures.RULE_SCHEMA.names
    return settings.load_rules(spark, [dict(zip(names, row)) for row in fixtures.RULES])


def _presets(spark: SparkSession) -> dict:
    return settings.preset_map(settings.load_presets(spark, list(fixtures.PRESETS.values())))


def _stream(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """The events as a stream of several micro-batches, each a stretch of time that was written after the one before."""
    log = _log(spark, sf_dir)
    ends = log.agg(F.unix_millis(F.min("ts")).alias("first"), F.unix_millis(F.max("ts")).alias("last")).first()
    folder, width = scratch_path(spark, "events"), (ends.last - ends.first) // batches + 1
    for part in range(batches):
        since = ends.first + part * width
        rows = log.where((F.col("ts") >= times.at_ms(since)) & (F.col("ts") < times.at_ms(since + width)))
        rows.coalesce(1).write.parquet(f"{folder}/part={part}")
    reader = spark.readStream.schema(log.schema).option("recursiveFileLookup", True)
    return reader.option("maxFilesPerTrigger", 1).parquet(folder)


# Sources and sinks


@query
def live_text_sources(spark, sf_dir):
    """Lines of two programs, written to a folder each in several files and read as one stream in several micro-batches."""
    folder, sources = scratch_path(spark, "text-lines"), {}
    for name in ("fswatch", "entr"):
        lines = _log(spark, sf_dir).where(predicates.source_eq(name)).select(F.col("message").alias("value"))
        lines.repartition(3).write.text(f"{folder}/{name}")
        sources[name] = logs.read_log_lines(spark, f"{folder}/{name}", name, stream=True, files_per_batch=1)
    found = flows.run_to_table(logs.union_live(sources, WATERMARK)).where("ts IS NOT NULL")
    return found.groupBy("source", "level", "message").agg(F.count(F.lit(1)).alias("events"))


@query
def snapshot_folder(spark, sf_dir):
    """Files of a folder captured as versions; a second look finds nothing new."""
    folder, table = scratch_path(spark, "folder"), scratch_path(spark, "captured")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 20).alias("part"), "doc_id", "text")
    ordered = docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text")
    ordered.write.partitionBy("part").text(folder)
    snapshots.capture_folder(spark, folder, table)
    if snapshots.capture_folder(spark, folder, table):
        raise RuntimeError("files that nobody changed were captured again")
    part = F.regexp_extract("path", "part=([0-9]+)/", 1).cast("bigint").alias("part")
    return snapshots.read_snapshots(spark, table).select(part, "size", F.md5("content").alias("md5"))


@query
def append_and_read_logs(spark, sf_dir):
    table = scratch_path(spark, "log-table")
    logs.append_logs(_log(spark, sf_dir), table)
    return _rows(logs.read_log_table(spark, table))


@query
def append_two_writers(spark, sf_dir):
    """A stream and appends by hand into one table, taking turns."""
    table, log = scratch_path(spark, "two-writers"), _log(spark, sf_dir)
    for turn in range(4):
        part = log.where(F.col("id") % 4 == turn)
        if turn % 2:
            logs.append_logs(part, table)
        else:
            logs.append_logs(part, table, turn // 2, "stream_a")
    logs.append_logs(log.where(F.col("id") % 4 == 2), table, 1, "stream_a")
    return _stored(spark, table)


@query
def append_after_restart(spark, sf_dir):
    """Two streaming queries, each with a checkpoint of its own, into one table."""
    table = scratch_path(spark, "restarted")
    for half in range(2):
        part = _stream(spark, sf_dir).where(F.col("id") % 2 == half)
        flows.run_available(part.writeStream.foreachBatch(logs.append_stream(table)), spark)
    return _stored(spark, table)


@query
def append_after_prune(spark, sf_dir):
    """Retention empties the table of all but its last day, then everything is appended again."""
    table, log = scratch_path(spark, "pruned"), _log(spark, sf_dir)
    logs.append_logs(log, table)
    logs.prune_table(spark, table, _now(spark, sf_dir), 1)
    logs.append_logs(log, table)
    return _stored(spark, table)


@query
def compact_stored_table(spark, sf_dir):
    table, log = scratch_path(spark, "compacted"), _log(spark, sf_dir)
    for turn in range(3):
        logs.append_logs(log.where(F.col("id") % 3 == turn), table)
    logs.compact_days(spark, table, _now(spark, sf_dir).date())
    return _stored(spark, table)


def _stored(spark: SparkSession, table: str) -> DataFrame:
    """The rows stored of each message, and how often one id occurs at most."""
    rows = spark.read.schema(logs.TABLE_SCHEMA).parquet(table)
    ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    counts = rows.groupBy("source", "level", "message").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select("*", ids.scalar().alias("most_per_id"))


@query
def read_log_lines(spark, sf_dir):
    folder = scratch_path(spark, "lines")
    line = F.when(F.col("id") % 7 == 0, F.lit(" \t ")).otherwise(F.col("message"))
    _log(spark, sf_dir).select(line.alias("value")).write.text(folder)
    return logs.read_log_lines(spark, folder, "entr", "stderr").select("source", "level", "message")


@query
def union_sources(spark, sf_dir):
    log = _log(spark, sf_dir)
    sources = {name: log.where(predicates.source_eq(name)) for name in ("fswatch", "watchman", "entr", "logstream")}
    sources = logs.register_source(sources, "sample", log.where(predicates.source_eq("plugin:sample")))
    return logs.union_sources(sources).select(F.unix_millis("ts").alias("ts_ms"), "source", "level", "message")


@query
def prune_kept(spark, sf_dir):
    return _rows(logs.prune(_log(spark, sf_dir), _now(spark, sf_dir), 7)[0])


@query
def prune_deleted(spark, sf_dir):
    return logs.prune(_log(spark, sf_dir), _now(spark, sf_dir), 7)[1]


@query
def prune_stored_table(spark, sf_dir):
    table = scratch_path(spark, "prune-table")
    logs.append_logs(_log(spark, sf_dir), table)
    logs.prune_table(spark, table, _now(spark, sf_dir), 7)
    left = logs.read_log_table(spark, table)
    return left.groupBy(F.col("dt").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@query
def export_csv(spark, sf_dir):
    folder = scratch_path(spark, "csv")
    export.export_csv(_log(spark, sf_dir), Query(keyword="C"), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query
def export_json(spark, sf_dir):
    folder = scratch_path(spark, "json")
    export.export_json(_log(spark, sf_dir), Query(source="watchman"), folder)
    return spark.read.schema("id bigint, ts string, source string, level string, message string").json(folder)


@query
def read_snapshots(spark, sf_dir):
    table = scratch_path(spark, "snapshots")
    fixtures.snapshots(spark, sf_dir).write.parquet(table)
    return snapshots.read_snapshots(spark, table).select("path", "version_id", "size")


@query
def fan_out(spark, sf_dir):
    kept, counted = scratch_path(spark, "fan-log"), scratch_path(spark, "fan-count")
    handlers = {
        "persist": logs.append_stream(kept),
        "count": lambda df, batch: df.groupBy("source").count().write.mode("overwrite").parquet(f"{counted}/batch={batch}"),
    }
    flows.run_available(flows.fan_out(_stream(spark, sf_dir), handlers), spark)
    stored = logs.read_log_table(spark, kept).groupBy("source").agg(F.count(F.lit(1)).alias("stored"))
    seen = spark.read.schema("source string, count bigint, batch bigint").parquet(counted)
    return stored.join(seen.groupBy("source").agg(F.sum("count").alias("counted")), "source")


# Filters


@query
def filter_since(spark, sf_dir):
    return _rows(_log(spark, sf_dir).where(predicates.since(_now(spark, sf_dir) - timedelta(days=3))))


@query
def filter_until(spark, sf_dir):
    return _rows(_log(spark, sf_dir).where(predicates.until(_now(spark, sf_dir) - timedelta(days=20))))


@query
def filter_source(spark, sf_dir):
    return _rows(_log(spark, sf_dir).where(predicates.source_eq("entr")))


@query
def filter_keyword(spark, sf_dir):
    return _rows(_log(spark, sf_dir).where(predicates.keyword("created")))


@query
def filter_search(spark, sf_dir):
    now = _now(spark, sf_dir)
    wanted = Query(since=now - timedelta(days=10), until=now - timedelta(days=1), source="fswatch", keyword="/VAR/log")
    return _rows(_log(spark, sf_dir).where(predicates.search_predicate(wanted)))


@query
def filter_parsed_query(spark, sf_dir):
    wanted = predicates.parse_query({"since": "2024-01-10T12:00:00+02:00", "until": "2024-01-20T00:00:00Z", "q": "is"})
    return _rows(_log(spark, sf_dir).where(predicates.search_predicate(wanted)))


@query
def filter_live(spark, sf_dir):
    return _rows(predicates.live_filter(_log(spark, sf_dir), ":15 FSWATCH"))


@query
def filter_multi_field(spark, sf_dir):
    return _rows(predicates.multi_field_filter(_log(spark, sf_dir), " Entr "))


@query
def preset_logs(spark, sf_dir):
    return _rows(predicates.apply_preset(_log(spark, sf_dir), _presets(spark), "logs"))


@query
def preset_temp(spark, sf_dir):
    return _rows(predicates.apply_preset(_log(spark, sf_dir), _presets(spark), "temp"))


@query
def filter_has_message(spark, sf_dir):
    return _rows(_log(spark, sf_dir).where(predicates.has_message()))


@query
def filter_not_alert(spark, sf_dir):
    log = _log(spark, sf_dir)
    fed = alerts.alert_feedback(log, alerts.fire_alerts(log, _rules(spark)))
    return fed.where(predicates.not_alert_source()).groupBy("source").agg(F.count(F.lit(1)).alias("events"))


@query
def filter_has_path(spark, sf_dir):
    return _rows(_log(spark, sf_dir).where(predicates.has_path()))


@query
def path_drilldown(spark, sf_dir):
    return _rows(search.path_drilldown(_log(spark, sf_dir), "/var/log/u4"))


# Scalar functions


@query
def extract_path(spark, sf_dir):
    return _log(spark, sf_dir).select("id", paths.extract_path(F.col("message")).alias("path"))


@query
def clean_path(spark, sf_dir):
    raw = F.concat(F.lit("/"), F.col("source"), F.lit("/./x//"), F.col("level"), F.lit("/../"), (F.col("id") % 9).cast("string"), F.lit("/"))
    return _log(spark, sf_dir).select("id", paths.clean_path(raw).alias("path"))


@query
def path_prefixes(spark, sf_dir):
    path = paths.extract_path(F.col("message"))
    return _log(spark, sf_dir).select("id", F.explode(paths.path_prefixes(path)).alias("prefix"))


@query
def leading_token(spark, sf_dir):
    return _log(spark, sf_dir).select("id", paths.leading_token(F.col("message")).alias("token"))


@query
def escape_like(spark, sf_dir):
    value = F.concat("source", F.lit("_100%\\"), "message")
    return _log(spark, sf_dir).select("id", text.escape_like(value).alias("pattern"))


@query
def dedup_keys(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("level", "message").agg(F.count(F.lit(1)).alias("events"))


@query
def time_parts(spark, sf_dir):
    ts = F.col("ts")
    hour = times.epoch_hour(ts)
    return _log(spark, sf_dir).select(
        "id", hour.alias("hour"), times.weekday(ts).alias("weekday"),
        times.weekday_label(times.weekday(ts)).alias("weekday_label"), times.hour_label(hour).alias("hour_label"),
        times.hour_label(hour, "Asia/Tokyo").alias("hour_label_tokyo"), times.rfc3339(ts).alias("rfc3339"),
    )


@query
def snapshot_lines(spark, sf_dir):
    content = text.normalise_newlines(F.col("content"))
    lines = text.split_lines(content)
    return fixtures.snapshots(spark, sf_dir).select(
        "version_id", F.size(lines).cast("bigint").alias("lines"), text.count_lines(content).cast("bigint").alias("counted"),
        F.length(F.array_join(lines, "")).cast("bigint").alias("chars"),
    )


@query
def alert_messages(spark, sf_dir):
    fired = alerts.fire_alerts(_log(spark, sf_dir), _rules(spark))
    return fired.select("event_id", "id", text.alert_message(F.col("name"), F.col("count"), F.col("last")).alias("message"))


@query
def bar_widths(spark, sf_dir):
    sources = stats.by_source(_log(spark, sf_dir), _now(spark, sf_dir), WEEK)
    total = sources.agg(F.max("count")).scalar()
    return sources.select("source", "count", text.bar_pct(F.col("count"), total).alias("pct"))


@query
def render_lines_cut(spark, sf_dir):
    line = text.render_line(times.clock(F.col("ts")), F.col("source"), F.col("message"), 12)
    return _log(spark, sf_dir).select("id", line.alias("line"))


@query
def render_lines(spark, sf_dir):
    line = text.render_line(times.clock(F.col("ts")), F.col("source"), F.col("message"))
    return _log(spark, sf_dir).select("id", line.alias("line"))


# Sorts, limits, top-k


@query
def search_logs(spark, sf_dir):
    now = _now(spark, sf_dir)
    return _rows(search.search_logs(_log(spark, sf_dir), Query(since=now - timedelta(days=14), source="fswatch", keyword="created")))


@query
def search_logs_max(spark, sf_dir):
    return _rows(search.search_logs(_log(spark, sf_dir), Query(limit=9999, cap=SEARCH_LIMIT_MAX)))


@query
def search_logs_wide(spark, sf_dir):
    return _rows(search.search_logs(_log(spark, sf_dir), Query(limit=9999)))


@query
def export_order(spark, sf_dir):
    return _rows(search.export_order(_log(spark, sf_dir), Query(source="logstream")))


@query
def tail(spark, sf_dir):
    return search.tail(_log(spark, sf_dir), 500).select("id", "line")


@query
def oldest_events(spark, sf_dir):
    return _rows(search.oldest_n(_log(spark, sf_dir), 3000))


@query
def top_paths(spark, sf_dir):
    return stats.top_paths(_log(spark, sf_dir), _now(spark, sf_dir), WEEK)


@query
def alert_history(spark, sf_dir):
    return _history(alerts.alert_history(alerts.fire_alerts(_log(spark, sf_dir), _rules(spark)), ALERT_HISTORY))


@query
def alert_history_all(spark, sf_dir):
    return _history(alerts.alert_history(alerts.fire_alerts(_log(spark, sf_dir), _rules(spark))))


def _history(fired: DataFrame) -> DataFrame:
    return fired.select("id", "name", "count", F.unix_millis("fired_at").alias("fired_ms"), "last", "event_id")


@query
def diff_history(spark, sf_dir):
    changed = diffs.diff_history(diffs.changed_pairs(fixtures.snapshots(spark, sf_dir)), 50, 20)
    return changed.select("path", "version_id", F.unix_millis("ts").alias("ts_ms"))


@query
def diff_history_all(spark, sf_dir):
    changed = diffs.diff_history(diffs.changed_pairs(fixtures.snapshots(spark, sf_dir)))
    return changed.select("path", "version_id", F.unix_millis("ts").alias("ts_ms"))


@query
def sibling_order(spark, sf_dir):
    rollup = tree.path_rollup(_log(spark, sf_dir), _now(spark, sf_dir), MONTH, None)
    return tree.sibling_order(rollup).select("path", "parent", "count", "sibling_rank")


# Aggregations


@query
def total(spark, sf_dir):
    return stats.total(_log(spark, sf_dir), _now(spark, sf_dir))


@query
def hourly(spark, sf_dir):
    return stats.hourly(_log(spark, sf_dir), _now(spark, sf_dir), buckets=HOUR_BUCKETS)


@query
def hourly_long_window(spark, sf_dir):
    return stats.hourly(_log(spark, sf_dir), _now(spark, sf_dir), WEEK, buckets=HOUR_BUCKETS)


@query
def hourly_whole_window(spark, sf_dir):
    return stats.hourly(_log(spark, sf_dir), _now(spark, sf_dir), WEEK)


@query
def weekday_counts(spark, sf_dir):
    return stats.weekday_counts(_log(spark, sf_dir), _now(spark, sf_dir), 60)


@query
def by_source(spark, sf_dir):
    return stats.by_source(_log(spark, sf_dir), _now(spark, sf_dir), WEEK)


@query
def dashboard(spark, sf_dir):
    """All dashboard parts from one scan, unfolded to rows for comparison."""
    return _unfolded(stats.stats(_log(spark, sf_dir), _now(spark, sf_dir), buckets=HOUR_BUCKETS))


@query
def dashboard_whole_window(spark, sf_dir):
    return _unfolded(stats.stats(_log(spark, sf_dir), _now(spark, sf_dir), 60))


def _unfolded(bundle: DataFrame) -> DataFrame:
    wide = bundle.select(
        F.array(F.struct(F.lit("all").alias("label"), F.col("total").alias("count"))).alias("total"),
        "hourly", "weekly",
        F.transform("by_source", lambda s: F.struct(s["source"].alias("label"), s["count"].alias("count"))).alias("by_source"),
        F.transform("top_paths", lambda p: F.struct(p["path"].alias("label"), p["count"].alias("count"))).alias("top_paths"),
    )
    parts = F.array(*[
        F.struct(F.lit(name).alias("part"), F.col(name).alias("rows"))
        for name in ("total", "hourly", "weekly", "by_source", "top_paths")
    ])
    return (
        wide.select(F.explode(parts).alias("p"))
        .select("p.part", F.posexplode("p.rows").alias("pos", "row"))
        .select("part", "pos", "row.label", "row.count")
    )


@query
def path_rollup(spark, sf_dir):
    return tree.path_rollup(_log(spark, sf_dir), _now(spark, sf_dir), MONTH, None)


@query
def path_rollup_limited(spark, sf_dir):
    return tree.path_rollup(_log(spark, sf_dir), _now(spark, sf_dir), WEEK, 500)


@query
def path_tree_json(spark, sf_dir):
    return tree.path_tree_json(tree.path_rollup(_log(spark, sf_dir), _now(spark, sf_dir), WEEK))


@query
def flatten_tree(spark, sf_dir):
    rollup = tree.path_rollup(_log(spark, sf_dir), _now(spark, sf_dir), MONTH, None)
    return tree.flatten_tree(rollup, ["/", "/var/log", "/var/tmp/u1"])


@query
def heatmap(spark, sf_dir):
    rollup = tree.path_rollup(_log(spark, sf_dir), _now(spark, sf_dir), MONTH, None)
    return tree.heatmap(rollup).select("path", "count", "hue", "lightness")


@query
def event_rate(spark, sf_dir):
    """Every second from the first to the last event, summed up by hour for comparison."""
    return _by_hour(rate.event_rate(_log(spark, sf_dir)))


def _by_hour(samples: DataFrame) -> DataFrame:
    return samples.groupBy(times.epoch_hour(F.col("ts")).alias("hour")).agg(
        F.count(F.lit(1)).alias("seconds"), F.count_if(F.col("events") == 0).alias("idle"), F.sum("events").alias("events"),
        F.max("events_sec").alias("peak"), F.unix_millis(F.min("ts")).alias("first_ms"),
    )


@query
def event_rate_hourly(spark, sf_dir):
    samples = rate.event_rate(_log(spark, sf_dir), times.HOUR_MS)
    return samples.select(F.unix_millis("ts").alias("ts_ms"), "events", F.round("events_sec", 9).alias("events_sec"))


@query
def rate_samples(spark, sf_dir):
    samples = rate.rate_samples(rate.event_rate(_log(spark, sf_dir)))
    return samples.select(F.unix_millis("ts").alias("ts_ms"), "events", "max_events")


@query
def rate_samples_hourly(spark, sf_dir):
    samples = rate.rate_samples(rate.event_rate(_log(spark, sf_dir), times.HOUR_MS))
    return samples.select(F.unix_millis("ts").alias("ts_ms"), "events", "max_events")


@query
def threshold_latch(spark, sf_dir):
    latch = rate.threshold_latch(fixtures.metric_samples(spark, sf_dir), "value", 200)
    return latch.select("warned", F.unix_millis("first_ts").alias("first_ms"), "threshold")


@query
def alert_count(spark, sf_dir):
    return alerts.alert_count(alerts.fire_alerts(_log(spark, sf_dir), _rules(spark)), ALERT_HISTORY)


@query
def alert_count_all(spark, sf_dir):
    return alerts.alert_count(alerts.fire_alerts(_log(spark, sf_dir), _rules(spark)))


@query
def source_overview(spark, sf_dir):
    overview = stats.source_overview(_log(spark, sf_dir))
    return overview.select("source", "events", F.unix_millis("last_ts").alias("last_ms"))


# Joins


@query
def match_rules(spark, sf_dir):
    return alerts.match_rules(_log(spark, sf_dir), _rules(spark)).select("rule_id", "id")


@query
def match_many_rules(spark, sf_dir):
    """As many rules as there are paths and changes of files, found through the index over their patterns."""
    found = alerts.match_rules(_log(spark, sf_dir), settings.load_rules(spark, fixtures.many_rules()))
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("events"), F.max("id").alias("last_id"))


@query
def zero_fill(spark, sf_dir):
    now = _now(spark, sf_dir)
    entr = _log(spark, sf_dir).where(predicates.source_eq("entr"))
    return stats.hourly(entr, now, 24, buckets=HOUR_BUCKETS)


@query
def link_children(spark, sf_dir):
    rollup = tree.path_rollup(_log(spark, sf_dir), _now(spark, sf_dir), MONTH, None)
    return tree.link_children(rollup).select("path", "has_children")


@query
def hide_collapsed(spark, sf_dir):
    rollup = tree.path_rollup(_log(spark, sf_dir), _now(spark, sf_dir), MONTH, None)
    busy = rollup.where((F.col("depth") == 3) & (F.col("count") > 300)).select("path")
    return tree.hide_collapsed(rollup, busy).select("path", "count")


# Windows and stateful operators


@query
def previous_snapshot(spark, sf_dir):
    before = diffs.previous_snapshot(diffs.eligible_snapshots(fixtures.snapshots(spark, sf_dir)))
    return before.select("path", "version_id", F.octet_length("prev_content").cast("bigint").alias("prev_bytes"))


@query
def runs_of_activity(spark, sf_dir):
    moments = _log(spark, sf_dir).select("level", F.unix_millis("ts").alias("ts_ms")).distinct()
    runs = activity_runs(moments, ["level"], "ts_ms", F.lit(times.HOUR_MS))
    return runs.groupBy("level", "run_start").agg(F.count(F.lit(1)).alias("moments"))


@query
def dedup_day(spark, sf_dir):
    return _rows(dedup_window(_log(spark, sf_dir), DAY_MS))


@query
def dedup_hour(spark, sf_dir):
    return _rows(dedup_window(_log(spark, sf_dir), times.HOUR_MS))


@query
def fire_alerts(spark, sf_dir):
    fired = alerts.fire_alerts(_log(spark, sf_dir), _rules(spark))
    return fired.select("id", "name", "count", F.unix_millis("fired_at").alias("fired_ms"), "last", "event_id", "sound")


@query
def alert_feedback(spark, sf_dir):
    log = _log(spark, sf_dir)
    fed = alerts.alert_feedback(log, alerts.fire_alerts(log, _rules(spark)))
    return fed.select(F.unix_millis("ts").alias("ts_ms"), "source", "level", "message")


@query
def dedup_stream(spark, sf_dir):
    return _rows(flows.run_to_table(folds.dedup_stream(_stream(spark, sf_dir), DAY_MS, WATERMARK)))


@query
def fire_alerts_stream(spark, sf_dir):
    fired = flows.run_to_table(folds.fire_alerts_stream(_stream(spark, sf_dir), _rules(spark), WATERMARK))
    return fired.select("id", "name", "count", F.unix_millis("fired_at").alias("fired_ms"), "last", "event_id", "sound")


@query
def rate_stream(spark, sf_dir):
    """Every second that the watermark has passed, idle ones too, summed up by hour for comparison."""
    return _by_hour(flows.run_to_table(folds.rate_stream(_stream(spark, sf_dir), WATERMARK)))


@query
def live_tail(spark, sf_dir):
    return flows.run_to_table(flows.live_tail(_stream(spark, sf_dir)))


@query
def diff_stream(spark, sf_dir):
    """Snapshots in three micro-batches; the state knows digests, and contents come from the stored table."""
    table, kept = scratch_path(spark, "snapshot-stream"), scratch_path(spark, "snapshot-diffs")
    snaps = fixtures.snapshots(spark, sf_dir)
    # A path's versions follow one another in time, which here is their number.
    last = snaps.agg(F.max("version_id").alias("last")).first().last
    for part in range(3):
        third = F.floor(F.col("version_id") * 3 / (last + 1))
        snaps.where(third == part).coalesce(1).write.parquet(f"{table}/part={part}")
    stream = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(table)

    def keep(df, batch):
        df.write.mode("overwrite").parquet(f"{kept}/batch={batch}")

    handler = folds.diff_batches(lambda: snapshots.read_snapshots(spark, table), keep)
    flows.run_available(folds.version_changes(stream).writeStream.foreachBatch(handler), spark)
    found = spark.read.parquet(f"{kept}/batch=*")
    return found.select("path", "version_id", F.unix_millis("ts").alias("ts_ms"), "added", "removed")


@query
def on_fire(spark, sf_dir):
    """A user's handler that keeps the alerts asking for a sound."""
    kept = scratch_path(spark, "on-fire")
    fired = folds.fire_alerts_stream(_stream(spark, sf_dir), _rules(spark), WATERMARK)

    def keep(df, batch):
        df.where("sound").write.mode("overwrite").parquet(f"{kept}/batch={batch}")

    flows.run_available(flows.on_fire(fired, keep), spark)
    return spark.read.schema(fired.schema).parquet(kept).select("id", "event_id", "count")


@query
def ingest_with_feedback(spark, sf_dir):
    """The whole way of an event: from the stream without repeats into the table, and its alerts into the same table."""
    table = scratch_path(spark, "ingest")
    fresh = folds.dedup_stream(_stream(spark, sf_dir), DAY_MS, WATERMARK)
    flows.run_available(fresh.writeStream.foreachBatch(logs.append_stream(table)), spark)
    stored = spark.readStream.schema(logs.TABLE_SCHEMA).parquet(table).select(*LOG_SCHEMA.names)
    fired = folds.fire_alerts_stream(stored, _rules(spark), WATERMARK)
    append = logs.append_stream(table)

    def feed_back(df, batch):
        append(alerts.alert_events(df), batch)

    flows.run_available(flows.on_fire(fired, feed_back), spark)
    rows = logs.read_log_table(spark, table)
    return rows.select(F.unix_millis("ts").alias("ts_ms"), "source", "level", "message")


# Diffs


@query
def eligible_snapshots(spark, sf_dir):
    return diffs.eligible_snapshots(fixtures.snapshots(spark, sf_dir)).select("path", "version_id")


@query
def eligible_small_snapshots(spark, sf_dir):
    return diffs.eligible_snapshots(fixtures.snapshots(spark, sf_dir), DIFF_MAX_BYTES).select("path", "version_id")


@query
def file_diffs_small(spark, sf_dir):
    """Files of at most 1 MiB, and no comparison of texts whose line counts multiply to more than 200."""
    small = diffs.file_diffs(fixtures.snapshots(spark, sf_dir), max_bytes=DIFF_MAX_BYTES, max_cells=200)
    return small.select("path", "version_id", "added", "removed")


@query
def changed_pairs(spark, sf_dir):
    changed = diffs.changed_pairs(fixtures.snapshots(spark, sf_dir))
    return changed.select(
        "path", "version_id", F.length("old").cast("bigint").alias("old_chars"), F.length("new").cast("bigint").alias("new_chars")
    )


@query
def file_diffs(spark, sf_dir):
    return diffs.file_diffs(fixtures.snapshots(spark, sf_dir)).select("path", "version_id", "added", "removed")


@query
def diff_lines(spark, sf_dir):
    lines = diffs.diff_lines(diffs.file_diffs(fixtures.snapshots(spark, sf_dir)))
    return lines.select("path", "version_id", "position", "kind", "line", "line_no")


@query
def diff_rebuild(spark, sf_dir):
    """Both texts put together again from the lines of each diff."""
    diffs_of = diffs.file_diffs(fixtures.snapshots(spark, sf_dir))

    def side(kind):
        kept = F.filter("changes", lambda c: c["kind"].isin("context", kind))
        return F.md5(F.rtrim(F.array_join(F.transform(kept, lambda c: c["line"]), "\n"), F.lit("\n")))

    return diffs_of.select("version_id", side("removed").alias("old_md5"), side("added").alias("new_md5"))


@query
def recent_diffs(spark, sf_dir):
    latest = diffs.recent_diffs(diffs.file_diffs(fixtures.snapshots(spark, sf_dir)), 20)
    return latest.select("path", "version_id", "added", "removed")
