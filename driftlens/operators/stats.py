"""Dashboard aggregations over the last hours before ``as_of``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftlens.functions import paths, times
from driftlens.operators.predicates import since
from driftlens.schema import STATS_HOURS, TOP_PATHS


def window_start(as_of: datetime, hours: int) -> datetime:
    return as_of - timedelta(hours=hours if hours > 0 else STATS_HOURS)


def recent(df: DataFrame, as_of: datetime, hours: int) -> DataFrame:
    """Events of the last ``hours``; later ones than ``as_of`` count too."""
    return df.where(since(window_start(as_of, hours), dated="dt" in df.columns))


def zero_fill(counts: DataFrame, spine: DataFrame, key: str, value: str = "count") -> DataFrame:
    """Every spine row, with 0 where there is no count."""
    return spine.join(counts.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def bucket_count(as_of: datetime, hours: int, buckets: int | None = None) -> int:
    """Hours from the one the window starts in to the one of ``as_of``, or the number asked for."""
    first = times.to_ms(window_start(as_of, hours)) // times.HOUR_MS
    return buckets if buckets is not None else times.to_ms(as_of) // times.HOUR_MS - first + 1


def hour_spine(spark: SparkSession, as_of: datetime, hours: int, buckets: int | None = None) -> DataFrame:
    first = times.to_ms(window_start(as_of, hours)) // times.HOUR_MS
    return spark.range(first, first + bucket_count(as_of, hours, buckets), 1, 1).withColumnRenamed("id", "hour")


def weekday_spine(spark: SparkSession) -> DataFrame:
    return spark.range(0, 7, 1, 1).select(F.col("id").cast("int").alias("weekday"))


def total(df: DataFrame, as_of: datetime, hours: int = STATS_HOURS) -> DataFrame:
    return recent(df, as_of, hours).agg(F.count(F.lit(1)).alias("total"))


def hourly(
    df: DataFrame, as_of: datetime, hours: int = STATS_HOURS, zone: str = "UTC", buckets: int | None = None
) -> DataFrame:
    """Hour buckets from the hour the window starts in to the current one, or just the first ``buckets`` of them."""
    spine = hour_spine(df.sparkSession, as_of, hours, buckets)
    first = times.to_ms(window_start(as_of, hours)) // times.HOUR_MS
    counts = (
        recent(df, as_of, hours)
        .where(F.col("ts") < times.at_ms((first + bucket_count(as_of, hours, buckets)) * times.HOUR_MS))
        .groupBy(times.epoch_hour(F.col("ts")).alias("hour"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    filled = zero_fill(counts, spine, "hour")
    return filled.select("hour", times.hour_label(F.col("hour"), zone).alias("label"), "count").orderBy("hour")


def weekday_counts(df: DataFrame, as_of: datetime, hours: int = STATS_HOURS) -> DataFrame:
    """UTC weekdays of the same window, Sunday first."""
    counts = (
        recent(df, as_of, hours)
        .groupBy(times.weekday(F.col("ts")).alias("weekday"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    filled = zero_fill(counts, weekday_spine(df.sparkSession), "weekday")
    return filled.select("weekday", times.weekday_label(F.col("weekday")).alias("label"), "count").orderBy("weekday")


def by_source(df: DataFrame, as_of: datetime, hours: int = STATS_HOURS) -> DataFrame:
    counts = recent(df, as_of, hours).groupBy("source").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "source")


def top_paths(df: DataFrame, as_of: datetime, hours: int = STATS_HOURS, k: int = TOP_PATHS) -> DataFrame:
    """Most frequent texts before the first space; messages without one share the empty text."""
    rows = recent(df, as_of, hours).where(F.col("message") != "")
    counts = rows.groupBy(paths.leading_token(F.col("message")).alias("path")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "path").limit(k)


def stats(
    df: DataFrame, as_of: datetime, hours: int = STATS_HOURS, zone: str = "UTC", buckets: int | None = None
) -> DataFrame:
    """All parts of the dashboard in one row, from one scan.

    The scan is grouped two ways at once: by (hour, source), which is small and yields every part but
    the last, and by leading token. Tokens may be many; only their top-n goes on. What is finally put
    into arrays is one count per hour, 7 weekdays, the sources and the top paths.
    """
    hours = hours if hours > 0 else STATS_HOURS
    shown = bucket_count(as_of, hours, buckets)
    first = times.to_ms(window_start(as_of, hours)) // times.HOUR_MS
    rows = recent(df, as_of, hours).select(
        times.epoch_hour(F.col("ts")).alias("hour"),
        "source",
        F.when(F.col("message") != "", paths.leading_token(F.col("message"))).alias("path"),
    )
    grouped = (
        rows.groupingSets([[F.col("hour"), F.col("source")], [F.col("path")]], "hour", "source", "path")
        # The kind is an aggregate, not a key: a filter on it stays above the shuffle, which both uses share.
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.grouping("path")).alias("kind"))
    )
    cells = grouped.where(F.col("kind") == 1).select(
        F.when(F.col("hour") < first + shown, F.col("hour")).alias("hour"),
        times.weekday_of_hour(F.col("hour")).alias("weekday"),
        "source",
        "n",
    )
    sums = cells.groupingSets(
        [[F.col("hour")], [F.col("weekday")], [F.col("source")], []], "hour", "weekday", "source"
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("part"))
    top = (
        grouped.where(F.when(F.col("kind") == 0, F.col("path")).isNotNull())
        .select("path", "n")
        .orderBy(F.desc("n"), "path")
        .limit(TOP_PATHS)
    )
    # Grouping ids: one bit per column that is not grouped, the first column highest.
    of_hour, of_weekday, of_source, of_all = (F.col("part") == part for part in (0b011, 0b101, 0b110, 0b111))
    bundle = sums.unionByName(top, allowMissingColumns=True).agg(
        F.max(F.when(of_all, F.col("n"))).alias("total"),
        _counts(of_hour & F.col("hour").isNotNull(), "hour").alias("hours"),
        _counts(of_weekday, "weekday").alias("days"),
        _ranked(of_source, "source").alias("sources"),
        _ranked(F.col("part").isNull(), "path").alias("paths"),
    )
    hour_list = F.sequence(F.lit(first), F.lit(first + shown - 1))
    day_list = F.sequence(F.lit(0), F.lit(6))

    def filled(counts: str, key: Column) -> Column:
        return F.coalesce(F.element_at(counts, key), F.lit(0)).alias("count")

    return bundle.select(
        F.coalesce("total", F.lit(0)).alias("total"),
        F.transform(hour_list, lambda h: F.struct(times.hour_label(h, zone).alias("label"), filled("hours", h))).alias("hourly"),
        F.transform(day_list, lambda d: F.struct(times.weekday_label(d).alias("label"), filled("days", d))).alias("weekly"),
        _by_rank("sources", "source").alias("by_source"),
        _by_rank("paths", "path").alias("top_paths"),
        F.lit(hours * 3600).alias("window_sec"),
    )


def _counts(part: Column, key: str) -> Column:
    return F.map_from_entries(F.collect_list(F.when(part, F.struct(F.col(key), F.col("n")))))


def _ranked(part: Column, label: str) -> Column:
    return F.array_sort(F.collect_list(F.when(part, F.struct((-F.col("n")).alias("rank"), F.col(label)))))


def _by_rank(ranked: str, label: str) -> Column:
    """Highest count first, then by name."""
    return F.transform(ranked, lambda r: F.struct(r[label].alias(label), (-r["rank"]).alias("count")))


def source_overview(df: DataFrame) -> DataFrame:
    """Events and latest time per source, by name."""
    return (
        df.groupBy("source")
        .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
        .orderBy("source")
    )
