"""The event table, raw text lines, and the union of sources."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from driftlens.functions import times
from driftlens.operators.ordering import with_ordinal
from driftlens.schema import EVENT_SCHEMA, LOG_SCHEMA, RETENTION_DAYS
from driftlens.session import files, scratch_path

# Layout: <table>/dt=<UTC date>/writer=<name>/batch=<n>/. A batch of a writer is written whole and can be written again.
# <table>/_ids/ holds an empty file per batch whose name tells the ids given to it: <last>-<first>-<writer>-<batch>.
TABLE_SCHEMA = T.StructType([
    *LOG_SCHEMA.fields, T.StructField("dt", T.DateType()), T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())
])
PARTS = ["dt", "writer", "batch"]
MANUAL = "manual"
COMPACTED = "compacted"


def read_log_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored events, with ``dt`` for partition pruning."""
    return spark.read.schema(TABLE_SCHEMA).parquet(path).drop("writer", "batch")


def stamp_missing_ts(df: DataFrame) -> DataFrame:
    """Events without a time get the time of arrival; the only use of the clock in the library."""
    return df.withColumn("ts", F.coalesce("ts", F.current_timestamp()))


def read_log_lines(
    spark: SparkSession, path: str, source: str, level: str = "stdout", stream: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """Raw text lines as events; lines of white space only are dropped. As a stream with at most so many files a micro-batch."""
    reader = spark.readStream if stream else spark.read
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.format("text").schema("value string").option("lineSep", "\n").load(path)
    message = F.regexp_replace("value", "\r$", "")
    events = lines.where(F.col("value").rlike(r"(?U)\S")).select(
        F.lit(None).cast("timestamp").alias("ts"),
        F.lit(source).alias("source"),
        F.lit(level).alias("level"),
        message.alias("message"),
    )
    return stamp_missing_ts(events)


def register_source(sources: Mapping[str, DataFrame], name: str, df: DataFrame) -> dict[str, DataFrame]:
    """Add a user's own source as ``plugin:<name>``; a name already taken is refused."""
    full = name if name.startswith("plugin:") else f"plugin:{name}"
    if full in sources:
        raise ValueError(f"source already registered: {full}")
    return {**sources, full: df}


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All sources as one event DataFrame (batch or stream), each row naming its source."""
    columns = EVENT_SCHEMA.names
    named = [df.withColumn("source", F.lit(name)).select(*columns) for name, df in sources.items()]
    if not named:
        raise ValueError("no sources")
    result = named[0]
    for df in named[1:]:
        result = result.unionByName(df)
    return result


def union_live(sources: Mapping[str, DataFrame], watermark: str, wait_for_slowest: bool = True) -> DataFrame:
    """All live sources as one stream, each with a watermark of its own.

    The stream's watermark is that of the slowest source, so that a source which lags behind loses nothing; a source
    that falls silent then holds it back. Without ``wait_for_slowest`` it is that of the fastest. The choice is a setting
    of the session and goes for all queries started from now on.
    """
    marked = {name: df.withWatermark("ts", watermark) for name, df in sources.items()}
    union = union_sources(marked)
    union.sparkSession.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min" if wait_for_slowest else "max")
    return union


def _partitions(spark: SparkSession, pattern: str) -> list[str]:
    """Folders matching a pattern: table metadata only."""
    path, fs = files(spark)
    return [status.getPath().toString() for status in fs(pattern).globStatus(path(pattern)) or []]


def _value(folder: str, key: str) -> str:
    return folder.split(f"{key}=")[-1].split("/")[0]


def _given(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[int, int]]:
    """(writer, batch) -> (first, last) of the ids given so far, from file names alone."""
    given = {}
    for name in _partitions(spark, f"{path}/_ids/*-*-*-*"):
        last, first, writer, batch = name.rsplit("/", 1)[-1].split("-")
        given[writer, int(batch)] = max(given.get((writer, int(batch)), (0, 0)), (int(first), int(last)))
    return given


def append_logs(df: DataFrame, path: str, batch: int | None = None, writer: str = MANUAL) -> int:
    """Append events with ids above all that were ever given, rising in time order; returns the batch.

    A batch belongs to its writer: only the same writer giving the same number again replaces it, with the same ids, which
    makes a retried streaming batch harmless and leaves what others wrote alone. Without a number a batch gets the
    writer's next one. Ids are noted down before the rows are written, so neither retention nor a failed write makes
    them come twice. Appends to one table come one after the other.
    """
    if not re.fullmatch("[A-Za-z0-9_]+", writer) or writer == COMPACTED:
        raise ValueError(f"not a writer's name: {writer}")
    spark = df.sparkSession
    given = _given(spark, path)
    if batch is None:
        batch = max((number for name, number in given if name == writer), default=-1) + 1
    rows = stamp_missing_ts(df).select(*EVENT_SCHEMA.names)
    rows = rows.withColumn("ts", F.timestamp_millis(F.unix_millis("ts")))
    # Arrival order decides between equal times, and keeps copies of one event from piling up in a task.
    rows = rows.withColumn("_arrival", F.monotonically_increasing_id())
    numbered = with_ordinal(rows, [], [F.col("ts"), F.col("_arrival")], "_nth")
    count = numbered.count()
    path_of, fs = files(spark)
    if (writer, batch) in given:
        first, last = given[writer, batch]
        # A retry may bring other days than the attempt before.
        for folder in _partitions(spark, f"{path}/dt=*/writer={writer}/batch={batch}"):
            fs(folder).delete(path_of(folder), True)
    if (writer, batch) not in given or last - first + 1 < count:
        first = max((last for _, last in given.values()), default=0) + 1
        mark = f"{path}/_ids/{first + count - 1}-{first}-{writer}-{batch}"
        fs(mark).create(path_of(mark), True).close()
    placed = numbered.select(
        (F.col("_nth") + first).alias("id"), *EVENT_SCHEMA.names, times.utc_date(F.col("ts")).alias("dt"),
        F.lit(writer).alias("writer"), F.lit(batch).cast("bigint").alias("batch"),
    )
    _replace_parts(placed, path)
    return batch


def _replace_parts(rows: DataFrame, path: str) -> None:
    """Write exactly the partitions that occur in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def append_stream(path: str, writer: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that appends each micro-batch once.

    The writer is by default the streaming query itself: its identity is kept in its checkpoint, so a restarted query goes
    on as the same writer and one with a new checkpoint is another writer. A micro-batch is kept while it is appended, which
    reads it more than once: what made it, and its state, would else run again each time.
    """
    def handle(df: DataFrame, batch_id: int) -> None:
        query = writer or df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise RuntimeError("name the writer: the query's identity is not known here")
        df.persist()
        try:
            append_logs(df, path, batch_id, query.replace("-", "_"))
        finally:
            df.unpersist()

    return handle


def compact_days(spark: SparkSession, path: str, before: date) -> int:
    """Merge the batches of each day before ``before`` into one; returns the number of days merged.

    For days that no writer adds to any more. A day is first written in full beside its batches and then these are
    removed; run again after a failure in between, it drops the rows that are there twice. Marks of ids are kept for
    the last batch of each writer only.
    """
    path_of, fs = files(spark)
    days: dict[str, list[str]] = {}
    for folder in _partitions(spark, f"{path}/dt=*/writer=*/batch=*"):
        days.setdefault(_value(folder, "dt"), []).append(folder)
    closed = {day: parts for day, parts in days.items() if day < before.isoformat() and len(parts) > 1}
    if closed:
        staged = scratch_path(spark, "compact")
        parts = [p for parts in closed.values() for p in parts]
        whole = spark.read.schema(TABLE_SCHEMA).option("basePath", path).parquet(*parts).dropDuplicates(["dt", "id"])
        whole.withColumns({"writer": F.lit(COMPACTED), "batch": F.lit(0).cast("bigint")}).repartition("dt").write.partitionBy(*PARTS).parquet(staged)
        _replace_parts(spark.read.schema(TABLE_SCHEMA).parquet(staged), path)
        for folder in parts:
            if (_value(folder, "writer"), _value(folder, "batch")) != (COMPACTED, "0"):
                fs(folder).delete(path_of(folder), True)
        fs(staged).delete(path_of(staged), True)
    given = _given(spark, path)
    newest = {name: max(number for other, number in given if other == name) for name, _ in given}
    top = max((last for _, last in given.values()), default=0)
    for (name, number), (first, last) in given.items():
        if number < newest[name] and last < top:
            mark = f"{path}/_ids/{last}-{first}-{name}-{number}"
            fs(mark).delete(path_of(mark), False)
    return len(closed)


def cutoff(as_of: datetime, retention_days: int = RETENTION_DAYS) -> datetime:
    return as_of - timedelta(days=retention_days if retention_days > 0 else RETENTION_DAYS)


def prune(df: DataFrame, as_of: datetime, retention_days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one row with the number ``deleted``): rows strictly before the cutoff go."""
    old = F.col("ts") < times.at_ms(times.to_ms(cutoff(as_of, retention_days)))
    return df.where(~old), df.agg(F.count_if(old).alias("deleted"))


def prune_table(spark: SparkSession, path: str, as_of: datetime, retention_days: int = RETENTION_DAYS) -> int:
    """Apply retention to a stored table; returns the number of rows deleted.

    Whole days before the cutoff are removed as folders. Only the day of the cutoff is rewritten: into the
    shared folder first and from there over its partitions.
    """
    moment = times.to_ms(cutoff(as_of, retention_days))
    day = _day(moment)
    path_of, fs = files(spark)
    gone = [f for f in _partitions(spark, f"{path}/dt=*") if _value(f, "dt") < day]
    edge = _partitions(spark, f"{path}/dt={day}/writer=*/batch=*")
    reader = spark.read.schema(TABLE_SCHEMA).option("basePath", path)
    # Row counts of whole files come from their footers.
    deleted = reader.parquet(*gone).count() if gone else 0
    if edge:
        kept, count = prune(reader.parquet(*edge), as_of, retention_days)
        dropped = count.first().deleted
        if dropped:
            deleted += dropped
            staged = scratch_path(spark, "prune")
            kept.write.partitionBy(*PARTS).parquet(staged)
            left = {folder.split("/dt=")[-1] for folder in _partitions(spark, f"{staged}/dt=*/writer=*/batch=*")}
            if left:
                _replace_parts(spark.read.schema(TABLE_SCHEMA).parquet(staged), path)
            gone += [folder for folder in edge if folder.split("/dt=")[-1] not in left]
            fs(staged).delete(path_of(staged), True)
    for folder in gone:
        fs(folder).delete(path_of(folder), True)
    return deleted


def _day(ms: int) -> str:
    return (datetime(1970, 1, 1) + timedelta(milliseconds=ms)).date().isoformat()
