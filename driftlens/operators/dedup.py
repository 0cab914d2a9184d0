"""De-duplication of repeated events within a time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from driftlens.functions.times import int_div
from driftlens.operators.ordering import HOT_ROWS, split_hot
from driftlens.operators.runs import MIN_CHUNK, chunk_width, select_spaced


def dedup_window(df: DataFrame, window_ms: int, min_chunk: int = MIN_CHUNK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Drop events repeating the level and message of one kept less than ``window_ms`` before.

    The source does not matter, a dropped event does not extend the window, and rows are taken in
    (ts, id) order. A window of 0 or less keeps everything.
    """
    if window_ms <= 0:
        return df
    # Sorting compares a number first and texts only where it is equal.
    rows = df.withColumns({"_key": F.xxhash64("level", "message"), "_ms": F.unix_millis("ts")})
    rows = rows.withColumn("_part", int_div(F.col("_ms"), chunk_width(F.lit(window_ms), min_chunk)))
    calm, hot = split_hot(rows, ["_key", "_part"], hot_rows)
    if hot is not None:
        # In one millisecond only the first event of a key can survive. Spark takes that top-1 before the
        # shuffle already, which leaves a chunk with at most as many rows as it has milliseconds.
        tied = Window.partitionBy("_key", "_ms", "level", "message").orderBy("id")
        firsts = hot.withColumn("_nth", F.row_number().over(tied)).where(F.col("_nth") == 1).drop("_nth")
        calm = calm.unionByName(firsts.select(*calm.columns))
    kept = select_spaced(calm.drop("_part"), ["_key", "level", "message"], "_ms", F.lit(window_ms), min_chunk, ["id"])
    return kept.select(*df.columns)
