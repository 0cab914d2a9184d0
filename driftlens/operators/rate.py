"""Event rates, their latest samples, and a latch on a metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from driftlens.functions.times import int_div
from driftlens.operators.stats import zero_fill
from driftlens.schema import LATCH_THRESHOLD, RATE_SAMPLES

_BLOCK = 3600


def event_rate(df: DataFrame, step_ms: int = 1000) -> DataFrame:
    """Events per interval from the first to the last event, intervals without events giving 0."""
    slots = df.groupBy(int_div(F.unix_millis("ts"), step_ms).alias("slot")).agg(F.count(F.lit(1)).alias("events"))
    # The spine grows in two steps, blocks of slots and then slots, so that tasks share its making.
    ends = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).where(F.col("a").isNotNull())
    first, last = (int_div(F.unix_millis(c), step_ms) for c in ("a", "b"))
    blocks = ends.select(
        first.alias("first"), last.alias("last"),
        F.explode(F.sequence(int_div(first, _BLOCK), int_div(last, _BLOCK))).alias("block"),
    ).repartition("block")
    start = F.greatest(F.col("first"), F.col("block") * _BLOCK)
    stop = F.least(F.col("last"), F.col("block") * _BLOCK + (_BLOCK - 1))
    spine = blocks.select(F.explode(F.sequence(start, stop)).alias("slot"))
    filled = zero_fill(slots, spine, "slot", "events")
    return filled.select(F.timestamp_millis(F.col("slot") * step_ms).alias("ts"), "events", (F.col("events") * 1000.0 / step_ms).alias("events_sec"))


def rate_samples(rate: DataFrame, n: int = RATE_SAMPLES) -> DataFrame:
    """The last ``n`` samples, oldest first, with their maximum for scaling."""
    n = n if n > 0 else RATE_SAMPLES
    last = rate.orderBy(F.desc("ts")).limit(n)
    # A window over at most n rows.
    return last.withColumn("max_events", F.max("events").over(Window.partitionBy())).orderBy("ts")


def threshold_latch(samples: DataFrame, value_col: str, threshold: float = LATCH_THRESHOLD) -> DataFrame:
    """Whether a metric ever reached the threshold, when it first did, and the threshold."""
    crossed = F.col(value_col) >= threshold
    return samples.agg(
        F.coalesce(F.bool_or(crossed), F.lit(False)).alias("warned"),
        F.min(F.when(crossed, F.col("ts"))).alias("first_ts"),
        F.lit(threshold).alias("threshold"),
    )
