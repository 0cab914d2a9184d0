"""Exact row numbers and previous rows that hold up when one group has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftlens.session import cut_lineage

# A group above this many rows is numbered across tasks instead of inside one.
HOT_ROWS = 1_000_000
_SLOT_MASK = (1 << 33) - 1


def with_ordinal(df: DataFrame, keys: list[str], order: list[Column], name: str = "ordinal") -> DataFrame:
    """Add the 0-based row number within ``keys`` in the given order.

    Rows are range-partitioned on keys and order together, so a big group simply spans several
    partitions. The sorted rows are checkpointed because partition numbers must not change between
    counting and numbering. Per-partition counts are the only thing broadcast: a sorted group
    occupies adjacent partitions, so there are at most (partitions + groups) of them. Callers keep
    the number of groups small (rules, hot groups) or pass no keys.
    """
    by = [*[F.col(k) for k in keys], *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = placed.withColumns({
        "_part": F.spark_partition_id(),
        "_slot": F.monotonically_increasing_id().bitwiseAND(F.lit(_SLOT_MASK)),
    })
    placed = cut_lineage(placed)
    spans = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_slot").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = spans.select(
        *keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        placed.join(F.broadcast(shifts), [*keys, "_part"])
        .withColumn(name, F.col("_slot") + F.col("_shift"))
        .select(*df.columns, name)
    )


def split_hot(
    df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, probe: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Split rows into (rows of ordinary groups, rows of hot groups or None).

    Hot groups are found with one map-side combined count, over ``probe`` where a cheaper table with at
    least the same rows exists. There can be at most rows / ``hot_rows`` of them, which bounds the broadcast.
    """
    counts = (df if probe is None else probe).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(counts.where(F.col("_n") > hot_rows).select(*keys))
    if hot.isEmpty():
        return df, None
    return df.join(F.broadcast(hot), keys, "left_anti"), df.join(F.broadcast(hot), keys, "left_semi")


def group_row_number(
    df: DataFrame, keys: list[str], order: list[Column], name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """1-based row number within ``keys``: a plain window, except for hot groups."""
    calm, hot = split_hot(df, keys, hot_rows)
    numbered = calm.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    if hot is None:
        return numbered
    spread = with_ordinal(hot, keys, order, name).withColumn(name, F.col(name) + 1)
    return numbered.unionByName(spread)


def previous_row(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    unique: list[str],
    hot_rows: int = HOT_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Add ``prev_<column>`` from the row before within ``keys``; null on the first row.

    Ordinary groups use ``lag``. A hot group is cut into equal slices by its row number, and the last
    row of each slice is handed on to the next slice, so that no task sees the whole group.
    ``unique`` names the columns that identify a row.
    """
    calm, hot = split_hot(df, keys, hot_rows, probe)
    lagged = _lag(calm, Window.partitionBy(*keys).orderBy(*order), columns)
    if hot is None:
        return lagged
    # Only the narrow columns are ordered across tasks; wide ones join back by identity.
    narrow = list(dict.fromkeys([*keys, *order, *unique]))
    ordinals = with_ordinal(hot.select(*narrow), keys, [F.col(c) for c in order], "_ord")
    placed = hot.join(ordinals.select(*keys, *unique, "_ord"), list(dict.fromkeys([*keys, *unique])))
    slice_no = F.floor(F.col("_ord") / hot_rows)
    last = F.pmod(F.col("_ord"), F.lit(hot_rows)) == hot_rows - 1
    own = F.struct(slice_no.alias("no"), F.lit(False).alias("handed"))
    onward = F.struct((slice_no + 1).alias("no"), F.lit(True).alias("handed"))
    sliced = placed.withColumn("_slice", F.explode(F.when(last, F.array(own, onward)).otherwise(F.array(own))))
    sliced = sliced.withColumns({"_no": F.col("_slice.no"), "_handed": F.col("_slice.handed")})
    window = Window.partitionBy(*keys, "_no").orderBy("_ord")
    spread = _lag(sliced, window, columns).where(~F.col("_handed"))
    return lagged.unionByName(spread.select(*lagged.columns))


def _lag(df: DataFrame, window, columns: list[str]) -> DataFrame:
    return df.withColumns({f"prev_{c}": F.lag(c).over(window) for c in columns})


def first_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows in an order that makes rows unique.

    A small ``n`` is a plain top-n. A large one is cut by row number, because a top-n merges all
    its candidates in a single task.
    """
    if n <= HOT_ROWS:
        return df.orderBy(*order).limit(n)
    return with_ordinal(df, [], order, "_ord").where(F.col("_ord") < n).drop("_ord")

