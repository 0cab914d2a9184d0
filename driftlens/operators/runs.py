"""Greedy spacing over sorted positions, cut so that no task holds a whole key.

De-duplication and alert firing are both "take the first position, then always the next one at least
``gap`` further on". De-duplication counts positions in milliseconds, alerts in matched events.

Each key's positions are cut into chunks of a fixed width. Nearly everything is then decided by window
functions inside a chunk: a row after a pause of ``gap`` is always taken, and every row closer than
``gap`` to such a row is not. Only runs longer than ``gap`` are left. Their chunks are first summed up in
small tables, one per chunk, saying where the fold leaves off for each place it may come in; walking a
key's tables tells how every chunk is entered, and with that all chunks are folded side by side.

Python sees numbers only, in Arrow batches, and only where there are long runs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from driftlens.functions.times import int_div

# Narrowest chunk, in positions, and its width in gaps.
MIN_CHUNK = 1 << 20
GAPS_PER_CHUNK = 8
# An entry that bars nothing: the chunk is entered with no earlier choice in reach.
FREE = -(1 << 62)

TABLE_TYPE = T.StructType([
    T.StructField("upper", T.ArrayType(T.LongType())), T.StructField("exit", T.ArrayType(T.LongType()))
])


def chunk_width(gap: Column, min_chunk: int = MIN_CHUNK) -> Column:
    return F.greatest(gap.cast("bigint") * GAPS_PER_CHUNK, F.lit(min_chunk))


def place_in_chunks(df: DataFrame, pos: str, gap: Column, min_chunk: int = MIN_CHUNK) -> DataFrame:
    """Add ``_gap``, ``_chunk``, ``_from`` (first position of the chunk) and ``_halo``.

    Rows within two gaps of the end are also copied into the next chunk, marked ``_halo``.
    """
    width, at = F.col("_width"), F.col(pos)
    df = df.withColumns({"_gap": gap.cast("bigint"), "_width": chunk_width(gap, min_chunk)})
    number = int_div(at, width)
    own = F.struct(number.alias("no"), F.lit(False).alias("halo"))
    copy = F.struct((number + 1).alias("no"), F.lit(True).alias("halo"))
    near_end = at >= (number + 1) * width - 2 * F.col("_gap")
    df = df.withColumn("_at", F.explode(F.when(near_end, F.array(own, copy)).otherwise(F.array(own))))
    return df.withColumns({
        "_chunk": F.col("_at.no"), "_from": F.col("_at.no") * width, "_halo": F.col("_at.halo")
    }).drop("_at", "_width")


def _with_starts(placed: DataFrame, keys: Sequence[str], pos: str, tie: Sequence[str] = ()) -> DataFrame:
    """Add ``_start`` (a pause of at least the gap lies before the row), ``_anchor`` (latest start) and
    ``_again`` (the row repeats the position before it)."""
    window = Window.partitionBy(*keys, "_chunk").orderBy(pos, *tie)
    pause = F.col(pos) - F.lag(pos).over(window)
    # The halo shows everything within one gap of rows that are less than one gap before the chunk.
    known = F.col(pos) >= F.col("_from") - F.col("_gap")
    placed = placed.withColumn("_pause", pause)
    placed = placed.withColumns({
        "_start": known & (F.col("_pause").isNull() | (F.col("_pause") >= F.col("_gap"))),
        "_again": F.coalesce(F.col("_pause") == 0, F.lit(False)),
    }).drop("_pause")
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("_anchor", F.max(F.when(F.col("_start"), F.col(pos))).over(running))


def activity_runs(df: DataFrame, keys: list[str], pos: str, gap: Column, min_chunk: int = MIN_CHUNK) -> DataFrame:
    """Add ``run_start``: the position where the row's run began.

    A run ends where the next position of the key is at least ``gap`` away. Positions that may repeat very
    often should be made distinct first, which bounds a chunk by its width. Rows whose run began in an
    earlier chunk take its start from a table with one row per key and occupied chunk.
    """
    marked = _with_starts(place_in_chunks(df, pos, gap, min_chunk), keys, pos).where(~F.col("_halo"))
    latest = marked.groupBy(*keys, "_chunk").agg(F.max("_anchor").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(*keys, "_chunk", F.max("_last").over(earlier).alias("_carried"))
    return (
        marked.join(carried, [*keys, "_chunk"], "left")
        .withColumn("run_start", F.coalesce("_anchor", "_carried"))
        .select(*df.columns, "run_start")
    )


def select_spaced(
    df: DataFrame,
    keys: list[str],
    pos: str,
    gap: Column,
    min_chunk: int = MIN_CHUNK,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Rows taken when each key takes its first position, then always the next at least ``gap`` later.

    Positions are non-negative; of equal ones in a key the first by ``tie`` counts. ``gap`` is at least 1
    and constant per key.
    """
    group = [*keys, "_chunk"]
    marked = _with_starts(place_in_chunks(df, pos, gap, min_chunk), keys, pos, tie)
    near = F.col("_anchor").isNotNull() & (F.col(pos) - F.col("_anchor") < F.col("_gap"))
    rows = marked.where(~F.col("_halo") & ~F.col("_again") & (F.col("_start") | ~near)).drop("_anchor", "_again", "_halo")

    tables = (
        rows.where(~F.col("_start"))
        .groupBy(*group)
        .agg(
            F.sort_array(F.collect_list(pos)).alias("_at"),
            F.first("_gap").alias("_gap"),
            F.first("_from").alias("_from"),
            # Needs every column, so that this branch and the one below read the very same shuffle.
            F.bit_xor(F.xxhash64(*df.columns)).alias("_all"),
        )
        .select(*group, _exit_table("_at", "_gap", "_from", "_all").alias("_table"))
    )
    entries = chain_entries(tables, keys, FREE)

    # Partitioning and order are there from the window already and the sort only states them. A left join,
    # as an inner one would filter this side for nulls and thereby need a shuffle of its own.
    ordered = rows.join(entries, group, "left").sortWithinPartitions(*group, pos)
    head = F.row_number().over(Window.partitionBy(*group).orderBy(pos)) == 1
    ordered = ordered.withColumn("_head", head).withColumn("_entry", F.coalesce("_entry", F.lit(FREE)))
    taken = ordered.withColumn("_taken", _replay("_head", "_start", pos, "_gap", "_from", "_entry"))
    return taken.where("_taken").select(*df.columns)


def chain_entries(tables: DataFrame, keys: list[str], initial: int) -> DataFrame:
    """Walk each key's chunk tables in order and say with which state every chunk is entered.

    A table maps a state to the state after the chunk: the first ``upper`` not below the state picks the
    ``exit``; a state above all of them passes unchanged. After a missing chunk the state is ``initial``
    again. The input is one row per unsettled chunk, read as a stream.
    """
    schema = T.StructType([*[tables.schema[k] for k in [*keys, "_chunk"]], T.StructField("_entry", T.LongType())])
    walk = tables.select(*keys, "_chunk", F.col("_table.upper").alias("_upper"), F.col("_table.exit").alias("_exit"))
    walk = walk.repartition(*keys).sortWithinPartitions(*keys, "_chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, state = None, None, initial
        for batch in batches:
            entry = []
            columns = [batch[c] for c in [*keys, "_chunk", "_upper", "_exit"]]
            for *this, number, upper, leave in zip(*columns):
                if this != key or number != chunk + 1:
                    state = initial
                key, chunk = this, number
                entry.append(state)
                at = bisect_left(upper, state)
                if at < len(upper):
                    state = int(leave[at])
            yield batch[[*keys, "_chunk"]].assign(_entry=np.array(entry, dtype="int64"))

    return walk.mapInPandas(run, schema)


@F.pandas_udf(TABLE_TYPE)
def _exit_table(at: pd.Series, gap: pd.Series, start: pd.Series, _all: pd.Series) -> pd.DataFrame:
    """The table of one chunk per row, from its sorted unsettled positions."""
    uppers, exits = [], []
    for line, step, first in zip(at, gap, start):
        line = np.asarray(line)
        index = np.arange(len(line))
        following = np.searchsorted(line, line + step)
        # Follow the choices to the last one inside the chunk, doubling the stride each time.
        final = np.where(following < len(line), following, index)
        while not np.array_equal(final[final], final):
            final = final[final]
        leave = line[final] + step
        # A state reaches at most one gap into the chunk: rows up to there, and the first beyond.
        reach = min(int(np.searchsorted(line, first + step)) + 1, len(line))
        keep = np.append(np.flatnonzero(np.diff(leave[:reach])), reach - 1)
        uppers.append(line[keep])
        exits.append(leave[keep])
    return pd.DataFrame({"upper": uppers, "exit": exits})


@F.pandas_udf(T.BooleanType())
def _take(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Fold rows sorted by chunk and position; the state runs on from batch to batch.

    ``head`` marks the first row of a chunk, entered with ``entry``; ``start`` rows are always taken.
    """
    bar = FREE
    for head, start, pos, gap, first, entry in batches:
        head, start, pos, gap, first, entry = (c.to_numpy() for c in (head, start, pos, gap, first, entry))
        if not len(pos):
            yield pd.Series([], dtype=bool)
            continue
        # Stretches that do not depend on each other, laid out on one line too far apart to interact.
        opens = head | start
        opens[0] = True
        bounds = np.flatnonzero(opens)
        number = np.cumsum(opens) - 1
        offset = pos - first
        stride = int(offset.max() + gap.max()) + 2
        line = number * stride + offset
        bars = np.where(start[bounds], pos[bounds], entry[bounds])
        if not head[0] and not start[0]:
            bars[0] = bar
        ends = np.append(bounds[1:], len(pos))
        at = np.searchsorted(line, np.maximum(bars - first[bounds], 0) + np.arange(len(bounds)) * stride)
        following = np.searchsorted(line, line + gap)
        taken = np.zeros(len(pos), dtype=bool)
        stretch = np.arange(len(bounds))
        live = at < ends
        # All stretches of the batch step forward together.
        while live.any():
            at, ends, stretch = at[live], ends[live], stretch[live]
            taken[at] = True
            bars[stretch] = pos[at] + gap[at]
            at = following[at]
            live = at < ends
        bar = bars[-1]
        yield pd.Series(taken)


# Depends on the order of rows, so it must stay where it is put.
_replay = _take.asNondeterministic()


def whole_groups(batches: Iterator[pd.DataFrame], group: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Regroup sorted batches so that no group is cut; yields rows and their group numbers from 0."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = int(np.flatnonzero(_changes(batch[group]))[-1])
        if last == 0 and rest and tuple(rest[-1][group].iloc[-1]) == tuple(batch[group].iloc[0]):
            rest.append(batch)
            continue
        ready = pd.concat([*rest, batch.iloc[:last]], ignore_index=True)
        rest = [batch.iloc[last:]]
        if len(ready):
            yield ready, np.cumsum(_changes(ready[group])) - 1
    if rest:
        ready = pd.concat(rest, ignore_index=True)
        yield ready, np.cumsum(_changes(ready[group])) - 1


def _changes(keys: pd.DataFrame) -> np.ndarray:
    changed = keys.ne(keys.shift()).any(axis=1).to_numpy()
    changed[0] = True
    return changed
