"""Rule alerts: "``min_events`` matches within ``window_sec`` seconds"."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from driftlens.functions.text import alert_message
from driftlens.operators.ordering import first_n, with_ordinal
from driftlens.operators.predicates import not_alert_source
from driftlens.operators.rule_index import GRAM, candidates, pattern_index
from driftlens.operators.runs import MIN_CHUNK, TABLE_TYPE, chain_entries, place_in_chunks, select_spaced, whole_groups
from driftlens.schema import ALERT_SOURCE

# Rules beyond this number are joined in several rounds, each with a broadcast of at most this size.
MAX_BROADCAST_RULES = 10_000
# Rules from which on an index over their patterns pays; see the README for the figures.
INDEX_FROM = 512

FIRED_COLUMNS = ["id", "name", "count", "fired_at", "last", "sound", "event_id", "rule_no"]


def match_rules(df: DataFrame, rules: DataFrame, total: int | None = None, index_from: int = INDEX_FROM) -> DataFrame:
    """One row per event and rule it matches; empty rule parts match anything.

    The rules carry their columns over with the prefix ``rule_``. Alert events never match. ``total`` is the number of
    rules at most, where the caller has counted them. From ``index_from`` rules on, those with a pattern of three
    characters or more are found through an index over their patterns; the others are compared one by one.
    """
    named = rules.select(
        "rule_no",
        F.col("id").alias("rule_id"),
        F.col("name").alias("rule_name"),
        F.col("pattern").alias("_pattern"),
        F.col("source").alias("_source"),
        F.col("level").alias("_level"),
        "min_events",
        "window_sec",
        "sound",
    )
    events = df.where(not_alert_source())
    matches = (
        ((F.col("_pattern") == "") | F.col("message").contains(F.col("_pattern")))
        & ((F.col("_source") == "") | (F.col("source") == F.col("_source")))
        & ((F.col("_level") == "") | (F.col("level") == F.col("_level")))
    )
    if total is None:
        total = (named.agg(F.max("rule_no").alias("last")).first().last or 0) + 1
    plain, joined = named, []
    if total >= index_from:
        for part in _rounds(pattern_index(named, "_pattern", "rule_no"), total):
            joined.append(candidates(events, "message", part, matches))
        plain = named.where(F.length("_pattern") < GRAM)
    if not joined or not plain.isEmpty():
        joined += [events.join(F.broadcast(part), matches) for part in _rounds(plain, total)]
    result = joined[0]
    for part in joined[1:]:
        result = result.unionByName(part)
    return result.drop("_pattern", "_source", "_level")


def _rounds(rules: DataFrame, total: int) -> list[DataFrame]:
    """The rules in parts small enough for a broadcast each."""
    if total <= MAX_BROADCAST_RULES:
        return [rules]
    starts = range(0, total, MAX_BROADCAST_RULES)
    return [rules.where(F.col("rule_no").between(start, start + MAX_BROADCAST_RULES - 1)) for start in starts]


def fire_alerts(df: DataFrame, rules: DataFrame, min_chunk: int = MIN_CHUNK) -> DataFrame:
    """Alerts fired over a table, counting in (ts, id) order.

    A rule fires when ``min_events`` matches lie within its window (inclusive) and then counts from
    zero. Rules with the same id share one counter.
    """
    kind = Window.partitionBy("id")
    variants = F.size(F.collect_set(F.struct("min_events", "window_sec")).over(kind))
    rules = rules.withColumn("_mixed", variants > 1)
    shapes = rules.agg(
        # Rule numbers run from 0 over the whole list.
        (F.coalesce(F.max("rule_no"), F.lit(-1)) + 1).alias("total"),
        F.bool_or(F.col("_mixed")).alias("mixed"),
        F.bool_or(~F.col("_mixed") & (F.col("min_events") > 1)).alias("counting"),
        F.bool_or(~F.col("_mixed") & (F.col("min_events") == 1)).alias("single"),
    ).first()

    parts = []
    if shapes.single:
        # Every match fires: a projection, with nothing to count.
        ones = match_rules(df, rules.where(~F.col("_mixed") & (F.col("min_events") == 1)), shapes.total)
        parts.append(_fired(_matched(ones), F.lit(1)))
    if shapes.counting:
        many = match_rules(df, rules.where(~F.col("_mixed") & (F.col("min_events") > 1)), shapes.total)
        parts.append(_fired(_count_same(_numbered(many), min_chunk), F.col("min_events")))
    if shapes.mixed:
        odd = match_rules(df, rules.where("_mixed"), shapes.total)
        parts.append(_fired(_count_mixed(_numbered(odd), min_chunk), F.col("_count")))
    if not parts:
        parts.append(_fired(_matched(match_rules(df, rules)), F.lit(1)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _matched(matches: DataFrame) -> DataFrame:
    return matches.select(
        "rule_id", "rule_no", "rule_name", "min_events", (F.col("window_sec") * F.lit(1000).cast("bigint")).alias("_span"),
        "sound", "id", "ts", F.unix_millis("ts").alias("_ms"), "message",
    )


def _numbered(matches: DataFrame) -> DataFrame:
    order = [F.col("_ms"), F.col("id"), F.col("rule_no")]
    return with_ordinal(_matched(matches), ["rule_id"], order, "_nth")


def _fired(rows: DataFrame, count) -> DataFrame:
    return rows.select(
        F.col("rule_id").alias("id"),
        F.col("rule_name").alias("name"),
        count.cast("int").alias("count"),
        F.timestamp_millis("_ms").alias("fired_at"),
        F.col("message").alias("last"),
        "sound",
        F.col("id").alias("event_id"),
        "rule_no",
    )


def _count_same(numbered: DataFrame, min_chunk: int) -> DataFrame:
    """Ids whose rules agree on count and window.

    A match can complete an alert when the match ``min_events - 1`` before it is still in the window.
    Of those, alerts fire greedily at least ``min_events`` matches apart.
    """
    # Only numbers take part in this; the alerts' other columns are joined on at the end.
    narrow = numbered.select("rule_id", "_nth", "_ms", "_span", F.col("min_events").cast("bigint").alias("min_events"))
    earlier = narrow.select(
        "rule_id", (F.col("_nth") + F.col("min_events") - 1).alias("_nth"), F.col("_ms").alias("_first_ms")
    )
    complete = (
        narrow.join(earlier, ["rule_id", "_nth"])
        .where(F.col("_ms") - F.col("_first_ms") <= F.col("_span"))
        .select("rule_id", "_nth", "min_events")
    )
    fired = select_spaced(complete, ["rule_id"], "_nth", F.col("min_events"), min_chunk)
    return numbered.join(fired.select("rule_id", "_nth"), ["rule_id", "_nth"])


def _count_mixed(numbered: DataFrame, min_chunk: int) -> DataFrame:
    """Ids whose rules differ in count or window, so that each match may prune and fire differently.

    What a shared counter holds is always the latest few matches, so its state is one small number.
    Every chunk of matches is folded once per possible number to find how it is left, and once more
    with the number it is really entered with.
    """
    # Per id: the most matches its counter can hold. The rules table is small.
    most = numbered.groupBy("rule_id").agg(F.max("min_events").alias("_most"))
    placed = place_in_chunks(numbered.join(F.broadcast(most), "rule_id"), "_nth", F.col("_most"), min_chunk)
    group = ["rule_id", "_chunk"]
    placed = placed.repartition(*group).sortWithinPartitions(*group, "_nth")
    schema = T.StructType([*[placed.schema[k] for k in group], T.StructField("_table", TABLE_TYPE)])

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, numbers in whole_groups(batches, group):
            for _, part in rows.groupby(numbers, sort=False):
                states = np.arange(int(part["_most"].iloc[0]))
                leaves = np.array([_count_chunk(part, int(s))[1] for s in states])
                yield part[group].head(1).assign(_table=[{"upper": states, "exit": leaves}])

    entries = chain_entries(placed.mapInPandas(tables, schema), ["rule_id"], 0)
    columns = numbered.columns
    fired_schema = T.StructType([*numbered.schema.fields, T.StructField("_count", T.LongType())])

    def fire(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, numbers in whole_groups(batches, group):
            for _, part in rows.groupby(numbers, sort=False):
                fired, _ = _count_chunk(part, int(part["_entry"].iloc[0]))
                if fired:
                    at, count = zip(*fired)
                    yield part.iloc[list(at)][columns].assign(_count=np.array(count, dtype="int64"))

    return placed.join(entries, group).sortWithinPartitions(*group, "_nth").mapInPandas(fire, fired_schema)


def _count_chunk(rows: pd.DataFrame, carried: int) -> tuple[list[tuple[int, int]], int]:
    """Fold one chunk, entered holding the last ``carried`` matches before it."""
    times, spans, needed = (rows[c].to_numpy() for c in ("_ms", "_span", "min_events"))
    first_own = int(rows["_halo"].to_numpy().sum())
    oldest = max(first_own - carried, 0)
    fired = []
    for at in range(first_own, len(times)):
        while times[oldest] < times[at] - spans[at]:
            oldest += 1
        held = at - oldest + 1
        if held >= needed[at]:
            fired.append((at, held))
            oldest = at + 1
    return fired, len(times) - oldest


def alert_events(fired: DataFrame) -> DataFrame:
    """One ``alert`` event per fired alert."""
    return fired.select(
        F.lit(None).cast("bigint").alias("id"),
        F.col("fired_at").alias("ts"),
        F.lit(ALERT_SOURCE).alias("source"),
        F.lit("warn").alias("level"),
        alert_message(F.col("name"), F.col("count"), F.col("last")).alias("message"),
    )


def alert_feedback(df: DataFrame, fired: DataFrame) -> DataFrame:
    """Events plus one ``alert`` event per fired alert; those never count toward rules again."""
    return df.unionByName(alert_events(fired).select(*df.columns))


def alert_history(fired: DataFrame, cap: int | None = None) -> DataFrame:
    """Alerts, newest first; with a ``cap`` only the latest so many."""
    newest = [F.desc("fired_at"), F.desc("event_id"), F.desc("rule_no")]
    return (fired if cap is None else first_n(fired, cap, newest)).orderBy(*newest)


def alert_count(fired: DataFrame, cap: int | None = None) -> DataFrame:
    """Number of alerts in the history."""
    kept = fired if cap is None else alert_history(fired, cap)
    return kept.agg(F.count(F.lit(1)).alias("alerts"))
