"""Search, export order and tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftlens.functions.text import render_line
from driftlens.functions.times import clock
from driftlens.operators.ordering import first_n
from driftlens.operators.predicates import search_predicate
from driftlens.schema import TAIL_LINES, TREE_LIMIT, Query


def matching(df: DataFrame, query: Query) -> DataFrame:
    """Rows the query asks for; a table partitioned by ``dt`` is pruned by it."""
    return df.where(search_predicate(query, dated="dt" in df.columns)).drop("dt")


def search_logs(df: DataFrame, query: Query) -> DataFrame:
    """Newest matching rows first, as many as the query asks for."""
    newest = [F.desc("ts"), F.desc("id")]
    return first_n(matching(df, query), query.row_limit, newest).orderBy(*newest)


def export_order(df: DataFrame, query: Query = Query()) -> DataFrame:
    """All matching rows, oldest first."""
    return matching(df, query).orderBy("ts", "id")


def path_drilldown(df: DataFrame, path: str, limit: int = 0) -> DataFrame:
    """Newest events whose message contains the path of a chosen tree node."""
    return search_logs(df, Query(keyword=path, limit=limit))


def tail(df: DataFrame, n: int = TAIL_LINES, length: int | None = None) -> DataFrame:
    """The last ``n`` rows as display lines, oldest first; ``length`` cuts long messages."""
    n = n if n > 0 else TAIL_LINES
    last = first_n(df, n, [F.desc("ts"), F.desc("id")])
    line = render_line(clock(F.col("ts")), F.col("source"), F.col("message"), length)
    return last.withColumn("line", line).orderBy("ts", "id")


def oldest_n(df: DataFrame, n: int = TREE_LIMIT) -> DataFrame:
    """The oldest ``n`` rows."""
    return first_n(df, n if n > 0 else TREE_LIMIT, [F.col("ts"), F.col("id")])
