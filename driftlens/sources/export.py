"""Exports: folders whose part files, in name order, hold the rows oldest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftlens.functions.text import csv_field
from driftlens.functions.times import rfc3339
from driftlens.operators.search import export_order, matching
from driftlens.schema import Query

CSV_HEADER = "ts,source,level,message"


def csv_lines(df: DataFrame, query: Query = Query()) -> DataFrame:
    """The export as text lines (column ``value``), header first."""
    fields = [rfc3339(F.col("ts")), *[csv_field(F.col(c)) for c in ("source", "level", "message")]]
    rows = matching(df, query).select(F.lit(1).alias("part"), "ts", "id", F.concat_ws(",", *fields).alias("value"))
    header = df.sparkSession.range(0, 1, 1, 1).select(
        F.lit(0).alias("part"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("id"),
        F.lit(CSV_HEADER).alias("value"),
    )
    return header.unionByName(rows).orderBy("part", "ts", "id").select("value")


def export_csv(df: DataFrame, query: Query, path: str) -> None:
    """Write matching rows as CSV; the part files put together are one CSV file with one header."""
    csv_lines(df, query).write.option("lineSep", "\n").text(path)


def json_rows(df: DataFrame, query: Query = Query()) -> DataFrame:
    return export_order(df, query).select("id", rfc3339(F.col("ts")).alias("ts"), "source", "level", "message")


def export_json(df: DataFrame, query: Query, path: str) -> None:
    """Write matching rows as JSON lines (one object per row, not one array)."""
    json_rows(df, query).write.json(path)
