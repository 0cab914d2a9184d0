"""Alert rules and presets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from driftlens.schema import PRESET_SCHEMA, RULE_FIELDS, RULE_MIN_EVENTS, RULE_SCHEMA, RULE_WINDOW_SEC

# Fixed defaults.
DEFAULT_PRESETS = [
    {"id": "logs", "name": "Log files", "target": "/var/log", "enabled": {"fswatch": True, "logstream": True}, "filter": ""},
    {"id": "caches", "name": "Caches", "target": "/var/folders", "enabled": {"fswatch": True, "watchman": True}, "filter": ""},
    {"id": "temp", "name": "Temp files", "target": "/tmp", "enabled": {"fswatch": True}, "filter": ""},
]


def _listed(spark: SparkSession, given: str | Sequence[Mapping], field: str, fields: T.StructType) -> DataFrame:
    """Rows of a list field of a JSON settings file, or given rows, numbered by ``_no``."""
    shape = T.StructType([T.StructField(field, T.ArrayType(fields))])
    if isinstance(given, str):
        settings = spark.read.schema(shape).option("multiLine", True).json(given)
    else:
        rows = [tuple(row.get(name) for name in fields.names) for row in given]
        settings = spark.createDataFrame([(rows,)], shape)
    return settings.select(F.posexplode(field).alias("_no", "row")).select("_no", "row.*")


def load_rules(spark: SparkSession, given: str | Sequence[Mapping]) -> DataFrame:
    """Alert rules from a settings file (``alerts``) or from rows, with their defaults filled in."""
    rules = _listed(spark, given, "alerts", RULE_FIELDS)
    text = {c: F.coalesce(c, F.lit("")) for c in ("id", "name", "pattern", "source", "level")}
    rules = rules.withColumns(text)

    def positive(column: str, default: int):
        return F.when(F.col(column) > 0, F.col(column)).otherwise(default)

    return rules.withColumns({
        "rule_no": F.col("_no"),
        "id": F.when(F.col("id") == "", F.col("name")).otherwise(F.col("id")),
        "min_events": positive("min_events", RULE_MIN_EVENTS),
        "window_sec": positive("window_sec", RULE_WINDOW_SEC),
        "sound": F.coalesce("sound", F.lit(False)),
    }).select(*RULE_SCHEMA.names)


def load_presets(spark: SparkSession, given: str | Sequence[Mapping] | None = None) -> DataFrame:
    """Presets from a settings file (``presets``) or from rows; the defaults when there are none."""
    presets = _listed(spark, DEFAULT_PRESETS if given is None else given, "presets", PRESET_SCHEMA).drop("_no")
    if presets.isEmpty():
        return load_presets(spark)
    return presets


def preset_map(presets: DataFrame) -> dict[str, dict]:
    """Presets by id, as filters need them; a settings list, not data."""
    return {row.id: row.asDict() for row in presets.toLocalIterator()}
