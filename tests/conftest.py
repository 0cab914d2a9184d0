import os
import sys
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftlens.session import build_session  # noqa: E402

BASE_MS = 1_700_000_000_000


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "driftlens-tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def log_of(spark):
    """Log rows from (id, offset in ms, source, level, message)."""
    def make(rows, base=BASE_MS):
        df = spark.createDataFrame(
            [(i, base + ms, s, lv, m) for i, ms, s, lv, m in rows],
            "id bigint, ms bigint, source string, level string, message string",
        )
        return df.select("id", F.timestamp_millis("ms").alias("ts"), "source", "level", "message")

    return make


@pytest.fixture(scope="session")
def at():
    """A moment some milliseconds after the base."""
    return lambda ms: datetime.fromtimestamp((BASE_MS + ms) / 1000, timezone.utc)
