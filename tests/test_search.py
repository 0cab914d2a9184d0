from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from driftlens.operators import predicates as P, search as S
from driftlens.operators.ordering import first_n, with_ordinal
from driftlens.schema import Query

ROWS = [
    (1, 0, "fswatch", "stdout", "/srv/mail/in created"),
    (2, 1000, "entr", "stdout", "/srv/mail/out changed"),
    (3, 2000, "fswatch", "stdout", "/opt/spool/c removed"),
    (4, 2000, "logstream", "stderr", "95% done É"),
]


def ids(df):
    return [r.id for r in df.collect()]


def test_newest_first_with_id_tie_break(log_of):
    assert ids(S.search_logs(log_of(ROWS), Query())) == [4, 3, 2, 1]


def test_limit_defaults_and_cap():
    assert [Query(limit=n).row_limit for n in (-1, 0, 7, 5000, 9000)] == [200, 200, 7, 5000, 9000]
    assert [Query(limit=n, cap=5000).row_limit for n in (-1, 0, 7, 5000, 9000)] == [200, 200, 7, 5000, 5000]


def test_keyword_is_literal_and_ascii_case_insensitive(log_of):
    df = log_of(ROWS)
    assert ids(S.search_logs(df, Query(keyword="SRV/MAIL"))) == [2, 1]
    assert ids(S.search_logs(df, Query(keyword="95%"))) == [4]
    assert ids(S.search_logs(df, Query(keyword="É"))) == [4]
    assert ids(S.search_logs(df, Query(keyword="é"))) == []
    assert ids(S.search_logs(df, Query(keyword="_"))) == []
    assert ids(S.search_logs(df, Query(keyword="n.c"))) == []


def test_time_bounds_are_inclusive_at_millisecond_resolution(spark, at):
    df = spark.sql("SELECT 1L AS id, timestamp_micros(1700000000000500) AS ts, 's' AS source, 'l' AS level, 'm' AS message")
    assert df.where(P.until(at(0))).count() == 1
    assert df.where(P.since(at(0))).count() == 1
    assert df.where(P.until(at(-1))).count() == 0
    assert df.where(P.since(at(1))).count() == 0


def test_all_conditions_together(log_of, at):
    wanted = Query(since=at(0), until=at(2000), source="fswatch", keyword="c")
    assert ids(S.export_order(log_of(ROWS), wanted)) == [1, 3]


def test_time_filter_reaches_the_scan(spark, log_of, at, tmp_path):
    log_of(ROWS).write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(P.since(at(5)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_parse_query():
    wanted = P.parse_query({"since": "2024-01-01T00:00:00Z", "q": "x", "source": "entr", "limit": "abc"})
    assert wanted == Query(since=datetime(2024, 1, 1, tzinfo=timezone.utc), source="entr", keyword="x", limit=0)
    for field, value in (("since", "bad-date"), ("until", "2024-01-01"), ("since", "2024-01-01 00:00:00+00:00")):
        with pytest.raises(ValueError, match=field):
            P.parse_query({field: value})


@pytest.mark.parametrize("value", [
    "2024-W01-1T00:00:00Z", "2024-01-01T00Z", "2024-01-01T00:00Z", "2024-01-01T000000Z", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z",
    "2024-01-01T00:00:00+0200", " 2024-01-01T00:00:00Z", "2024-01-01t00:00:00z", "2024-01-01T00:00:00,5Z",
])
def test_only_full_times_are_accepted(value):
    with pytest.raises(ValueError, match="until"):
        P.parse_query({"until": value})


def test_times_with_fractions_and_offsets():
    wanted = P.parse_query({"since": "2024-01-01T02:00:00.123456789+02:00"})
    assert wanted.since == datetime(2024, 1, 1, 0, 0, 0, 123456, timezone.utc)
    assert [P.parse_query({"limit": n}).limit for n in ("1_000", " 7 ", "+7", "-3", "7.0", "")] == [0, 0, 7, -3, 0, 0]


def test_live_and_multi_field_filters(log_of):
    df = log_of(ROWS)
    assert ids(P.live_filter(df, "FSWATCH /srv/MAIL").orderBy("id")) == [1]
    assert ids(P.live_filter(df, "DONE é")) == [4]
    long = log_of([(1, 0, "s", "l", "x" * 3000 + "needle"), (2, 0, "s", "l", "x" * 3000)])
    assert ids(P.live_filter(long, "NEEDLE")) == [1]
    assert ids(P.multi_field_filter(df, "  ENTR ")) == [2]
    assert ids(P.multi_field_filter(df, " ").orderBy("id")) == [1, 2, 3, 4]


def test_presets_scope_by_path_or_text(log_of):
    rows = [
        (1, 0, "fswatch", "o", "/var/log/a Created"), (2, 0, "fswatch", "o", "/var/logs/a Created"),
        (3, 0, "watchman", "o", "/var/log/a"), (4, 0, "logstream", "o", "seen /var/log/x"),
        (5, 0, "plugin:sample", "o", "anything"), (6, 0, "logstream", "o", "nothing"),
    ]
    presets = {"logs": {"target": "/var/log", "enabled": {"fswatch": True, "logstream": True, "watchman": False}}}
    assert ids(P.apply_preset(log_of(rows), presets, "logs").orderBy("id")) == [1, 4, 5]
    with pytest.raises(KeyError, match="unknown preset"):
        P.apply_preset(log_of(rows), presets, "nope")


def test_tail_shows_last_lines_oldest_first(log_of):
    lines = [r.line for r in S.tail(log_of(ROWS), 2).collect()]
    assert lines == ["22:13:22 fswatch /opt/spool/c removed", "22:13:22 logstream 95% done É"]


def test_large_first_n_equals_small_one(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v"))
    expected = {r.id for r in df.orderBy("v", "id").limit(1234).collect()}
    monkeypatch.setattr("driftlens.operators.ordering.HOT_ROWS", 10)
    assert {r.id for r in first_n(df, 1234, [F.col("v"), F.col("id")]).collect()} == expected


def test_ordinals_are_dense_within_skewed_groups(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("k"))
    rows = with_ordinal(df, ["k"], [F.desc("id")]).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.k, []).append((r.ordinal, r.id))
    for found in groups.values():
        found.sort()
        assert [o for o, _ in found] == list(range(len(found)))
        assert [i for _, i in found] == sorted((i for _, i in found), reverse=True)


def test_drilldown_uses_the_path_as_keyword(log_of):
    assert ids(S.path_drilldown(log_of(ROWS), "/srv/mail")) == [2, 1]
