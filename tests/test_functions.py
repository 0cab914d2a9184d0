import pytest
from pyspark.sql import functions as F

from driftlens.functions import paths, text, times


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("message, path", [
    ("/srv/spool/q7 Updated IsDir", "/srv/spool/q7"),
    ("written to: /opt/data/y", "/opt/data/y"),
    ("no path here", ""),
    ("relative/X Y", ""),
    (" /a b", "/a"),
    ("x\t/a//b/./c/../d/ y", "/a/b/d"),
    ("/../..", "/"),
    ("/", "/"),
    ("//", "/"),
    ("/a/..b/...", "/a/..b/..."),
    ("", ""),
])
def test_extract_path(spark, message, path):
    assert one(spark, message, paths.extract_path) == path


def test_prefixes_names_and_parents(spark):
    assert one(spark, "/a/b/c", paths.path_prefixes) == ["/a", "/a/b", "/a/b/c"]
    assert one(spark, "/", paths.path_prefixes) == []
    assert [one(spark, p, paths.path_parent) for p in ("/", "/a", "/a/b")] == [None, "/", "/a"]
    assert [one(spark, p, paths.path_name) for p in ("/", "/a", "/a/b")] == ["/", "a", "b"]
    assert [one(spark, p, paths.path_depth) for p in ("/", "/a", "/a/b")] == [0, 1, 2]


@pytest.mark.parametrize("message, token", [("/a b", "/a"), ("none", ""), (" lead", ""), ("a\tb c", "a\tb")])
def test_leading_token(spark, message, token):
    assert one(spark, message, paths.leading_token) == token


def test_escape_like(spark):
    assert one(spark, r"a\b%c_d", text.escape_like) == r"a\\b\%c\_d"


@pytest.mark.parametrize("raw, lines", [("a\n\nb\n", ["a", "", "b"]), ("", []), ("a", ["a"]), ("\n", [""]), ("a\n\n", ["a", ""])])
def test_split_lines(spark, raw, lines):
    assert one(spark, raw, text.split_lines) == lines
    assert one(spark, raw, text.count_lines) == len(lines)


def test_normalise_newlines(spark):
    assert one(spark, "a\r\nb\rc\n\r", text.normalise_newlines) == "a\nb\nc\n\n"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.sql("SELECT timestamp_millis(1710054005120) AS ts").select(
            times.rfc3339(F.col("ts")).alias("a"), times.clock(F.col("ts")).alias("b"),
            times.weekday(F.col("ts")).alias("c"), times.weekday_label(times.weekday(F.col("ts"))).alias("d"),
            times.hour_label(times.epoch_hour(F.col("ts")), "Asia/Tokyo").alias("e"),
            times.hour_label(times.epoch_hour(F.col("ts"))).alias("f"),
            times.utc_date(F.col("ts")).cast("string").alias("g"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == ("2024-03-10T07:00:05.12Z", "07:00:05", 0, "日", "16:00", "07:00", "2024-03-10")


def test_rfc3339_without_fraction(spark):
    ts = spark.sql("SELECT timestamp_millis(1710054005000) AS ts")
    assert ts.select(times.rfc3339(F.col("ts"))).first()[0] == "2024-03-10T07:00:05Z"


def test_heat_and_bars(spark):
    row = spark.range(1).select(
        text.heat(F.lit(5), F.lit(10)).alias("half"), text.heat(F.lit(0), F.lit(10)).alias("none"),
        text.bar_pct(F.lit(1), F.lit(1000)).alias("tiny"), text.bar_pct(F.lit(5), F.lit(8)).alias("some"),
        text.bar_pct(F.lit(0), F.lit(0)).alias("zero"),
    ).first()
    assert tuple(row.half) == (150.0, 40.0, "hsl(150, 80%, 40%)")
    assert tuple(row.none) == (None, None, "rgba(56,189,248,0.08)")
    assert (row.tiny, row.some, row.zero) == (2, 63, 0)


def test_alert_message(spark):
    made = spark.range(1).select(text.alert_message(F.lit("n"), F.lit(3), F.lit("last"))).first()[0]
    assert made == "alert: n (3 events) — last"


def test_rendered_line_is_cut_on_request(spark):
    cut = lambda length: one(spark, "x" * 5000, lambda v: text.render_line(F.lit("00:00:00"), F.lit("s"), v, length))
    assert cut(2048) == "00:00:00 s " + "x" * 2048
    assert cut(None) == "00:00:00 s " + "x" * 5000
