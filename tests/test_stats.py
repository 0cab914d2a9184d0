from pyspark.sql import functions as F

from driftlens.operators import rate, stats, tree

HOUR = 3_600_000
ROWS = [
    (1, -5 * HOUR, "fswatch", "stdout", "/srv/mail/in created"),
    (2, -HOUR, "fswatch", "stdout", "/srv/mail/in created"),
    (3, -60_000, "fswatch", "stdout", "/srv/mail/in changed"),
    (4, -60_000, "entr", "stdout", "heartbeat"),
]


def test_dashboard_parts(log_of, at):
    df = log_of(ROWS)
    row = stats.stats(df, at(0), 2, buckets=24).first()
    assert row.total == stats.total(df, at(0), 2).first().total == 3
    assert len(row.hourly) == 24 and sum(b["count"] for b in row.hourly) == 3
    assert [b.label for b in row.hourly] == [r.label for r in stats.hourly(df, at(0), 2, buckets=24).collect()]
    assert [b["count"] for b in row.hourly] == [r["count"] for r in stats.hourly(df, at(0), 2, buckets=24).collect()]
    assert [tuple(b) for b in row.weekly] == [(r.label, r["count"]) for r in stats.weekday_counts(df, at(0), 2).collect()]
    assert len(row.weekly) == 7
    assert [tuple(s) for s in row.by_source] == [("fswatch", 2), ("entr", 1)]
    assert [tuple(s) for s in row.by_source] == [tuple(r) for r in stats.by_source(df, at(0), 2).collect()]
    assert [tuple(p) for p in row.top_paths] == [("/srv/mail/in", 2), ("", 1)]
    assert [tuple(p) for p in row.top_paths] == [tuple(r) for r in stats.top_paths(df, at(0), 2).collect()]
    assert row.window_sec == 7200


def test_dashboard_of_no_events(log_of, at):
    row = stats.stats(log_of(ROWS), at(100 * HOUR), 0, buckets=24).first()
    assert (row.total, len(row.hourly), row.by_source, row.top_paths, row.window_sec) == (0, 24, [], [], 86400)


def test_dashboard_reads_the_table_once(log_of, at, tmp_path, spark):
    log_of(ROWS).write.parquet(str(tmp_path / "t"))
    df = stats.stats(spark.read.parquet(str(tmp_path / "t")), at(0), 2)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_current_partial_hour_is_cut_off(log_of, at):
    # 24 hours back touch 25 hour buckets; asking for 24 cuts off the current one.
    df = log_of([(1, 0, "s", "l", "m x")])
    assert stats.total(df, at(0), 24).first().total == 1
    assert stats.hourly(df, at(0), 24, buckets=24).agg(F.sum("count")).first()[0] == 0
    whole = stats.hourly(df, at(0), 24)
    assert whole.count() == 25 and whole.agg(F.sum("count")).first()[0] == 1
    assert len(stats.stats(df, at(0), 24).first().hourly) == 25


def test_empty_messages_are_dropped_from_top_paths(log_of, at):
    df = log_of([(1, 0, "s", "l", ""), (2, 0, "s", "l", "plain"), (3, 0, "s", "l", " lead")])
    assert [tuple(r) for r in stats.top_paths(df, at(0), 1).collect()] == [("", 2)]
    assert [tuple(p) for p in stats.stats(df, at(0), 1).first().top_paths] == [("", 2)]


def test_source_overview(log_of):
    rows = stats.source_overview(log_of(ROWS)).select("source", "events").collect()
    assert [tuple(r) for r in rows] == [("entr", 1), ("fswatch", 3)]


def test_rates_fill_silent_seconds(log_of):
    df = log_of([(1, 0, "s", "l", "m"), (2, 100, "s", "l", "m"), (3, 3500, "s", "l", "m")])
    samples = rate.event_rate(df).orderBy("ts").collect()
    assert [r.events for r in samples] == [2, 0, 0, 1]
    last = rate.rate_samples(rate.event_rate(df), 3).collect()
    assert [(r.events, r.max_events) for r in last] == [(0, 1), (0, 1), (1, 1)]
    assert rate.rate_samples(rate.event_rate(df), 0).count() == 4


def test_rates_over_block_borders(log_of):
    df = log_of([(1, 0, "s", "l", "m"), (2, 8_000_000, "s", "l", "m")])
    samples = rate.event_rate(df)
    assert (samples.count(), samples.agg(F.sum("events")).first()[0]) == (8001, 2)


def test_rate_of_nothing(log_of):
    assert rate.event_rate(log_of([(1, 0, "s", "l", "m")]).where("id > 5")).count() == 0


def test_latch_stays_once_crossed(spark, log_of):
    df = log_of([(i, i, "s", "l", "m") for i in range(5)]).withColumn("v", F.element_at(F.array(*map(F.lit, (1, 512, 3, 900, 1))), F.col("id").cast("int") + 1))
    row = rate.threshold_latch(df, "v").select("warned", F.unix_millis("first_ts").alias("ms"), "threshold").first()
    assert tuple(row) == (True, 1_700_000_000_001, 512)
    assert tuple(rate.threshold_latch(df, "v", 1000).select("warned", "first_ts").first()) == (False, None)


TREE = [
    (1, 0, "s", "l", "/var/log/system.log Updated"), (2, 1, "s", "l", "/var/log/system.log Updated"),
    (3, 2, "s", "l", "/var/log/install.log Created"), (4, 3, "s", "l", "/var/cache/com.apple/x Created"),
    (5, 4, "s", "l", "note /tmp/../var/tmp/y/"), (6, 5, "s", "l", "/ Created"), (7, 6, "s", "l", "no path"),
]


def test_rollup_counts_every_ancestor(log_of, at):
    rollup = tree.path_rollup(log_of(TREE), at(10), 1)
    counts = {r.path: r["count"] for r in rollup.collect()}
    assert counts == {
        "/": 6, "/var": 5, "/var/log": 3, "/var/log/system.log": 2, "/var/log/install.log": 1, "/var/cache": 1,
        "/var/cache/com.apple": 1, "/var/cache/com.apple/x": 1, "/var/tmp": 1, "/var/tmp/y": 1,
    }


def test_rollup_limit_takes_the_oldest(log_of, at):
    assert {r.path: r["count"] for r in tree.path_rollup(log_of(TREE), at(10), 1, 2).collect()} == {
        "/": 2, "/var": 2, "/var/log": 2, "/var/log/system.log": 2,
    }


def test_empty_rollup_has_a_root(log_of, at):
    rollup = tree.path_rollup(log_of(TREE), at(100 * HOUR), 1)
    assert [tuple(r) for r in rollup.collect()] == [("/", None, "/", 0, 0)]
    assert tree.path_tree_json(rollup).first().tree == '{"name":"/","path":"/","count":0}'


def test_siblings_in_plain_and_hot_directories(log_of, at):
    rollup = tree.path_rollup(log_of(TREE), at(10), 1)
    expected = {"/": 1, "/var": 1, "/var/log": 1, "/var/cache": 2, "/var/tmp": 3, "/var/log/system.log": 1,
                "/var/log/install.log": 2, "/var/cache/com.apple": 1, "/var/cache/com.apple/x": 1, "/var/tmp/y": 1}
    assert {r.path: r.sibling_rank for r in tree.sibling_order(rollup).collect()} == expected
    assert {r.path: r.sibling_rank for r in tree.sibling_order(rollup, hot_rows=1).collect()} == expected


def test_flattening_and_collapsing(spark, log_of, at):
    rollup = tree.path_rollup(log_of(TREE), at(10), 1)
    walk = [(r.path, r.depth, r.has_children) for r in tree.flatten_tree(rollup, ["/", "/var/log"]).collect()]
    assert walk == [
        ("/var", 1, True), ("/var/log", 2, True), ("/var/cache", 2, True), ("/var/cache/com.apple", 3, True),
        ("/var/cache/com.apple/x", 4, False), ("/var/tmp", 2, True), ("/var/tmp/y", 3, False),
    ]
    collapsed = spark.createDataFrame([("/var/log",), ("/",)], "path string")
    assert [(r.path, r.depth, r.has_children) for r in tree.flatten_tree(rollup, collapsed).collect()] == walk


def test_walk_of_a_random_tree(log_of, at):
    import random

    rng = random.Random(7)
    rows = [(i, 0, "s", "l", "/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) + " x") for i in range(400)]
    found = tree.flatten_tree(tree.path_rollup(log_of(rows), at(10), 1)).collect()
    counts = {}
    for *_, message in rows:
        parts = message.split()[0].split("/")[1:]
        for n in range(1, len(parts) + 1):
            counts[tuple(parts[:n])] = counts.get(tuple(parts[:n]), 0) + 1
    wanted = sorted(counts, key=lambda p: [(-counts[p[:n + 1]], p[n]) for n in range(len(p))])
    assert [(r.path, r["count"], r.depth) for r in found] == [("/" + "/".join(p), counts[p], len(p)) for p in wanted]


def test_tree_json(log_of, at):
    import json

    text = tree.path_tree_json(tree.path_rollup(log_of(TREE), at(10), 1)).first().tree
    root = json.loads(text)
    assert (root["name"], root["count"]) == ("/", 6)
    var = root["children"][0]
    assert [c["name"] for c in var["children"]] == ["log", "cache", "tmp"]
    assert [c["name"] for c in var["children"][0]["children"]] == ["system.log", "install.log"]
    assert "children" not in var["children"][0]["children"][0]


def test_heatmap_is_relative_to_the_root(log_of, at):
    rows = {r.path: (r.hue, r.lightness) for r in tree.heatmap(tree.path_rollup(log_of(TREE), at(10), 1)).collect()}
    assert rows["/"] == (100.0, 30.0)
    assert rows["/var/log"] == (150.0, 40.0)
