"""The greedy operators against plain folds over random sequences."""

import random

import pytest
from pyspark.sql import functions as F

from driftlens.operators import alerts
from driftlens.operators.dedup import dedup_window
from driftlens.operators.runs import activity_runs, select_spaced
from driftlens.schema import ALERT_HISTORY, RULE_SCHEMA
from driftlens.sources.settings import load_rules


def fold_dedup(rows, window):
    last, kept = {}, []
    for i, ms, _, level, message in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (level, message)
        if key in last and ms - last[key] < window:
            continue
        last[key] = ms
        kept.append(i)
    return sorted(kept)


def fold_alerts(rows, rules):
    held, fired = {}, []
    for i, ms, source, level, message in sorted(rows, key=lambda r: (r[1], r[0])):
        if source == "alert":
            continue
        for _, rid, name, pattern, src, lvl, needed, span, _ in rules:
            if pattern not in message or (src and src != source) or (lvl and lvl != level):
                continue
            times = [t for t in (*held.get(rid, []), ms) if t >= ms - span * 1000]
            if len(times) >= needed:
                fired.append((rid, name, len(times), i, message))
                times = []
            held[rid] = times
    return sorted(fired)


def random_rows(rng, n, span, hot=0.6):
    return [
        (i, rng.randrange(span), rng.choice(["a", "b", "alert"]), rng.choice(["x", "y"]) if rng.random() > hot else "x",
         "hot event" if rng.random() < hot else f"event {rng.randrange(4)}")
        for i in range(n)
    ]


@pytest.mark.parametrize("seed, window, span, min_chunk", [
    (1, 7, 2500, 1), (2, 50, 30_000, 1), (3, 50, 2500, 4000), (4, 1, 900, 1), (5, 400, 2_000_000, 1), (6, 3, 20_000, 64),
])
def test_dedup_equals_the_fold(log_of, seed, window, span, min_chunk):
    rows = random_rows(random.Random(seed), 2500, span)
    kept = sorted(r.id for r in dedup_window(log_of(rows), window, min_chunk).collect())
    assert kept == fold_dedup(rows, window)


def test_hot_groups_and_small_batches(spark, log_of):
    rng = random.Random(21)
    rows = random_rows(rng, 3000, 4000, 0.9) + [(10_000 + n, 777, "a", "x", "hot event") for n in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for window in (3, 60, 900):
            kept = sorted(r.id for r in dedup_window(log_of(rows), window, 1, hot_rows=20).collect())
            assert kept == fold_dedup(rows, window)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_dedup_shares_its_shuffle(spark, log_of, tmp_path):
    log_of([(n, n * 7, "a", "x", f"m{n % 3}") for n in range(200)]).write.parquet(str(tmp_path / "t"))
    from driftlens.schema import LOG_SCHEMA

    df = dedup_window(spark.read.schema(LOG_SCHEMA).parquet(str(tmp_path / "t")), 100)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_dedup_rules(log_of):
    rows = [(1, 0, "a", "l", "m"), (2, 300, "b", "l", "m"), (3, 600, "a", "l", "m"), (4, 900, "a", "l", "m"),
            (5, 1300, "a", "l", "m"), (6, 5000, "a", "l", "m"), (7, 5100, "a", "l", "m"), (8, 5500, "a", "l", "m"),
            (9, 10, "a", "other", "m")]
    kept = sorted(r.id for r in dedup_window(log_of(rows), 500).collect())
    assert kept == [1, 3, 5, 6, 8, 9] == fold_dedup(rows, 500)
    assert dedup_window(log_of(rows), 0).count() == dedup_window(log_of(rows), -5).count() == len(rows)


def test_a_run_without_any_pause_spans_many_chunks(spark):
    # One key with an event every millisecond and 2000 chunks; nothing but the state carries over.
    df = spark.range(0, 160_000, 1, 8).select(F.lit("k").alias("k"), F.col("id").alias("pos"))
    taken = [r.pos for r in select_spaced(df, ["k"], "pos", F.lit(7), 80).orderBy("pos").collect()]
    assert taken == list(range(0, 160_000, 7))


def test_every_key_may_have_its_own_gap(spark):
    rng = random.Random(9)
    rows = sorted({(k, rng.randrange(3000)) for k in "ppqrs" for _ in range(500)})
    gaps = {"p": 1, "q": 5, "r": 40, "s": 333}
    df = spark.createDataFrame([(k, p, gaps[k]) for k, p in rows], "k string, pos bigint, gap int")
    last, expected = {}, []
    for k, p in rows:
        if k not in last or p - last[k] >= gaps[k]:
            last[k] = p
            expected.append((k, p))
    assert sorted((r.k, r.pos) for r in select_spaced(df, ["k"], "pos", F.col("gap"), 1).collect()) == expected


@pytest.mark.parametrize("seed, gap, min_chunk", [(1, 5, 1), (2, 30, 1), (3, 30, 1000)])
def test_runs_end_at_pauses(spark, seed, gap, min_chunk):
    rng = random.Random(seed)
    rows = sorted({(rng.choice("aab"), rng.randrange(9000)) for _ in range(1500)})
    expected, before = {}, {}
    for k, p in rows:
        start = before[k][1] if k in before and p - before[k][0] < gap else p
        before[k] = (p, start)
        expected[(k, p)] = start
    df = spark.createDataFrame(rows, "k string, pos bigint")
    found = {(r.k, r.pos): r.run_start for r in activity_runs(df, ["k"], "pos", F.lit(gap), min_chunk).collect()}
    assert found == expected


def fired_rows(df):
    return sorted((r.id, r["name"], r["count"], r.event_id, r.last) for r in df.collect())


@pytest.mark.parametrize("seed, span, min_chunk", [(1, 200_000, 1), (2, 3_000_000, 1), (3, 200_000, 500)])
def test_alerts_equal_the_fold(spark, log_of, seed, span, min_chunk):
    rng = random.Random(seed)
    rows = random_rows(rng, 1200, span)
    rules = [
        (0, "hot", "Hot", "hot", "", "", rng.choice([2, 5]), rng.choice([1, 20]), True),
        (1, "any", "Any", "", "", "", 3, 10, False),
        (2, "each", "Each", "event 1", "", "", 1, 60, False),
        (3, "level", "Level", "", "a", "y", 2, 30, False),
        (4, "mix", "Mixed 1", "event 2", "", "", 3, 50, False),
        (5, "mix", "Mixed 2", "hot", "", "", 2, 1, False),
        (6, "mix", "Mixed 3", "event 3", "", "", 4, 200, False),
        (7, "same", "Same 1", "event 1", "", "", 3, 100, False),
        (8, "same", "Same 2", "", "", "", 3, 100, False),
        (9, "none", "None", "absent", "", "", 2, 2, False),
    ]
    fired = alerts.fire_alerts(log_of(rows), spark.createDataFrame(rules, RULE_SCHEMA), min_chunk)
    assert fired_rows(fired) == fold_alerts(rows, rules)


def test_alert_fires_at_the_third_match_and_resets(spark, log_of):
    rules = load_rules(spark, [{"name": "burst", "pattern": "/var/tmp", "min_events": 3, "window_sec": 60}])
    rows = [(i, i * 1000, "fswatch", "o", "/var/tmp/x") for i in range(1, 6)] + [(9, 9000, "alert", "warn", "/var/tmp/x")]
    fired = fired_rows(alerts.fire_alerts(log_of(rows), rules))
    assert fired == [("burst", "burst", 3, 3, "/var/tmp/x")]


def test_alert_window_is_inclusive(spark, log_of):
    rules = load_rules(spark, [{"id": "r", "name": "n", "min_events": 2, "window_sec": 10}])
    at_edge = [(1, 0, "s", "l", "m"), (2, 10_000, "s", "l", "m")]
    beyond = [(1, 0, "s", "l", "m"), (2, 10_001, "s", "l", "m")]
    assert len(fired_rows(alerts.fire_alerts(log_of(at_edge), rules))) == 1
    assert fired_rows(alerts.fire_alerts(log_of(beyond), rules)) == []


def test_rules_beyond_one_broadcast(spark, log_of, monkeypatch):
    rules = load_rules(spark, [{"id": f"r{n}", "name": "n", "pattern": f"event {n}"} for n in range(7)])
    rows = [(n, n, "s", "l", f"event {n % 9}") for n in range(30)]
    whole = sorted(tuple(r) for r in alerts.match_rules(log_of(rows), rules).select("rule_id", "id").collect())
    monkeypatch.setattr(alerts, "MAX_BROADCAST_RULES", 2)
    parts = sorted(tuple(r) for r in alerts.match_rules(log_of(rows), rules).select("rule_id", "id").collect())
    assert parts == whole and len(whole) > 7


def test_no_rules(spark, log_of):
    rules = load_rules(spark, [])
    assert alerts.fire_alerts(log_of([(1, 0, "s", "l", "m")]), rules).count() == 0


def test_feedback_history_and_badge(spark, log_of):
    rules = load_rules(spark, [{"id": "each", "name": "Each", "pattern": "m", "sound": True}])
    log = log_of([(n, n * 1000, "s", "l", f"m{n}") for n in range(130)])
    fired = alerts.fire_alerts(log, rules)
    history = alerts.alert_history(fired, ALERT_HISTORY).collect()
    assert len(history) == 100 and history[0].last == "m129" and history[0].sound
    assert alerts.alert_count(fired, ALERT_HISTORY).first().alerts == 100
    # Without a cap the history is whole.
    whole = alerts.alert_history(fired).collect()
    assert [r.last for r in whole] == [f"m{n}" for n in range(129, -1, -1)] and alerts.alert_count(fired).first().alerts == 130
    fed = alerts.alert_feedback(log, fired)
    assert fed.where("source = 'alert' AND level = 'warn'").count() == 130
    assert fed.where("message = 'alert: Each (1 events) — m5'").count() == 1
    # Alerts do not fire alerts.
    assert alerts.fire_alerts(fed, rules).count() == 130
