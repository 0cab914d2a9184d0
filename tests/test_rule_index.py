"""Rules found through the index are the rules found one by one."""

import random

import pytest

from driftlens.operators import alerts
from driftlens.operators.rule_index import pattern_index
from driftlens.sources.settings import load_rules


def pairs(df):
    return sorted((r.rule_id, r.rule_no, r.id) for r in df.select("rule_id", "rule_no", "id").collect())


@pytest.fixture(scope="module")
def case(spark, log_of):
    rng = random.Random(6)
    letters = "abAB é\n😀%_\\."
    text = lambda n: "".join(rng.choices(letters, k=n))
    messages = [text(rng.randint(0, 40)) for _ in range(400)] + ["", "ab", "aaaaaaa", "abab" * 500]
    patterns = [text(rng.randint(0, 6)) for _ in range(150)] + [m[3:9] for m in messages[:80]] + ["", "a", "ab", "aaa", "😀😀"]
    rules = [
        {"id": f"r{n % 90}", "name": "n", "pattern": p, "source": rng.choice(["", "s", "t"]), "level": rng.choice(["", "l"]), "min_events": 1 + n % 3}
        for n, p in enumerate(patterns)
    ]
    rows = [(i, i, rng.choice(["s", "t", "alert"]), rng.choice(["l", "k"]), m) for i, m in enumerate(messages)]
    return log_of(rows), load_rules(spark, rules), rules, rows


def test_index_finds_what_a_plain_search_finds(case):
    log, loaded, rules, rows = case
    wanted = sorted(
        (r["id"], n, i) for n, r in enumerate(rules) for i, _, s, lv, m in rows
        if s != "alert" and r["pattern"] in m and r["source"] in ("", s) and r["level"] in ("", lv)
    )
    found = alerts.match_rules(log, loaded, index_from=1)
    assert pairs(found) == wanted == pairs(alerts.match_rules(log, loaded, index_from=10**9)) and len(wanted) > 2000
    assert found.columns == alerts.match_rules(log, loaded, index_from=10**9).columns


def test_index_in_rounds(case, monkeypatch):
    log, loaded, _, _ = case
    whole = pairs(alerts.match_rules(log, loaded, index_from=1))
    monkeypatch.setattr(alerts, "MAX_BROADCAST_RULES", 50)
    assert pairs(alerts.match_rules(log, loaded, index_from=1)) == whole


def test_each_rule_has_one_gram_the_rarest(spark):
    rules = load_rules(spark, [{"id": str(n), "name": "n", "pattern": p} for n, p in enumerate(["abcd", "abcx", "bcd", "ab", "zabc"])])
    index = {r.id: r._gram for r in pattern_index(rules, "pattern", "rule_no").collect()}
    assert index == {"0": "bcd", "1": "bcx", "2": "bcd", "4": "zab"}


def test_no_nested_loop_for_many_rules(spark, log_of):
    rules = load_rules(spark, [{"id": str(n), "name": "n", "pattern": f"event {n}"} for n in range(10_000)])
    log = log_of([(n, n, "s", "l", f"this is event {n}.") for n in range(50)])
    found = alerts.match_rules(log, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "BroadcastHashJoin" in plan
    # "event 37" holds "event 3" too.
    assert found.count() == 10 + 2 * 40


def test_alerts_over_indexed_rules(case, monkeypatch):
    log, loaded, _, _ = case
    columns = ["id", "rule_no", "count", "event_id"]
    plain = sorted(map(tuple, alerts.fire_alerts(log, loaded).select(*columns).collect()))
    monkeypatch.setattr(alerts.match_rules, "__defaults__", (None, 1))
    assert sorted(map(tuple, alerts.fire_alerts(log, loaded).select(*columns).collect())) == plain and len(plain) > 500
