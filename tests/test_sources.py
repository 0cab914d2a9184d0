import glob
import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from driftlens.schema import Query
from driftlens.sources import export, logs, settings, snapshots

DAY = 86_400_000


def rows_of(n, step=1000):
    return [(i, i * step, "fswatch", "stdout", f"/f{i} Created") for i in range(n)]


def test_append_gives_rising_dense_ids_and_retries_are_harmless(spark, log_of, tmp_path):
    table = str(tmp_path / "t")
    first, second = log_of(rows_of(50)), log_of(rows_of(30), 1_700_100_000_000)
    assert logs.append_logs(first, table) == 0
    assert logs.append_logs(second, table) == 1
    stored = logs.read_log_table(spark, table)
    before = sorted((r.id, r.message) for r in stored.collect())
    assert [i for i, _ in before] == list(range(1, 81))
    assert [r.id for r in stored.orderBy("ts").collect()] == list(range(1, 81))
    logs.append_logs(second, table, 1)
    assert sorted((r.id, r.message) for r in logs.read_log_table(spark, table).collect()) == before


def stored(spark, table):
    return sorted((r.id, r.message) for r in logs.read_log_table(spark, table).collect())


def test_writers_leave_each_other_alone(spark, log_of, tmp_path):
    table, make = str(tmp_path / "t"), lambda tag: log_of([(i, i, "s", "l", f"{tag}{i}") for i in range(5)])
    logs.append_logs(make("a"), table, 0, "stream")
    logs.append_logs(make("b"), table)
    logs.append_logs(make("c"), table, 1, "stream")
    logs.append_logs(make("d"), table, 0, "other_stream")
    before = stored(spark, table)
    assert [i for i, _ in before] == list(range(1, 21)) and {m[0] for _, m in before} == set("abcd")
    logs.append_logs(make("c"), table, 1, "stream")
    assert stored(spark, table) == before
    with pytest.raises(ValueError, match="name"):
        logs.append_logs(make("e"), table, 0, "no/name")


def test_a_retry_with_other_days_and_more_rows_leaves_nothing_behind(spark, log_of, tmp_path):
    table = str(tmp_path / "t")
    logs.append_logs(log_of([(1, 0, "s", "l", "x")]), table, 0, "w")
    logs.append_logs(log_of([(1, 0, "s", "l", "y")]), table, 1, "w")
    logs.append_logs(log_of([(1, 3 * DAY, "s", "l", "x"), (2, 3 * DAY, "s", "l", "z")]), table, 0, "w")
    assert stored(spark, table) == [(2, "y"), (3, "x"), (4, "z")]


def test_ids_never_come_twice_after_retention(spark, log_of, at, tmp_path):
    table = str(tmp_path / "t")
    logs.append_logs(log_of([(1, 10 * DAY, "s", "l", "new")]), table)
    logs.append_logs(log_of([(1, 0, "s", "l", "old"), (2, 1, "s", "l", "old")]), table)
    assert logs.prune_table(spark, table, at(10 * DAY), 5) == 2
    logs.append_logs(log_of([(1, 11 * DAY, "s", "l", "newer")]), table)
    assert stored(spark, table) == [(1, "new"), (4, "newer")]


def test_compaction_keeps_rows_and_can_be_repeated(spark, log_of, at, tmp_path):
    table = str(tmp_path / "t")
    for turn in range(3):
        logs.append_logs(log_of([(i, i * DAY + turn, "s", "l", f"{turn}/{i}") for i in range(3)]), table)
    before = stored(spark, table)
    spare = spark.read.schema(logs.TABLE_SCHEMA).parquet(table).where("batch = 1").withColumn("writer", F.lit("compacted"))
    logs._replace_parts(spare, table)  # what a failure between the two steps leaves
    assert logs.compact_days(spark, table, at(2 * DAY).date()) == 2
    assert logs.compact_days(spark, table, at(2 * DAY).date()) == 0
    assert [r for r in stored(spark, table) if not r[1].endswith("/2")] == [r for r in before if not r[1].endswith("/2")]
    assert len(glob.glob(f"{table}/dt=*/writer=*/batch=*")) == 2 + 4
    logs.append_logs(log_of([(1, 5 * DAY, "s", "l", "next")]), table)
    assert max(stored(spark, table)) == (10, "next")


def test_copies_of_one_event_get_their_own_ids(spark, log_of, tmp_path):
    table = str(tmp_path / "t")
    copies = spark.range(0, 5000, 1, 8).crossJoin(log_of([(1, 0, "s", "l", "m")]).drop("id")).drop("id")
    logs.append_logs(copies, table)
    assert logs.read_log_table(spark, table).agg(F.count_distinct("id"), F.max("id")).first()[:] == (5000, 5000)


def test_search_prunes_partitions(spark, log_of, at, tmp_path):
    from driftlens.operators.search import search_logs

    table = str(tmp_path / "t")
    logs.append_logs(log_of(rows_of(10, DAY)), table)
    found = search_logs(logs.read_log_table(spark, table), Query(since=at(7 * DAY)))
    assert [r.message for r in found.collect()] == ["/f9 Created", "/f8 Created", "/f7 Created"]
    assert "dt" not in found.columns
    assert "PartitionFilters: [isnotnull(dt" in found._jdf.queryExecution().executedPlan().toString()


def test_prune_is_strict(log_of, at):
    kept, deleted = logs.prune(log_of([(1, -1, "s", "l", "m"), (2, 0, "s", "l", "m")]), at(DAY), 1)
    assert ([r.id for r in kept.collect()], deleted.first().deleted) == ([2], 1)
    assert logs.cutoff(at(0), 0) == at(0) - timedelta(days=30)


def test_prune_table_drops_days_and_rewrites_the_edge(spark, log_of, at, tmp_path):
    table = str(tmp_path / "t")
    logs.append_logs(log_of(rows_of(40, DAY // 4)), table)
    logs.append_logs(log_of(rows_of(40, DAY // 4)), table)
    assert logs.prune_table(spark, table, at(8 * DAY + 5), 3) == 2 * 21
    left = logs.read_log_table(spark, table)
    assert left.agg(F.count("id"), F.min(F.unix_millis("ts"))).first()[:] == (38, 1_700_000_000_000 + 21 * DAY // 4)
    assert logs.prune_table(spark, table, at(8 * DAY + 5), 3) == 0


def test_prune_table_may_empty_the_edge_of_a_batch(spark, log_of, at, tmp_path):
    table = str(tmp_path / "t")
    logs.append_logs(log_of([(1, 5 * DAY, "s", "l", "old"), (2, 9 * DAY, "s", "l", "new")]), table)
    logs.append_logs(log_of([(1, 5 * DAY, "s", "l", "old"), (2, 5 * DAY + 9, "s", "l", "kept")]), table)
    assert logs.prune_table(spark, table, at(8 * DAY + 5), 3) == 2
    assert sorted((r.id, r.message) for r in logs.read_log_table(spark, table).collect()) == [(2, "new"), (4, "kept")]


def test_read_log_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("/x Created\r\n  \t \n \n last".encode())
    rows = logs.read_log_lines(spark, str(tmp_path), "entr", "stderr").collect()
    assert sorted((r.source, r.level, r.message) for r in rows) == [("entr", "stderr", " last"), ("entr", "stderr", "/x Created")]
    assert all(r.ts is not None for r in rows)


def test_sources_are_named_and_unique(log_of):
    sources = {"fswatch": log_of(rows_of(2))}
    sources = logs.register_source(sources, "mine", log_of(rows_of(3)))
    counts = {r.source: r["count"] for r in logs.union_sources(sources).groupBy("source").count().collect()}
    assert counts == {"fswatch": 2, "plugin:mine": 3}
    with pytest.raises(ValueError, match="already"):
        logs.register_source(sources, "mine", log_of(rows_of(1)))


def test_export_csv_is_one_file_in_parts(log_of, tmp_path):
    rows = [(1, 1500, "s", "l", 'a, "quoted", line'), (2, 0, "s", "l", " lead"), (3, 2000, "s", "l", "two\nlines"), (4, 2001, "x", "l", "no")]
    export.export_csv(log_of(rows), Query(source="s"), str(tmp_path / "c"))
    text = "".join(open(p, newline="").read() for p in sorted(glob.glob(str(tmp_path / "c" / "part-*"))))
    assert text == (
        "ts,source,level,message\n"
        '2023-11-14T22:13:20Z,s,l," lead"\n'
        '2023-11-14T22:13:21.5Z,s,l,"a, ""quoted"", line"\n'
        '2023-11-14T22:13:22Z,s,l,"two\nlines"\n'
    )


def test_export_json_lines(log_of, tmp_path):
    export.export_json(log_of(rows_of(3)), Query(), str(tmp_path / "j"))
    lines = [json.loads(line) for p in sorted(glob.glob(str(tmp_path / "j" / "part-*"))) for line in open(p)]
    assert [line["id"] for line in lines] == [0, 1, 2]
    assert lines[1] == {"id": 1, "ts": "2023-11-14T22:13:21Z", "source": "fswatch", "level": "stdout", "message": "/f1 Created"}


def test_rules_get_their_defaults(spark, tmp_path):
    given = [{"name": "n", "pattern": "p"}, {"id": "i", "name": "m", "min_events": -1, "window_sec": 5, "sound": True}]
    expected = [(0, "n", "n", "p", "", "", 1, 60, False), (1, "i", "m", "", "", "", 1, 5, True)]
    assert [tuple(r) for r in settings.load_rules(spark, given).collect()] == expected
    (tmp_path / "c.json").write_text(json.dumps({"lang": "en", "alerts": given}, indent=1))
    assert [tuple(r) for r in settings.load_rules(spark, str(tmp_path / "c.json")).collect()] == expected


def test_presets_default_when_none_are_given(spark, tmp_path):
    assert set(settings.preset_map(settings.load_presets(spark))) == {"logs", "caches", "temp"}
    (tmp_path / "c.json").write_text('{"presets": [{"id": "x", "target": "/t", "enabled": {"entr": true}}]}')
    presets = settings.preset_map(settings.load_presets(spark, str(tmp_path / "c.json")))
    assert presets["x"]["target"] == "/t" and presets["x"]["enabled"] == {"entr": True}
    (tmp_path / "d.json").write_text('{"presets": []}')
    assert len(settings.preset_map(settings.load_presets(spark, str(tmp_path / "d.json")))) == 3


def test_snapshots_from_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes(b"hello\n")
    (tmp_path / "b.bin").write_bytes(b"x" * ((1 << 20) + 1))
    from driftlens.operators.diffs import eligible_snapshots

    found = snapshots.read_snapshots(spark, str(tmp_path), files=True)
    assert {r.size for r in found.collect()} == {6, (1 << 20) + 1}
    assert eligible_snapshots(found).count() == 2
    fine = eligible_snapshots(found, 1 << 20)
    assert [bytes(r.content) for r in fine.collect()] == [b"hello\n"]
    assert "LessThanOrEqual(len" in fine._jdf.queryExecution().executedPlan().toString()
