import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.llm.substring_dedup import anchors, op8_suffix_dedup, repeated, substring_dedup
from driftlens.llm.suffix_sort import common_prefix, deep_shallow, neighbours


def brute(rows, length):
    seen = Counter()
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, b in bodies:
        seen.update(b[p:p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                cover[p:p + length] = True
        runs = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        out.append((i, len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def overlapping():
    rng = random.Random(9)
    say = lambda n: "".join(rng.choices("abcdé \n", k=n))
    shared = [say(n) for n in (39, 40, 41, 90, 300)]
    rows = [(i, say(rng.randrange(60)) + rng.choice(shared) + say(rng.randrange(60)) + rng.choice([*shared, ""])) for i in range(80)]
    return rows + [(100, "a" * 500), (101, "ab" * 200), (107, shared[0] + "ab" * 50 + shared[1]), (108, shared[1] + "ab" * 60 + "c" + "ab" * 21), (102, "x" * 39), (103, "y" * 40), (104, "y" * 40), (105, shared[4][50:150]), (106, say(700))]


key = lambda r: tuple(map(str, r))


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"chunk": 5, "gram": 30}])
def test_against_brute_force(docs_of, awkward, options):
    rows = overlapping() + [(None if i is None else 1000 + i, t) for i, t in awkward if len(t or "") < 6000]
    got = substring_dedup(docs_of(rows, clashing=True), length=40, **{"gram": 12, **options}).drop("kept").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 40), key=key)


def test_hot_anchor_is_not_dealt_to_one_task(spark):
    rows = [(k, 0, 7 if k % 4 else k // 8 if k < 2000 else k, 0, 0) for k in range(4000)]
    spots = spark.createDataFrame(rows, "key bigint, pos bigint, h bigint, least int, most int").repartition(8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        often, some_hot = repeated(spots, 100)
        got = often.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    counts = Counter(r[2] for r in rows)
    assert some_hot and sorted((r["key"], r["h"], r["hot"]) for r in got) == sorted((r[0], r[2], counts[r[2]] > 100) for r in rows if counts[r[2]] > 1)
    assert max(Counter(r["task"] for r in got if r["hot"]).values()) < len(rows) / 4


def test_query_gives_what_is_left(spark, docs_of, tmp_path):
    rng = random.Random(12)
    say = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, short = say(450), say(390)
    # é and è share their first byte: the passage runs into the character.
    rows = [(1, "x" + passage + "é one"), (2, "y" + passage + "è two"), (3, say(600)), (4, None), (5, "u" + short + "v"), (6, "w" + short + "z")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op8_suffix_dedup(spark, str(tmp_path)).collect()}
    left = {1: "x\ufffd one", 2: "y\ufffd two"}
    assert {i: r["text"] for i, r in got.items()} == {i: left.get(i, t or "") for i, t in rows}
    assert {i: r["n_removed"] for i, r in got.items()} == {i: 451 if i in left else 0 for i, _ in rows}
    assert [tuple(got[i])[1:5] for i, _ in rows] == [r[1:] for r in brute(rows, 400)]


def test_empty_table(docs_of):
    assert substring_dedup(docs_of([])).count() == 0


def test_every_string_has_its_anchor():
    rng = np.random.default_rng(2)

    def served(data, piece=1 << 20):
        places, _, least, most = anchors(data, 30, 8, piece)
        starts = {}
        for x, a, b in zip(places, least, most, strict=True):
            for m in range(a, b + 1):
                assert starts.setdefault(int(x) - m, int(x)) == x and 0 <= m <= 22
        return starts

    for _ in range(50):
        data = rng.integers(0, rng.choice([1, 2, 3]) + 1, int(rng.integers(30, 400))).astype(np.uint8)
        at = served(data)
        assert sorted(at) == list(range(len(data) - 29)) and at == served(data, 16)
        shifted = served(np.concatenate((rng.integers(0, 3, 17).astype(np.uint8), data)))
        assert all(shifted[p + 17] == x + 17 for p, x in at.items())


def test_deep_shallow_sorts():
    rng = random.Random(3)
    for _ in range(300):
        stem = bytes(rng.randrange(2) for _ in range(60))
        strings = [rng.choice([b"", stem[:rng.randrange(61)]]) + bytes(rng.randrange(3) for _ in range(rng.randrange(50))) for _ in range(rng.randrange(1, 60))]
        order = deep_shallow(strings)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        shared = neighbours(strings, order)
        assert all(shared[k] == common_prefix(strings[order[k - 1]], strings[order[k]]) for k in range(1, len(order)))
