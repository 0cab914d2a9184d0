import glob
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from driftlens.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows, group=5):
    """Nodes as sequences of turns, subtrees by comparing sequences."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, group)), [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    parents = {n[:-1] for n in members if n}
    out = []
    children, leaves, saved = {}, {}, {}
    for n, who in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] = leaves.get(n[:d], 0) + (n not in parents)
            saved[n[:d]] = saved.get(n[:d], 0) + ((len(who) - 1) * len(n[-1][1].encode()) if n else 0)
        if n:
            children[n[:-1]] = children.get(n[:-1], 0) + 1
    for n, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if rebuilt[c] == n)
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), children.get(n, 0), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def random_rows(rng, convs, length, start=0):
    rows = []
    for c in range(start, start + convs):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.randint(1, length)):
            rows.append((c, turn, rng.choice(["user", "assistant"][turn % 2:turn % 2 + 1]), rng.choice(["a", "bb", "é", ""] if turn else ["hello"])))
    return rows


def test_against_plain_trie(spark):
    rows = random_rows(random.Random(3), 300, 14)
    assert found(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), shard_rows=100)) == plain_trie(rows)


def test_long_conversations_in_bands(spark, monkeypatch):
    monkeypatch.setattr(pt, "BAND", 4)
    rows = random_rows(random.Random(4), 120, 40)
    copies = [(c + 1000, t, r, x) for c, t, r, x in rows if c < 40]
    longer = [(c + 2000, t, r, x) for c, t, r, x in rows if c < 20] + [(c + 2000, 100 + t, "user", "more") for c in range(20) for t in range(9)]
    every = rows + copies + longer
    # With groups of one, copies stay copies to their end.
    for group in (5, 1):
        assert found(pt.prefix_trie(spark.createDataFrame(every, SCHEMA), group, shard_rows=150)) == plain_trie(every, group)


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, None, None), (0, 1, "user", "x"), (0, 2, "user", "x" * 100_000), (-3, 0, "user", "x"), (-7, 1, None, "y"),
        (5, 0, "a", "bc"), (6, 0, "ab", "c"), (7, 0, "a", "bc"), (7, 0, "a", "bc"), (11, 5, "", ""), (12, None, "", None), (13, 1, "t", "1"), (13, 0, "t", "0"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    clashing = df.withColumns({c: F.lit(1) for c in ("conv", "pos", "depth", "a", "b", "size", "total", "shard", "band", "kind", "n", "h1", "lead")})
    for table in (df, clashing):
        assert found(pt.prefix_trie(table)) == plain_trie(rows)
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, 0, "u", x) for x in "abcdefghijkl"]
    orders = {tuple(found(pt.prefix_trie(spark.createDataFrame(rs, SCHEMA)))) for rs in (rows, rows[::-1])}
    assert len(orders) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_node_table_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    d1, d2 = rng.integers(-2**63, 2**63 - 1, (2, n), dtype=np.int64)
    nodes = pt.NodeTable(d1, d2)
    assert nodes.size == n and sorted(nodes.slots(d1, d2)) == list(range(n))
    # Digests that share one half with a known one are told apart.
    assert (nodes.slots(d1, d2 + 1) == -1).all() and (nodes.slots(d2, d1) == -1).all()


def test_repeated_digests_are_refused():
    with pytest.raises(ValueError):
        pt.NodeTable(np.array([1, 1]), np.array([2, 2]))


def test_a_digest_of_two_prefixes_is_noticed(spark, monkeypatch):
    from pyspark.sql import functions as F
    rows = [(c, 0, "user", str(c)) for c in range(1, 5)]
    real = pt.rebuilt_turns
    clash = lambda turns, group: real(turns, group).withColumn("h1", F.col("depth")).withColumn("h2", F.col("depth"))
    monkeypatch.setattr(pt, "rebuilt_turns", clash)
    with pytest.raises(Exception, match="one digest"):
        pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), 1, 100).collect()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{glob.glob(f'/root/testdata/{sf}/conversations.parquet')[0]}'")
    wanted = duck.sql(f"SELECT {', '.join(COLUMNS)} FROM ({pt.OP11_SQL})").fetchall()
    assert found(pt.op11_prefix_trie(spark, f"/root/testdata/{sf}")) == sorted(wanted, key=repr) and len(wanted) > 30
