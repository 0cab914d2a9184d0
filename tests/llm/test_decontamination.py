import random
import re
from itertools import combinations

import pytest

from driftlens.llm.decontamination import GROUPS, contaminated, keep_clean


def brute(docs, items, window=16, percent=80):
    """Every pair where some window agrees well enough at any shift."""
    cut = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    found = set()
    for d, text in docs:
        words = cut(text)
        for i, item in items:
            b = cut(item)
            need = min(window, len(b))
            if len(b) < 5:
                continue
            for shift in range(-len(b), len(words) + 1):
                same = [0 <= k + shift < len(words) and words[k + shift] == w for k, w in enumerate(b)]
                if any(100 * sum(same[k:k + need]) >= percent * need for k in range(len(b) - need + 1)):
                    found.add((d, i))
    return found


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    say = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, say(rng.choice([6, 12, 16, 25, 40]))) for i in range(12)]
    docs = []
    for d in range(60):
        body = say(rng.randrange(0, 50))
        if d % 3 == 0:
            _, item = rng.choice(items)
            item = list(item)
            for _ in range(rng.randrange(0, 1 + len(item) // 10)):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(body) + 1)
            body = body[:at] + item + body[at:]
        elif d % 3 == 1:
            _, item = rng.choice(items)
            body += item[:max(3, len(item) // 3)]
        docs.append((d, " ".join(body)))
    return docs, [(i, ", ".join(w).upper()) for i, w in items]


@pytest.mark.parametrize("block_keys", [1_000_000, 50])
def test_against_brute_force(spark, docs_of, case, block_keys):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_of(docs, clashing=True), bench, block_keys=block_keys, few=3).collect()}
    assert got == brute(docs, items)
    assert {r.doc_id for r in keep_clean(docs_of(docs, clashing=True), bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_awkward_rows(spark, docs_of, awkward):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, awkward[3][1][:200]), (4, "a " * 40)], "item_id bigint, text string")
    docs = docs_of(awkward, clashing=True)
    hit = contaminated(docs, bench).collect()
    assert {r.item_id for r in hit} == {None} and {r.doc_id for r in hit} == {None, 4, 5, 6, 14}
    assert keep_clean(docs, bench).columns == docs.columns and keep_clean(docs, bench).count() == len(awkward) - 6


def test_empty_tables(spark, docs_of, awkward):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contaminated(docs_of(awkward), none).count() == 0 and keep_clean(docs_of(awkward), none).count() == len(awkward)
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    assert contaminated(docs_of([]), some).count() == 0 and keep_clean(docs_of([]), some).count() == 0


def test_seeds_hit_every_pattern_of_the_rule():
    lost = []
    for n in range(5, 17):
        masks = next(masks for least, masks in GROUPS if n >= least)
        places = [{p + k for k in mask} for mask in masks for p in range(n - mask[-1])]
        lost += [(n, c) for c in combinations(range(n), n * 20 // 100) if not any(p.isdisjoint(c) for p in places)]
    assert lost == []


@pytest.mark.parametrize("block_keys", [1_000_000, 50])
def test_substitutions_in_short_items(spark, docs_of, block_keys):
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in range(5, 17)]
    docs = [
        (f"{n}-{c}", "before it " + " ".join("other" if k in c else w for k, w in enumerate(words)) + " and after")
        for n, words in items for c in combinations(range(n), n * 20 // 100)
    ]
    rows = [(d, text) for d, (_, text) in enumerate(docs)]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_of(rows), bench, block_keys=block_keys).collect()}
    assert got == {(d, int(name.split("-")[0])) for d, (name, _) in enumerate(docs)}


def test_edges_of_a_document(spark, docs_of):
    """A window of 16 item words counts with 13 equal ones wherever the others lie, outside the document too."""
    item = [f"w{k}" for k in range(40)]
    cuts = {1: ["x"] * 20 + item[10:25] + ["y"] * 20, 2: item[10:25], 3: ["x"] * 20 + item[:13], 4: item[27:] + ["y"] * 20, 5: item[10:22], 6: ["x"] * 20 + item[:12]}
    rows = [(d, " ".join(words)) for d, words in cuts.items()]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "a b c d e")], "item_id bigint, text string")
    found = {r.doc_id: (r.start_word, r.n_words, r.n_same) for r in contaminated(docs_of([*rows, (7, "a b c d"), (8, "a b c")]), bench).collect()}
    assert found == {1: (10, 40, 15), 2: (0, 15, 15), 3: (20, 13, 13), 4: (0, 13, 13), 7: (0, 4, 4)}


def test_query_equals_sql_on_planted_rows(spark, docs_of, case, tmp_path):
    import duckdb

    from driftlens.llm.decontamination import OP6_SQL, op6_decontamination
    docs, items = case
    docs_of(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, op6_decontamination(spark, str(tmp_path)).collect()))
    assert got == sorted(duck.sql(OP6_SQL).fetchall()) and got
