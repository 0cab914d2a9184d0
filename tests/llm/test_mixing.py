import re

import pytest

from driftlens.llm.mixing import keep_mixed, mix, permuted, source_targets, words_taken
from pyspark.sql import functions as F


def waterfill(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    want, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = want - sum(most * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return {**target, **{s: most * sizes[s] for s in capped}}
        capped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 500, None: 20, "é": 7, "Z": 3}, {"a": 10, "b": 0}, {"x": 5}, {f"s{i}": i * i for i in range(30)},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(waterfill(sizes))


def rows():
    return [(i, " ".join(["w"] * (i % 97)), None if i % 11 == 0 else f"s{i % 5}") for i in range(2000)]


def test_mix_holds_its_promises(docs_of):
    got = words_taken(docs_of(rows(), clashing=True)).collect()
    again = words_taken(docs_of(rows()).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = {i: len(re.findall(r"[^\x20\x09-\x0d]+", t)) for i, t, _ in rows()}
    assert {r.doc_id: r["size"] for r in got} == size
    assert all(r.taken <= 2 * r["size"] for r in got)
    source, taken, target = {i: s for i, _, s in rows()}, {}, {}
    for r in got:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    for s, words in taken.items():
        assert words == pytest.approx(target[s], abs=200)


def test_blocks_of_a_pass_are_all_different(docs_of):
    facts, mixed, pieces = mix(docs_of(rows()), block=16)
    passes = mixed.join(facts.select("source_no", "n_blocks").distinct(), "source_no").withColumn("turn", F.floor(F.col("place") / F.col("n_blocks")))
    assert passes.groupBy("source_no", "turn", "block_no").count().where("count > 1").isEmpty()
    assert mixed.join(pieces, ["source_no", "block_no"], "left_anti").isEmpty()
    laid = pieces.groupBy("row").agg(F.sum("words").alias("words")).join(facts, "row")
    assert laid.where("words <> size").isEmpty()


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_awkward_rows(docs_of, awkward):
    got = words_taken(docs_of(awkward, clashing=True)).collect()
    assert len(got) == len(awkward)
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    kept = keep_mixed(docs_of(awkward, clashing=True))
    assert kept.where("taken <= 0").isEmpty() and 0 < kept.count() <= len(awkward)


def test_no_words(docs_of):
    assert words_taken(docs_of([])).count() == 0
    assert [(r["size"], r.taken, r.target) for r in words_taken(docs_of([(1, None), (2, " ")])).collect()] == [(0, 0, 0.0)] * 2
