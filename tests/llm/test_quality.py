import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftlens.llm import quality
from driftlens.llm.quality import classify, features, fit, counted, keep_good


def sample(n=240):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(rng.randint(1, 60))]
        good = rng.random() < 0.7
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [w + "%%%" for w in words], [words[0]] * max(6, len(words)), [w + " |" for w in words]])
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = sample()
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(docs_of, labelled):
    rows, labels = labelled
    got = classify(docs_of(rows, clashing=True), labels).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [r.predicted == truth[r.doc_id] for r in got if r.held_out]
    assert len(out) > 50 and sum(out) >= 0.9 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_labels_of_held_out_rows_are_never_read(docs_of, labelled):
    rows, labels = labelled
    flipped = labels.withColumn("quality", F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted((r.doc_id, r.score) for r in classify(docs_of(rows), x).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_awkward_rows(docs_of, awkward, labelled):
    rows, labels = labelled
    odd = labels.unionByName(labels.limit(3)).unionByName(labels.sparkSession.createDataFrame([(None, 1, 0), (4, None, 0), (5, 7, 0)], labels.schema))
    docs = docs_of(rows + [(None if i is None else 1000 + i, t) for i, t in awkward], clashing=True)
    got = classify(docs, odd).collect()
    assert len(got) == len(rows) + len(awkward) and all(r.score is not None for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert keep_good(docs, odd).columns == docs.columns


def test_without_labels(docs_of, labelled):
    none = labelled[1].limit(0)
    assert {r.score for r in classify(docs_of([(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert classify(docs_of([]), none).count() == 0


def test_pieces_of_long_texts_cover_everything():
    text = " ".join(f"word{i % 977}" for i in range(5000))
    whole = sum(len(f) for f in features(text))
    data = quality.np.frombuffer(text.encode(), quality.np.uint8)
    assert b"".join(p.tobytes() for p in quality.segments(data, 1000)) == text.encode()
    assert whole > 2 * len(text)


def test_log_odds_are_linear_in_the_average():
    rows = [counted("good text here"), counted("BAD!! BAD!!")] * 5
    weights = fit(rows, quality.np.array([1, 0] * 5), epochs=30)
    odds = [share @ weights[ids] for ids, share in rows[:2]]
    assert odds[0] > 0 > odds[1]
