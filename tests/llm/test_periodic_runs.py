import hashlib
import random
import zlib

import pytest

from driftlens.llm import periodic_runs as pr


def plain_runs(words, exponent=4, length=6):
    """Every period tried at every place; a stretch found with several periods keeps the smallest."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(length, exponent * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapse(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in dropped]


def random_words(rng):
    words = []
    while len(words) < rng.randint(0, 120):
        part = [rng.choice("abc").encode() for _ in range(rng.randint(1, 6))]
        words += part * rng.randint(1, 7) if rng.random() < 0.5 else [rng.choice("abcdefgh").encode()]
        if rng.random() < 0.2:
            words = words[:-1]
    return words


def test_against_plain_search():
    rng = random.Random(11)
    texts = [random_words(rng) for _ in range(600)]
    found = pr.find_all(texts)
    assert found == [plain_runs(t) for t in texts]
    assert sum(map(len, found)) > 500
    assert [pr.collapse(t, r) for t, r in zip(texts, found)] == [plain_collapse(t, r) for t, r in zip(texts, found)]


@pytest.mark.parametrize("exponent, length", [(2, 2), (2, 6), (3, 5), (5, 12)])
def test_other_bounds(exponent, length):
    rng = random.Random(exponent * 10 + length)
    texts = [random_words(rng) for _ in range(150)]
    assert pr.find_all(texts, exponent, length) == [plain_runs(t, exponent, length) for t in texts]


def test_fibonacci_and_thue_morse():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    assert pr.find_all([b], 2, 2) == [plain_runs(b, 2, 2)]
    morse = [b"ab"[bin(i).count("1") % 2:][:1] for i in range(512)]
    assert pr.find_all([morse], 2, 2) == [plain_runs(morse, 2, 2)] and pr.find_all([morse], 3, 6) == [[]]


def test_long_runs_in_one_text():
    words = [b"x"] * 60_000 + [b"a", b"b", b"c"] * 20_000 + [str(i).encode() for i in range(1000)] * 5
    assert pr.find_all([words]) == [[(0, 60_000, 1), (60_000, 60_000, 3), (120_000, 5000, 1000)]]


def test_texts_do_not_touch():
    assert pr.find_all([[b"a"] * 4, [b"a"] * 4, [], [b"a"] * 6]) == [[], [], [], [(0, 6, 1)]]


def plain_query(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(plain_collapse(words, runs))),
    )


def test_query_against_plain_search(spark, tmp_path, docs_of, awkward):
    rng = random.Random(5)
    rows = [r for r in awkward if not r[1] or len(r[1]) < 20_000]
    rows += [(100 + i, b" ".join(random_words(rng)).decode()) for i in range(150)]
    docs_of(rows, clashing=True).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in pr.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted([plain_query(*r) for r in rows], key=repr)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 8


def test_query_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    some = [r for r in docs if len(r.text or "") < 6000]
    found = {r[0]: tuple(r) for r in pr.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(docs) and len(some) > 150
    assert [found[r.doc_id] for r in some] == [plain_query(*r) for r in some]


def test_empty_table_and_bad_bounds(spark, docs_of):
    assert pr.periodic_runs(docs_of([])).collect() == []
    with pytest.raises(ValueError):
        pr.periodic_runs(docs_of([]), 1)
