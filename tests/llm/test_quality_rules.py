import random
from collections import Counter

import duckdb
import pytest

from driftlens.llm import quality_rules as qr

SPACE = " \t\n\x0b\x0c\r"


def plain(text):
    """The measurements, read off the contract a character and a word at a time."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)), "n_repeat_words": len(inside), "n_lines": len(lines),
        "n_letters": sum(c.isalpha() for c in text), "n_upper": sum(c.isupper() for c in text),
        "n_bare_words": sum(not any(c.isalpha() for c in w) for w in words), "n_exclaims": text.count("!"),
        "n_same_words": sum(a == b for a, b in zip(words, words[1:])), "longest_word": max(map(len, words), default=0),
    }


def random_text(rng):
    kind = rng.random()
    odd = rng.choice([["NO!!"], ["x###"], ["|", "12"], ["!"], ["<b>", "NO!!", "x###", "|"], ["ça"]])
    plain_word = lambda: "".join(rng.choices("abcdeü", k=rng.randint(2, 6)))
    share = rng.choice([0.02, 0.15, 0.45])
    words = [rng.choice(odd) if rng.random() < share else plain_word() for _ in range(rng.randint(0, 150))]
    if kind < 0.3:
        words = words[:5] * rng.randint(1, 20)
    return "".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\n\n"]) for w in words)


@pytest.fixture(scope="module")
def rows(awkward):
    rng = random.Random(9)
    return [*awkward, *((100 + i, random_text(rng)) for i in range(250))]


@pytest.fixture(scope="module")
def ledger(docs_of, rows):
    return qr.ledger(docs_of(rows, clashing=True)).cache()


def test_measurements(ledger, rows):
    wanted = sorted(((i, *(plain(t)[m] for m in qr.MEASURES)) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in ledger.select("doc_id", *qr.MEASURES).collect()), key=repr) == wanted


def fails(values):
    return {rule.name for rule in qr.RULES if eval(rule.fails.replace(" = ", " == "), {}, values)}


def test_bits_and_policies(ledger):
    found = ledger.withColumns({f"p{n}": qr.stays(p) for n, p in enumerate(qr.POLICIES)}).collect()
    for row in found:
        failed = fails(row.asDict())
        assert {rule.name for rule in qr.RULES if row.fail_mask >> rule.bit & 1} == failed
        assert [row[f"p{n}"] for n in range(len(qr.POLICIES))] == [not failed & set(p.rules) for p in qr.POLICIES]
    counts = {(r.policy, r.version): (r.n_docs, r.n_kept) for r in qr.compare_policies(ledger).collect()}
    assert counts == {(p.name, p.version): (len(found), sum(r[f"p{n}"] for r in found)) for n, p in enumerate(qr.POLICIES)}


def test_ablation(ledger):
    masks = [fails(r.asDict()) & set(qr.CURRENT.rules) for r in ledger.collect()]
    found = {r.rule: (r.n_failed, r.n_alone, r.n_kept_without) for r in qr.ablation(ledger).collect()}
    kept = sum(not m for m in masks)
    assert found == {
        name: (sum(name in m for m in masks), sum(m == {name} for m in masks), kept + sum(m == {name} for m in masks)) for name in qr.CURRENT.rules
    }
    assert sum(alone for _, alone, _ in found.values()) > 5


def test_bits_are_unique():
    assert len({r.bit for r in qr.RULES}) == len({r.name for r in qr.RULES}) == len(qr.RULES)


def test_kept_documents_keep_their_columns(docs_of, rows, ledger):
    docs = docs_of(rows, clashing=True)
    kept = qr.keep_by_policy(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, (r.doc_id for r in ledger.where(qr.stays(qr.CURRENT)).collect())))


def test_query_equals_sql_on_awkward_rows(spark, docs_of, rows, tmp_path):
    # Neighbouring code points that one side may not know as letters stay out: none here.
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    df = qr.op12_quality_rules(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({qr.OP12_SQL})").fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(wanted, key=repr)


def test_clean_labels_stay(spark):
    """Documents of at least 50 words labelled good are kept, and most labelled bad go."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = qr.op12_quality_rules(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("n_words >= 50").groupBy("quality").agg(
        {"*": "count", "n_words": "min"}).collect()
    assert len(rows) == 2
    kept = qr.op12_quality_rules(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("n_words >= 50").groupBy("quality", "kept").count().collect()
    share = {q: sum(r["count"] for r in kept if r.quality == q and r.kept) / sum(r["count"] for r in kept if r.quality == q) for q in (0, 1)}
    assert share[1] > 0.999 and share[0] < 0.25


def test_empty_table(docs_of):
    empty = qr.ledger(docs_of([]))
    assert empty.collect() == [] and qr.ablation(empty).collect() == [] and qr.compare_policies(empty).collect() == []
