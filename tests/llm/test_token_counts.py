import base64
import random
import re
from collections import Counter

import tiktoken
from pyspark.sql import functions as F

from driftlens.llm.token_counts import PATTERN, VOCABULARY, changes, commit, compact, count_tokens, deltas, feed, op7_token_counts, totals

CHANGES = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def test_against_plain_counts(docs_of, awkward, tmp_path):
    rows = [(i, t, None if n % 5 == 0 else f"s{n % 3}", None if n % 4 == 0 else "en") for n, (i, t) in enumerate(awkward * 2)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    encoder = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, tokens = Counter(), Counter()
    for _, text, source, lang in rows:
        words = len([w for w in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")])
        for name, n in (("words-1", words), ("byte-bpe-50k", len(encoder.encode_ordinary(text or "")))):
            docs[source, lang, name] += 1
            tokens[source, lang, name] += n
    got = count_tokens(docs_of(rows, clashing=True), f"file://{tmp_path}/ledger").collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == {k: (docs[k], tokens[k]) for k in docs}


def test_inserts_deletes_and_revisions(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    change = lambda *rows: spark.createDataFrame(rows, CHANGES)
    assert totals(spark, ledger).count() == 0
    assert commit(change(("a", "en", "w", 1, 10), ("a", "en", "w", 1, 5), ("b", None, "w", 1, 7)), ledger, "1")
    assert commit(change(("a", "en", "w", -1, -10), ("a", "en", "w", 1, 12)), ledger, "2")          # a revision
    assert commit(change(("b", None, "w", -1, -7)), ledger, "3")                                     # a delete
    assert not commit(change(("a", "en", "w", 1, 999)), ledger, "1")                                 # a replay
    got = [tuple(r) for r in totals(spark, ledger).collect()]
    assert got == [("a", "en", "w", 2, 17)]
    compact(spark, ledger, f"{ledger}-2")
    assert [tuple(r) for r in totals(spark, f"{ledger}-2").collect()] == got


def test_a_half_written_batch_is_replaced(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    (tmp_path / "ledger/batch=1").mkdir(parents=True)
    (tmp_path / "ledger/batch=1/part-0.parquet").write_bytes(b"broken")
    assert commit(spark.createDataFrame([("a", "en", "w", 1, 3)], CHANGES), ledger, "1")
    assert [r.n_tokens for r in totals(spark, ledger).collect()] == [3]


def test_empty_table(docs_of, tmp_path):
    assert count_tokens(docs_of([]), f"file://{tmp_path}/ledger").count() == 0
    assert count_tokens(docs_of([(1, None)]), f"file://{tmp_path}/other").select(F.sum("n_tokens")).first()[0] == 0


def plain(rows):
    """Documents and words by (source, lang)."""
    docs, words = Counter(), Counter()
    for _, text, source, lang in rows:
        docs[source, lang] += 1
        words[source, lang] += len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    return {k: (docs[k], words[k]) for k in docs}


def found(rollup):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.collect()}


def test_changes_of_tables_with_replays(docs_of, awkward, tmp_path):
    """Random old and new tables with nulls, repeated rows and moves between groups, each batch committed twice."""
    rng = random.Random(3)
    ledger = f"file://{tmp_path}/ledger"
    pick = lambda: (rng.choice([None, *range(8)]), rng.choice([None, "", *[t for _, t in awkward if t and len(t) < 500]]), rng.choice(["a", "b", None]), rng.choice(["en", None]))
    now = []
    for batch in range(5):
        later = rng.sample(now, len(now) // 2) + [pick() for _ in range(rng.randrange(0, 12))]
        signed = changes(docs_of(now, clashing=True), docs_of(later, clashing=True), {})
        assert commit(signed, ledger, str(batch)) and not commit(signed, ledger, str(batch))
        now = later
        assert found(totals(docs_of([]).sparkSession, ledger)) == plain(now)
    assert changes(docs_of(now), docs_of(rng.sample(now, len(now))), {}).count() == 0
    commit(changes(docs_of(now), docs_of([]), {}), ledger, "all gone")
    assert totals(docs_of([]).sparkSession, ledger).count() == 0


def test_the_feed_moves_counts_and_ends_where_it_began(docs_of):
    rows = [(n, f"a  b\t\tc {n}", "s", "en") for n in range(200)]
    steps = [deltas(changes(old, new)).collect() for _, old, new in feed(docs_of(rows))]
    moved = [{(r.tokenizer): (r.n_docs, r.n_tokens) for r in step} for step in steps]
    assert moved[0]["words-1"][0] < 0 and moved[1].keys() == {"byte-bpe-50k"} and moved[1]["byte-bpe-50k"][0] == 0
    assert all(sum(m.get(name, (0, 0))[k] for m in moved) == 0 for name in ("words-1", "byte-bpe-50k") for k in (0, 1))


def test_query_equals_a_plain_load(spark, docs_of, awkward, tmp_path):
    rows = [(n, t, f"s{n % 3}") for n, (_, t) in enumerate(awkward * 3) if len(t or "") < 10_000]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = count_tokens(docs_of(rows), f"file://{tmp_path}/ledger").collect()
    assert sorted(map(tuple, op7_token_counts(spark, str(tmp_path)).collect())) == sorted(map(tuple, want))
