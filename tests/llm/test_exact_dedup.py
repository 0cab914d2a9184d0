import hashlib
import re

from driftlens.llm.exact_dedup import exact_dedup, keep_first


def brute(rows):
    """Counter of expected (doc_id, keep_id, group_size, text_sha256) rows, and of kept ones."""
    groups = {}
    for i, text in rows:
        norm = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups.setdefault(norm, []).append((i, len(text or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return out, len(groups)


def test_against_brute_force(docs_of, awkward):
    got = exact_dedup(docs_of(awkward, clashing=True), runs=6, fan_in=2).collect()
    want, groups = brute(awkward)
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == groups


def test_longest_then_smallest_stays(docs_of):
    rows = [(5, "ab"), (3, "a b"), (2, "a b"), (1, "ab")]
    got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in exact_dedup(docs_of(rows)).collect()}
    assert got == {5: (2, False, 4), 3: (2, False, 4), 2: (2, True, 4), 1: (2, False, 4)}


def test_kept_rows_are_whole(docs_of, awkward):
    docs = docs_of(awkward, clashing=True)
    kept = keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == brute(awkward)[1]
    rows = [(i, "t" if i % 3 else "u") for i in range(300)]
    assert sorted(r.doc_id for r in keep_first(docs_of(rows)).collect()) == [0, 1]


def test_empty_table(docs_of):
    assert exact_dedup(docs_of([])).count() == 0 and keep_first(docs_of([])).count() == 0
