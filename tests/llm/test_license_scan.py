import random
import re
from functools import cache

import pytest

from driftlens.llm.license_scan import BASE, HINT, LEADS, fired, license_scan, rules

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in BASE.items():
        want = phrase.split()
        for k in range(len(words) - len(want) + 1):
            if words[k:k + len(want)] == want:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_phrases(docs_of, awkward):
    rng = random.Random(2)
    bits = ["under the MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc-by", "under the-mit.license", "é", "word", "version 2", "ccby nc", "Apache license version 20", "K"]
    rows = [(100 + i, " ".join(rng.choices(bits, k=8))) for i in range(150)] + [(50 + n, t) for n, (_, t) in enumerate(awkward)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan(docs_of(rows, clashing=True)).collect()}
    assert got == {i: brute(t) for i, t in rows}


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the GNU General Public License, version 3", "gpl-3"),
    ("This is GPLv2+ code", "gpl-2"),
    ("released under the Apache License, Version 2.0 and nothing else", "apache-2"),
    ("the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
    ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa-4.0"),
    ("the 3-clause BSD license or the MIT license", "bsd-3-clause,mit"),
    ("fahren mit dem Zug", ""), ("the general public", ""), ("apache helicopters", "apache"), ("a poetic licence", ""),
])
def test_labels(docs_of, text, labels):
    (row,) = license_scan(docs_of([(1, text)])).collect()
    assert row.labels == labels or text.startswith("apache h") and row.score <= 0.6
    assert 0 <= row.score <= 1 and (row.score > 0) == bool(row.labels)


def test_rules_compile_and_are_many():
    made = rules()
    assert len(made) > 300 and all(re.compile(r[2]) for r in made)
    assert all(" " not in keyword for _, keyword, _, _ in made)


def test_empty_table(docs_of):
    assert license_scan(docs_of([])).count() == 0


@cache
def ways(pattern):
    """Every string that a rule's pattern, which has no unbounded repeats, matches."""
    def walk(parts):
        made = [""]
        for op, value in parts:
            name = str(op)
            if name == "LITERAL":
                tails = [chr(value)]
            elif name == "IN":
                tails = [chr(v) for _, v in value]
            elif name == "SUBPATTERN":
                tails = walk(value[3])
            elif name == "BRANCH":
                tails = [w for part in value[1] for w in walk(part)]
            elif name == "MAX_REPEAT":
                assert value[:2] == (0, 1)
                tails = ["", *walk(value[2])]
            else:
                assert name in ("ASSERT", "ASSERT_NOT")
                continue
            made = [m + t for m in made for t in tails]
        return made

    return sorted(set(walk(re._parser.parse(pattern))))


def test_every_match_holds_its_keyword():
    assert [(r, w) for r in rules() for w in ways(r[2]) if r[1] not in w.split()] == []


def test_every_rule_fires_on_its_own_text(spark):
    made = rules()
    texts = [(i, f" {w} ") for i, r in enumerate(made) for w in {ways(r[2])[0], ways(r[2])[-1]}]
    texts = [(n, i, t) for n, (i, t) in enumerate(texts)]
    got = {(r.row, r.label, r.priority, r.e) for r in fired(spark.createDataFrame(texts, "row bigint, rule bigint, norm string")).collect() if r.s == 1}
    assert [made[i] for n, i, t in texts if (n, made[i][0], made[i][3], len(t) - 1) not in got] == []


@pytest.mark.parametrize("text, label", [
    ("built on FreeBSD", "bsd-2-clause"), ("Beerware License", "beerware"), ("Beer-Ware license", "beerware"), ("No license is granted.", "proprietary"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
])
def test_labels_of_phrases_alone(docs_of, text, label):
    assert license_scan(docs_of([(1, text)])).first().labels == label


@pytest.mark.parametrize("between", [" ", "_", "\n", " \t\r\n# ", "-", "`", "[", "/", "\x00"])
def test_every_match_has_a_hint(between):
    bare = {w for r in rules() if not r[2].startswith(f"(?<= )(?:{LEADS}") for w in ways(r[2])} | set(BASE)
    found = re.compile(HINT)
    assert [t for t in bare if not found.search(f"_{t.replace(' ', between).upper()}_") or not found.search(t.replace(" ", between))] == []


def test_separators_other_than_spaces(docs_of):
    rng = random.Random(3)
    phrases = ["CC BY-NC", "under the MIT License", "Apache License Version 2", "cc by", "éCC by NC", "CC BY NCé", "word"]
    rows = [(1, "data/cc_by_nc/x.json"), (2, "Photo: CC-BY_NC"), (3, "_CC BY-NC 4.0_"), (4, "é_cc\nby\r\nnc_é"), (5, "cc_by_ncé"), (6, "écc_by_nc"), (7, "acc_by_nc")]
    for n in range(200):
        between = [rng.choice(["_", "\n", " ", "__", "-", "\r\n  ", "`"]) for _ in range(30)]
        words = " ".join(rng.choices(phrases, k=3)).replace("-", " ").split()
        rows.append((10 + n, "".join(w + b for w, b in zip(words, between))))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan(docs_of(rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_a_wrapped_grant(docs_of):
    text = "Permission\nto use, copy, modify, and/or\n * distribute this software for any purpose with or without fee is\nhereby granted"
    mit = "Permission\n# is hereby granted, free of charge, to any person\n# obtaining a copy of this software"
    assert [r.labels for r in license_scan(docs_of([(1, text), (2, mit)])).orderBy("doc_id").collect()] == ["isc", "mit"]
