import hashlib
import random
import re

from pyspark.sql import functions as F

from driftlens.llm.secret_scan import SPANS, ratio, scanned, secret, secret_spans, train, untouched
from driftlens.session import cut_lineage

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW](?:[oO][rR])?[dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def texts():
    rng = random.Random(8)
    key = lambda a, n: "".join(rng.choices(a, k=n))
    made = []
    for i in range(200):
        plain = " ".join(rng.choice(["river", "mountain", "some_variable_name", "internationalization", "walking2school", "2024"]) for _ in range(30))
        secret = rng.choice([
            f'PassWord: "{key("abcXYZ0189", 12)}"', f"token={key('ab', 5)}", f"api_key = '{key('abc123', 9)}", f"secret==={key('abc', 6)}",
            "AKIA" + key("ABC123", 16), "AKIA" + key("ABC123", 15), key("0123456789abcdef", 40), key("0123456789abcdef", 23), "😀 passwd = é", "",
            key("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 40),
        ])
        made.append((i, f"{plain} {secret} {plain}"))
    return made


def test_fixed_patterns(docs_of, awkward):
    rows = [*texts(), *[(None if i is None else 1000 + n, t) for n, (i, t) in enumerate(awkward)]]
    got = secret_spans(docs_of(rows, clashing=True)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(brute(t))
    for r in got:
        assert [(s.s, s.kind_no, s.e) for s in r.spans if s.kind_no < 3] in want[r.doc_id]


def test_models_add_random_strings_only(docs_of):
    rows = texts()
    text = dict(rows)
    added = {text[r.doc_id][s.s:s.e] for r in secret_spans(docs_of(rows)).collect() for s in r.spans if s.kind_no == 3}
    unseen = {m for t in text.values() for m in re.findall("(?<![A-Za-z0-9])[A-Za-z0-9]{40}(?![A-Za-z0-9])", t) if not re.fullmatch("[0-9a-f]+", m)}
    assert unseen and len(unseen - added) <= 0.1 * len(unseen)
    assert not any("variable" in a or "walking" in a for a in added)


def test_query_digest(spark, tmp_path, docs_of):
    from driftlens.llm.secret_scan import op1_secret_scan
    docs_of(texts()).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op1_secret_scan(spark, str(tmp_path)).collect():
        base = brute(dict(texts())[r.doc_id])
        joined = ",".join(f"{['assign', 'access', 'hex'][k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_empty_table(docs_of):
    assert secret_spans(docs_of([])).count() == 0


LETTERS, CAPITALS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "letters and digits": LETTERS + CAPITALS + DIGITS, "letters": LETTERS + CAPITALS, "small and digits": LETTERS + DIGITS, "capitals and digits": CAPITALS + DIGITS,
    "small": LETTERS, "capitals": CAPITALS, "base64": LETTERS + CAPITALS + DIGITS + "+/",
}
NAMES = [
    "getElementsByClassName2", "some_variable_name", "internationalization", "handleUserInputChange", "2023-01-15T10", "org/apache/commons/lang3", "============",
    "------------", "4111111111111111", "v1/users/profile/settings", "utf8_general_ci", "page_2_section_4", "windows-1252-encoding",
]


def test_recall_by_alphabet_and_few_false_alarms(spark):
    """Models fitted on real rows, judging strings that these rows do not hold. At least 0.9 from length 16 on."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = train(docs, cut_lineage(scanned(docs, "text", "doc_id")), "text", "doc_id")
    rng = random.Random(11)
    rows = [(f"{a} {k}", "".join(rng.choices(c, k=k))) for a, c in ALPHABETS.items() for k in (16, 20, 24, 32) for _ in range(200)]
    rows += [("name", n) for n in NAMES]
    judged = spark.createDataFrame(rows, "kind string, word string").select("kind", secret(F.col("word"), ratio(F.col("word"), model)).cast("int").alias("hit"))
    rates = {r.kind: r.rate for r in judged.groupBy("kind").agg(F.avg("hit").alias("rate")).collect()}
    assert rates.pop("name") * len(NAMES) <= 1
    assert {k: r for k, r in rates.items() if r < 0.9} == {}
    found = secret_spans(docs).where("exists(spans, x -> x.kind_no = 3)")
    assert found.count() <= 2


def test_tokens_that_touch_fixed_spans(spark):
    """Against a plain search: a token is judged when no fixed span overlaps it, wherever the span starts."""
    rng = random.Random(12)
    rows = []
    for _ in range(300):
        cuts = sorted(rng.sample(range(60), 2 * rng.randrange(0, 6)))
        tokens = [(s, e, "t") for s, e in zip(cuts[::2], cuts[1::2])]
        starts = [rng.randrange(60) for _ in range(rng.randrange(0, 4))]
        rows.append((tokens, [(s, s + rng.randrange(1, 9), "f") for s in starts]))
    got = spark.createDataFrame(rows, f"tokens {SPANS}, fixed {SPANS}").select("tokens", "fixed", untouched(F.col("tokens"), F.col("fixed")).alias("free")).collect()
    for r in got:
        assert r.free == [t for t in r.tokens if not any(f.s < t.e and t.s < f.e for f in r.fixed)]
