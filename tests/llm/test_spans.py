import random
import re

import pytest
from pyspark.sql import functions as F

from driftlens.llm.common import match_spans, running, running_sums
from driftlens.llm.license_scan import license_scan
from driftlens.llm.secret_scan import secret_spans


@pytest.mark.parametrize("pattern", ["[a-c]+", "[0-9a-f]{4,}", "(?<=a)b", "é|😀"])
def test_spans_against_the_plain_search(spark, pattern):
    rng = random.Random(6)
    texts = ["", " ", *["".join(rng.choices("abcdef019 é😀", k=rng.randrange(200))) for _ in range(300)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string").select("t", match_spans(F.col("t"), pattern).alias("x")).collect()
    for r in rows:
        assert [(x.s, x.e, x.m) for x in r.x] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r.t)]
    assert spark.sql("SELECT string(null) AS t").select(match_spans(F.col("t"), pattern)).first()[0] is None


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 64, 1000])
def test_running(spark, n):
    rng = random.Random(n)
    numbers = [rng.randrange(-50, 50) for _ in range(n)]
    row = spark.createDataFrame([(numbers,)], "a array<bigint>").select(running_sums(F.col("a")), running(F.col("a"), F.greatest)).first()
    assert row[0] == [sum(numbers[:k + 1]) for k in range(n)] and row[1] == [max(numbers[:k + 1]) for k in range(n)]


def test_many_matches_in_one_long_text(docs_of):
    """About 1 MB each: 200,000 short runs of hex letters and one digest; 20,000 digests; 50,000 phrases."""
    digest = "0123456789abcdef0123456789abcdef"
    (row,) = secret_spans(docs_of([(1, "fade " * 200_000 + digest)])).collect()
    assert [(s.s, s.e) for s in row.spans if s.kind_no < 3] == [(1_000_000, 1_000_032)]
    (row,) = secret_spans(docs_of([(1, f"{digest} password:ok{digest} " * 10_000)])).collect()
    assert [(s.kind_no, s.s, s.e) for s in row.spans] == [
        x for k in range(10_000) for x in [(2, 77 * k, 77 * k + 32), (0, 77 * k + 33, 77 * k + 76), (2, 77 * k + 44, 77 * k + 76)]]
    (row,) = license_scan(docs_of([(1, "Under the MIT License. " * 50_000)])).collect()
    assert (row.n_base, row.first_word, row.last_word, row.labels) == (50_000, 0, 199_996, "mit")
