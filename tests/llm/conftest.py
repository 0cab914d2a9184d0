import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Extra columns with the names of the operators' own columns.
CLASHING = {
    "kept": "1", "keep_id": "2", "row": "3", "key": "4", "id": "5", "size": "6", "taken": "7", "run": "8", "component_id": "9", "n": "10",
    "spans": "11", "score": "12", "h": "13", "tokens": "14", "words": "15", "block": "16", "body": "17", "_key": "18", "_doc": "19", "tokenizer": "20",
}


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source[, lang]]) rows, with clashing columns on request."""
    def make(rows, clashing=False):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clashing:
            from pyspark.sql import functions as F
            df = df.withColumns({name: F.lit(value) for name, value in CLASHING.items()})
        return df

    return make


@pytest.fixture(scope="session")
def awkward():
    """Rows with nulls, empty, blank, very long and repeated texts, ties and unusual characters."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 7)))
    prose = " ".join(word() for _ in range(300))
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, prose), (4, prose), (None, prose), (None, None), (5, prose.replace(" ", "  ", 1)),
        (6, prose + " tail"), (7, "x" * 5000), (8, " ".join(word() for _ in range(40_000))), (9, "é ü  😀 naïve K"), (10, "a\x00b \x1f c"),
        (11, "one"), (12, "one two three"), (13, "\n".join(["same line again and again"] * 200)), (14, prose.upper()),
    ]
