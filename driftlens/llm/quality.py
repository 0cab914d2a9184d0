"""Quality classifier: supervised subword embeddings averaged over a document, softmax on top, trained by SGD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftlens.llm.common import table
from driftlens.llm.texthash import BYTE, IS_SPACE, U, mix, word_hashes

BUCKETS = 1 << 17
GRAMS = (3, 4)          # lengths of character n-grams, in bytes
DIM = 8
EPOCHS = 5
RATE = 4.0
SAMPLE_ROWS = 4000      # labelled rows, about, that the model is fitted on
SEGMENT = 1 << 20       # bytes of a text that are hashed at a time
AGAIN = 0               # the bucket of "same word as the one before"


def segments(data: np.ndarray, size: int = SEGMENT) -> Iterator[np.ndarray]:
    """The text in pieces that end at white space where there is some, so memory does not grow with its length."""
    low = 0
    while low < len(data):
        high = min(len(data), low + size)
        if high < len(data):
            space = np.flatnonzero(IS_SPACE[data[low:high]])
            if len(space):
                high = low + int(space[-1]) + 1
        yield data[low:high]
        low = high


def features(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of the words, repeated words and character n-grams of a text, a piece at a time."""
    for data in segments(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)):
        words = word_hashes(data)
        yield (words % U(BUCKETS - 1)).astype(np.int64) + 1
        yield np.full(int((words[1:] == words[:-1]).sum()), AGAIN, np.int64)
        letters = BYTE[data]
        for k in GRAMS:
            if len(data) >= k:
                gram = np.full(len(data) - k + 1, U(k), U)
                with np.errstate(over="ignore"):
                    for i in range(k):
                        gram = gram * U(0x100000001B3) + letters[i:len(data) - k + 1 + i]
                    gram ^= gram >> U(29)
                yield (mix(gram) % U(BUCKETS - 1)).astype(np.int64) + 1


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> np.ndarray:
    """The weight of each bucket: its learned vector times the difference of the two output vectors.

    ``rows`` holds the distinct buckets of each document and their shares. A document's vector is the average of its
    feature vectors. As everything after the average is linear, the log-odds of a document are the average of these
    weights, which is all that scoring needs.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, dim)).astype(np.float32) / dim
    out = np.zeros((2, dim), np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            held = vectors[ids]
            mean = share @ held
            logits = out @ mean
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            step = np.float32(rate * (1 - done / steps))
            vectors[ids] = held - step * share[:, None] * (error @ out)
            out -= step * np.outer(error, mean)
            done += 1
    return (vectors @ (out[1] - out[0])).astype(np.float32)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share of each."""
    parts = list(features(text))
    ids, n = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int64), return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, text: str = "text",
          ident: str = "doc_id", label: str = "quality") -> np.ndarray | None:
    """Fit on about ``sample_rows`` labelled rows, chosen by a hash of the identifier, in one task. None without any label.

    ``usable`` is a condition on the column ``id``. The sample is bounded, so its identifiers may be broadcast.
    """
    marked = labels.select(F.col(ident).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    marked = marked.where(usable).groupBy("id").agg(F.min("label").alias("label"))
    share = min(1.0, sample_rows / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    def count_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [counted(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"].astype(str), "label": batch["label"], "ids": [a.astype(np.int32).tobytes() for a, _ in made],
                                "share": [b.tobytes() for _, b in made]})

    def fit_all(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "label"])
        bags = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(rows["ids"], rows["share"], strict=True)]
        return pd.DataFrame({"model": [fit(bags, rows["label"].to_numpy()).tobytes()]})

    bags = sample.mapInPandas(count_all, "id string, label int, ids binary, share binary")
    models = bags.groupBy(F.lit(0).alias("all")).applyInPandas(fit_all, "model binary").collect()
    return np.frombuffer(models[0]["model"], np.float32) if models else None


def scorer(model: np.ndarray | None):
    """A column function: the probability of label 1 for a text."""
    weights = np.zeros(BUCKETS, np.float32) if model is None else model

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        odds = []
        for body in texts:
            total, n = 0.0, 0
            for ids in features(body):
                total, n = total + float(weights[ids].sum(dtype=np.float64)), n + len(ids)
            odds.append(total / max(1, n))
        return pd.Series(1 / (1 + np.exp(-np.array(odds, "float64"))))

    return score


def held_out(ident: Column) -> Column:
    """Rows never learned from: crc32 of the identifier as text leaves 1 after division by 3."""
    return F.coalesce(F.crc32(F.encode(ident.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Whole texts are scored by their words and characters alone. Null and empty texts have no features and score 0.5, as
    does everything without labels. Labels that are null or neither 0 nor 1 are skipped; of repeated labels the smaller
    counts. An empty table gives no rows; other columns are not read.
    """
    model = train(docs, labels, ~held_out(F.col("id")), sample_rows, text, ident)
    scored = docs.select(F.col(ident), held_out(F.col(ident)).alias("held_out"), scorer(model)(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The documents whose score is at least 0.5, with all their columns."""
    model = train(docs, labels, ~held_out(F.col("id")), sample_rows, text, ident)
    return docs.where(scorer(model)(F.col(text)) >= 0.5)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
