"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the element tree."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftlens.llm.common import table
from driftlens.llm.html_blocks import Block, blocks_of
from driftlens.llm.html_layouts import labelled_pages

TRAIN_PAGES = 600
EPOCHS = 6
RATE = 0.3
DECAY = 1e-5


class ChainModel:
    """Weights of a two-state chain: per feature the lean towards state 1, and a table of moves between states."""

    def __init__(self) -> None:
        self.lean: dict[str, float] = {}
        self.moves = np.zeros((2, 2))
        self.first = np.zeros(2)

    def scores(self, pages: list[list[str]]) -> np.ndarray:
        """[block, state] scores of the features."""
        get = self.lean.get
        return np.array([[0.0, sum(get(m, 0.0) for m in marks)] for marks in pages]).reshape(-1, 2)

    def decode(self, pages: list[list[str]]) -> list[int]:
        """The most likely states (Viterbi)."""
        if not pages:
            return []
        scores = self.scores(pages)
        best, back = (self.first + scores[0]).tolist(), []
        (stay0, up), (down, stay1) = self.moves.tolist()
        for at0, at1 in scores[1:].tolist():
            zero, one = (best[0] + stay0, best[1] + down), (best[0] + up, best[1] + stay1)
            back.append((int(zero[1] > zero[0]), int(one[1] > one[0])))
            best = [max(zero) + at0, max(one) + at1]
        states = [int(best[1] > best[0])]
        for step in reversed(back):
            states.append(step[states[-1]])
        return states[::-1]

    def learn(self, marks: list[list[str]], labels: list[int], rate: float, seen: dict[str, float]) -> None:
        """One step up the log-likelihood of a page: observed less expected counts, by forward and backward sums."""
        scores, n = self.scores(marks), len(marks)
        ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
        ahead[0] = self.first + scores[0]
        for t in range(1, n):
            ahead[t] = np.logaddexp(ahead[t - 1, 0] + self.moves[0], ahead[t - 1, 1] + self.moves[1]) + scores[t]
        for t in range(n - 2, -1, -1):
            after = behind[t + 1] + scores[t + 1]
            behind[t] = np.logaddexp(self.moves[:, 0] + after[0], self.moves[:, 1] + after[1])
        whole = np.logaddexp(*ahead[-1])
        each = np.exp(ahead + behind - whole)
        for t in range(n):
            error = labels[t] - each[t, 1]
            for m in marks[t]:
                seen[m] = seen.get(m, 1e-2) + error * error
                old = self.lean.get(m, 0.0)
                self.lean[m] = old + rate * (error - DECAY * old) / seen[m] ** 0.5
        change = np.zeros((2, 2))
        for t in range(1, n):
            change[labels[t - 1], labels[t]] += 1
            change -= np.exp(ahead[t - 1][:, None] + self.moves + (scores[t] + behind[t])[None, :] - whole)
        self.moves += 0.1 * rate * np.clip(change, -3, 3)
        start = -each[0]
        start[labels[0]] += 1
        self.first += 0.1 * rate * start


def train(pages: list[tuple[str, list[int]]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> ChainModel:
    """Fit on pages with a label for every block. A page whose labels do not match its blocks is an error."""
    model, seen = ChainModel(), {}
    ready = []
    for page, labels in pages:
        marks = [b.marks for b in blocks_of(page)]
        if len(marks) != len(labels):
            raise ValueError(f"{len(marks)} blocks, {len(labels)} labels")
        if marks:
            ready.append((marks, labels))
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for i in rng.permutation(len(ready)):
            model.learn(*ready[i], rate / (1 + epoch / 2), seen)
    return model


@lru_cache(maxsize=1)
def default_model() -> ChainModel:
    """The model of the built-in labelled layouts."""
    return train(labelled_pages(TRAIN_PAGES))


def main_blocks(html: str | None, model: ChainModel) -> list[Block]:
    """The blocks of the main text, in page order."""
    blocks = blocks_of(html)
    return [b for b, state in zip(blocks, model.decode([b.marks for b in blocks]), strict=True) if state]


def main_text(pages: DataFrame, model: ChainModel | None = None, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with a column ``name`` in place of ``html``: the main text, blocks joined by an empty line.

    White space inside a block is one space; character references are decoded. Null and empty pages, and pages without
    main text, give an empty text. Rows are independent, so repeated rows repeat; an empty table gives no rows. A column
    that is already called ``name`` is replaced.
    """
    fitted = model or default_model()

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(["\n\n".join(b.text for b in main_blocks(page, fitted)) for page in batch], dtype=object)

    return pages.withColumn(name, extract(F.col(html))).drop(*({html} - {name}))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
