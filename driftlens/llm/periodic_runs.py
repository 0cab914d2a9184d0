"""Runs of words that repeat with a period, by branching tandem repeats over an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftlens.llm.common import SPACE, table, whole

MIN_EXPONENT = 4        # a run holds its period at least so many times
MIN_LENGTH = 6          # and at least so many words
BATCH_WORDS = 200_000   # words of the texts that share one suffix array; a longer text has one of its own
RUN_TYPE = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"

Runs = list[tuple[int, int, int]]


class SuffixArray:
    """Suffix array, its inverse, common prefixes of neighbours and the ranks of all stretches of 1, 2, 4, ... codes.

    Sorted by prefix doubling; every round sorts only what the rounds before left undecided. A rank is the place at
    which its group starts, so equal ranks on a level mean equal stretches.
    """

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        sa = np.argsort(codes, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = codes[sa[1:]] != codes[sa[:-1]]
        rank = np.full(n + 1, -1, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        self.levels: list[np.ndarray] = []
        step = 1
        while True:
            last = np.append(fresh[1:], True)
            at = np.flatnonzero(~(fresh & last))
            if not len(at):
                break
            self.levels.append(rank.astype(np.int32) if n < 1 << 31 else rank.copy())
            rows = sa[at]
            key = rank[rows] * (n + 2) + rank[np.minimum(rows + step, n)] + 1
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            sa[at] = rows
            starts = np.ones(len(at), bool)
            starts[1:] = key[1:] != key[:-1]
            fresh[at] = starts
            rank[rows] = at[np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))]
            step *= 2
        self.sa, self.isa = sa, rank[:n]
        self.lcp = np.zeros(n + 1, np.int64)
        self.lcp[1:n] = self._shared(sa[:-1], sa[1:])

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes that the suffixes at ``a`` and ``b`` have in common."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks = self.levels[level]
            # Nothing shared reaches beyond the end of the later suffix.
            out += (ranks[a + out] == ranks[b + out]).astype(np.int64) << level
        return out

    def shared_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes just before ``a`` that equal those just before ``b``; a lies before b."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks, far = self.levels[level], out + (1 << level)
            fits = far <= a
            same = fits & (ranks[np.where(fits, a - far, 0)] == ranks[np.where(fits, b - far, 0)])
            out += same.astype(np.int64) << level
        return out

    def intervals(self) -> tuple[np.ndarray, ...]:
        """All LCP intervals but the root: (depths, firsts, lasts), and their children: (interval, firsts, ends)."""
        lcp = self.lcp.tolist()
        depths, lows, cuts = [0], [0], [[0]]
        found: list[tuple[int, int, int]] = []
        owner: list[int] = []
        child: list[int] = []
        stop: list[int] = []
        for t in range(1, len(lcp)):
            shared, low = lcp[t], t - 1
            while shared < depths[-1]:
                low = lows.pop()
                bounds = cuts.pop()
                owner += [len(found)] * len(bounds)
                child += bounds
                stop += bounds[1:]
                stop.append(t)
                found.append((depths.pop(), low, t - 1))
            if shared == depths[-1]:
                cuts[-1].append(t)
            else:
                depths.append(shared)
                lows.append(low)
                cuts.append([low, t])
        table = np.array(found, np.int64).reshape(-1, 3)
        return table[:, 0], table[:, 1], table[:, 2], np.array(owner, np.int64), np.array(child, np.int64), np.array(stop, np.int64)


def branching_squares(index: SuffixArray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of the squares whose next code breaks the period.

    In an interval of depth d, two suffixes d apart are a square, and it is branching when they lie in different
    children. One of the two is then outside the largest child, so only suffixes of the smaller children are tried, which
    are at most n log n in all.
    """
    depth, low, high, owner, first, stop = index.intervals()
    if not len(depth):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = stop - first
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    most = np.repeat(np.maximum.reduceat(size, heads), np.diff(np.append(heads, len(owner))))
    # The first of the largest children is left out.
    largest = np.flatnonzero(size == most)
    largest = largest[np.append(True, owner[largest[1:]] != owner[largest[:-1]])]
    small = np.ones(len(size), bool)
    small[largest] = False
    owner, first, size = owner[small], first[small], size[small]
    place = np.arange(int(size.sum())) + np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size)
    node = np.repeat(owner, size)
    at, span, low, high = index.sa[place], depth[node], low[node], high[node]
    padded, n = np.append(codes, -1), len(codes)
    starts, periods = [], []
    for begin, other in ((at, at + span), (at - span, at - span)):
        inside = (other >= 0) & (other < n)
        inside[inside] = (index.isa[other[inside]] >= low[inside]) & (index.isa[other[inside]] <= high[inside])
        begin, width = begin[inside], span[inside]
        breaks = padded[begin + width] != padded[begin + 2 * width]
        starts.append(begin[breaks])
        periods.append(width[breaks])
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(codes: np.ndarray, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of the runs in a sequence of codes, by start, then period.

    A branching square stands at the right end of its run. Rotated to the left as far as the period holds it gives the
    whole run; the same stretch found with several periods keeps the smallest.
    """
    if len(codes) < min_length:
        return np.empty((0, 3), np.int64)
    index = SuffixArray(codes)
    start, period = branching_squares(index, codes)
    end = start + 2 * period
    start = start - index.shared_before(start, start + period)
    length = end - start
    good = length >= np.maximum(min_length, min_exponent * period)
    rows = np.stack([start[good], length[good], period[good]], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[keep]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def repeating(codes: np.ndarray, k: int) -> np.ndarray:
    """Positions whose next ``k`` codes stand somewhere else too."""
    at = np.arange(max(0, len(codes) - k + 1))
    known = np.zeros(len(at), np.int64)
    top = int(codes.max(initial=0)) + 1
    for i in range(k):
        _, known, count = np.unique(known * top + codes[at + i], return_inverse=True, return_counts=True)
        again = count[known] > 1
        at, known = at[again], known[again]
    return at


def find_all(texts: Sequence[list[bytes]], min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> list[Runs]:
    """The runs of each list of words. The lists share one suffix array, each with numbers of its own for its words."""
    numbers: list[int] = []
    bounds = [0]
    used = 0
    for words in texts:
        seen: dict[bytes, int] = {}
        numbers += [used + seen.setdefault(w, len(seen)) for w in words]
        used += len(seen)
        bounds.append(len(numbers))
    codes, edges = np.array(numbers, np.int64), np.array(bounds)
    out: list[Runs] = [[] for _ in texts]
    # A run of period q starts like the place q words on, for at least so many words; texts without such a pair have none.
    needed = max(1, min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1)))
    which = np.unique(np.searchsorted(edges, repeating(codes, needed), side="right") - 1)
    if not len(which):
        return out
    sizes = edges[which + 1] - edges[which]
    starts = np.append(0, np.cumsum(sizes))
    for start, length, period in runs_of(np.concatenate([codes[edges[i]:edges[i + 1]] for i in which]), min_exponent, min_length).tolist():
        nth = int(np.searchsorted(starts, start, side="right")) - 1
        out[which[nth]].append((start - int(starts[nth]), length, period))
    return out


def collapse(words: list[bytes], runs: Runs) -> list[bytes]:
    """The words without those that stand in some run after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def batches_of(texts: Sequence[str | None], size: int = BATCH_WORDS) -> Iterator[list[list[bytes]]]:
    """The texts as lists of words, in groups of about ``size`` words."""
    group: list[list[bytes]] = []
    held = 0
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if group and held + len(words) > size:
            yield group
            group, held = [], 0
        group.append(words)
        held += len(words)
    if group:
        yield group


def run_finder(min_exponent: int, min_length: int):
    """A column function: the runs of a text and the text without their repeats."""
    @F.pandas_udf(RUN_TYPE)
    def find(texts: pd.Series) -> pd.DataFrame:
        runs: list[list[dict]] = []
        texts_left: list[str] = []
        for group in batches_of(texts):
            for words, found in zip(group, find_all(group, min_exponent, min_length), strict=True):
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts_left.append(b" ".join(collapse(words, found)).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"runs": runs, "collapsed": texts_left}, columns=["runs", "collapsed"])

    return find


def periodic_runs(docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, text: str = "text",
                  ident: str = "doc_id") -> DataFrame:
    """One row per document: its identifier, ``runs`` (start, length, period by start, then period) and ``collapsed``.

    Words are what stands between white space. A run is a stretch of words with a smallest period, as long as that
    period holds, of at least ``min_length`` words and ``min_exponent`` (two or more) periods. ``collapsed`` is the text without the
    words of a run after its first period, joined by single spaces. Whole texts are searched, however long; memory grows
    with the longest text. Null, empty and blank texts have no runs and an empty ``collapsed``. Every row counts for
    itself: repeated rows and null identifiers give a row each. An empty table gives no rows; other columns are not read.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two periods and two words")
    found = run_finder(min_exponent, min_length)(whole(F.col(text)))
    return docs.select(F.col(ident), found.alias("_found")).select(ident, "_found.runs", "_found.collapsed")


def best_run(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period."""
    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(x != y, F.sign(y - x)).when(a["start"] != b["start"], F.sign(a["start"] - b["start"])).otherwise(
            F.sign(a["period"] - b["period"])).cast("int")

    return F.get(F.array_sort(runs, better), F.lit(0))


def with_planted_periods(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(identifier, text) where every tenth text, by the crc32 of its identifier, goes on with a period from some word on.

    A null identifier is never chosen.
    """
    chance = F.crc32(F.encode(F.col(ident).cast("string"), "UTF-8"))
    chosen = docs.select(
        F.col(ident), whole(F.col(text)).alias("_text"), F.coalesce(chance % 10 == 0, F.lit(False)).alias("_chosen"),
        F.floor(F.coalesce(chance, F.lit(0)) / 10).alias("_g"),
    )
    words = F.when(F.col("_chosen"), F.regexp_extract_all("_text", F.lit(f"[^{SPACE}]+"), F.lit(0)))
    chosen = chosen.withColumn("_words", words).withColumn("_n", F.greatest(F.size("_words"), F.lit(1)).cast("bigint"))
    chosen = chosen.withColumn("_a", (F.col("_g") % F.col("_n")).cast("int"))
    chosen = chosen.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    left = (F.col("_n") - F.col("_a")).cast("int")
    period = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil(left / F.col("_p")).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), again), " ")
    return chosen.select(ident, F.when(F.col("_chosen"), planted).otherwise(F.col("_text")).alias(text))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs).withColumn("best", best_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
