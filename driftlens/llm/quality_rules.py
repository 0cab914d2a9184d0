"""Quality rules: a ledger of measurements and failure bits, and versioned policies over it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from driftlens.llm.common import SPACE, table, whole

WORD = f"[^{SPACE}]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3              # words whose repetition counts

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bare_words", "n_exclaims",
    "n_same_words", "longest_word",
]


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails``, a condition over the measurements in whole numbers, holds."""

    bit: int
    name: str
    fails: str


# A bit keeps its meaning for good: a changed threshold is a new rule with a new bit, so old ledgers stay readable.
RULES = [
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "most_symbols", "100 * n_symbols > 25 * n_words"),
    Rule(4, "short_words", "word_chars < 3 * n_words"),
    Rule(5, "long_words", "word_chars > 12 * n_words"),
    Rule(6, "repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(7, "capitals", "100 * n_upper > 35 * n_letters"),
    Rule(8, "words_without_letters", "100 * n_bare_words > 30 * n_words"),
    Rule(9, "exclamations", "100 * n_exclaims > 25 * n_words"),
    Rule(10, "same_word_again", "100 * n_same_words > 20 * n_words"),
    Rule(11, "endless_word", "longest_word > 1000"),
    Rule(12, "no_letters", "n_letters = 0"),
]


@dataclass(frozen=True)
class Policy:
    """A named and numbered choice of rules; a document stays when it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {rule.name: rule.bit for rule in RULES}
        return sum(1 << bits[name] for name in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_words"))
POLICIES = [
    BASE,
    Policy("prose", 1, (*BASE.rules, "many_symbols", "short_words", "long_words", "repeated_lines")),
    # Lists with marks and prices are prose too: more symbols are allowed, and other signs of junk count.
    Policy("prose", 2, (
        *BASE.rules, "most_symbols", "short_words", "long_words", "repeated_lines", "capitals", "words_without_letters", "exclamations",
        "same_word_again", "endless_word", "no_letters",
    )),
]
CURRENT = POLICIES[-1]


def repeated_words(text: str, window: int = WINDOW) -> tuple[int, int]:
    """(words in windows of ``window`` words that stand in the text twice or more, words equal to the one before)."""
    words = text.encode("utf-8", "surrogatepass").split()
    if len(words) < 2:
        return 0, 0
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    same = int((codes[1:] == codes[:-1]).sum())
    # Windows are numbered a word at a time, so numbers stay small and equal numbers mean equal words.
    n, known = len(codes) - window + 1, np.zeros(max(0, len(codes) - window + 1), np.int64)
    if n < 2:
        return 0, same
    for i in range(window):
        _, known, count = np.unique(known * len(seen) + codes[i:n + i], return_inverse=True, return_counts=True)
    inside = np.zeros(len(codes), bool)
    for i in range(window):
        inside[i:n + i] |= count[known] > 1
    return int(inside.sum()), same


@F.pandas_udf(T.StructType([T.StructField("n_repeat_words", T.LongType()), T.StructField("n_same_words", T.LongType())]))
def _repeated(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repeated_words(t) for t in texts], columns=["n_repeat_words", "n_same_words"], dtype="int64")


def measured(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The identifier and every measurement of a text, as whole numbers; a null text counts as empty.

    Words stand between white space; lines between line feeds, those without a word left out. Letters and capitals are
    Unicode's, a bare word has no letter.
    """
    body, number = F.col("_text"), lambda c: c.cast("bigint")
    read = docs.select(F.col(ident).alias("_id"), whole(F.col(text)).alias("_text"))
    parts = read.withColumns({
        "_lines": F.filter(F.split(body, "\n", -1), lambda line: line.rlike(WORD)),
        "_lengths": F.transform(F.split(body, f"[{SPACE}]+", -1), F.length),
        "_again": _repeated(body),
    })
    return parts.select(
        F.col("_id").alias(ident),
        number(F.regexp_count(body, F.lit(WORD))).alias("n_words"),
        number(F.aggregate("_lengths", F.lit(0), lambda total, n: total + n)).alias("word_chars"),
        number(F.regexp_count(body, F.lit(SYMBOLS))).alias("n_symbols"),
        number(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.col("_again.n_repeat_words").alias("n_repeat_words"),
        number(F.size("_lines")).alias("n_lines"),
        number(F.length(F.regexp_replace(body, r"\P{L}+", ""))).alias("n_letters"),
        number(F.regexp_count(body, F.lit(r"\p{Lu}"))).alias("n_upper"),
        number(F.regexp_count(body, F.lit(rf"(?<![^{SPACE}])[^{SPACE}\p{{L}}]++(?![^{SPACE}])"))).alias("n_bare_words"),
        number(F.regexp_count(body, F.lit("!"))).alias("n_exclaims"),
        F.col("_again.n_same_words").alias("n_same_words"),
        number(F.array_max("_lengths")).alias("longest_word"),
    )


def ledger(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: its identifier, the measurements and ``fail_mask`` with the bit of every rule it fails.

    Every rule is evaluated once, whether a policy uses it or not; policies and ablations then need the mask alone.
    Null, empty and blank texts have zeros throughout and fail ``few_words`` and ``no_letters``. Every row counts for itself: repeated
    rows and null identifiers give a row each. An empty table gives no rows; other columns are not read.
    """
    mask = F.lit(0).cast("bigint")
    for rule in RULES:
        mask = mask.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measured(docs, text, ident).withColumn("fail_mask", mask)


def stays(policy: Policy, mask: str = "fail_mask") -> Column:
    """Whether a policy keeps the document."""
    return F.col(mask).bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def compare_policies(rows: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """One row per policy: policy, version, n_docs, n_kept. All policies are counted over distinct masks in one pass."""
    masks = rows.groupBy("fail_mask").agg(F.count(F.lit(1)).alias("n"))
    chosen = F.array(*[
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(p.mask).cast("bigint").alias("mask"))
        for p in (POLICIES if policies is None else policies)
    ])
    each = masks.select("fail_mask", "n", F.explode(chosen).alias("p"))
    kept = F.when(F.col("fail_mask").bitwiseAND(F.col("p.mask")) == 0, F.col("n")).otherwise(F.lit(0))
    return each.groupBy("p.policy", "p.version").agg(F.sum("n").alias("n_docs"), F.sum(kept).alias("n_kept"))


def ablation(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """One row per rule of a policy: rule, n_failed, n_alone (kept but for this rule), n_kept_without.

    Documents are counted by the bits of the policy that they fail, before any shuffle; the rules then read the few
    distinct masks. Of an empty ledger there are no rows.
    """
    masks = rows.groupBy(F.col("fail_mask").bitwiseAND(F.lit(policy.mask).cast("bigint")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    bits = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in RULES if r.name in policy.rules])
    each = masks.select("mask", "n", F.explode(bits).alias("r"))

    def sum_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    mask, bit = F.col("mask"), F.col("r.bit")
    return each.groupBy("r.rule").agg(
        sum_where(mask.bitwiseAND(bit) != 0).alias("n_failed"), sum_where(mask == bit).alias("n_alone"),
        sum_where((mask == 0) | (mask == bit)).alias("n_kept_without"),
    )


def keep_by_policy(docs: DataFrame, policy: Policy = CURRENT, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The documents that a policy keeps, with all their columns.

    The measured columns are made beside the document, so columns of the same names do not clash. An empty table gives no rows.
    """
    packed = docs.select(F.col(text).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("doc_id"))
    return ledger(packed).where(stays(policy)).select("doc_id.*")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *base, (~stays(BASE)).alias("base_failed"), stays(CURRENT).alias("kept"), "fail_mask", *[c for c in MEASURES if c not in base])


_MASK_SQL = " | ".join(f"CASE WHEN {rule.fails} THEN {1 << rule.bit} ELSE 0 END" for rule in RULES).replace(" | CASE", "\n    | CASE")

OP12_SQL = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS body FROM documents),
p AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(body, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
w AS (SELECT r, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM p),
s AS (
  SELECT r, i, word, lag(word) OVER o AS before,
    CASE WHEN lead(word, 2) OVER o IS NOT NULL THEN struct_pack(a := word, b := lead(word) OVER o, c := lead(word, 2) OVER o) END AS stretch
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
n AS (SELECT *, stretch IS NOT NULL AND count(*) OVER (PARTITION BY r, stretch) > 1 AS again FROM s),
c AS (SELECT *, again OR coalesce(lag(again) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS inside FROM n WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, count(*) FILTER (inside) AS n_repeat_words, count(*) FILTER (word = before) AS n_same_words FROM c GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(length(regexp_replace(body, '\P{{L}}', '', 'g')) AS BIGINT) AS n_letters,
    CAST(length(regexp_replace(body, '\P{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_bare_words,
    CAST(length(regexp_replace(body, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims, coalesce(n_same_words, 0) AS n_same_words,
    CAST(coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS longest_word
  FROM p LEFT JOIN g USING (r)),
f AS (SELECT *, CAST({_MASK_SQL} AS BIGINT) AS fail_mask FROM m)
SELECT *, fail_mask & {BASE.mask} <> 0 AS base_failed, fail_mask & {CURRENT.mask} = 0 AS kept FROM f
"""
