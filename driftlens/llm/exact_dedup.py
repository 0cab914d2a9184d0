"""Exact de-duplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftlens.llm.common import SPACE, table, whole
from driftlens.session import cut_lineage

KEY = ["digest", "norm_chars", "check"]


def digests(docs: DataFrame, runs: int, text: str, ident: str) -> DataFrame:
    """Narrow rows: the digest of the normalised text, two further checks of equality, and the leaf run of the row."""
    norm = F.regexp_replace(whole(F.col(text)), f"[{SPACE}]+", "")
    return docs.select(
        F.col(ident).alias("id"), F.length(whole(F.col(text))).cast("bigint").alias("chars"), norm.alias("norm")
    ).select(
        "id", "chars", F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("digest"),
        F.length("norm").alias("norm_chars"), F.xxhash64("norm").alias("check"),
        F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run"),
    )


def merge_runs(facts: DataFrame, runs: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """(leaf runs, merged run). A run is a sorted list of digests with the best row and the number of rows of each.

    The leaves are the rows dealt to ``runs`` runs by identifier, each merged before it is sent on. In every round the
    runs whose numbers share all but their last digit (in base ``fan_in``) meet and are merged into one, keeping of equal
    digests the row with the most characters, then the smallest identifier. Digests are only merged where the length and
    a second hash agree too. A digest that a third of all rows share arrives as one row per run in each round, never as
    the rows themselves.
    """
    best = F.struct((-F.col("chars")).alias("neg_chars"), F.col("id").isNull().alias("no_id"), "id", "row")
    run = facts.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    leaves = run
    while runs > 1:
        runs = -(-runs // fan_in)
        run = run.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), *KEY).agg(
            F.min("best").alias("best"), F.sum("n").alias("n")
        )
    return leaves, run


def exact_dedup(docs: DataFrame, runs: int = 64, fan_in: int = 8, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after all white space is deleted; null counts as empty, so null and blank texts form
    one group. Of equal texts the one with the most characters stays, then the smallest identifier; a null identifier
    comes after all others. Of repeated rows with one identifier exactly one is kept. An empty table gives no rows. Only
    the two named columns are read, so other columns never clash.
    """
    facts = cut_lineage(digests(docs, runs, text, ident).withColumn("row", F.monotonically_increasing_id()))
    leaves, merged = merge_runs(facts, runs, fan_in)
    # Back down the same tree: winners go to the leaf runs, and from there to the rows of that leaf.
    winners = merged.select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))
    per_leaf = leaves.select("run", *KEY).join(winners, KEY)
    return facts.join(per_leaf, ["run", *KEY]).select(
        F.col("id").alias(ident), "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, runs: int = 64, fan_in: int = 8, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns; the same choice as ``exact_dedup``.

    Whole rows are sent once, dealt by (run, digest), so a digest with very many rows is spread over the runs.
    """
    facts = digests(docs, runs, text, ident).withColumn("row", F.lit(0))
    _, merged = merge_runs(facts, runs, fan_in)
    winners = merged.select(
        F.col("digest").alias("_digest"), F.col("best.id").alias("_id"), (-F.col("best.neg_chars")).alias("_chars"),
        F.pmod(F.xxhash64("best.id"), F.lit(runs)).cast("int").alias("_run"),
    )
    norm = F.regexp_replace(whole(F.col(text)), f"[{SPACE}]+", "")
    marked = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.col(ident).alias("_own_id"),
        F.length(whole(F.col(text))).cast("bigint").alias("_own_chars"),
        F.unhex(F.sha2(F.encode(norm, "UTF-8"), 256)).alias("_digest"),
        F.pmod(F.xxhash64(F.col(ident)), F.lit(runs)).cast("int").alias("_run"),
    )
    stay = marked.join(winners, ["_run", "_digest"]).where(
        F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_chars") == F.col("_chars"))
    )
    # Repeated rows with one identifier: one of them.
    one = stay.groupBy("_run", "_digest").agg(F.first("_doc").alias("_doc"))
    return one.select("_doc.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
