"""Token counts: rollups by source, language and tokenizer version, maintained by signed deltas."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftlens.llm.common import SPACE, table, whole, word_count
from driftlens.session import cut_lineage, scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-pair vocabulary splits text into pieces before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ["source", "lang", "tokenizer"]
ROLLUP = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"

def vocabulary(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a byte-pair vocabulary, read by Spark so that any store will do; its size is fixed."""
    lines = spark.read.text(path).where("value <> ''").collect()
    return {base64.b64decode(token): int(rank) for token, rank in (line["value"].split() for line in lines)}


def bpe_counter(ranks: dict[bytes, int], name: str):
    """A column function: the number of byte-pair tokens of a text. The encoder is built once in each worker."""
    shared = SparkSession.active().sparkContext.broadcast(ranks)
    made: list = []

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        if not made:
            made.append(tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={}))
        for batch in batches:
            yield pd.Series([len(made[0].encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return count


def counted(docs: DataFrame, vocabularies: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by (tokenizer, tokens) rows: words between white space, and each vocabulary."""
    counters = {"words-1": word_count(F.col(text))}
    for name, path in vocabularies.items():
        counters[name] = bpe_counter(vocabulary(docs.sparkSession, path), name)(whole(F.col(text)))
    rest = [c for c in docs.columns if c != text]
    wide = docs.select(*rest, *[c.alias(f"_n{i}") for i, c in enumerate(counters.values())])
    each = F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.col(f"_n{i}").alias("tokens")) for i, n in enumerate(counters)])
    return wide.select(*rest, F.explode(each).alias("_t")).select(*rest, "_t.tokenizer", "_t.tokens")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed totals of a batch of changes (source, lang, tokenizer, docs, tokens).

    An insert has docs 1 and its tokens, a delete -1 and minus the tokens it had, a revision both: the old count off, the
    new one on. Changes that cancel out leave no row.
    """
    summed = changes.groupBy(*KEYS).agg(F.sum("docs").cast("bigint").alias("n_docs"), F.sum("tokens").cast("bigint").alias("n_tokens"))
    return summed.where("n_docs <> 0 OR n_tokens <> 0")


def commit(changes: DataFrame, ledger: str, batch: str) -> bool:
    """Add a batch of changes to the ledger, once. False if it was there already.

    The batch's name is its folder, and Spark's success file is the commit: a replay of a finished batch does nothing, a
    half-written one is replaced. Totals are sums over batches, so batches may come in any order.
    """
    spark = changes.sparkSession
    folder = f"{ledger}/batch={batch}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        return False
    deltas(changes).coalesce(1).write.mode("overwrite").parquet(folder)
    return True


def totals(spark: SparkSession, ledger: str) -> DataFrame:
    """The rollup: (source, lang, tokenizer, n_docs, n_tokens), groups without documents or tokens left out.

    A ledger without a batch gives no rows.
    """
    try:
        rows = spark.read.schema(ROLLUP).option("basePath", ledger).parquet(f"{ledger}/batch=*")
    except AnalysisException:
        return spark.createDataFrame([], ROLLUP)
    summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return summed.where("n_docs <> 0 OR n_tokens <> 0")


def compact(spark: SparkSession, ledger: str, into: str) -> None:
    """Write the totals as the one batch of a new ledger; it never touches the old one."""
    totals(spark, ledger).coalesce(1).write.mode("overwrite").parquet(f"{into}/batch=base")


def changes(old: DataFrame, new: DataFrame, vocabularies: dict[str, str] | None = None,
            text: str = "text", ident: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """Signed changes (source, lang, tokenizer, docs, tokens) that turn the counts of ``old`` rows into those of ``new`` ones.

    Rows that stand on both sides equally often (same identifier, source, language and text) cancel before any text is
    tokenized, so a whole old and new table may be given as well as the rows that changed. A row on the old side only is a delete, one
    on the new side only an insert, both together a revision. Nulls are values of their own and repeated rows count each
    time; empty tables give no rows on their side; other columns are not read.
    """
    names = {"byte-bpe-50k": VOCABULARY} if vocabularies is None else vocabularies
    columns = {"id": ident, "source": source, "lang": lang, "text": text}

    def side(df: DataFrame, sign: int) -> DataFrame:
        rows = df.select(*[F.col(c).alias(k) for k, c in columns.items()])
        parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
        # The lengths keep the parts apart.
        key = F.sha2(F.concat_ws(",", *[F.concat(F.length(p).cast("string"), p) for p in parts]), 256)
        return rows.select("source", "lang", "text", F.lit(sign).cast("bigint").alias("sign"), key.alias("key"))

    both = side(old, -1).unionByName(side(new, 1))
    # Copies meet before the shuffle; what is left of a row is how many more one side has of it.
    rest = both.groupBy("key").agg(
        F.sum("sign").alias("net"), *[F.first(c).alias(c) for c in ("source", "lang", "text")]).where("net <> 0")
    each = counted(rest.select("net", "source", "lang", "text"), names)
    return each.select(*KEYS, F.col("net").alias("docs"), (F.col("net") * F.col("tokens")).alias("tokens"))


def count_tokens(docs: DataFrame, ledger: str, batches: int = 4, vocabularies: dict[str, str] | None = None,
                 text: str = "text", ident: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """Load documents into a ledger in batches by a hash of the identifier and return the rollup.

    Null and empty texts count as documents without tokens; null sources and languages are groups of their own; repeated
    rows count each time; an empty table gives no rows; other columns are not read. Each text is tokenized once.
    """
    rows = docs.select(F.col(ident).alias("id"), F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    names = {"byte-bpe-50k": VOCABULARY} if vocabularies is None else vocabularies
    # Counts of a group of documents within each batch are all that later steps need.
    part = F.pmod(F.xxhash64("id"), F.lit(batches)).alias("part")
    sums = counted(rows.select(part, "source", "lang", "text"), names).groupBy("part", *KEYS).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    sums = cut_lineage(sums)
    for no in range(batches):
        commit(sums.where(F.col("part") == no), ledger, f"load-{no}")
    return totals(docs.sparkSession, ledger)


def feed(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> list[tuple[str, DataFrame, DataFrame]]:
    """Named changes (batch, old rows, new rows) that end with the table they started from.

    By a hash of the identifier, one document in 16 is deleted and comes back; another one in 16 is revised, with its white
    space folded, and revised back.
    """
    spread = F.pmod(F.xxhash64(F.col(ident)), F.lit(16))
    gone, revised = docs.where(spread == 3), docs.where(spread == 7)
    folded = revised.withColumn(text, F.regexp_replace(F.col(text), f"[{SPACE}]+", " "))
    return [
        ("delete", gone, gone.limit(0)), ("revise", revised, folded),
        ("restore", gone.limit(0).unionByName(folded), gone.unionByName(revised)),
    ]


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads the whole table, deletes, revises and restores part of it, and replays every batch."""
    docs, ledger = table(spark, sf_dir, "documents"), scratch_path(spark, "token-counts")
    count_tokens(docs, ledger)
    for batch, old, new in feed(docs):
        signed = cut_lineage(deltas(changes(old, new)).withColumnsRenamed({"n_docs": "docs", "n_tokens": "tokens"}))
        for _ in range(2):
            commit(signed, ledger, batch)
    return totals(spark, ledger)
