"""Benchmark decontamination: spaced-seed hashes find hits, overlaps around them are verified word by word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftlens.llm.common import table, whole
from driftlens.session import cut_lineage

# Offsets of the words that a seed reads; the others may differ. These have weight 6.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 7, 8), (0, 2, 3, 6, 7, 10), (0, 1, 2, 5, 8, 9))
SHORT_MASK = (0, 1, 2, 3, 4)   # for items with fewer words than the widest mask
# (fewest words of an item, masks), longest first. Wherever 80 in a hundred of an item's words, or of some 16 of them, agree,
# one of its masks reads equal words only; the tests enumerate all patterns.
GROUPS = (
    (11, (*MASKS, (0, 1, 2, 4, 6, 7), (0, 1, 3, 4, 6, 8))),
    (9, (SHORT_MASK, (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))),
    (5, ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))),
)
WINDOW = 16                    # words of an item that have to be found together (the whole item if it is shorter)
PERCENT = 80                   # of them in a hundred that have to agree
BLOCK_KEYS = 1_000_000         # benchmark seeds broadcast at a time
FEW = 500_000                  # rows of two numbers that may be broadcast
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in lower case, ASCII punctuation and white space removed."""
    return F.filter(F.split(F.lower(whole(text)), SEPARATORS), lambda w: w != "")


def seeds(rows: DataFrame, keep: list[str], groups: list[int]) -> DataFrame:
    """(keep..., pos, seed): the hash of every mask of some groups at every place of ``h``, an array of word hashes.

    Places are generated next to the array, so hashing and the join that follows stay in one generated loop.
    """
    masks = [(group, mask) for group in groups for mask in GROUPS[group][1]]
    low = min(m[-1] for _, m in masks) + 1
    at = F.explode(F.sequence(F.lit(0), F.size("h") - low)).alias("pos")
    placed = rows.where(F.size("h") >= low).select(*keep, "h", at)
    keys = []
    for group, mask in masks:
        key = F.xxhash64(F.lit(group), F.lit(GROUPS[group][1].index(mask)), *[F.get("h", F.col("pos") + k) for k in mask])
        keys.append(key if mask[-1] + 1 == low else F.when(F.col("pos") + mask[-1] < F.size("h"), key))
    return placed.select(*keep, "pos", F.explode(F.array(*keys)).alias("seed")).where("seed IS NOT NULL")


def hits(docs: DataFrame, items: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(key, item, shift): documents and items on whose common diagonal some seed agrees.

    ``docs`` has ``key`` and ``words``, ``items`` has ``item`` and ``words``. Seeds of the benchmark are broadcast in blocks of
    about ``block_keys``; each block meets all documents, so the size of a broadcast does not grow with the benchmark.
    """
    hashed = lambda rows, *keep: rows.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    known, below, parts = hashed(items, "item"), None, []
    for group, (least, _) in enumerate(GROUPS):
        sized = known.where(F.size("h") >= least) if below is None else known.where(F.size("h").between(least, below - 1))
        parts.append(seeds(sized, ["item"], [group]).withColumn("group", F.lit(group)))
        below = least
    item_seeds = reduce(DataFrame.unionByName, parts).select("seed", "item", F.col("pos").alias("item_pos"), "group")
    item_seeds = cut_lineage(item_seeds.distinct())
    made = {row["group"]: row["count"] for row in item_seeds.groupBy("group").count().collect()}
    blocks = max(1, -(-sum(made.values()) // block_keys))
    item_seeds = item_seeds.drop("group")
    text_hashes = hashed(docs, "key")
    # Texts need the seeds of groups with items only; any group will do for a benchmark without items.
    groups = sorted(made) or [0]
    found = []
    for no in range(blocks):
        part = item_seeds if blocks == 1 else item_seeds.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == no)
        met = seeds(text_hashes, ["key"], groups).join(F.broadcast(part), "seed")
        found.append(met.select("key", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    return reduce(DataFrame.unionByName, found).distinct()


def verified(pairs: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """Of (words, item_words, shift) rows, those where some ``window`` words of the item agree well enough.

    Adds start (first word of the overlap in the text), overlap (its length), same (words that agree in it) and best (the
    most that agree in one window).
    """
    low = F.greatest(F.lit(0), -F.col("shift"))
    length = F.least(F.size("item_words"), F.size("words") - F.col("shift")) - low
    need = F.least(F.lit(window), F.size("item_words"))
    # Item words beyond the edge of the document count as different.
    there = lambda w, k: F.coalesce(F.get("words", k + F.col("shift")) == w, F.lit(False)).cast("int")
    laid = pairs.withColumns({"low": low, "overlap": length, "need": need, "equal": F.transform("item_words", there)})
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("item_words") - F.col("need") + 1), lambda i: total(F.slice("equal", i, F.col("need")))))
    laid = laid.withColumns({"best": best, "same": total("equal"), "start": F.col("low") + F.col("shift")})
    return laid.where(F.col("best") * 100 >= F.col("need") * percent).drop("low", "equal")


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, block_keys: int = BLOCK_KEYS,
             few: int = FEW, text: str = "text", ident: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, key, item, start, overlap, same, best): the best overlap of each contaminated document with each item.

    Words are compared in lower case without punctuation. An overlap counts when ``percent`` in a hundred of some
    ``window`` words of an item (of the whole item if it is shorter) stand in the document at one distance, so single
    words may be replaced; at the edge of a document the words of the window that lie outside count as replaced. Items of fewer than five
    words are not searched for. Null and empty texts have no words; null
    identifiers are reported as null; repeated rows count once; empty tables give no rows; other columns are not read.
    """
    texts = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    named = benchmark.select(
        F.xxhash64(F.col(item), F.col(item_text)).alias("item"), F.col(item).alias("item_id"), words_of(F.col(item_text)).alias("words")
    ).dropDuplicates(["item"])
    items = named.select("item", "words")
    found = cut_lineage(hits(texts.select("key", words_of(F.col("text")).alias("words")), items, block_keys))
    keys = found.select("key").distinct()
    asked = F.broadcast(keys) if keys.count() <= few else keys
    held = texts.join(asked, "key", "left_semi").dropDuplicates(["key"]).select("id", "key", words_of(F.col("text")).alias("words"))
    pairs = found.join(held, "key").join(named.withColumnRenamed("words", "item_words"), "item")
    good = verified(pairs, window, percent)
    best = F.max(F.struct("best", "same", (-F.col("start")).alias("neg_start"), "overlap")).alias("b")
    return good.groupBy("key", "item").agg(F.first("id").alias("id"), F.first("item_id").alias("item_id"), best).select(
        "id", "key", F.col("item_id").alias("item"), (-F.col("b.neg_start")).alias("start"), F.col("b.overlap").alias("overlap"),
        F.col("b.same").alias("same"), F.col("b.best").alias("best"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, start_word, n_words, n_same."""
    ident, item = options.get("ident", "doc_id"), options.get("item", "item_id")
    return overlaps(docs, benchmark, **options).select(
        F.col("id").alias(ident), F.col("item").alias(item), F.col("start").cast("bigint").alias("start_word"),
        F.col("overlap").cast("bigint").alias("n_words"), F.col("same").cast("bigint").alias("n_same")).distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame, few: int = FEW, **options) -> DataFrame:
    """The documents without any overlap, with all their columns."""
    text, ident = options.get("text", "text"), options.get("ident", "doc_id")
    dirty = cut_lineage(overlaps(docs, benchmark, few=few, **options).select(F.col("key").alias("_key")).distinct())
    asked = F.broadcast(dirty) if dirty.count() <= few else dirty
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.xxhash64(F.col(ident), F.col(text)).alias("_key"))
    return marked.join(asked, "_key", "left_anti").select("_doc.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_seeds(words: str, ident: str) -> str:
    """SQL for the seeds of a table of (ident, pos, w, n): group and mask number, text of the read words."""
    lead = lambda k: "w" if k == 0 else f"lead(w, {k}) OVER (PARTITION BY {ident} ORDER BY pos)"
    tops = [2 ** 31, *[least for least, _ in GROUPS]]
    return " UNION ALL ".join(
        f"SELECT {ident}, pos, {100 * group + no} AS mask, s FROM (SELECT {ident}, pos, n, {' || chr(1) || '.join(lead(k) for k in mask)} AS s FROM {words}) "
        f"WHERE s IS NOT NULL" + (f" AND n >= {least} AND n < {tops[group]}" if ident == "item_id" else "")
        for group, (least, masks) in enumerate(GROUPS) for no, mask in enumerate(masks))


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{SEPARATORS}'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{SEPARATORS}'), lambda x: x <> '') AS ws FROM benchmark),
dw AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
bw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM b),
ds AS ({_sql_seeds("dw", "doc_id")}),
bs AS ({_sql_seeds("bw", "item_id")}),
c AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.pos - bs.pos AS shift FROM ds JOIN bs ON ds.mask = bs.mask AND ds.s = bs.s),
e AS (
  SELECT c.doc_id, c.item_id, c.shift, bw.pos, least(bw.n, {WINDOW}) AS need, dw.pos AS place, coalesce(dw.w = bw.w, false)::INT AS eq
  FROM c JOIN bw ON bw.item_id = c.item_id LEFT JOIN dw ON dw.doc_id = c.doc_id AND dw.pos = bw.pos + c.shift),
f AS (
  SELECT *, sum(eq) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos ROWS BETWEEN need - 1 PRECEDING AND CURRENT ROW) AS got,
    row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos) AS k FROM e),
g AS (
  SELECT doc_id, item_id, shift, max(got) FILTER (k >= need) AS best, sum(eq) AS same, min(place) - 1 AS start, count(place) AS overlap, max(need) AS need
  FROM f GROUP BY 1, 2, 3)
SELECT doc_id, item_id, start::BIGINT AS start_word, overlap::BIGINT AS n_words, same::BIGINT AS n_same
FROM g WHERE best * 100 >= need * {PERCENT}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, same DESC, start, overlap DESC) = 1
"""
