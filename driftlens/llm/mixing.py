"""Mixing sources to target weights: packed blocks, multinomial draws, pseudorandom index permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from driftlens.llm.common import running_total, table, word_count
from driftlens.session import cut_lineage

WEIGHTS = (3, 1, 2)
BLOCK = 128            # words in a block
SHARD = 1024           # places for blocks in an output shard
ROUNDS = 24            # rounds of the permutation
CHUNK = 50_000         # rows of counts that one task adds up in order
DOC_CHUNK = 1_000      # documents of a source that are laid end to end together
CELLS = 4096           # cells over the shares of the sources
SEED = 20240


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> the same with ``weight`` and ``target``.

    Sources in code-point order, null last, take the weights in turn and share ``share`` times all words. A target stops
    at ``most`` times its source's size; what is over is shared by weight among the rest. Sources fill up in the order
    of size over weight, so the ones that are full are the first ones of that order: each row tests the level that the
    words left over by all fuller sources would reach. One row per source passes through these windows.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight"), place.alias("_place"))
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "_cap": most * F.col("source_size"), "_want": share * F.sum("source_size").over(everything),
        "_weights": F.sum("weight").over(everything),
    })
    fuller = Window.orderBy(F.col("_cap") / F.col("weight"), "_place").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    left = F.col("_want") - F.coalesce(F.sum("_cap").over(fuller), zero)
    over = F.col("_weights") - F.coalesce(F.sum("weight").over(fuller), zero)
    rows = rows.withColumn("_level", left / over)
    full = F.col("_cap") <= F.col("weight") * F.col("_level")
    # The level of those that are not full is the one at the first of them.
    level = F.min_by(F.when(~full, F.col("_level")), F.when(~full, F.col("_cap") / F.col("weight"))).over(everything)
    target = F.when(full, F.col("_cap")).otherwise(F.col("weight") * level)
    return rows.select("source", "source_size", "weight", target.cast("double").alias("target"))


def permuted(place: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 chosen by ``key``: the swap-or-not shuffle (Hoang, Morris, Rogaway, 2012)."""
    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        swap = F.pmod(F.xxhash64(key, r, F.greatest(x, partner), F.lit(1)), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place.cast("bigint"), step)


def packed(facts: DataFrame, block: int) -> DataFrame:
    """Pieces (source, block_no, row, words): the documents of a source laid end to end and cut into blocks."""
    laid = facts.where("size > 0")
    # A place for each row that depends on its identifier alone: hashed chunks, then the order inside a chunk.
    spots = laid.withColumn("_spread", F.pmod(F.when(F.col("id").isNull(), F.col("row")).otherwise(F.xxhash64("id")), F.col("_chunks")))
    sums = spots.groupBy("source", "_spread").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_spread").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), "_spread", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_spread").orderBy("id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    spots = spots.withColumn("_own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        sums, F.col("source").eqNullSafe(F.col("_source")) & (spots["_spread"] == sums["_spread"])
    )
    at = F.col("_base") + F.col("_own")
    pieces = spots.select("source", "row", "size", at.alias("at")).select(
        "source", "row", "size", "at",
        F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block_no"),
    )
    low = F.greatest(F.col("at"), F.col("block_no") * block)
    high = F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * block)
    return pieces.select("source", "block_no", "row", (low - F.col("at")).alias("first_word"), (high - low).alias("words"))


def drawn(plan: DataFrame, shard: int, seed: int) -> DataFrame:
    """(shard, source, n, start): how many blocks each output shard takes of each source, drawn multinomially.

    Every place of a shard draws a number below the sum of all quotas; a source owns the numbers of its quota. Which
    source that is comes from a join on equal cells of numbers. ``start`` counts the draws of the source in all earlier
    shards. A source stops at its quota; the places this frees are handed to the sources short of theirs in settling
    shards at the end, so each total comes out at its quota and no block can be taken more often than the cap allows.
    """
    spark = plan.sparkSession
    total, sources = plan.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], "shard bigint, source_no bigint, n bigint, start bigint")
    wide = max(1, -(-total // max(CELLS, 4 * sources)))
    owners = plan.where("quota > 0").select(
        "source_no", "quota", F.col("quota_from").alias("low"), (F.col("quota_from") + F.col("quota")).alias("high")
    ).withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("high") - 1) / wide))))
    places = spark.range(total).select(
        F.floor(F.col("id") / shard).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("draw")
    ).withColumn("cell", F.floor(F.col("draw") / wide))
    hits = places.join(owners, "cell").where("draw >= low AND draw < high")
    counts = hits.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(running_total(counts, ["source_no"], "shard", "n", "start", CHUNK))
    shards = -(-total // shard)
    quotas = plan.select("source_no", "quota", F.col("source_no").alias("_no"))
    kept = counts.join(quotas, "source_no").select(
        "shard", "source_no", F.least(F.col("n"), F.col("quota") - F.col("start")).alias("n"), "start"
    ).where("n > 0")
    taken = kept.groupBy("source_no").agg(F.sum("n").alias("got"))
    short = quotas.join(taken, "source_no", "left").select(
        "source_no", F.coalesce("got", F.lit(0)).alias("got"), "quota"
    ).where("got < quota").withColumn("first", F.explode(F.sequence(F.col("got"), F.col("quota") - 1, F.lit(shard))))
    settle = short.select(
        (F.lit(shards) + F.floor((F.col("first") - F.col("got")) / shard)).alias("shard"), "source_no",
        F.least(F.lit(shard), F.col("quota") - F.col("first")).alias("n"), F.col("first").alias("start"),
    )
    return kept.unionByName(settle)


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, text: str = "text",
        ident: str = "doc_id", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, blocks, pieces).

    ``facts``: a row per document with its size in words and its source's size and target. ``blocks``: the mix, a row
    per place: shard, place, source, block_no. ``pieces``: the words of documents that make up each block. Blocks and
    pieces meet on (source_no, block_no).

    The words of a source are laid end to end and cut into blocks of ``block`` words. Each source has a quota of blocks
    nearest to its target. Place p of source s takes block perm(p mod N) of its N blocks, with another permutation in
    each pass over the source, so blocks repeat only after all were taken. Null text has no words, null is a source like
    any other (the last one). An empty table, or one without words, gives an empty mix.
    """
    facts = docs.select(F.col(ident).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    facts = cut_lineage(facts.withColumn("row", F.monotonically_increasing_id()))
    sizes = facts.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    chunks = sizes.select(F.col("source").alias("_s"), F.ceil(F.col("docs") / DOC_CHUNK).alias("_chunks"))
    targets = source_targets(sizes.select("source", "source_size"))
    blocks = F.ceil(F.col("source_size") / block)
    plan = targets.withColumn("n_blocks", blocks).withColumn(
        "quota", F.when(F.col("n_blocks") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("bigint")
    )
    order = Window.orderBy(F.col("source").isNull(), "source")
    plan = plan.withColumns({
        "source_no": F.row_number().over(order).cast("bigint"),
        "quota_from": F.coalesce(F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    plan = cut_lineage(plan.select(
        F.col("source").alias("_s"), "source_size", "target", "n_blocks", "quota", "quota_from", "source_no"
    ).join(chunks.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t"))
    facts = facts.join(plan, facts["source"].eqNullSafe(plan["_s"])).drop("_s")
    # The counts are small but stand for up to a shard of places each, so they are dealt before they are expanded.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = drawn(plan, shard, seed).repartition(parts, "shard", "source_no", "start")
    places = shares.select(
        "shard", "source_no", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place")
    ).join(plan.select("source_no", "n_blocks", F.col("_s").alias("source")), "source_no")
    turn = F.floor(F.col("place") / F.col("n_blocks"))
    index = permuted(F.pmod("place", "n_blocks"), F.col("n_blocks"), F.xxhash64("source_no", turn, F.lit(seed)))
    mixed = places.select("shard", "place", "source_no", "source", index.alias("block_no"))
    pieces = packed(facts.drop("source").withColumnRenamed("source_no", "source"), block).withColumnRenamed("source", "source_no")
    return facts, mixed, pieces


def words_taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    ident = options.get("ident", "doc_id")
    facts, mixed, pieces = mix(docs, **options)
    times = mixed.groupBy("source_no", "block_no").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces.join(times, ["source_no", "block_no"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return facts.join(taken, "row", "left").select(
        F.col("id").alias(ident), "size", F.col("source_size").cast("bigint").alias("source_size"), "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes words of, with all their columns and ``taken``, the words it takes.

    Rows meet their counts on a hash of identifier, source and text; repeated rows are told apart by their number.
    """
    ident, source, text = (options.get(k, d) for k, d in (("ident", "doc_id"), ("source", "source"), ("text", "text")))
    key = F.xxhash64(F.col(ident), F.col(source), F.col(text))
    turn = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "taken"]).alias("_doc"), key.alias("_key")).withColumn("_turn", turn)
    narrow = docs.select(key.alias("_key"), F.col(source).alias("source"), F.col(text).alias("text"))
    counts = words_taken(narrow, **{**options, "ident": "_key", "source": "source", "text": "text"}).where("taken > 0")
    counts = counts.withColumn("_turn", turn).select("_key", "_turn", "taken")
    return marked.join(counts, ["_key", "_turn"]).select("_doc.*", "taken")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_taken(table(spark, sf_dir, "documents"))
