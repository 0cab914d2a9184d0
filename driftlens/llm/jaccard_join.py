"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from driftlens.llm.common import stars, table
from driftlens.llm.texthash import U, mix, shingle_set
from driftlens.session import cut_lineage

WORDS = 4
PERCENT = 85
TILE = 1500            # rows on either side of one product
FEW = 500_000          # narrow rows that may be broadcast
CELLS = 2_000_000      # incidences that a product multiplies at a time


class Signatures:
    """Signatures of a set such that any two sets that link share one.

    Sizes fall into levels, each reaching up to the largest partner of the level before. Linked sets differ in at most
    ``k`` elements, a bound that follows from their sizes. Elements are dealt over k + 1 + spare parts by hash; at most k
    parts can differ, so at least 1 + spare parts agree. An empty part says nothing and gives no signature, unless a set
    has more than ``spare`` empty parts; then it gives its empty ones too. Sets link within a level or across neighbours,
    hence each set signs for its own level and the next.

    ``common`` lists shingles that many texts share, in any number; a small part may hold nothing else, and would chain
    texts that have only a line in common. They are left out first, which changes no bound: without them sets differ
    in at most as many elements. A set that then has too many empty parts signs a second time with all its elements;
    of two linked sets either one has few empty parts and a part of rare shingles agrees, or both sign the second time.
    """

    def __init__(self, percent: int, seed: int = 0, common: np.ndarray | None = None) -> None:
        self.percent = percent
        self.starts = [1]
        self.known: dict[int, tuple[int, int]] = {}
        self.seed = mix(np.array([seed], U))[0]
        self.common = np.empty(0, U) if common is None else np.sort(common)

    def level(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def parts(self, level: int) -> tuple[int, int]:
        """(parts, spare) of a level."""
        if level in self.known:
            return self.known[level]
        while len(self.starts) < level + 2:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        largest = self.starts[level + 1] - 1
        k = 2 * largest * (100 - self.percent) // (100 + self.percent)
        # As many spare parts as the smallest sets of the level will hardly ever have empty ones.
        spare, smallest = 0, self.starts[max(0, level - 1)]
        while k and spare < k:
            empty = (k + 1 + spare) * math.exp(-smallest / (k + 1 + spare))
            if spare >= empty + 3 * math.sqrt(empty):
                break
            spare += 1 + k // 50
        self.known[level] = (k + 1 + spare, spare)
        return self.known[level]

    def deal(self, hashed: np.ndarray, level: int, turn: int) -> tuple[np.ndarray, np.ndarray | None]:
        """(signatures of the parts that hold something, signatures of the empty ones if those are too many)."""
        parts, spare = self.parts(level)
        tag = (U(level) << U(40)) + (U(turn) << U(38))
        part = (hashed * U(2 * level + 0x9E3779B97F4A7C15) >> U(33)) % U(parts)
        order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
        dealt = part[order]
        first = np.flatnonzero(np.concatenate(([True], dealt[1:] != dealt[:-1]))) if len(dealt) else np.empty(0, np.int64)
        held = dealt[first]
        signed = mix(np.add.reduceat(hashed[order], first) ^ mix(tag + held)) if len(first) else np.empty(0, U)
        if parts - len(held) <= spare:
            return signed, None
        empty = np.setdiff1d(np.arange(parts, dtype=U), held)
        return signed, mix(tag + empty + (U(1) << U(39)))

    def of(self, items: np.ndarray) -> np.ndarray:
        if not len(items):
            return np.empty(0, np.int64)
        rare = items
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, items), len(self.common) - 1)
            rare = items[self.common[at] != items]
        made = []
        own = self.level(len(items))
        with np.errstate(over="ignore"):
            for level in (own, own + 1):
                signed, empty = self.deal(mix(rare ^ self.seed), level, 0)
                made.append(signed)
                if empty is not None:
                    signed, empty = self.deal(mix(items ^ self.seed), level, 1)
                    made += [signed] if empty is None else [signed, empty]
        return np.concatenate(made).view(np.int64)


def common_shingles(docs: DataFrame, words: int, sample_docs: int = 8000, least: int = 3, most: int = 100_000) -> np.ndarray:
    """Shingles found in ``least`` or more of about ``sample_docs`` documents, the ``most`` frequent ones.

    They only decide how texts sign, never which texts link, so a bounded sample and a bounded list will do.
    """
    n = docs.count()
    share = int(1e6 * min(1.0, sample_docs / max(1, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))], ["g"])

    sample = docs.where(F.pmod("key", F.lit(1_000_000)) < share).select("text").mapInArrow(run, "g bigint")
    often = sample.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return np.array([r.g for r in often.orderBy(F.desc("n"), "g").limit(most).collect()], np.int64).view(U)


def sketches(docs: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """Per row of (id, key, row, text): set size, a hash of the set and its signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signatures(percent, common=common)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                sizes, hashes, sigs = [], [], []
                for text in part.column("text").to_pylist():
                    items = shingle_set(text, words)
                    sizes.append(len(items))
                    with np.errstate(over="ignore"):
                        hashes.append(int(mix(items).sum(dtype=U).view(np.int64)) if len(items) else 0)
                    sigs.append(sign.of(items))
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sigs]))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key"), part.column("row"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.int64()), listed],
                    ["id", "key", "row", "n", "set_hash", "sigs"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, key bigint, row bigint, n bigint, set_hash bigint, sigs array<bigint>")


def product_links(sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """The component of each row by the links between ``left`` and ``right`` rows.

    Rows times columns is multiplied in blocks of rows: the columns of a row give the rows that share them, and counting
    those gives the overlaps. A pair counts when its overlap reaches the bound that follows from both sizes. Columns of
    one row alone are dropped first. A row whose partners of possible size are all in its component is skipped.
    """
    m = len(sets)
    columns = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(columns, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    by_column = np.argsort(column, kind="stable")
    posting, starts = owner[by_column], np.searchsorted(column[by_column], np.arange(len(count) + 1))
    row_starts = np.searchsorted(owner, np.arange(m + 1))
    comp = np.arange(m)
    sides = [(r, right) for r in np.flatnonzero(left)]
    at = 0
    while at < len(sides):
        block, cells = [], 0
        while at < len(sides) and (not block or cells < CELLS) and len(block) < 1 + 2 * at:
            r, partners = sides[at]
            at += 1
            fits = partners & (sizes * 100 >= sizes[r] * percent) & (sizes[r] * 100 >= sizes * percent)
            if (comp[fits] == comp[r]).all():
                continue
            mine = column[row_starts[r]:row_starts[r + 1]]
            block.append((r, fits, mine))
            cells += int((starts[mine + 1] - starts[mine]).sum())
        for r, fits, mine in block:
            if (comp[fits] == comp[r]).all() or not len(mine):
                continue
            overlap = np.bincount(np.concatenate([posting[starts[c]:starts[c + 1]] for c in mine]), minlength=m)
            hit = fits & ((100 + percent) * overlap >= percent * (sizes + sizes[r])) & (comp != comp[r])
            merged = np.unique(np.append(comp[hit], comp[r]))
            comp[np.isin(comp, merged)] = merged[0]
    return comp


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, tile: int = TILE, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(id, key, row, n, comp): the rows of the join with their component, named by one of its rows.

    1. One pass gives every set's size, hash and signatures (written down once).
    2. The smallest rows of signatures are joined where one row has both; components of that are blocks, outside of
       which no links exist. Equal sets of a block are one member.
    3. Members fetch their sets. Large blocks are cut again by other signatures. A block is one sparse product; a block of more than ``tile`` members is cut into tiles,
       and each pair of tiles is one product, so the rows in a task are bounded. A product returns the components of its
       rows: at most one link per member and tile pair.
    """
    body = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    keyed = body.withColumn("key", F.xxhash64("id", "text"))
    common = common_shingles(keyed, words)
    rows = keyed.withColumn("row", F.monotonically_increasing_id()).select("id", "key", "row", "text")
    facts = cut_lineage(sketches(rows, words, percent, common))
    blocks = blocks_of(facts.select("row", F.explode("sigs").alias("sig")))
    facts = facts.drop("sigs")
    inside = cut_lineage(facts.join(blocks, "row"))
    members = inside.groupBy("block", "n", "set_hash").agg(F.min(F.struct("row", "key")).alias("m"))
    members = members.select("block", "n", "set_hash", F.col("m.row").alias("member"), F.col("m.key").alias("key"))
    number = F.count(F.lit(1)).over(Window.partitionBy("block"))
    wanted = cut_lineage(members.withColumn("members", number).where("members > 1").withColumn("tiles", F.ceil(F.col("members") / tile).cast("int")).drop("members"))
    sets = cut_lineage(fetch_sets(keyed.select("key", "text"), wanted, words))
    sets = refined(sets, percent, tile)
    own = F.pmod(F.xxhash64("member"), F.col("tiles")).cast("int")
    pairs = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "member", "n", "items", "tiles")
    group = ["block", "i", "j"]
    links = cut_lineage(tile_products(pairs.repartition(*group).sortWithinPartitions(*group), percent))
    # The product of a block in one tile has its components; those of cut blocks are put together.
    joined = links.where("tiles = 1").select(F.col("a").alias("node"), F.col("b").alias("component"))
    cut = links.where("tiles > 1")
    if not cut.isEmpty():
        joined = joined.union(stars(cut))
    placed = inside.join(members.select("block", "n", "set_hash", "member"), ["block", "n", "set_hash"])
    placed = placed.join(joined.withColumnRenamed("node", "member"), "member", "left").select(
        "row", F.coalesce("component", "member").alias("comp"))
    return facts.join(placed, "row", "left").select("id", "key", "row", "n", F.coalesce("comp", "row").alias("comp"))


def blocks_of(signed: DataFrame) -> DataFrame:
    """(row, block) for the rows of (row, sig) that share a signature with another row; blocks are components of that.

    The smallest row with a signature is its hub. A row belongs with its smallest hub and links that to its other ones, so
    only hubs are nodes and the rows of a group, which share most hubs, give the same few links.
    """
    # One shuffle by signature; a window reads a group as a stream that spills.
    group = Window.partitionBy("sig")
    hubs = signed.withColumn("hub", F.min("row").over(group)).withColumn("most", F.max("row").over(group)).where("most > hub")
    each = cut_lineage(hubs.groupBy("row").agg(F.collect_set("hub").alias("hubs")).withColumn("low", F.array_min("hubs")))
    found = stars(each.select(F.col("low").alias("a"), F.explode("hubs").alias("b")).where("a <> b").distinct())
    return each.join(found.withColumnRenamed("node", "low"), "low", "left").select("row", F.coalesce("component", "low").alias("block"))


def fetch_sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The shingle sets of the wanted members; a text that only shares the key is told apart by the hash of its set."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sets = [shingle_set(t, words) for t in rows["text"]]
            with np.errstate(over="ignore"):
                hashes = [int(mix(s).sum(dtype=U).view(np.int64)) if len(s) else 0 for s in sets]
            right = np.array([h == w for h, w in zip(hashes, rows["set_hash"], strict=True)], bool)
            out = rows[["block", "member", "n", "tiles"]].assign(items=[s.tobytes() for s in sets])
            yield out[right]

    # A few members are looked up where the texts are; more of them meet the texts in a shuffle.
    asked = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    found = texts.join(asked, "key").select("block", "member", "n", "tiles", "set_hash", "text")
    made = found.mapInPandas(run, "block bigint, member bigint, n bigint, tiles int, items binary")
    return made.dropDuplicates(["member"])


def refined(sets: DataFrame, percent: int, tile: int, rounds: int = 2) -> DataFrame:
    """Blocks of more than one tile cut further: their members sign again with another seed, within their block.

    Blocks grow large when texts that do not link are chained by signatures they share by chance. Linked members share a
    signature under every seed, so no link is lost, while few chance chains come about twice.
    """
    before = 0
    for seed in range(1, rounds + 1):
        large = sets.where("tiles > 1")
        number = large.count()
        # Blocks that a round has not made smaller hold texts that do link.
        if number in (0, before):
            break
        before = number
        signed = sign_again(large.select("block", "member", "items"), percent, seed).select("block", "member", F.explode("sigs").alias("sig"))
        parts = blocks_of(signed.select(F.col("member").alias("row"), F.xxhash64("block", "sig").alias("sig")))
        parts = parts.withColumn("tiles", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("block")) / tile).cast("int"))
        cut = large.drop("block", "tiles").join(parts.withColumnRenamed("row", "member"), "member")
        sets = cut_lineage(sets.where("tiles = 1").unionByName(cut.select(*sets.columns)))
    return sets


def sign_again(members: DataFrame, percent: int, seed: int) -> DataFrame:
    """(block, member, sigs) from (block, member, items)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signatures(percent, seed)
        for batch in batches:
            sigs = [sign.of(np.frombuffer(items.as_buffer(), U)) for items in batch.column("items")]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("member"), pa.array(sigs, pa.list_(pa.int64()))], ["block", "member", "sigs"])

    return members.mapInArrow(run, "block bigint, member bigint, sigs array<bigint>")


def tile_products(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, tiles): each member with the smallest one it is joined to in a tile pair, for all tile pairs.

    Rows come sorted by (block, i, j), and one tile pair is held at a time.
    """
    def links_of(rows: list[tuple]) -> list[tuple[int, int, int]]:
        rows.sort(key=lambda r: (r[5], r[4]))
        i, j = rows[0][1:3]
        own, member, sizes = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
        comp = product_links(sizes, [np.frombuffer(r[6], U) for r in rows], own == i, own == j, percent)
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, comp, member)
        return [(int(m), int(x), rows[0][7]) for m, x in zip(member, least[comp], strict=True) if m != x]

    def batch_of(made: list[tuple[int, int, int]]) -> pa.RecordBatch:
        kinds = {"a": pa.int64(), "b": pa.int64(), "tiles": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made: list[tuple[int, int, int]] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[:3] != held[0][:3]:
                    made += links_of(held)
                    held = []
                held.append(row)
            yield batch_of(made)
            made = []
        if held:
            yield batch_of(links_of(held))

    return pairs.mapInArrow(run, "a bigint, b bigint, tiles int")


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", ident: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest identifier reachable by links).

    A document's set holds its distinct runs of ``words`` words, A-Z in lower case; with fewer words the whole sequence
    is the one element. Two documents link when their Jaccard similarity is at least ``percent`` in a hundred. Null, empty
    and blank texts have no set and link with nothing. Repeated rows link with each other. Null identifiers take part, but
    are not the smallest unless all are null. An empty table gives no rows; other columns are not read.
    """
    rows = linked(docs, words, percent, text=text, ident=ident, **options)
    first = rows.where("comp <> row OR n > 0").groupBy("comp").agg(F.min("id").alias("component_id"))
    return rows.join(first, "comp", "left").select(
        F.col("id").alias(ident), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", ident: str = "doc_id", **options) -> DataFrame:
    """The documents with one of each component left, the one with the smallest identifier; all columns."""
    rows = cut_lineage(linked(docs, words, percent, text=text, ident=ident, **options))
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))).alias("best"))
    stay = best.select(F.col("best.row").alias("row"), F.lit(1).alias("stays"))
    left = rows.join(stay, "row", "left").groupBy(F.col("key").alias("_key")).agg(
        F.count(F.lit(1)).alias("_rows"), F.coalesce(F.sum("stays"), F.lit(0)).alias("_left"))
    changed = cut_lineage(left.where("_left < _rows").select("_key", "_left"))
    some = lambda keys: F.broadcast(keys) if changed.count() <= FEW else keys
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.xxhash64(F.col(ident), F.col(text)).alias("_key"))
    kept = marked.join(some(changed.select("_key")), "_key", "left_anti").select("_doc.*")
    # Of repeated rows, which share a key, as many as stay.
    partly = changed.where("_left > 0")
    if partly.isEmpty():
        return kept
    turn = F.row_number().over(Window.partitionBy("_key").orderBy("_left"))
    again = marked.join(some(partly), "_key").withColumn("_turn", turn).where("_turn <= _left")
    return kept.unionByName(again.select("_doc.*"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' '))) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 85 * (x.n + y.n - p.i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
