"""Prefix trie of conversations: node tables addressed by minimal perfect hashes, filled and summed up shard by shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from driftlens.llm.common import table, whole
from driftlens.llm.texthash import U, mix
from driftlens.operators.ordering import group_row_number
from driftlens.session import cut_lineage

SHARD_ROWS = 4_000     # turns of one shard, about
MAX_HEAD = 8            # turns that a rebuilt conversation takes over at most
BAND = 1024             # depths of one shard; longer conversations go on in other shards
CHUNK_IDS = 4096        # identifiers joined to one piece of text at most
KEY = ["depth", "d1", "d2"]
PART = ["shard", "band"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

# Rows of a shard: a turn; the turn before a band's first, whose digest the band starts from; sums handed up from deeper bands.
TURN, HALO, CARRY = 0, 1, 2


class NodeTable:
    """Slots 0 to n-1 for n distinct 128-bit digests, without stored chains or empty places.

    Built level by level: on each, the digests left hash into twice as many places, those alone in theirs take it, and
    the others go on. A digest's slot is the rank of its place among all taken ones. The table keeps the digest of
    every slot, so that a digest which does not belong there is told from one that does.
    """

    def __init__(self, d1: np.ndarray, d2: np.ndarray) -> None:
        self.taken: list[np.ndarray] = []       # per level: slot of each place, -1 where free
        left = np.arange(len(d1))
        used = 0
        while len(left):
            size = 2 * len(left)
            place = self._place(d1[left], d2[left], len(self.taken), size)
            alone = np.bincount(place, minlength=size) == 1
            slots = np.where(alone, np.cumsum(alone) - 1 + used, -1)
            self.taken.append(slots)
            used += int(alone.sum())
            left = left[~alone[place]]
            if len(self.taken) > 64:
                raise ValueError("digests are not distinct")
        self.size = used
        self.d1, self.d2 = np.zeros(used, np.int64), np.zeros(used, np.int64)
        slots = self._slots(d1, d2)
        self.d1[slots], self.d2[slots] = d1, d2

    @staticmethod
    def _place(d1: np.ndarray, d2: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(mix(d1.view(U) + U(level)) ^ d2.view(U)) % U(size)).astype(np.int64)

    def _slots(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        out = np.full(len(d1), -1, np.int64)
        left = np.arange(len(d1))
        for level, slots in enumerate(self.taken):
            if not len(left):
                break
            out[left] = slots[self._place(d1[left], d2[left], level, len(slots))]
            left = left[out[left] < 0]
        return out

    def slots(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """The verified slot of each digest; -1 for a digest that is not in the table."""
        out = self._slots(d1, d2)
        if not self.size:
            return out
        return np.where((out >= 0) & (self.d1[out] == d1) & (self.d2[out] == d2), out, -1)


def head_turns(ident: Column) -> Column:
    """How many turns a conversation takes over: crc32 of its identifier as text, modulo 9."""
    return (F.crc32(F.encode(ident.cast("string"), "UTF-8")) % 9).cast("int")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos from 0, a, b, size): the turns in order with two hashes of role and text, and the text's bytes.

    Order is by turn, null first; equal turns come by their hashes. Texts are read here and never again.
    """
    role, text = whole(F.col("role")), whole(F.col("text"))
    narrow = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"), F.octet_length(text).cast("bigint").alias("size"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    return group_row_number(narrow, ["conv"], order, "_nth").select("conv", (F.col("_nth") - 1).alias("pos"), "a", "b", "size")


def rebuilt_turns(turns: DataFrame, group: int) -> DataFrame:
    """(conv, depth, a, b, size, total, h1, h2, band) of rebuilt conversations; depth 0 is the root, which all pass.

    The first ``head_turns`` turns come from the first conversation of each ``group`` identifiers, the others from the
    conversation itself. A conversation's own row is met once per band of turns, so a very long one is not joined in a
    single task. A prefix has as its digest the exclusive or of ``h1`` and ``h2`` over its turns.
    """
    zero = F.lit(0).cast("bigint")
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = lengths.withColumns({"lead": F.col("conv") - F.col("conv") % group, "h": head_turns(F.col("conv"))})
    leads = lengths.select(F.col("conv").alias("lead"), F.col("n").alias("n_lead"))
    taken = F.least(F.col("h"), F.coalesce("n_lead", zero))
    convs = convs.join(leads, "lead", "left").select("conv", "lead", "n", "h", taken.alias("taken")).withColumn(
        "total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), zero))
    root = convs.select("conv", zero.alias("depth"), *[zero.alias(c) for c in ("a", "b", "size")], "total")
    heads = turns.where(F.col("pos") < MAX_HEAD).select(F.col("conv").alias("lead"), "pos", "a", "b", "size")
    lent = convs.join(heads, "lead").where("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "a", "b", "size", "total")
    bands = convs.withColumn("at", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / BAND)))).select("conv", "at", "h", "taken", "total")
    own = turns.where(F.col("pos") >= head_turns(F.col("conv"))).withColumn("at", F.floor(F.col("pos") / BAND)).join(bands, ["conv", "at"])
    kept = own.select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "a", "b", "size", "total")
    inside = F.col("depth") > 0
    return root.unionByName(lent).unionByName(kept).withColumns({
        "h1": F.when(inside, F.xxhash64("depth", "a", "b")).otherwise(zero),
        "h2": F.when(inside, F.xxhash64("b", "depth", "a")).otherwise(zero),
        "band": F.floor(F.col("depth") / BAND),
    })


def band_starts(rows: DataFrame) -> DataFrame:
    """(conv, band, depth, h1, h2) for all bands but the first: the digest of the turns before it, at the last depth before."""
    sums = rows.where(F.col("total") >= BAND).groupBy("conv", "band").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv", "band", (F.col("band") * BAND - 1).alias("depth"), *[F.bit_xor(h).over(before).alias(h) for h in ("h1", "h2")])
    return starts.where("band > 0")


def prefix_digests(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(d1, d2, p1, p2, top) for rows by (conv, depth): the digest of every prefix and of the one before, none at the top."""
    conv = rows["conv"].to_numpy(np.int64)
    top = np.ones(len(conv), bool)
    top[1:] = conv[1:] != conv[:-1]
    start = np.maximum.accumulate(np.where(top, np.arange(len(conv)), 0))
    digests, parents = [], []
    for name in ("h1", "h2"):
        own = rows[name].to_numpy(np.int64)
        total = np.bitwise_xor.accumulate(own)
        digest = total ^ np.where(start > 0, total[start - 1], 0)
        digests.append(digest)
        parents.append(np.where(top, 0, digest ^ own))
    return *digests, *parents, top


COUNTED = "shard bigint, band bigint, depth bigint, d1 bigint, d2 bigint, p1 bigint, p2 bigint, top boolean, a bigint, b bigint, size bigint, n bigint, n_ends bigint, conv bigint"


def count_nodes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The distinct prefixes of a shard, with members, ends and smallest member counted into arrays by slot."""
    rows = rows.sort_values(["conv", "depth"], kind="stable")
    conv, depth, kind, a, b, size, total = (rows[c].to_numpy(np.int64) for c in ("conv", "depth", "kind", "a", "b", "size", "total"))
    d1, d2, p1, p2, top = prefix_digests(rows)
    order = np.lexsort((d2, d1))
    distinct = np.ones(len(order), bool)
    distinct[1:] = (d1[order[1:]] != d1[order[:-1]]) | (d2[order[1:]] != d2[order[:-1]])
    nodes = NodeTable(d1[order][distinct], d2[order][distinct])
    slot = nodes.slots(d1, d2)
    # One row stands for each slot, and all rows of the slot have to agree with it in what makes the node.
    chosen = np.zeros(nodes.size, np.int64)
    chosen[slot] = np.arange(len(slot))
    if any((fact != fact[chosen][slot]).any() for fact in (depth, kind, top, p1, p2, a, b, size)):
        raise ValueError("two different prefixes have one digest")
    turn = kind == TURN
    ends = turn & (depth == total)
    n, n_ends, least = np.zeros(nodes.size, np.int64), np.zeros(nodes.size, np.int64), np.full(nodes.size, np.iinfo(np.int64).max)
    np.add.at(n, slot[turn], 1)
    np.add.at(n_ends, slot[ends], 1)
    np.minimum.at(least, slot[turn], conv[turn])
    return pd.DataFrame({
        "shard": key[0], "band": key[1], "depth": depth[chosen], "d1": nodes.d1, "d2": nodes.d2, "p1": p1[chosen], "p2": p2[chosen],
        "top": top[chosen], "a": a[chosen], "b": b[chosen], "size": size[chosen], "n": n, "n_ends": n_ends, "conv": least,
    })


def merged_nodes(counted: DataFrame) -> DataFrame:
    """(depth, d1, d2, conv, n_convs, leaf, saved): the nodes of all shards, checked to be the same node in each."""
    facts = ["p1", "p2", "a", "b", "size"]
    same = F.lit(True)
    for fact in facts:
        same = same & (F.min(fact) == F.max(fact))
    # The parents of a band's first nodes are known to the band that holds them as turns.
    nodes = counted.where("n > 0").groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n_convs"), (F.sum("n") == F.sum("n_ends")).alias("leaf"),
        F.when(same, F.min("size")).otherwise(F.raise_error("two different prefixes have one digest").cast("bigint")).alias("size"),
    )
    return nodes.select(*KEY, "conv", "n_convs", "leaf", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))


def handed_up(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(conv, band, d1, d2, leaves, saved): what the bands below a band add to it, at the last turn of each conversation.

    A node's sums go the way of the conversation that stands for it. A band gets the sums of all deeper ones at once, so
    no band waits for another.
    """
    deep = nodes.where(F.col("depth") >= BAND).withColumn("band", F.floor(F.col("depth") / BAND))
    sums = deep.groupBy("conv", "band").agg(F.sum(F.col("leaf").cast("bigint")).alias("leaves"), F.sum("saved").alias("saved"))
    zero = F.lit(0).cast("bigint")
    last = sums.groupBy("conv").agg(F.max("band").alias("last"))
    spine = last.select("conv", F.explode(F.sequence(zero, F.col("last") - 1)).alias("band"), zero.alias("leaves"), zero.alias("saved"))
    every = spine.unionByName(sums).groupBy("conv", "band").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    below = Window.partitionBy("conv").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("conv", (F.col("band") + 1).alias("band"), F.sum("leaves").over(below).alias("leaves"), F.sum("saved").over(below).alias("saved"))
    carried = carried.where("leaves > 0 OR saved > 0").join(starts.select("conv", "band", "h1", "h2"), ["conv", "band"])
    return carried.select("conv", (F.col("band") - 1).alias("band"), F.col("h1").alias("d1"), F.col("h2").alias("d2"), "leaves", "saved")


SUMMED = "depth bigint, d1 bigint, d2 bigint, conv bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, parent bigint"


def sum_subtrees(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtrees of a shard's nodes, through an array of parent slots in order of depth.

    A node that several shards hold is put in by the shard of its smallest member alone, so that sums of shards add up.
    """
    carried = rows["kind"].to_numpy() == CARRY
    held = rows[~carried]
    d1, d2, depth, conv, n_convs = (held[c].to_numpy(np.int64) for c in ("d1", "d2", "depth", "conv", "n_convs"))
    mine, top, halo = held["mine"].to_numpy(bool), held["top"].to_numpy(bool), held["kind"].to_numpy() == HALO
    nodes = NodeTable(d1, d2)
    slot = nodes.slots(d1, d2)
    parent = nodes.slots(held["p1"].to_numpy(np.int64), held["p2"].to_numpy(np.int64))
    parent[top] = -1
    below = np.full(nodes.size, -1, np.int64)
    below[slot] = parent
    level, who = np.zeros(nodes.size, np.int64), np.zeros(nodes.size, np.int64)
    level[slot], who[slot] = depth, conv
    if (parent[~top] < 0).any() or (level[parent[~top]] != depth[~top] - 1).any():
        raise ValueError("a prefix without the one before it")
    children, leaves, saved = (np.zeros(nodes.size, np.int64) for _ in range(3))
    np.add.at(children, parent[mine & ~top], 1)
    leaves[slot] = np.where(mine, held["leaf"].to_numpy(bool), False)
    saved[slot] = np.where(mine, held["saved"].to_numpy(np.int64), 0)
    if carried.any():
        more = rows[carried]
        place = nodes.slots(more["d1"].to_numpy(np.int64), more["d2"].to_numpy(np.int64))
        if (place < 0).any():
            raise ValueError("sums for a prefix that is not there")
        np.add.at(leaves, place, more["leaves"].to_numpy(np.int64))
        np.add.at(saved, place, more["saved"].to_numpy(np.int64))
    order = np.argsort(level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[order])) + 1
    for group in reversed(np.split(order, cuts)):
        group = group[below[group] >= 0]
        np.add.at(leaves, below[group], leaves[group])
        np.add.at(saved, below[group], saved[group])
    # The turn before a band belongs to the band above, which has been handed these sums already.
    return pd.DataFrame({
        "depth": depth, "d1": d1, "d2": d2, "conv": conv, "n_convs": n_convs, "n_children": children[slot],
        "n_leaves": np.where(halo, 0, leaves[slot]), "saved": np.where(halo, 0, saved[slot]),
        "parent": pd.Series(who[parent], dtype="Int64").mask(top),
    })


def id_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Identifiers in order as pieces of comma-joined text per node."""
    for batch in batches:
        keys = batch[KEY].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) else []
        out = []
        for part in np.split(np.arange(len(batch)), cuts):
            for low in range(0, len(part), CHUNK_IDS):
                ids = batch["conv"].iloc[part[low]:part[min(len(part), low + CHUNK_IDS) - 1] + 1]
                out.append((*keys[part[low]], ids.iloc[0], ",".join(map(str, ids))))
        yield pd.DataFrame(out, columns=[*KEY, "conv", "ids"])


def hash_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each node's pieces in order; only the state of the hash is held."""
    node, state = None, None
    for batch in batches:
        out = []
        for *key, _, ids in batch.itertuples(index=False, name=None):
            if key != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=[*KEY, "ends_sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """(depth, d1, d2, ends_sha256) for every node at which a conversation ends.

    Identifiers are sorted across tasks and joined to pieces there; a node's pieces are then hashed one after another, as
    a digest over text has to be, from a sorted stream and not from a collected list.
    """
    ends = rows.groupBy("conv").agg(F.max("depth").alias("depth"), F.bit_xor("h1").alias("d1"), F.bit_xor("h2").alias("d2"))
    ordered = ends.select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    pieces = ordered.mapInPandas(id_pieces, "depth bigint, d1 bigint, d2 bigint, conv bigint, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "conv").mapInPandas(hash_pieces, "depth bigint, d1 bigint, d2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie over rebuilt conversations.

    conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. ``group`` tells which conversations are rebuilt from one another's first turns; with 1 each keeps its own.

    Turns come in order of ``turn``, null first, equal ones by a hash of role and text; repeated rows are turns of their
    own. Null roles and texts count as empty. Rows without a conv_id belong to no conversation and are left out. The
    remainder of a negative identifier is negative, as in SQL. An empty table gives no rows, not even a root. Other columns
    are not read.

    Conversations are dealt to shards by identifier, long ones by bands of depth too, so a first turn that a third of them
    share, or one conversation with a third of all turns, is spread. A shard holds about ``shard_rows`` turns.
    """
    shards = 1 + conversations.count() // shard_rows
    shard = F.pmod(F.xxhash64("conv"), F.lit(shards)).alias("shard")
    turns = cut_lineage(numbered_turns(conversations))
    rows = cut_lineage(rebuilt_turns(turns, group))
    starts = band_starts(rows)
    zeros = [F.lit(0).cast("bigint").alias(c) for c in ("a", "b", "size", "total")]
    dealt = rows.select(shard, "band", F.lit(TURN).alias("kind"), "conv", "depth", "h1", "h2", "a", "b", "size", "total").unionByName(
        starts.select(shard, "band", F.lit(HALO).alias("kind"), "conv", "depth", "h1", "h2", *zeros))
    counted = cut_lineage(dealt.groupBy(*PART).applyInPandas(count_nodes, COUNTED))
    nodes = merged_nodes(counted)
    kind = F.when(F.col("n") > 0, F.lit(TURN)).otherwise(F.lit(HALO)).alias("kind")
    known = counted.select(*PART, *KEY, "p1", "p2", "top", kind).join(nodes, KEY)
    known = known.withColumn("mine", (F.col("kind") == TURN) & (shard == F.col("shard"))).withColumn("leaves", F.lit(0).cast("bigint"))
    # Nulls would reach pandas as floating-point numbers, so what a sum lacks is 0.
    blank = [F.lit(0).cast(known.schema[c].dataType).alias(c) for c in ("depth", "p1", "p2", "top", "conv", "n_convs", "leaf", "mine")]
    carried = handed_up(nodes, starts).select(shard, "band", "d1", "d2", "leaves", "saved", F.lit(CARRY).alias("kind"), *blank)
    sums = known.unionByName(carried).groupBy(*PART).applyInPandas(sum_subtrees, SUMMED)
    whole_sums = sums.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    joined = whole_sums.join(end_digests(rows), KEY, "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# DuckDB has no crc32: eight shifts a byte, with the polynomial of the standard.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
    lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda r, step: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(crc, byte)),
    CAST(4294967295 AS BIGINT)))"""

OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS lead, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = lead WHERE pos < h
  UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM r),
p AS (
  SELECT conv_id, depth, strlen(text) AS size, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k
  FROM n),
o AS (
  SELECT conv_id, depth, size, k, CASE WHEN depth = 1 THEN '' ELSE lag(k) OVER (PARTITION BY conv_id ORDER BY depth) END AS parent FROM p
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
l AS (SELECT conv_id, max(depth) AS total FROM o GROUP BY conv_id),
g AS (
  SELECT depth, k, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(depth = total) AS leaf,
    (count(*) - 1) * any_value(size) AS saved, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = total), '') AS ends
  FROM o JOIN l USING (conv_id) GROUP BY depth, k),
s AS (
  SELECT o.depth, o.k, count(*) FILTER (g.leaf) AS n_leaves, sum(g.saved) AS saved_tokens, count(*) FILTER (g.depth = o.depth + 1) AS n_children
  FROM g JOIN o ON o.conv_id = g.conv_id AND o.depth <= g.depth GROUP BY o.depth, o.k)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, g.n_convs, n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN s ON s.depth = g.depth AND s.k = g.k LEFT JOIN g AS above ON above.depth = g.depth - 1 AND above.k = g.parent
"""
