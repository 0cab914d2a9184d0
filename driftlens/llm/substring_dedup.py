"""Suffix-array de-duplication: removes every byte of a long string that also stands somewhere else."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from driftlens.llm.common import table, whole
from driftlens.llm.suffix_sort import deep_shallow, neighbours
from driftlens.llm.texthash import U, inverse_powers, mix, prefix_sums
from driftlens.session import cut_lineage

LENGTH = 400
GRAM = 64              # bytes of an anchor
CHUNK = 20_000         # contexts that are sorted together
HOT = 100_000          # places of an anchor above which its contexts are compared by key, not sorted together


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours: the smaller of a block's suffix and the next block's prefix minimum."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(U).max, U)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def anchors(data: np.ndarray, length: int, gram: int, piece: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, least, most): each string of ``length`` bytes has one anchor, its first gram of the smallest hash.

    An anchor serves the strings that start ``least`` to ``most`` bytes before it. Which gram of a string is its anchor
    depends on its bytes alone, so equal strings have it at the same place. Texts are gone through in pieces.
    """
    found = []
    w = length - gram + 1
    for base in range(0, len(data) - length + 1, piece):
        part = data[base:base + piece + length - 1]
        sums = prefix_sums(part)
        with np.errstate(over="ignore"):
            hashes = mix((sums[gram:] - sums[:-gram]) * inverse_powers(len(part))[:len(part) - gram + 1])
        # The low bits hold the place, so the smallest number is the first of the smallest hashes.
        low = U((1 << 24) - 1)
        at = (sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=U), w) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        places = at[first]
        found.append((places + base, hashes[places], places - last, places - first))
    if not found:
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def find_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, pos, h, least, most): the anchors of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                keys, found = [], []
                for key, body in zip(part.column("key").to_pylist(), part.column("body"), strict=True):
                    found.append(anchors(np.frombuffer(body.as_buffer(), np.uint8), length, gram))
                    keys.append(np.full(len(found[-1][0]), key, np.int64))
                places, hashes, least, most = (np.concatenate(c) for c in zip(*found, strict=True))
                columns = [np.concatenate(keys), places, hashes.view(np.int64), least.astype(np.int32), most.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "pos", "h", "least", "most"])

    return texts.mapInArrow(run, "key bigint, pos bigint, h bigint, least int, most int")


def repeated(spots: DataFrame, hot: int) -> tuple[DataFrame, bool]:
    """The rows of anchors that occur more than once, with ``hot`` for those of over ``hot`` places, and whether there are any.

    The places of a hot anchor would meet in one task if they were dealt by anchor. Hot anchors are few, their places over
    ``hot``, so they are broadcast and their rows stay where they are; only the others are shuffled by anchor.
    """
    counts = spots.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    few = cut_lineage(counts.where(F.col("n") > hot).select("h"))
    cold = counts.where((F.col("n") >= 2) & (F.col("n") <= hot)).select("h")
    if few.isEmpty():
        return spots.join(cold, "h").withColumn("hot", F.lit(False)), False
    rest = spots.join(F.broadcast(few), "h", "left_anti").join(cold, "h").withColumn("hot", F.lit(False))
    return rest.unionByName(spots.join(F.broadcast(few), "h").withColumn("hot", F.lit(True))), True


def contexts(held: DataFrame, length: int, with_bytes: bool) -> DataFrame:
    """The surroundings of anchors, from rows (id, key, body, spots: array<struct<pos, h, hot, least, most>>).

    With bytes: (h, hot, c, left, right, n), equal ones of a batch counted together. ``right`` starts at the anchor, ``left``
    runs backwards from it, and together they hold just the strings that the anchor serves. ``c`` is a hash of both.
    Without: (key, pos, h, c).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            rows: list[tuple] = []
            for key, body, spots in zip(batch.column("key").to_pylist(), batch.column("body"), batch.column("spots").to_pylist(), strict=True):
                body = body.as_py()
                for spot in spots:
                    pos = spot["pos"]
                    left, right = body[pos - spot["most"]:pos][::-1], body[pos:pos + length - spot["least"]]
                    digest = hashlib.blake2b(left + b"|" + right, digest_size=8, salt=len(left).to_bytes(4)).digest()
                    c = int.from_bytes(digest, signed=True)
                    if with_bytes:
                        own = (spot["h"], spot["hot"], c, left, right)
                        seen[own] = seen.get(own, 0) + 1
                    else:
                        rows.append((key, pos, spot["h"], c))
            if with_bytes:
                rows = [(*own, n) for own, n in seen.items()]
            for low in range(0, len(rows), 5000):
                columns = list(zip(*rows[low:low + 5000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    wide = {"h": pa.int64(), "hot": pa.bool_(), "c": pa.int64(), "left": pa.binary(), "right": pa.binary(), "n": pa.int64()}
    kinds = wide if with_bytes else {"key": pa.int64(), "pos": pa.int64(), "h": pa.int64(), "c": pa.int64()}
    schema = "h bigint, hot boolean, c bigint, left binary, right binary, n bigint" if with_bytes else "key bigint, pos bigint, h bigint, c bigint"
    return held.mapInArrow(run, schema)


def repeated_shifts(lefts: list[bytes], rights: list[bytes], counts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """[context, m]: whether the string that starts ``m`` bytes before the anchor stands elsewhere too.

    Both sides are sorted. Strings agree when the contexts lie in one run of left sides with common prefixes of at least
    ``m``, and in one run of right sides with at least ``length - m``; such runs are read off the sorted orders.
    """
    total = len(lefts)
    order_left, order_right = deep_shallow(lefts), deep_shallow(rights)
    same_left, same_right = neighbours(lefts, order_left), neighbours(rights, order_right)
    size_left, size_right = np.array([len(s) for s in lefts]), np.array([len(s) for s in rights])
    out = np.zeros((total, length - gram + 1), bool)
    run_left, run_right = np.empty(total, np.int64), np.empty(total, np.int64)
    for m in range(length - gram + 1):
        fits = np.flatnonzero((size_left >= m) & (size_right >= length - m))
        if not len(fits):
            continue
        run_left[order_left] = np.cumsum(same_left < m)
        run_right[order_right] = np.cumsum(same_right < length - m)
        _, group = np.unique(run_left[fits] * (total + 1) + run_right[fits], return_inverse=True)
        out[fits, m] = np.bincount(group, counts[fits])[group] >= 2
    return out


def runs_of(shifts: np.ndarray, length: int) -> list[list[int]]:
    """The bytes covered by repeated strings, as [from, to) around the anchor, flattened."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], shifts, [False])).astype(np.int8)))
    return [x for a, b in zip(edges[::2], edges[1::2], strict=True) for x in (-(int(b) - 1), length - int(a))]


def sorted_groups(found: DataFrame, length: int, gram: int, chunk: int) -> DataFrame:
    """(h, c, spans) for contexts that come sorted by ``h``: whole groups are gathered up to a chunk and sorted."""
    def finish(rows: list[tuple]) -> pa.RecordBatch:
        shifts = repeated_shifts([r[2] for r in rows], [r[3] for r in rows], np.array([r[4] for r in rows]), length, gram)
        spans = [runs_of(s, length) for s in shifts]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(spans, pa.list_(pa.int64()))], ["h", "c", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in ("h", "c", "left", "right", "n")], strict=True):
                if len(held) >= chunk and row[0] != held[-1][0]:
                    yield finish(held)
                    held = []
                held.append(row)
        if held:
            yield finish(held)

    return found.mapInArrow(run, "h bigint, c bigint, spans array<bigint>")


def keyed_groups(found: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, c, spans) for the contexts of very frequent anchors: one key per string around the anchor, counted in Spark.

    Such a group would not fit in a task, so each string is its own group here; contexts were merged before.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, left, right, n in zip(*[batch.column(x).to_pylist() for x in ("h", "c", "left", "right", "n")], strict=True):
                forward = left[::-1]
                shifts = [m for m in range(length - gram + 1) if m <= len(left) and length - m <= len(right)]
                made = [hashlib.blake2b(forward[len(left) - m:] + right[:length - m], digest_size=16).digest() for m in shifts]
                k = len(shifts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * k, pa.int64()), pa.array([c] * k, pa.int64()), pa.array(shifts, pa.int64()), pa.array(made, pa.binary()), pa.array([n] * k, pa.int64())],
                    ["h", "c", "m", "string", "n"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for shifts in batch.column("shifts").to_pylist():
                held = np.zeros(length - gram + 1, bool)
                held[shifts] = True
                made.append(runs_of(held, length))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(made, pa.list_(pa.int64()))], ["h", "c", "spans"])

    each = found.mapInArrow(keys, "h bigint, c bigint, m bigint, string binary, n bigint")
    # One shuffle by string; a window reads a group as a stream that spills.
    often = each.withColumn("total", F.sum("n").over(Window.partitionBy("m", "string"))).where("total >= 2")
    shifts = often.groupBy("h", "c").agg(F.collect_set("m").alias("shifts"))
    return shifts.mapInArrow(spans, "h bigint, c bigint, spans array<bigint>")


def cut_out(rows: DataFrame, kind: str) -> DataFrame:
    """(id, body, spans: array<struct<lo, hi>> or null) -> the bytes that remain and what was removed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, runs, digests = [], [], [], [], []
            for body, spans in zip(batch.column("body"), batch.column("spans").to_pylist(), strict=True):
                body = body.as_py()
                parts, at, removed, n = [], 0, 0, 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if lo > at or not n:
                        parts.append(body[at:lo])
                        n += 1
                        removed, at = removed + hi - lo, hi
                    elif hi > at:
                        removed, at = removed + hi - at, hi
                parts.append(body[at:])
                rest = b"".join(parts)
                kept.append(rest)
                sizes.append(len(body))
                gone.append(removed)
                runs.append(n)
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())],
                ["id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"id {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, hot: int = HOT, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same or another document, is
    removed. Strings are those of the input and never cross documents. Null counts as empty; repeated rows count each, so
    their long strings go from all of them; an empty table gives no rows; other columns are not read.

    A full suffix array of a corpus cannot be sorted in one place. Instead each string has anchors, grams with the
    smallest hash in it, which equal strings share at the same place in them. Only anchors that occur more than once are
    looked at. Their suffixes, and their prefixes read backwards, are sorted by deep-shallow sorting in groups of equal
    grams; the common prefixes of sorted neighbours tell for each string around an anchor whether it stands elsewhere.
    """
    body = whole(F.col(text))
    texts = docs.select(F.col(ident).alias("id"), F.encode(body, "UTF-8").alias("body")).select("id", F.xxhash64("id", "body").alias("key"), "body")
    spots = cut_lineage(find_anchors(texts.select("key", "body").where(F.length("body") >= length), length, gram))
    often, some_hot = repeated(spots, hot)
    places = often.groupBy("key").agg(F.collect_set(F.struct("pos", "h", "hot", "least", "most")).alias("spots"))
    # All columns of ``texts`` are kept here: then the cut at the end reads the same shuffled texts again.
    held = texts.join(places, "key").select(*texts.columns, "spots")
    around = contexts(held, length, True).repartition("h")
    merged = around.groupBy("h", "hot", "c", "left", "right").agg(F.sum("n").alias("n"))
    spans = sorted_groups(merged.where("NOT hot").sortWithinPartitions("h"), length, gram, chunk)
    if some_hot:
        spread = contexts(held, length, True).where("hot").groupBy("h", "c", "left", "right").agg(F.sum("n").alias("n"))
        spans = spans.unionByName(keyed_groups(spread, length, gram))
    spans = spans.where(F.size("spans") > 0)
    at = contexts(held, length, False).join(spans, ["h", "c"])
    pairs = F.transform(F.sequence(F.lit(1), F.size("spans"), F.lit(2)), lambda i: F.struct(
        (F.col("pos") + F.get("spans", (i - 1).cast("int"))).alias("lo"), (F.col("pos") + F.get("spans", i.cast("int"))).alias("hi")))
    cuts = at.select("key", F.explode(pairs).alias("span")).groupBy("key").agg(F.collect_set("span").alias("spans"))
    kind = docs.schema[ident].dataType.simpleString()
    return cut_out(texts.join(cuts, "key", "left").select("id", "body", "spans"), kind).withColumnRenamed("id", ident)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, and as ``text`` what is left; a character that a cut went through is U+FFFD there."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
