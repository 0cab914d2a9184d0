"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from driftlens.session import cut_lineage

# The white space that separates words, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: Column) -> Column:
    """The text, null counted as empty."""
    return F.coalesce(column, F.lit(""))


def word_count(column: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(whole(column), F.lit(f"[^{SPACE}]+")).cast("bigint")


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case, every other character untouched."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running(values: Column, join) -> Column:
    """An array with each element joined with all before it; ``join`` is associative, as sums and maxima are.

    Each round joins to every element the one 1, 2, 4, ... places before it, so n elements take n log n steps and no array
    is copied once per element.
    """
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def add(so_far: Column, k: Column) -> Column:
        before = lambda i: F.get(so_far, i - F.pow(F.lit(2), k).cast("int"))
        return F.transform(so_far, lambda x, i: F.coalesce(join(before(i), x), x))

    return F.aggregate(rounds, values, add)


def running_sums(lengths: Column) -> Column:
    """The sums of an array<bigint> up to and with each element."""
    return running(lengths, lambda a, b: a + b)


def match_spans(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, m>>, offsets in code points.

    ``split`` and ``regexp_extract_all`` walk the same matches, so the pieces between matches and the matches
    themselves give every offset. The pattern never matches the empty string.
    """
    found = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    both = F.struct(F.split(text, pattern, -1).alias("p"), found.alias("m"))

    def laid(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["p"], 1, F.size(x["m"])), x["m"], lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
        return F.zip_with(let(steps, running_sums), x["m"], lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))

    return let(both, laid)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int) -> DataFrame:
    """Add the sum of ``value`` over the rows before, within ``keys`` by ``order`` (a unique number from 0).

    The order is cut into chunks of ``width``. Chunk sums are added up first, then rows within their chunk, so a key
    with most of the rows is spread over its chunks.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(order) / width))
    sums = cut.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, [*keys, "_chunk"])
    return out.withColumn(name, F.col("_base") + F.col("_own")).drop("_chunk", "_own", "_base")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links between numbers: (node, component), the smallest number reachable."""
    links = stars(edges, a, b)
    return links.union(links.select("component", "component").distinct())


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) as ``components`` gives them, without the rows of nodes that are themselves the smallest.

    Every round turns links to the smallest neighbour, first of their lower end, then of their higher one, with one
    shuffle each; links never become more. When a round turns none, each links a node to the smallest of its component.
    """
    links = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b")
    while True:
        both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = links.select(F.explode(both).alias("end")).select(F.col("end.a").alias("node"), F.col("end.b").alias("other"))
        ends = ends.repartition("node").distinct().withColumn("near", F.least("node", F.min("other").over(Window.partitionBy("node"))))
        lower = ends.where("other > node").select(F.col("other").alias("a"), F.col("near").alias("b"), (F.col("near") < F.col("node")).alias("moved"))
        lower = lower.repartition("a").groupBy("a", "b").agg(F.max("moved").alias("moved"))
        higher = lower.withColumn("near", F.min("b").over(Window.partitionBy("a"))).withColumn("far", F.col("b") > F.col("near"))
        fresh = cut_lineage(higher.select(
            F.when(F.col("far"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("near").alias("b"), (F.col("moved") | F.col("far")).alias("moved")))
        links = fresh.select("a", "b")
        if fresh.where("moved").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
