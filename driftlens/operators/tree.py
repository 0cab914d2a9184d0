"""Path hierarchy: rollup, ordering, rendering and heat map."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from driftlens.functions import paths
from driftlens.functions.text import heat
from driftlens.operators.ordering import HOT_ROWS, group_row_number
from driftlens.operators.predicates import has_message
from driftlens.operators.search import oldest_n
from driftlens.operators.stats import recent
from driftlens.schema import STATS_HOURS
from driftlens.session import cut_lineage


def path_rollup(
    df: DataFrame, as_of: datetime, hours: int = STATS_HOURS, limit: int | None = None
) -> DataFrame:
    """Events at each path and at all its ancestors up to ``/``: (path, parent, name, depth, count).

    Reads all events with a message, or with a ``limit`` only the oldest so many. Events are
    counted per distinct path before ancestors are expanded, so the second shuffle carries paths.
    """
    rows = recent(df, as_of, hours).where(has_message())
    if limit is not None:
        rows = oldest_n(rows, limit)
    # Where there is no path there is no slash either, in nearly all messages.
    rows = rows.where(F.col("message").contains("/"))
    counts = rows.groupBy(paths.extract_path(F.col("message")).alias("leaf")).agg(F.count(F.lit(1)).alias("n")).where(F.col("leaf") != "")
    # The root exists even without events.
    counts = counts.unionByName(df.sparkSession.range(0, 1, 1, 1).select(F.lit("/").alias("leaf"), F.lit(0).cast("bigint").alias("n")))
    levels = counts.select("n", "leaf", F.explode(F.sequence(F.lit(0), paths.path_depth(F.col("leaf")))).alias("level"))
    nodes = (
        levels.select("n", paths.path_prefix(F.col("leaf"), F.col("level")).alias("path"))
        .groupBy("path").agg(F.sum("n").alias("count"))
    )
    path = F.col("path")
    return nodes.select(
        "path", paths.path_parent(path).alias("parent"), paths.path_name(path).alias("name"),
        paths.path_depth(path).alias("depth"), "count",
    )


def sibling_order(rollup: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``sibling_rank`` below each parent: highest count first, then by name."""
    # Nodes are used more than once below; the event table is not read again for that.
    named = cut_lineage(rollup).withColumn("_parent", F.coalesce("parent", F.lit("")))
    ranked = group_row_number(named, ["_parent"], [F.desc("count"), F.col("name")], "sibling_rank", hot_rows)
    return ranked.drop("_parent")


def link_children(rollup: DataFrame) -> DataFrame:
    """Add ``has_children``."""
    parents = rollup.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.lit(True).alias("has_children"))
    linked = rollup.join(parents.withColumnRenamed("parent", "path"), "path", "left")
    return linked.withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def with_walk_key(rollup: DataFrame) -> DataFrame:
    """Add ``walk_key``, which sorts nodes in pre-order with siblings in their order.

    The key lists (-count, name) of the node's ancestors and itself. It is handed down level by level: a node takes its
    parent's key and adds its own step, so an upper directory is met once per child and never once per descendant. That is
    one checkpointed round per level of the paths; a directory with very many children of its own is left to Spark's
    handling of skewed joins.
    """
    empty = F.array().cast("array<struct<level:int,o:bigint,name:string>>")
    step = F.struct(F.col("depth").cast("int").alias("level"), (-F.col("count")).alias("o"), "name")
    nodes = rollup.select("path", "parent", "depth", step.alias("step"))
    deepest = nodes.agg(F.max("depth").alias("deepest")).first().deepest or 0
    keys = above = nodes.where(F.col("depth") == 0).select("path", empty.alias("walk_key"))
    for level in range(1, deepest + 1):
        here = nodes.where(F.col("depth") == level)
        handed = here.join(above.select(F.col("path").alias("parent"), "walk_key"), "parent", "left")
        above = cut_lineage(handed.select("path", F.concat(F.coalesce("walk_key", empty), F.array("step")).alias("walk_key")))
        keys = keys.unionByName(above)
    return rollup.join(keys, "path", "left").withColumn("walk_key", F.coalesce("walk_key", empty))


def flatten_tree(rollup: DataFrame, collapsed: Iterable[str] | DataFrame = ()) -> DataFrame:
    """Visible rows in pre-order below the root: path, label, count, depth, has_children."""
    rows = with_walk_key(link_children(cut_lineage(rollup))).where(F.col("depth") > 0)
    return (
        hide_collapsed(rows, collapsed)
        .orderBy("walk_key")
        .select("path", F.col("name").alias("label"), "count", "depth", "has_children")
    )


def _proper_ancestors(path: Column) -> Column:
    above = paths.path_prefixes(path)
    return F.slice(above, F.lit(1), F.greatest(F.size(above) - 1, F.lit(0)))


def hide_collapsed(tree: DataFrame, collapsed: Iterable[str] | DataFrame) -> DataFrame:
    """Drop nodes below a collapsed one; collapsing the root hides nothing.

    Collapsed paths picked by a user are a short list and become part of the filter. A DataFrame of
    them (column ``path``) is joined by ancestor instead.
    """
    if isinstance(collapsed, DataFrame):
        hidden = (
            tree.select("path", F.explode(_proper_ancestors(F.col("path"))).alias("ancestor"))
            .join(collapsed.select(F.col("path").alias("ancestor")), "ancestor", "left_semi")
            .select("path")
        )
        return tree.join(hidden, "path", "left_anti")
    chosen = sorted(set(collapsed) - {"/"})
    if not chosen:
        return tree
    return tree.where(~F.arrays_overlap(_proper_ancestors(F.col("path")), F.array(*[F.lit(p) for p in chosen])))


def path_tree_json(rollup: DataFrame) -> DataFrame:
    """The tree as one nested JSON text, siblings in order, ``children`` absent on leaves.

    A rendering for display: the text is one value, so it suits rollups with a ``limit``. The flat
    rollup is the form for everything else.
    """
    node = F.struct("walk_key", "depth", F.to_json(F.struct("name", "path", "count")).alias("text"))
    walk = with_walk_key(cut_lineage(rollup)).agg(F.array_sort(F.collect_list(node)).alias("walk"))

    def piece(item: Column, at: Column) -> Column:
        depth = item["depth"]
        # In pre-order the next node's depth says whether this one opens a list, and how many end here.
        following = F.when(at + 1 < F.size("walk"), F.element_at("walk", at + 2)["depth"]).otherwise(0)
        opened = F.concat(F.substring(item["text"], F.lit(1), F.length(item["text"]) - 1), F.lit(',"children":['))
        closed = F.concat(
            item["text"],
            F.repeat(F.lit("]}"), F.greatest(depth - following, F.lit(0))),
            F.when(following > 0, F.lit(",")).otherwise(F.lit("")),
        )
        return F.when(following > depth, opened).otherwise(closed)

    return walk.select(F.array_join(F.transform("walk", piece), "").alias("tree"))


def heatmap(rollup: DataFrame) -> DataFrame:
    """Add hue, lightness and css colour relative to the highest count, which is always the root's."""
    rollup = cut_lineage(rollup)
    top = rollup.where(F.col("path") == "/").select("count").scalar()
    return rollup.withColumn("_heat", heat(F.col("count"), top)).select("*", "_heat.*").drop("_heat")
