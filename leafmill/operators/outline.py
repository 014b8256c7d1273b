"""Outlines: adjacency lists of nodes to levels, reading order, page spans and paths.

Input: (doc_id, node_id, parent_id, sibling_ord, title, page), one row per node; repeated nodes count once (the row
with the smallest sibling_ord, then title). Nodes that no root leads to, as their parent is missing or is below them,
are left out; `unreachable` lists them. A page that is null, below 1 or beyond the document counts as 1 or as the last
page; null titles stay null and have the slug 'untitled'. Nodes may nest to any depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.ids import short_hash
from leafmill.functions.text import slug
from leafmill.state import materialized


def outline_tree(outline: DataFrame, documents: DataFrame, compat_paths: bool = False) -> DataFrame:
    """(doc_id, node_id, root_id, level, dfs_ord, title, page_start, page_end, path).

    A node ends on the page before the next node of its level or above (on page 1 at least), else with the document.
    That next node is the next sibling of the node or of its nearest ancestor that has one, so it is found on the way to
    the root and no self-join on ranges is needed. With `compat_paths` a path has the root's slug for each ancestor.

    The way to the root is found by doubling: each node knows a stretch of ancestors, and joins the stretch that its
    uppermost one knows, until it reaches a root. A tree of depth d takes log2(d) equi-joins of narrow rows, each
    written once; it ends when no node is left or none came to a root in a round.
    """
    counts = documents.select("doc_id", F.coalesce("page_count", F.lit(0)).alias("pages")).groupBy("doc_id").agg(F.max("pages").alias("pages"))
    once = outline.groupBy("doc_id", "node_id").agg(F.min_by(F.struct("parent_id", "sibling_ord", "title", "page"), F.struct("sibling_ord", "title", "page")).alias("n")).select("doc_id", "node_id", "n.*")
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("sibling_ord", "node_id")
    way = once.withColumn("page_start", F.greatest(F.lit(1), F.coalesce("page", F.lit(1)))).select(
        "doc_id", "node_id", F.col("parent_id").alias("up"), F.col("node_id").alias("root_id"), F.lit(1).alias("level"), "title", "page_start",
        F.format_string("%08d", F.row_number().over(siblings)).alias("key"), F.array(slug(F.col("title"))).alias("path"), F.lead("page_start").over(siblings).alias("after"),
    )
    left = -1
    while True:
        way = materialized(way)
        below = way.where("up is not null")
        before, left = left, below.count()
        if left in (0, before):
            break
        above = way.select("doc_id", F.col("node_id").alias("up"), *[F.col(c).alias(f"a_{c}") for c in ("up", "root_id", "level", "key", "path", "after")])
        joined = below.join(above, ["doc_id", "up"]).select(
            "doc_id", "node_id", F.col("a_up").alias("up"), F.col("a_root_id").alias("root_id"), (F.col("a_level") + F.col("level")).alias("level"), "title", "page_start",
            F.concat("a_key", "key").alias("key"), F.concat("a_path", "path").alias("path"), F.coalesce("after", "a_after").alias("after"),
        )
        way = way.where("up is null").unionByName(joined)
    tree = way.where("up is null")
    if compat_paths:
        tree = tree.withColumn("path", F.expr("concat(array_repeat(path[0], level - 1), slice(path, -1, 1))"))
    spans = tree.join(counts, "doc_id", "left").withColumn("last", F.greatest(F.coalesce("pages", F.lit(0)), F.lit(1)))
    end = F.least(F.when(F.col("after").isNull(), F.col("last")).otherwise(F.greatest(F.lit(1), F.col("after") - 1)), F.col("last"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("key"))
    return spans.select("doc_id", "node_id", "root_id", "level", order.alias("dfs_ord"), "title", "page_start", end.alias("page_end"), "path")


def unreachable(outline: DataFrame, tree: DataFrame) -> DataFrame:
    """(doc_id, node_id) of the nodes that no root leads to."""
    return outline.select("doc_id", "node_id").distinct().join(tree.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")


def unique_slugs(tree: DataFrame) -> DataFrame:
    """`tree` with `unique`: the node's slug, from the second one of a level and document on with its number.

    Numbered slugs are not looked up again, so "intro", "intro" and "intro-2" give "intro-2" twice.
    """
    last = F.element_at("path", -1)
    n = F.row_number().over(Window.partitionBy("doc_id", "level", last).orderBy("dfs_ord"))
    return tree.withColumn("unique", F.when(n == 1, last).otherwise(F.concat_ws("-", last, n.cast("string"))))


def outline_counts(tree: DataFrame) -> DataFrame:
    """(doc_id, chapters, sections): roots, and nodes below them."""
    return tree.groupBy("doc_id").agg(F.count_if(F.col("level") == 1).alias("chapters"), F.count_if(F.col("level") >= 2).alias("sections"))


def fallback_outline(documents: DataFrame, outline: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One root over all pages for each document without an outline; its title from `titles` (doc_id, title)."""
    bare = documents.select("doc_id").distinct().join(outline.select("doc_id").distinct(), "doc_id", "left_anti")
    if titles is None:
        named = bare.withColumn("title", F.lit("Document"))
    else:
        named = bare.join(titles, "doc_id", "left").withColumn("title", F.coalesce("title", F.lit("Document")))
    return named.select("doc_id", F.lit(1).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(1).alias("sibling_ord"), "title", F.lit(1).alias("page"))


def title_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, title) from the first block with text on page 1 that is a title or heading or at least 16 points high."""
    large = F.lower("type").isin("title", "heading") | (F.col("font_size") >= 16)
    first = blocks.where((F.col("page_no") == 1) & large & F.col("text").rlike(r"(?U)\S"))
    return first.groupBy("doc_id").agg(F.min_by(F.trim("text"), F.struct("block_ord", "text")).alias("title"))


def outline_key(tree: DataFrame) -> DataFrame:
    """`tree` with `path_id`, a short hash of document and path."""
    return tree.withColumn("path_id", short_hash(F.concat_ws("|", "doc_id", F.array_join("path", "/"))))
