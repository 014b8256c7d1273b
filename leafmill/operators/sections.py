"""Sections: the pages of each outline span, merged in order; chapters without sections get one per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.outline import unique_slugs


def spans(tree: DataFrame, first_pages: bool = False) -> DataFrame:
    """(doc_id, chapter_ord, section_ord, level, title, page_start, page_end, id_path, chapter_title, chapter_path).

    Chapters are the roots; their sections are all nodes below, in reading order. A chapter without any has a section
    "Page N" for each page of its span. `first_pages` adds the pages of a chapter before its first section as a
    section of that chapter's title, level 2; else they belong to none.
    """
    named = unique_slugs(tree)
    in_doc = Window.partitionBy("doc_id").orderBy("dfs_ord")
    roots = named.where("level = 1").select(
        "doc_id", "root_id", F.row_number().over(in_doc).alias("chapter_ord"), F.col("title").alias("chapter_title"),
        F.array("unique").alias("chapter_path"), F.col("page_start").alias("from"), F.col("page_end").alias("to"),
    )
    below = named.where("level >= 2").select("doc_id", "root_id", "dfs_ord", "level", "title", "page_start", "page_end", "unique")
    if first_pages:
        starts = below.groupBy("doc_id", "root_id").agg(F.min("page_start").alias("s")).join(roots, ["doc_id", "root_id"]).where("s > `from`")
        lead = starts.select("doc_id", "root_id", F.lit(0).alias("dfs_ord"), F.lit(2).alias("level"), F.col("chapter_title").alias("title"), F.col("from").alias("page_start"), (F.col("s") - 1).alias("page_end"), F.lit("start").alias("unique"))
        below = below.unionByName(lead)
    empty = roots.join(below.select("doc_id", "root_id").distinct(), ["doc_id", "root_id"], "left_anti").where("`to` >= `from`")
    synthetic = empty.select("doc_id", "root_id", F.explode(F.sequence("from", "to")).alias("n")).select(
        "doc_id", "root_id", F.col("n").alias("dfs_ord"), F.lit(2).alias("level"), F.concat(F.lit("Page "), F.col("n").cast("string")).alias("title"),
        F.col("n").alias("page_start"), F.col("n").alias("page_end"), F.format_string("page-%03d", "n").alias("unique"),
    )
    in_chapter = Window.partitionBy("doc_id", "root_id").orderBy("dfs_ord")
    both = below.unionByName(synthetic).withColumn("section_ord", F.row_number().over(in_chapter)).join(roots, ["doc_id", "root_id"])
    return both.select(
        "doc_id", "chapter_ord", "section_ord", "level", "title", "page_start", "page_end",
        F.concat("chapter_path", F.array("unique")).alias("id_path"), "chapter_title", "chapter_path",
    )


def joined_pages(html: str, order: str) -> Column:
    """An aggregate: pages in order, a blank line between them."""
    return F.expr(f"listagg({html}, '\n\n') within group (order by {order})")


def merge_pages(spans_: DataFrame, pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "chapter_ord", "section_ord")) -> DataFrame:
    """`spans_` with `html`: the pages from page_start to page_end, '' if there are none; null html counts as ''.

    The range becomes an equi-join on (doc_id, page_no): spans are exploded to page numbers first, which is narrow.
    A span that ends before it begins has no pages; a null page_end goes to the document's last page.
    """
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("__last"))
    ranged = spans_.join(last, "doc_id", "left").withColumn("__to", F.least(F.coalesce("page_end", "__last"), "__last"))
    numbers = ranged.where("__to >= page_start").select(*keys, F.explode(F.sequence("page_start", "__to")).alias("page_no"))
    merged = numbers.join(pages.select("doc_id", "page_no", F.coalesce("html", F.lit("")).alias("__html")), ["doc_id", "page_no"])
    merged = merged.groupBy(*keys).agg(joined_pages("__html", "page_no").alias("html"))
    return spans_.join(merged, list(keys), "left").withColumn("html", F.coalesce("html", F.lit("")))
