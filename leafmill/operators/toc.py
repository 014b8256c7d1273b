"""Tables of contents: rendering from entry pages, and links that lead nowhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.ids import entry_id, page_id, uuid_link
from leafmill.operators.extract import uuid_targets


def render_toc(pages: DataFrame, title: str = "Table of Contents", scope: str = "leafmill", link: Callable[[Column, Column, Column], Column] = uuid_link) -> DataFrame:
    """(doc_id, html) from (doc_id, chapter_ord, entry_id, entry_name, page_id, name, sort, section_ord).

    Two ordered aggregations: pages by sort (ties by section_ord) to a list per chapter, chapters to a page.
    """
    item = F.concat(F.lit("<li>"), link(F.col("entry_id"), F.col("page_id"), F.col("name")), F.lit("</li>"))
    chapters = pages.withColumn("item", item).groupBy("doc_id", "chapter_ord", "entry_name").agg(F.expr("listagg(item, '') within group (order by sort, section_ord)").alias("items"))
    chapters = chapters.withColumn(
        "part",
        F.concat(
            F.lit('<section class="toc-chapter"><h2>'), "entry_name", F.lit("</h2>"),
            F.when(F.coalesce("items", F.lit("")) != "", F.concat(F.lit("<ul>"), "items", F.lit("</ul>"))).otherwise(""), F.lit("</section>"),
        ),
    )
    docs = chapters.groupBy("doc_id").agg(F.expr("listagg(part, '') within group (order by chapter_ord)").alias("parts"))
    return docs.select("doc_id", F.concat(F.lit(f'<div class="{scope} toc"><h1>{title}</h1>'), "parts", F.lit("</div>")).alias("html"))


def toc_entries(pages: DataFrame, title: str = "Table of Contents", scope: str = "leafmill") -> DataFrame:
    """The table of contents of each document as an entry page, chapter 0, to be united with `pages`."""
    path = F.array(F.lit("toc"))
    modules = pages.select("doc_id", "mod_id", "book").distinct()
    return render_toc(pages, title, scope).join(modules, "doc_id").select(
        "doc_id", "mod_id", "book", F.lit(0).alias("chapter_ord"), F.lit(1).alias("section_ord"), entry_id(F.col("mod_id"), path).alias("entry_id"),
        F.lit(title).alias("entry_name"), page_id(F.col("mod_id"), path, F.lit(title)).alias("page_id"), F.lit(title).alias("name"),
        F.lit(1).alias("level"), F.lit(1000).alias("sort"), path.alias("chapter_path"), F.col("html").alias("content"),
    )


def broken_links(toc: DataFrame, pages: DataFrame, html: str = "html") -> DataFrame:
    """(doc_id, link_ord, issue) of links to entries or pages that do not exist in the document; two anti joins."""
    targets = uuid_targets(toc, ["doc_id"], html)
    lost = targets.join(pages.select("doc_id", "entry_id", "page_id").distinct(), ["doc_id", "entry_id", "page_id"], "left_anti")
    entries = pages.select("doc_id", "entry_id", F.lit(True).alias("known")).distinct()
    said = F.when(F.col("known").isNull(), F.concat(F.lit("'"), "label", F.lit("' targets missing entry "), "entry_id")).otherwise(
        F.concat(F.lit("'"), "label", F.lit("' targets missing page "), "page_id", F.lit(" in entry "), "entry_id")
    )
    return lost.join(entries, ["doc_id", "entry_id"], "left").select("doc_id", "link_ord", said.alias("issue"))
