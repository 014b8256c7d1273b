"""The extraction of pages as one plan: images, tables, links, recognised text and captions, as the options ask.

The stages and their order: embedded images come out and leave their asset names; sources of image files that exist are
renamed; tables become images, structured tables or stay; links are listed; pages with too little text are recognised;
images are described and their captions put in. A stage that is not asked for, or has nothing to work on, is not in the
plan. Pages stay rows throughout: only narrow findings (rendered tables, recognised blocks, captions) are joined to them.

Defined results: null html counts as empty; a page without images, tables or links has none; an option that needs an
engine raises FeatureMissing without one, but for ocr "auto", which then recognises nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.html import escape
from leafmill.operators import engines, extract, layout, tables
from leafmill.options import FeatureMissing, Options

PAGE = ["doc_id", "page_no"]


@dataclass(frozen=True)
class Extracted:
    """Lazy results: pages (doc_id, page_no, html and what else came along), images (doc_id, page_no, img_ord, name, origin,
    content, path, caption), tables (doc_id, page_no, table_ord, kind, name, html), links (doc_id, page_no, link_ord, kind, target)."""

    pages: DataFrame
    images: DataFrame
    tables: DataFrame
    links: DataFrame


def _structured(cells: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_ord, confidence, html) of the tables that cells make up, rendered."""
    placed = cells.where("table_id is not null").groupBy(*PAGE, "table_id").agg(F.min("table_ord").alias("table_ord"), F.max("confidence").alias("confidence"))
    return tables.render_tables(tables.table_grid(cells)).join(placed, [*PAGE, "table_id"])


def _tables(pages: DataFrame, cells: DataFrame | None, options: Options) -> tuple[DataFrame, DataFrame]:
    """The pages with their tables as the mode asks, and what became of each table."""
    found = extract.html_tables(pages, PAGE)
    if options.tables == "image-only":
        images = extract.decide_tables(found, found, PAGE, "image-only").withColumn("html", F.lit(None).cast("string"))
        return pages.withColumn("html", extract.tables_to_images(F.col("html"), F.col("page_no"))), images
    if cells is None:
        return pages, found.select(*PAGE, "table_ord", F.lit("html").alias("kind"), F.lit(None).cast("string").alias("name"), "html")
    rendered = _structured(cells)
    decided = extract.decide_tables(found, rendered, PAGE, options.tables, options.table_confidence)
    chosen = decided.where("kind = 'structured'").join(rendered.select(*PAGE, "table_ord", "html"), [*PAGE, "table_ord"])
    own = decided.where("kind = 'html'").join(found, [*PAGE, "table_ord"])
    columns = [*PAGE, "table_ord", "kind", "name", "html"]
    return extract.pages_with_tables(pages, chosen, PAGE), chosen.select(*columns).unionByName(own.select(*columns))


def extract_pages(
    pages: DataFrame, options: Options = Options(), cells: DataFrame | None = None, files: DataFrame | None = None, page_images: DataFrame | None = None,  # noqa: B008 - frozen
    recognizer: Callable[[], engines.Recognizer] | None = None, captioner: Callable[[], engines.Captioner] | None = None,
) -> Extracted:
    """`pages` (doc_id, page_no, html, ...), one row per page; `cells` are positioned table cells, `files` image files
    (path, and content if they are to be described), `page_images` the pages as pictures (doc_id, page_no, content)."""
    if options.ocr == "on" and (recognizer is None or page_images is None):
        raise FeatureMissing("recognition is on, but there is no engine, or there are no pictures of pages")
    if options.captions and captioner is None:
        raise FeatureMissing("captions are on, but there is no engine")
    if options.tables == "structured" and cells is None:
        raise FeatureMissing("structured tables are asked for, but there are no cells")
    pages = pages.withColumn("html", F.coalesce("html", F.lit("")))
    content = F.lit(None).cast("binary").alias("content")
    images = extract.embedded_images(pages, PAGE).select(*PAGE, "img_ord", "name", F.lit("embedded").alias("origin"), "content", F.lit(None).cast("string").alias("path"))
    out = pages.withColumn("html", extract.embedded_images_to_assets(F.col("html"), F.col("page_no")))
    if files is not None:
        referred = extract.referenced_images(out, files, PAGE)
        names = referred.groupBy(*PAGE).agg(F.map_from_entries(F.collect_set(F.struct("src", "name"))).alias("__names"))
        out = out.join(names, PAGE, "left").withColumn("html", extract.referenced_to_assets(F.col("html"), F.col("__names"))).drop("__names")
        if "content" in files.columns:
            bytes_of = files.select(F.regexp_replace("path", "(?i)^file:(//)?", "").alias("path"), "content").dropDuplicates(["path"])
            referred = referred.join(bytes_of, "path", "left")
        else:
            referred = referred.withColumn("content", content)
        images = images.unionByName(referred.select(*PAGE, "img_ord", "name", F.lit("referenced").alias("origin"), "content", "path"))
    out, found = _tables(out, cells, options)
    if options.tables == "image-only":  # each has a picture of its own, white until a renderer makes it
        images = images.unionByName(found.select(*PAGE, F.col("table_ord").alias("img_ord"), "name", F.lit("table").alias("origin"), F.lit(extract.PLACEHOLDER).alias("content"), F.lit(None).cast("string").alias("path")))
    links = extract.links(out, PAGE)
    if recognizer is not None and page_images is not None and options.ocr != "off":
        out = engines.ocr_pages(out, page_images, options.ocr, recognizer, options.ocr_threshold)
    caption = F.lit(None).cast("string")
    if options.captions and captioner is not None:
        described = engines.once_per_content(images.where("content is not null and origin <> 'table'"), lambda d: engines.describe(d, captioner))
        images = images.join(described.select(*PAGE, "origin", "img_ord", "caption"), [*PAGE, "origin", "img_ord"], "left")
        known = extract.caption_map(images, PAGE)
        out = out.join(known, PAGE, "left").withColumn("html", F.when(F.col("captions").isNull(), F.col("html")).otherwise(extract.captions_to_alt(F.col("html"), F.col("captions")))).drop("captions")
    else:
        images = images.withColumn("caption", caption)
    return Extracted(out, images.select(*PAGE, "img_ord", "name", "origin", "content", "path", "caption"), found, links)


def reading_orders(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, columns, text): the text of each page's blocks in their reading order, a line each. Pages keep
    their own html; this is what a page without any, known by its blocks only, has in its place (`block_pages`)."""
    order = layout.reading_order(blocks)
    texts = blocks.select(*PAGE, "block_ord", "text").where("text is not null")
    return order.join(texts, [*PAGE, "block_ord"]).groupBy(*PAGE).agg((F.max("column_no") + 1).alias("columns"), F.expr("listagg(text, '\n') within group (order by read_ord)").alias("text"))


def block_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """`pages` with the text of their blocks, in reading order, as paragraphs where a page has no html."""
    read = reading_orders(blocks).select(*PAGE, F.concat(F.lit("<p>"), F.replace(escape(F.col("text")), F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>")).alias("__read"))
    bare = F.coalesce("html", F.lit("")) == ""
    return pages.join(read, PAGE, "left").withColumn("html", F.when(bare, F.coalesce("__read", "html")).otherwise(F.col("html"))).drop("__read")
