"""The conversion of a corpus as one plan: pages and outlines to sections, entries and tables of contents.

Pages are extracted first (`plans.extract`): images, tables, recognition and captions as the options ask and as there
are cells, image files, pictures of pages and engines. Pages known by their blocks only get the blocks' text in reading
order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from leafmill.operators.engines import Captioner, Recognizer
from leafmill.operators.entries import entry_pages, name_pages, nest_entries
from leafmill.operators.outline import fallback_outline, outline_tree, title_blocks
from leafmill.operators.pages import first_deliveries, select_pages
from leafmill.operators.sections import merge_pages, spans
from leafmill.operators.toc import toc_entries
from leafmill.options import Options
from leafmill.plans.extract import Extracted, block_pages, extract_pages


@dataclass(frozen=True)
class Converted:
    """Lazy results: sections with their text, entry pages (the table of contents is chapter 0), nested
    entries, and what the pages held (images, tables, links)."""

    sections: DataFrame
    pages: DataFrame
    entries: DataFrame
    extracted: Extracted


def convert(
    documents: DataFrame, pages: DataFrame, outline: DataFrame, options: Options = Options(), blocks: DataFrame | None = None, cells: DataFrame | None = None,  # noqa: B008 - frozen
    files: DataFrame | None = None, page_images: DataFrame | None = None, recognizer: Callable[[], Recognizer] | None = None, captioner: Callable[[], Captioner] | None = None,
) -> Converted:
    """Documents without an outline become one chapter, titled by their blocks if there are any, with a section per page."""
    nodes = outline.select("doc_id", "node_id", "parent_id", "sibling_ord", "title", "page")
    nodes = nodes.unionByName(fallback_outline(documents, outline, title_blocks(blocks) if blocks is not None else None))
    chosen = select_pages(first_deliveries(pages), list(options.pages) if options.pages is not None else None)
    if blocks is not None:
        chosen = block_pages(chosen, blocks)
    extracted = extract_pages(chosen, options, cells, files, page_images, recognizer, captioner)
    bare = spans(outline_tree(nodes, documents), first_pages=not options.compat)
    sections = merge_pages(bare, extracted.pages)
    own = entry_pages(sections, documents, options.scope, options.repair)
    # contents need names only, so they are made from the spans, without the text
    all_pages = own.unionByName(toc_entries(name_pages(bare, documents), scope=options.scope))
    return Converted(sections, all_pages, nest_entries(all_pages), extracted)


def convert_tables(spark: SparkSession, folder: str, options: Options = Options()) -> Converted:  # noqa: B008 - frozen
    """`convert` of the tables parsed_documents, pages, outline and, if it is there, table_cells in a folder."""
    documents, pages, outline = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("parsed_documents", "pages", "outline"))
    try:
        cells = spark.read.parquet(f"{folder}/table_cells.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cells = None
    return convert(documents, pages, outline, options, cells=cells)
