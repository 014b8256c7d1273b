"""Entries and their pages: deterministic names and ids, cleaned HTML, flags, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.html import clean_fragment, module_image_sources, wrap_scope
from leafmill.functions.ids import entry_id, page_id
from leafmill.operators.extract import anchor_tokens, anchors_to_links

_KEYS = ["doc_id", "chapter_ord"]


def _named(title: Column, fallback: str, number: Column) -> Column:
    bare = F.regexp_replace(title, r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.concat(F.lit(fallback), number.cast("string")))


def name_pages(sections: DataFrame, documents: DataFrame, unique_ids: bool = True) -> DataFrame:
    """Names, ids, levels and sort keys of sections, without their text.

    (doc_id, mod_id, chapter_ord, section_ord, entry_id, entry_name, page_id, name, level, sort, chapter_path). Names
    repeated in a chapter get " (2)" and so on; ids come from these names, so no two pages of a chapter share one.
    With `unique_ids` off they come from the bare names and can collide.
    """
    docs = documents.groupBy("doc_id").agg(F.min(F.struct("mod_id", "title")).alias("d")).select("doc_id", "d.mod_id", F.col("d.title").alias("book"))
    raw = sections.withColumn("raw", _named(F.col("title"), "Untitled Section ", F.col("section_ord")))
    n = F.row_number().over(Window.partitionBy(*_KEYS, "raw").orderBy("section_ord"))
    named = raw.withColumn("name", F.when(n == 1, F.col("raw")).otherwise(F.concat("raw", F.lit(" ("), n.cast("string"), F.lit(")"))))
    named = named.join(docs, "doc_id").withColumn("entry_name", _named(F.col("chapter_title"), "Untitled Chapter ", F.col("chapter_ord")))
    return named.select(
        "doc_id", "mod_id", "book", "chapter_ord", "section_ord", entry_id(F.col("mod_id"), F.col("chapter_path")).alias("entry_id"), "entry_name",
        page_id(F.col("mod_id"), F.col("chapter_path"), F.col("name" if unique_ids else "raw")).alias("page_id"), "name",
        F.greatest(F.lit(1), F.least(F.lit(3), F.col("level") - 1)).alias("level"), (F.col("section_ord") * 1000).alias("sort"), "chapter_path",
        *[c for c in ("html",) if c in sections.columns],
    )


def page_html(html: Column, module: Column, scope: str = "leafmill", repair: bool = True) -> Column:
    """A section's HTML as an entry's page holds it."""
    return module_image_sources(wrap_scope(clean_fragment(html, repair), scope), module)


def entry_pages(sections: DataFrame, documents: DataFrame, scope: str = "leafmill", repair: bool = True, unique_ids: bool = True) -> DataFrame:
    """`name_pages` with `content`: cleaned, scoped, with image sources and anchors rewritten within the entry."""
    named = name_pages(sections, documents, unique_ids)
    anchors = anchor_tokens(named, _KEYS, "name", "page_id", "section_ord")
    cleaned = named.withColumn("content", page_html(F.col("html"), F.col("mod_id"), scope, repair)).drop("html")
    return cleaned.join(anchors, _KEYS, "left").withColumn("content", anchors_to_links(F.col("content"), F.col("entry_id"), F.col("anchors"))).drop("anchors")


def folder_flags(path: list[Column], color: Column | None = None) -> Column:
    """The folder flag of an entry as a struct."""
    fields = [F.array(*path).alias("folderPath")] + ([color.alias("color")] if color is not None else [])
    return F.struct(*fields)


def nest_entries(pages: DataFrame) -> DataFrame:
    """(doc_id, chapter_ord, entry_id, name, pages, flags): one row per entry, its pages in order, for the sink only.

    Pages come together per entry; an entry is a chapter, so its size is that of its text.
    """
    canonical = F.concat("chapter_path", F.array("name"))
    page = F.struct(
        F.col("sort"), F.col("page_id").alias("_id"), F.col("name"), F.struct(F.lit(True).alias("show"), F.col("level")).alias("title"),
        F.struct(F.lit(1).alias("format"), F.col("content")).alias("text"), F.lit("text").alias("type"),
        F.struct(canonical.alias("canonicalPath"), F.array_join(canonical, "/").alias("canonicalPathStr"), (F.col("section_ord") - 1).alias("sectionOrder")).alias("flags"),
        F.concat(F.lit("!journal.pages!"), "entry_id", F.lit("."), "page_id").alias("_key"),
    )
    grouped = pages.groupBy("doc_id", "mod_id", "book", "chapter_ord", "entry_id", "entry_name", "chapter_path").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    flags = F.struct(
        folder_flags([F.col("book"), F.col("entry_name")]).alias("folders"),
        F.struct(F.col("chapter_path").alias("canonicalPath"), F.array_join("chapter_path", "/").alias("canonicalPathStr"), F.element_at("chapter_path", -1).alias("nameSlug")).alias("module"),
    )
    return grouped.select("doc_id", "mod_id", "chapter_ord", F.col("entry_id"), F.col("entry_name").alias("name"), "pages", flags.alias("flags"), F.concat(F.lit("!journal!"), "entry_id").alias("_key"))


def invalid_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, issue) of pages that break the rules of an entry: level 1 to 3, a name, 16-digit ids, content."""
    checks = [
        (F.col("level").between(1, 3), "level is not 1 to 3"), (F.col("name").rlike(r"(?U)\S"), "the name is blank"),
        (F.col("page_id").rlike("^[a-f0-9]{16}$"), "the id is not 16 hexadecimal digits"), (F.col("content").isNotNull(), "there is no content"),
    ]
    issues = F.filter(F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(said)) for good, said in checks]), lambda x: x.isNotNull())
    return pages.select("doc_id", "page_id", F.explode(issues).alias("issue"))
