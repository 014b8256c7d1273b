"""Which pages: page specifications, selection, missing pages, and how selections are written."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_page_spec(spec: str) -> list[int]:
    """'1,5-7' as [1, 5, 6, 7]: sorted, each page once; ValueError for anything else than numbers from 1 and ranges."""
    if not isinstance(spec, str) or not spec.strip():
        raise ValueError("an empty page specification")
    pages: set[int] = set()
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m:
            raise ValueError(f"not a page or range: {part!r}")
        first = int(m[1])
        last = int(m[2]) if m[2] else first
        if first < 1 or last < first:
            raise ValueError(f"not a page or range: {part!r}")
        pages.update(range(first, last + 1))
    return sorted(pages)


def page_specs(df: DataFrame, keys: list[str], page: str = "page_no") -> DataFrame:
    """(keys, spec): each group's pages as '1-3,5', runs of consecutive pages joined. null pages don't count."""
    distinct = df.select(*keys, page).where(F.col(page).isNotNull()).distinct()
    runs = distinct.withColumn("run", F.col(page) - F.row_number().over(Window.partitionBy(*keys).orderBy(page)))
    runs = runs.groupBy(*keys, "run").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    runs = runs.withColumn("piece", F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b")))
    return runs.groupBy(*keys).agg(F.expr("listagg(piece, ',') within group (order by a)").alias("spec"))


def select_pages(pages: DataFrame, wanted: list[int] | None) -> DataFrame:
    """All pages for None, else those asked for; the filter reaches the scan."""
    return pages if wanted is None else pages.where(F.col("page_no").isin(sorted(set(wanted))))


def missing_pages(documents: DataFrame, wanted: list[int]) -> DataFrame:
    """(doc_id, page_no) of pages asked for beyond a document's page count."""
    asked = documents.select("doc_id", "page_count", F.explode(F.array(*[F.lit(p) for p in sorted(set(wanted))])).alias("page_no"))
    return asked.where("page_no > page_count").select("doc_id", "page_no")


def first_deliveries(pages: DataFrame) -> DataFrame:
    """One row per (doc_id, page_no): the first loaded; ties go to the smaller row_id, of equal rows one is kept.

    Which row is first is found on narrow columns, combined before they move. The rows themselves move once, to their
    (doc_id, page_no), and lie there for what comes next. Rows without a doc_id or page_no belong to no page and are
    left out.
    """
    first = pages.groupBy("doc_id", "page_no").agg(F.min_by("row_id", F.struct("loaded_at", "row_id")).alias("__first"))
    # not an equality, which would become a third key and ask for another partitioning
    kept = pages.join(first, ["doc_id", "page_no"]).where("row_id >= __first and row_id <= __first")
    return kept.drop("__first").dropDuplicates(["doc_id", "page_no"])
