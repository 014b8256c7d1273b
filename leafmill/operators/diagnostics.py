"""What is wrong with a delivery, as rows: nothing is dropped silently, and nothing stops a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.outline import outline_tree, unreachable


def _issue(df: DataFrame, code: str, severity: str, message: str | Column, page: str | None = None) -> DataFrame:
    said = F.lit(message) if isinstance(message, str) else message
    number = F.col(page).cast("int") if page else F.lit(None).cast("int")
    return df.select("doc_id", number.alias("page_no"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), said.alias("message"))


def diagnostics(documents: DataFrame, pages: DataFrame, outline: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, page_no, code, severity, message), one row per finding; page_no is null for whole documents.

    Each kind is a filter or an aggregation combined before its shuffle; only nodes that no root leads to need the tree,
    and are looked for where the outline says what is above a node.
    """
    docs = documents.select("doc_id", "page_count").dropDuplicates(["doc_id"])
    node = outline.join(docs, "doc_id")
    again = pages.groupBy("doc_id", "page_no").agg(F.count("*").alias("n")).where("n > 1")
    tables = cells.where("tbl_x0 is null or tbl_y0 is null or tbl_x1 is null or tbl_y1 is null").select("doc_id", "page_no", "table_id").distinct()
    found = [
        _issue(docs.join(outline.select("doc_id").distinct(), "doc_id", "left_anti"), "outline-missing", "warning", "no outline"),
        _issue(docs.where("page_count is null"), "page-count-missing", "warning", "no page count"),
        _issue(pages.where("html is null or html = ''"), "page-empty", "warning", "no html", "page_no"),
        _issue(pages.join(docs, "doc_id").where("page_no > page_count"), "page-beyond-end", "error", "behind the last page", "page_no"),
        _issue(node.where("page is null or page < 1 or page > page_count"), "outline-page-invalid", "warning", F.concat(F.lit("node "), F.col("node_id").cast("string"))),
        _issue(again, "page-delivered-again", "info", F.concat(F.col("n").cast("string"), F.lit(" deliveries")), "page_no"),
        _issue(tables, "table-without-box", "warning", F.col("table_id"), "page_no"),
    ]
    if "parent_id" in outline.columns:
        lost = unreachable(outline, outline_tree(outline, documents))
        found.append(_issue(lost, "outline-node-unreachable", "error", F.concat(F.lit("node "), F.col("node_id").cast("string"))))
    return reduce(DataFrame.unionAll, found)
