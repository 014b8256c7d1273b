"""The JSON cache of converted documents: JSON objects of up to `PART` pages, read back without converting again.

Shape: {"doc_id", "first_page", "num_pages", "pages_html": [...], "schema_version": 1}; pages are stored in order, the
first of the document is page 1. A document of any length is as many records, so none is larger than its pages. A
record without a first_page is a whole document. A corrupt record is not an error of the job: it comes back with its
text and a reason, to be converted again (`reused`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, first_page int, num_pages int, pages_html array<string>, schema_version int"
#: Pages in a record.
PART = 50


def to_cache(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, json) of each part of a document; pages missing from 1 to page_count are '', keys are in alphabetical order.

    A document without pages has one record that says so. What comes together in one row is a part's pages.
    """
    asked = documents.select("doc_id", F.coalesce("page_count", F.lit(0)).alias("num_pages")).groupBy("doc_id").agg(F.max("num_pages").alias("num_pages"))
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("last"))
    asked = asked.join(last, "doc_id", "left").select("doc_id", F.greatest("num_pages", F.coalesce("last", F.lit(0))).alias("num_pages"))
    parts = asked.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"greatest(num_pages - 1, 0) div {PART}").cast("int"))).alias("part"))
    own = pages.where("page_no >= 1").select("doc_id", F.expr(f"(page_no - 1) div {PART}").cast("int").alias("part"), "page_no", F.coalesce("html", F.lit("")).alias("html"))
    own = own.groupBy("doc_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("page_no", "html"))).alias("by"))
    both = parts.join(own, ["doc_id", "part"], "left").withColumn("first_page", F.col("part") * PART + 1)
    numbers = F.sequence(F.col("first_page"), F.greatest(F.col("first_page"), F.least(F.col("num_pages"), F.col("first_page") + PART - 1)))
    html = F.when(F.col("num_pages") > 0, F.transform(numbers, lambda n: F.coalesce(F.try_element_at("by", n), F.lit("")))).otherwise(F.array().cast("array<string>"))
    return both.select("doc_id", F.to_json(F.struct("doc_id", "first_page", "num_pages", html.alias("pages_html"), F.lit(1).alias("schema_version"))).alias("json"))


def write_cache(documents: DataFrame, pages: DataFrame, path: str) -> None:
    """The cache as text files of one JSON object a line; Spark's commit makes the write atomic."""
    to_cache(documents, pages).select("json").write.mode("overwrite").text(path)


def parse_cache(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, bad): (doc_id, first_page, num_pages, pages_html) of valid records, and (json, reason) of the others.

    A record is valid if it is JSON with a doc_id and either a page count or pages, at least one page.
    """
    parsed = lines.select(F.col(column).alias("json"), F.from_json(column, SCHEMA + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    count = F.greatest(F.coalesce("r.num_pages", F.lit(0)), F.coalesce(F.size("r.pages_html"), F.lit(0)))
    reason = F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "not JSON").when(F.col("r.doc_id").isNull(), "no doc_id").when(count < 1, "no pages")
    checked = parsed.withColumn("reason", reason).withColumn("num_pages", count)
    good = checked.where("reason is null").select("r.doc_id", "r.first_page", "num_pages", F.coalesce("r.pages_html", F.array().cast("array<string>")).alias("pages_html"))
    return good, checked.where("reason is not null").select("json", "reason")


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_cache(spark.read.text(path))


def cached_pages(records: DataFrame) -> DataFrame:
    """(doc_id, page_no, html) of `parse_cache`'s records, pages from 1; pages without HTML are ''."""
    count = F.when(F.col("first_page").isNull(), F.col("num_pages")).otherwise(F.size("pages_html"))
    numbered = records.withColumn("first_page", F.coalesce("first_page", F.lit(1))).select("doc_id", "first_page", "pages_html", F.explode(F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1))))).alias("n"))
    return numbered.select("doc_id", (F.col("first_page") + F.col("n") - 1).alias("page_no"), F.coalesce(F.try_element_at("pages_html", F.col("n")), F.lit("")).alias("html"))


def reused(documents: DataFrame, lines: DataFrame, convert: Callable[[DataFrame], DataFrame], column: str = "value") -> DataFrame:
    """(doc_id, page_no, html, error) of all `documents`: from the cache where it has them whole, else converted.

    `lines` are the cache's records; `convert` makes (doc_id, page_no, html, error) of the documents left, as
    `files.convert_documents` does. A document counts as cached if all its parts are there: a corrupt one is converted again.
    """
    records, _ = parse_cache(lines, column)
    pages = cached_pages(records)
    wanted = records.groupBy("doc_id").agg(F.max("num_pages").alias("n"))
    whole = pages.groupBy("doc_id").agg(F.countDistinct("page_no").alias("have")).join(wanted, "doc_id").where("have >= n").select("doc_id")
    held = pages.join(whole.join(documents.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "left_semi")
    return held.withColumn("error", F.lit(None).cast("string")).unionByName(convert(not_cached(documents, whole)))


def not_cached(documents: DataFrame, cached: DataFrame) -> DataFrame:
    """The documents still to be converted."""
    return documents.join(cached.select("doc_id").distinct(), "doc_id", "left_anti")
