import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafmill.__main__ import main
from leafmill.operators import diagnostics as d
from leafmill.operators import extract as x


def test_diagnostics(spark):
    docs = spark.createDataFrame([("a", 1), ("b", None)], "doc_id string, page_count int")
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 1, ""), ("a", 2, None)], "doc_id string, page_no int, html string")
    outline = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, None), ("a", 4, 9)], "doc_id string, node_id int, page int")
    cells = spark.createDataFrame([("a", 1, "t", 1.0, 1.0, 1.0, None)] * 2, "doc_id string, page_no int, table_id string, tbl_x0 double, tbl_y0 double, tbl_x1 double, tbl_y1 double")
    got = sorted((r.doc_id, r.page_no or 0, r.code, r.message) for r in d.diagnostics(docs, pages, outline, cells).collect())
    assert got == [
        ("a", 0, "outline-page-invalid", "node 1"), ("a", 0, "outline-page-invalid", "node 3"), ("a", 0, "outline-page-invalid", "node 4"),
        ("a", 1, "page-delivered-again", "2 deliveries"), ("a", 1, "page-empty", "no html"), ("a", 1, "table-without-box", "t"),
        ("a", 2, "page-beyond-end", "behind the last page"), ("a", 2, "page-empty", "no html"),
        ("b", 0, "outline-missing", "no outline"), ("b", 0, "page-count-missing", "no page count"),
    ]
    assert d.diagnostics(*(f.limit(0) for f in (docs, pages, outline, cells))).collect() == []


def test_images(spark):
    pages = spark.createDataFrame([(1, '<img src="assets/a/b.png" alt="x"><img alt="" src="c.jpg"><img>'), (2, None)], "row_id int, html string")
    tags = x.image_tags(pages, ["row_id"])
    assert [tuple(r)[1:] for r in tags.orderBy("img_ord").collect()] == [(1, "assets/a/b.png", "b.png", "x"), (2, "c.jpg", "c.jpg", "")]
    embedded = tags.select("row_id", F.lit(1).alias("img_ord"), F.lit("e").alias("name")).limit(1)
    assert [r.name for r in x.all_images(embedded, tags, ["row_id"]).orderBy("img_ord").collect()] == ["e", "b.png", "c.jpg"]


def test_tables_in_pages(spark):
    pages = spark.createDataFrame([(1, "<table>a</table>-<table>b</table>"), (2, "<table>c</table>"), (3, None)], "row_id int, html string")
    rendered = spark.createDataFrame([(1, 2, "B"), (1, 5, "E")], "row_id int, table_ord int, html string")
    got = {r.row_id: r.html for r in x.pages_with_tables(pages, rendered, ["row_id"]).collect()}
    assert got == {1: "<table>a</table>-B", 2: "<table>c</table>", 3: None}


def test_queries_and_sql_fit():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert "p1_found" in queries and set(sql) <= set(queries)


def test_command_line(spark, tmp_path):
    spark.createDataFrame([("d", "m", "Book", 1, "A", "x", "pk")], "doc_id string, mod_id string, title string, page_count int, author string, license string, pack_name string").write.parquet(str(tmp_path / "in/parsed_documents.parquet"))
    spark.createDataFrame([(1, "d", 1, "<p>é</p>", "2024")], "row_id bigint, doc_id string, page_no int, html string, loaded_at string").write.parquet(str(tmp_path / "in/pages.parquet"))
    spark.createDataFrame([("d", 1, None, 1, "C", 1)], "doc_id string, node_id int, parent_id int, sibling_ord int, title string, page int").write.parquet(str(tmp_path / "in/outline.parquet"))
    assert main(["convert", str(tmp_path / "in"), str(tmp_path / "out"), "--pages", "1", "--export"]) == 0
    written = [json.loads(json.loads(r.value)["entry"]) for r in spark.read.text(str(tmp_path / "out/entries")).collect()]
    assert sorted(e["name"] for e in written) == ["C", "Table of Contents"]
    assert (tmp_path / "out/files/d/002-c.json").exists() and (tmp_path / "out/files/d/module.json").exists()
    assert main(["doctor"]) == 0
