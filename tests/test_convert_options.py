import pytest
from pyspark.sql import functions as F

from leafmill.operators.extract import PLACEHOLDER
from leafmill.options import FeatureMissing, Options
from leafmill.plans.convert import convert
from leafmill.plans.extract import block_pages, extract_pages

PAGE = (
    '<p><a href="#x">x</a><img src="data:image/jpeg;base64,aGk="><img src="/data/a.png"><img src="gone.png"></p>'
    '<table><tr><td><a href="http://q">1</a></td></tr></table>-<table><tr><td>2</td></tr></table>'
)


def frames(spark):
    pages = spark.createDataFrame([("d", 1, PAGE, 7), ("d", 2, None, 7)], "doc_id string, page_no int, html string, row_id int")
    keys = "doc_id string, page_no int, table_id string, table_ord int, confidence double, row_idx int, col_idx int, rowspan int, colspan int, text string, is_header boolean, tbl_x0 double, tbl_y0 double, tbl_x1 double, tbl_y1 double, loaded_at string, row_id bigint"
    cells = spark.createDataFrame([("d", 1, f"t{n}", n, c, 0, 0, 1, 1, f"T{n}", None, 1.0, 1.0, 2.0, 2.0, "2024", n) for n, c in ((1, 0.9), (2, 0.2))], keys)
    files = spark.createDataFrame([("file:/data/a.png", bytearray(b"png"))], "path string, content binary")
    return pages, cells, files


@pytest.mark.parametrize("asked", [{"ocr": "on"}, {"captions": True}, {"tables": "structured"}])
def test_options_that_lack_their_engine_are_refused(spark, asked):
    with pytest.raises(FeatureMissing):
        extract_pages(frames(spark)[0], Options(**asked))


def one(df, page=1):
    return df.where(F.col("page_no") == page).first().html


@pytest.mark.parametrize("mode, kinds, tables", [
    ("auto", ["structured", "html"], "<table><tbody><tr><td>T1</td></tr></tbody></table>-<table><tr><td>2</td></tr></table>"),
    ("structured", ["structured", "structured"], "<table><tbody><tr><td>T1</td></tr></tbody></table>-<table><tbody><tr><td>T2</td></tr></tbody></table>"),
    ("image-only", ["image", "image"], '<img src="assets/page-0001_table_0001.png">-<img src="assets/page-0001_table_0002.png">'),
])
def test_table_modes(spark, mode, kinds, tables):
    pages, cells, files = frames(spark)
    got = extract_pages(pages, Options(tables=mode), cells, files)
    head = '<p><a href="#x">x</a><img src="assets/page-0001_img_0001.jpg"><img src="assets/page-0001_a.png"><img src="gone.png"></p>'
    assert one(got.pages) == head + tables and one(got.pages, 2) == "" and [r.row_id for r in got.pages.collect()] == [7, 7]
    assert [r.kind for r in got.tables.orderBy("table_ord").collect()] == kinds
    images = {(r.origin, r.name): bytes(r.content) for r in got.images.collect()}
    want = {("embedded", "page-0001_img_0001.jpg"): b"hi", ("referenced", "page-0001_a.png"): b"png"}
    if mode == "image-only":
        want |= {("table", f"page-0001_table_000{n}.png"): PLACEHOLDER for n in (1, 2)}
    assert images == want
    assert [r.target for r in got.links.orderBy("link_ord").collect()] == ["#x"]
    # without cells, tables stay as they are
    assert one(extract_pages(pages, Options()).pages).endswith(PAGE[PAGE.index("<table>") :])


def test_engines_and_captions(spark):
    pages, cells, files = frames(spark)
    shots = spark.createDataFrame([("d", 2, bytearray(b"shot"))], "doc_id string, page_no int, content binary")
    got = extract_pages(pages, Options(captions=True), cells, files, shots, lambda: lambda image: [("read it", 0.5, None)], lambda: lambda image: "a photo of " + image.decode())
    assert one(got.pages, 2) == '\n<div class="ocr-content" data-source="ocr">\n<p data-ocr="true" data-ocr-confidence="0.500">read it</p>\n</div>'
    assert '<img src="assets/page-0001_img_0001.jpg" alt="Hi"><img src="assets/page-0001_a.png" alt="Png"><img src="gone.png">' in one(got.pages)
    assert {r.name: r.caption for r in got.images.collect()} == {"page-0001_img_0001.jpg": "Hi", "page-0001_a.png": "Png"}


def test_pages_known_by_their_blocks(spark):
    places = [(50.0, 1), (400.0, 1), (50.0, 2), (400.0, 2), (50.0, 3), (400.0, 3)]
    blocks = spark.createDataFrame([("d", 2, i, "text", x, float(y), x + 9, y + 1.0, f"b<{i}") for i, (x, y) in enumerate(places)], "doc_id string, page_no int, block_ord int, type string, x0 double, y0 double, x1 double, y1 double, text string")
    got = block_pages(frames(spark)[0], blocks)
    assert one(got) == PAGE and one(got, 2) == "\n".join(f"<p>b&lt;{i}</p>" for i in (0, 2, 4, 1, 3, 5))


def test_the_conversion_extracts(spark):
    pages, cells, files = frames(spark)
    docs = spark.createDataFrame([("d", "m", "Book", 2)], "doc_id string, mod_id string, title string, page_count int")
    outline = spark.createDataFrame([], "doc_id string, node_id int, parent_id int, sibling_ord int, title string, page int")
    got = convert(docs, pages.withColumn("loaded_at", F.lit("2024")), outline, Options(tables="structured"), cells=cells)
    content = {r.name: r.content for r in got.pages.collect()}
    assert "<td>T2</td>" in content["Page 1"] and "modules/m/assets/page-0001_img_0001.jpg" in content["Page 1"] and got.extracted.tables.count() == 2
