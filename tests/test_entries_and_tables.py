import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import engines, entries, layout, manifest, tables, toc
from leafmill.options import FeatureMissing, Options
from leafmill.plans.convert import convert
from leafmill.sources import files, json_cache, sinks

SECTIONS = "doc_id string, chapter_ord int, section_ord int, level int, title string, chapter_title string, chapter_path array<string>, html string"


def sections(spark, rows):
    docs = spark.createDataFrame([("d", "mod", "Book")], "doc_id string, mod_id string, title string")
    return spark.createDataFrame(rows, SECTIONS), docs


def test_names_levels_ids(spark):
    rows = [("d", 1, i, lv, t, " ", ["c"], "<p>x</p>") for i, (lv, t) in enumerate([(2, "Intro"), (3, " Intro "), (5, "  "), (2, None)], 1)]
    got = entries.name_pages(*sections(spark, rows)).orderBy("section_ord").collect()
    assert [(r.name, r.level, r.sort) for r in got] == [("Intro", 1, 1000), ("Intro (2)", 2, 2000), ("Untitled Section 3", 3, 3000), ("Untitled Section 4", 1, 4000)]
    assert {r.entry_name for r in got} == {"Untitled Chapter 1"} and len({r.page_id for r in got}) == 4
    compat = entries.name_pages(*sections(spark, rows), unique_ids=False).collect()
    assert len({r.page_id for r in compat}) == 3


def test_entry_pages_and_toc(spark):
    rows = [("d", 1, 1, 2, "One", "Ch", ["ch"], '<img src="assets/a.png"> <a href="#two">t</a> <a href="#gone">g</a>'), ("d", 1, 2, 2, "Two", "Ch", ["ch"], None)]
    s, docs = sections(spark, rows)
    pages = entries.entry_pages(s, docs)
    by = {r.name: r for r in pages.collect()}
    link = f"@UUID[JournalEntry.{by['Two'].entry_id}.JournalEntryPage.{by['Two'].page_id}]{{t}}"
    assert by["One"].content == f"<div class='leafmill'><img src=\"modules/mod/assets/a.png\"> {link} g</div>"
    assert by["Two"].content == "<div class='leafmill'></div>"
    rendered = toc.render_toc(pages)
    html = rendered.first().html
    assert html.startswith('<div class="leafmill toc"><h1>Table of Contents</h1><section class="toc-chapter"><h2>Ch</h2><ul><li>@UUID[') and html.count("<li>") == 2
    assert toc.broken_links(rendered, pages).collect() == []
    lost = toc.broken_links(rendered, pages.where("name = 'One'")).collect()
    assert [r.issue for r in lost] == [f"'Two' targets missing page {by['Two'].page_id} in entry {by['Two'].entry_id}"]
    assert "missing entry" in toc.broken_links(rendered, pages.limit(0)).first().issue
    nested = entries.nest_entries(pages).first()
    assert [p._id for p in nested.pages] == [by["One"].page_id, by["Two"].page_id] and nested.flags.module.nameSlug == "ch"
    written = json.loads(sinks.entry_json(entries.nest_entries(pages)).first().json)
    assert written["folder"] is None and written["ownership"] == {"default": 0} and list(written)[:3] == ["_id", "name", "pages"]
    bad = pages.withColumn("level", F.lit(4)).withColumn("name", F.lit(" "))
    assert entries.invalid_pages(pages).count() == 0 and entries.invalid_pages(bad).count() == 4


def test_convert_whole(spark, tmp_path):
    docs = spark.createDataFrame([("d", "m", "Book", 3, "A", None, "pk"), ("e", "m2", "Bare", 2, "", "x", "pk2")], "doc_id string, mod_id string, title string, page_count int, author string, license string, pack_name string")
    pages = spark.createDataFrame([(i, d, n, f"<p>{d}{n}</p>", "2024-01-01") for i, (d, n) in enumerate([("d", 1), ("d", 2), ("d", 2), ("e", 1), ("e", 2)])], "row_id bigint, doc_id string, page_no int, html string, loaded_at string")
    outline = spark.createDataFrame([("d", 1, None, 1, "C", 1), ("d", 2, 1, 1, "S", 2)], "doc_id string, node_id int, parent_id int, sibling_ord int, title string, page int")
    got = convert(docs, pages, outline)
    assert sorted((r.doc_id, r.chapter_ord, r.name) for r in got.pages.collect()) == [("d", 0, "Table of Contents"), ("d", 1, "S"), ("e", 0, "Table of Contents"), ("e", 1, "Page 1"), ("e", 1, "Page 2")]
    sinks.write_entries(got.entries, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted((x["doc_id"], x["file_name"], json.loads(x["entry"])["name"]) for x in lines) == [
        ("d", "001-table-of-contents.json", "Table of Contents"), ("d", "002-c.json", "C"), ("e", "001-table-of-contents.json", "Table of Contents"), ("e", "002-document.json", "Document"),
    ]
    lead = convert(docs, pages, outline, Options(compat=False))
    assert lead.sections.where("doc_id = 'd'").count() == 2
    sinks.write_manifests(manifest.manifests(docs), str(tmp_path / "m"))
    made = [json.loads(r.value)["manifest"] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert sorted((m["id"], len(m["authors"]), "license" in m) for m in made) == [("m", 1, False), ("m2", 0, True)]
    entries_ = got.entries.where("doc_id = 'd'")
    for _ in range(2):  # a second export writes the same files
        sinks.export_entries(entries_, str(tmp_path / "files"))
        sinks.export_manifests(manifest.manifests(docs), str(tmp_path / "files"))
        sinks.export_style(spark, docs, str(tmp_path / "files"))
    names = sorted(os.path.relpath(os.path.join(at, n), tmp_path / "files") for at, _, each in os.walk(tmp_path / "files") for n in each)
    assert names == ["d/001-table-of-contents.json", "d/002-c.json", "d/module.json", "d/styles/leafmill.css", "e/module.json", "e/styles/leafmill.css"]
    assert json.loads((tmp_path / "files/d/002-c.json").read_text())["name"] == "C"


def test_manifest_issues(spark):
    docs = spark.createDataFrame([("a", "m", "T", "", "", "pk"), ("b", None, "", "", "", "pk")], "doc_id string, mod_id string, title string, author string, license string, pack_name string")
    made = manifest.manifests(docs)
    assert sorted((r.doc_id, r.issue) for r in manifest.manifest_issues(made).collect()) == [("b", "id is missing"), ("b", "title is missing")]
    old = made.withColumn("manifest", F.col("manifest").withField("compatibility", F.struct(F.lit("9").alias("minimum"))).withField("packs", F.filter("manifest.packs", lambda p: F.lit(False))))
    assert {r.issue for r in manifest.manifest_issues(old.where("doc_id = 'a'")).collect()} == {"compatibility.minimum is below 13", "there are no packs"}


CELLS = "doc_id string, page_no int, table_id string, row_idx int, col_idx int, rowspan int, colspan int, text string, is_header boolean, tbl_x0 double, tbl_y0 double, tbl_x1 double, tbl_y1 double, loaded_at string, row_id bigint"


def cell(r, c, text, rs=1, cs=1, head=None, when="2024", rid=0, box=10.0):
    return ("d", 1, "t", r, c, rs, cs, text, head, box, 20.0, 50.0, 60.0, when, rid)


def test_grid_and_rendering(spark):
    rows = [cell(0, 0, "A1", cs=2, head=True), cell(1, 0, "<b>"), cell(1, 0, "last", when="2025"), cell(2, 2, None, rs=None), cell(None, 1, "lost"), cell(0, 0, "unboxed", box=None)]
    grid = tables.table_grid(spark.createDataFrame(rows, CELLS))
    got = {(r.row_idx, r.col_idx): r.text for r in grid.collect()}
    assert got == {(0, 0): "A1", (0, 2): "", (1, 0): "last", (1, 1): "", (1, 2): "", (2, 0): "", (2, 1): "", (2, 2): ""}
    keys = "doc_id string, page_no int, table_id string"
    captions = spark.createDataFrame([("d", 1, "t", "a < b")], f"{keys}, caption string")
    html = tables.render_tables(grid, captions).first().html
    assert html == (
        '<table><caption>a &lt; b</caption><thead><tr><th colspan="2">A1</th></tr></thead><tbody><tr><td></td></tr><tr><td>last</td><td></td><td></td></tr>'
        "<tr><td></td><td></td><td></td></tr></tbody></table>"
    )
    assert tables.table_grid(spark.createDataFrame([], CELLS)).collect() == []


def test_overlap_and_best(spark):
    def share(b):
        lit = lambda t: tuple(F.lit(float(v)) for v in t)
        return spark.range(1).select(tables.overlap(lit((0, 0, 10, 10)), lit(b))).first()[0]

    assert [share(b) for b in ((20, 20, 10, 10), (0, 0, 10, 10), (5, 5, 10, 10), (10, 0, 10, 10), (0, 0, 0, 10))] == [0, 1, 0.25, 0, 0]
    each = spark.createDataFrame([("d", 1, "a", 1, 0.5, 0.0, 0.0, 10.0, 10.0), ("d", 1, "b", 2, 0.5, 0.0, 0.0, 10.0, 10.0), ("d", 2, "c", 1, 0.0, 0.0, 0.0, 1.0, 1.0), ("d", 3, "e", 1, None, 0.0, 0.0, 1.0, 1.0)], "doc_id string, page_no int, table_id string, table_ord int, confidence double, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in tables.best_tables(each).collect()] == [("d", 1, "a", 0.5)]
    assert [r.confidence for r in tables.best_tables(each, (5, 5, 10, 10)).collect()] == [0.125] and tables.best_tables(each, (50, 50, 1, 1)).count() == 0


def test_references(spark):
    items = spark.createDataFrame([("d", 1, None, "own"), ("d", 1, "s1", None), ("d", 1, "gone", None)], "doc_id string, page_no int, ref string, table_id string")
    store = spark.createDataFrame([("d", "s1", 0.5)], "doc_id string, table_id string, confidence double")
    assert sorted((r.table_id, r.confidence) for r in tables.resolve_references(items, store).collect()) == [("own", None), ("s1", 0.5)]


def blocks(spark, xs, kind="text"):
    rows = [("d", 1, i, kind, x - 5.0 if x is not None else None, float(y), x + 5.0 if x is not None else None, y + 1.0) for i, (x, y) in enumerate(xs)]
    return spark.createDataFrame(rows, "doc_id string, page_no int, block_ord int, type string, x0 double, y0 double, x1 double, y1 double")


def test_columns(spark):
    count = lambda b: layout.column_counts(b).first().columns
    assert count(blocks(spark, [(100.0 + i * 10, i) for i in range(10)])) == 1
    two = [(50.0 + i * 5, i) for i in range(10)] + [(400.0 + i * 5, i) for i in range(10)]
    assert count(blocks(spark, two)) == 2 and count(blocks(spark, two[:7])) == 1 and count(blocks(spark, [(None, 1)] * 9)) == 1
    near = [(x + 0.0, 1) for x in (*range(0, 50, 5), 62, 65, 70, 75, 80, 85, 90, 95, 98, 100)]  # one empty bin of ten
    assert layout.histogram_split(blocks(spark, near), width=100.0).first().boundary == 55.0
    assert layout.histogram_split(blocks(spark, near)).count() == 0 and layout.histogram_split(blocks(spark, near[:7]), 100.0).count() == 0


def test_reading_order(spark):
    two = [(50.0, 1), (400.0, 1), (50.0, 2), (400.0, 2), (50.0, 3), (400.0, 3)]
    order = lambda b: [r.block_ord for r in layout.reading_order(b).orderBy("read_ord").collect()]
    assert order(blocks(spark, two)) == [0, 2, 4, 1, 3, 5]
    assert order(blocks(spark, two[:3])) == [0, 1, 2] and order(blocks(spark, two, "image")) == [0, 1, 2, 3, 4, 5]
    assert order(blocks(spark, [(100.0, 1), (110.0, 1), (100.0, 2), (110.0, 2), (100.0, 3), (110.0, 3)])) == [0, 1, 2, 3, 4, 5]


def test_clusters_and_silhouette():
    g, m = layout.cluster(np.array([1.0]), 2)
    assert g.tolist() == [0] and m.tolist() == [1.0]
    assert layout.cluster(np.array([5.0] * 4), 2)[1].tolist() == [5.0]
    rng = np.random.default_rng(1)
    for _ in range(30):
        points = rng.integers(0, 50, 20).astype(float)
        group = rng.integers(0, 3, 20)
        slow = []
        for i in range(20):
            mean = {c: [abs(points[i] - points[j]) for j in range(20) if group[j] == c and j != i] for c in set(group)}
            a = np.mean(mean[group[i]]) if mean[group[i]] else 0.0
            b = min(np.mean(v) for c, v in mean.items() if c != group[i])
            slow.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
        assert layout.silhouette(points, group) == pytest.approx(np.mean(slow))


def test_engines(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def read(image):
            calls.add(1)
            if image == b"bad":
                raise ValueError("unreadable")
            return [("a < b", 0.5, "en"), ("  ", 0.9, None)]

        return read

    pages = spark.createDataFrame([("d", 1, "<body></body>"), ("d", 2, "x" * 4000), ("d", 3, None)], "doc_id string, page_no int, html string")
    images = spark.createDataFrame([("d", 1, bytearray(b"img")), ("d", 2, bytearray(b"img")), ("d", 3, bytearray(b"bad"))], "doc_id string, page_no int, content binary")
    got = {r.page_no: r.html for r in engines.ocr_pages(pages, images, "auto", make).collect()}
    assert got[1] == '<body><div class="ocr-content" data-source="ocr">\n<p data-ocr="true" data-ocr-confidence="0.500" data-ocr-language="en">a &lt; b</p>\n</div>\n</body>'
    assert got[2] == "x" * 4000 and got[3] == ""
    with pytest.raises(FeatureMissing):
        engines.ocr_pages(pages, images, "on", None)
    assert engines.ocr_pages(pages, images, "auto", None) is pages
    described = engines.once_per_content(images, lambda d: engines.describe(d, lambda: lambda c: "a photo of x"))
    assert [r.caption for r in described.collect()] == ["X"] * 3


def test_json_cache(spark, tmp_path):
    docs = spark.createDataFrame([("d", 3), ("e", None)], "doc_id string, page_count int")
    pages = spark.createDataFrame([("d", 1, "<p>1</p>"), ("d", 3, None), ("d", 4, "é")], "doc_id string, page_no int, html string")
    json_cache.write_cache(docs, pages, str(tmp_path / "c"))
    good, bad = json_cache.read_cache(spark, str(tmp_path / "c"))
    assert sorted((r.doc_id, r.page_no, r.html) for r in json_cache.cached_pages(good).collect()) == [("d", 1, "<p>1</p>"), ("d", 2, ""), ("d", 3, ""), ("d", 4, "é")]
    assert [r.reason for r in bad.collect()] == ["no pages"]
    lines = spark.createDataFrame([("{",), ('{"num_pages": 2}',), ('{"doc_id":"x","num_pages":2}',), (None,)], "value string")
    good, bad = json_cache.parse_cache(lines)
    assert [(r.doc_id, r.num_pages) for r in good.collect()] == [("x", 2)] and sorted(r.reason for r in bad.collect()) == ["no doc_id", "not JSON", "not JSON"]
    assert [r.doc_id for r in json_cache.not_cached(docs, good.withColumn("doc_id", F.lit("d"))).collect()] == ["e"]


def test_cache_in_parts_and_its_use(spark):
    docs = spark.createDataFrame([("d", 120), ("e", 1), ("f", 2), ("g", 3)], "doc_id string, page_count int")
    pages = spark.createDataFrame([("d", n, f"p{n}") for n in (1, 50, 51, 100, 120)] + [("e", 1, "x"), ("f", 2, "y")], "doc_id string, page_no int, html string")
    cached = json_cache.to_cache(docs, pages)
    assert sorted((r.doc_id, r.n) for r in cached.groupBy("doc_id").agg(F.count("*").alias("n")).collect()) == [("d", 3), ("e", 1), ("f", 1), ("g", 1)]
    good, bad = json_cache.parse_cache(cached, "json")
    got = {(r.doc_id, r.page_no): r.html for r in json_cache.cached_pages(good).collect()}
    assert bad.count() == 0 and len(got) == 126 and got["d", 51] == "p51" and got["d", 120] == "p120" and got["d", 119] == "" and got["f", 1] == ""
    # one part is lost, one record is cut off, and one document was never cached
    lines = cached.where("doc_id <> 'g' and not (doc_id = 'd' and json like '%\"first_page\":51%')").withColumn("json", F.when(F.col("doc_id") == "f", F.expr("left(json, 20)")).otherwise(F.col("json")))
    convert_ = lambda left: left.select("doc_id", F.lit(1).alias("page_no"), F.lit("new").alias("html"), F.lit(None).cast("string").alias("error"))
    used = {(r.doc_id, r.page_no): r.html for r in json_cache.reused(docs, lines, convert_, "json").collect()}
    assert used == {("e", 1): "x", ("d", 1): "new", ("f", 1): "new", ("g", 1): "new"}


def test_files_and_converters(spark, tmp_path):
    for name, content in (("a.pdf", b"one two"), ("b.pdf", b"one two"), ("c.pdf", b"bad"), ("d.txt", b"x")):
        (tmp_path / name).write_bytes(content)
    docs = files.documents(spark, str(tmp_path))
    assert docs.count() == 3 and docs.select("doc_id").distinct().count() == 2

    def make():
        def run(content):
            if content == b"bad":
                raise ValueError("empty")
            return [f"<p>{w}</p>" for w in content.decode().split()]

        return run

    got = files.convert_documents(docs, make)
    assert sorted((r.page_no, r.html, r.error) for r in got.collect()) == [(0, None, "empty"), (1, "<p>one</p>", None), (2, "<p>two</p>", None)]
    with pytest.raises(FeatureMissing):
        files.convert_documents(docs, None)


def test_streaming(spark, tmp_path):
    from leafmill.streaming.ingest import PAGES, hourly_deliveries, ingest, page_stream

    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    batch = spark.createDataFrame([(1, "d", 1, "<p>a</p>"), (2, "d", 1, "<p>a</p>"), (3, "d", 2, None)], "row_id long, doc_id string, page_no int, html string")
    full = batch.selectExpr("*", "'scan' as origin", "timestamp'2024-01-01 00:00:00' as extracted_at", "timestamp'2024-01-01 00:10:00' as loaded_at")
    for _ in range(2):  # the second delivery holds nothing new
        full.write.mode("append").parquet(folder)
        ingest(page_stream(spark, folder), target, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.page_no, r.html) for r in spark.read.parquet(target).collect()) == [(1, "<p>a</p>"), (2, None)]
    query = hourly_deliveries(spark.readStream.schema(PAGES).parquet(folder)).writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.pages for r in spark.table("hourly").collect()] == [6]
