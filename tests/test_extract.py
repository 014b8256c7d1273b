import re

from pyspark.sql import functions as F

from leafmill.operators import extract as x


def pages(spark, *html):
    return spark.createDataFrame([(i, 3, h) for i, h in enumerate(html)], "row_id int, page_no int, html string").withColumn("at", F.lit(0))


def column(spark, f, *html):
    return [r.x for r in pages(spark, *html).select("row_id", f(F.col("html")).alias("x")).orderBy("row_id").collect()]


def test_links(spark):
    got = x.links(pages(spark, '<a id=1 href="http://q">x</a><A HREF="#t"><a href=\'no\'><a  href="MAILTO:x">', None, ""), ["row_id"]).collect()
    assert [tuple(r) for r in got] == [(0, 1, "external", "http://q"), (0, 2, "internal", "#t"), (0, 3, "internal", "MAILTO:x")]


def test_embedded_images(spark):
    html = '<img src="data:image/jpeg;base64,aGk="><img src="data:image/svg+xml;base64,!!"> tail'
    got = x.embedded_images(pages(spark, html), ["row_id"]).orderBy("img_ord").collect()
    assert [(r.name, bytes(r.content)) for r in got] == [("page-0003_img_0001.jpg", b"hi"), ("page-0003_img_0002.svg", b"")]
    assert column(spark, lambda c: x.embedded_images_to_assets(c, F.lit(3)), html, None, "none") == [
        '<img src="assets/page-0003_img_0001.jpg"><img src="assets/page-0003_img_0002.svg"> tail', None, "none",
    ]


def test_referenced_images(spark):
    files = spark.createDataFrame([("file:/data/a.png",), ("file:/data/a.png",)], "path string")
    html = '<img src="/data/a.png"><img src="file:///data/a.png"><img src="/data/gone.png"><img src="assets/x.png"><img src="http://x/y.png">'
    got = x.referenced_images(pages(spark, html), files, ["row_id"]).orderBy("img_ord").collect()
    assert [(r.img_ord, r.name) for r in got] == [(1, "page-0003_a.png"), (2, "page-0003_a.png")]


def test_tables_and_decisions(spark):
    html = "<table><tr></tr></table>x<TABLE a>y</TABLE>"
    found = x.html_tables(pages(spark, html, None, "").withColumn("doc_id", F.lit("d")), ["row_id", "page_no"])
    assert [r.html for r in found.orderBy("table_ord").collect()] == ["<table><tr></tr></table>", "<TABLE a>y</TABLE>"]
    structured = spark.createDataFrame([(0, 3, 1, 0.2), (0, 3, 3, 0.9)], "row_id int, page_no int, table_ord int, confidence double")
    kinds = lambda mode, s=structured: [r.kind for r in x.decide_tables(found, s, ["row_id", "page_no"], mode).orderBy("table_ord").collect()]
    assert kinds("auto") == ["html", "html"] and kinds("structured") == ["structured", "html"] and kinds("image-only") == ["image", "image"]
    unknown = structured.withColumn("confidence", F.lit(None).cast("double"))
    assert kinds("auto", unknown) == ["html", "html"] and kinds("auto", structured.withColumn("confidence", F.lit(0.6))) == ["structured", "html"]
    put = column(spark, lambda c: x.put_tables(c, F.array(F.lit(None).cast("string"), F.lit("<T/>"))), html, "no", None)
    assert put == ["<table><tr></tr></table>x<T/>", "no", None]


def test_placeholders(spark):
    rendered = F.array(F.lit("A"), F.lit("B"))
    assert column(spark, lambda c: x.fill_placeholders(c, rendered), "<!-- structured table 2 -->|<!--STRUCTURED  table 1-->|<!-- structured table 3 -->|<!-- structured table 0 -->") == ["B|A|<!-- structured table 3 -->|<!-- structured table 0 -->"]


def test_uuid_targets(spark):
    html = "@UUID[JournalEntry.e1.JournalEntryPage.p1]{A} @uuid[journalentry.e2.journalentrypage.p2]{B\nC} @UUID[JournalEntry.e3]{x} @UUID[JournalEntry..JournalEntryPage.p]{x}"
    got = x.uuid_targets(pages(spark, html, None), ["row_id"], "html").orderBy("link_ord").collect()
    assert [(r.entry_id, r.page_id, r.label) for r in got] == [("e1", "p1", "A"), ("e2", "p2", "B\nC")]


def test_anchors(spark):
    names = spark.createDataFrame([("e", 1, "Overview", "p1"), ("e", 2, "Key Concepts", "p2"), ("e", 3, "overview", "p3"), ("e", 4, None, "p4")], "entry string, ord int, name string, page_id string")
    anchors = x.anchor_tokens(names, ["entry"], "name", "page_id", "ord").first().anchors
    assert anchors == {"overview": "p1", "key-concepts": "p2", "untitled": "p4"}
    known = F.create_map(*[F.lit(v) for kv in anchors.items() for v in kv])
    html = '<a href="#overview">O</a> <a class="q" href=\'#Key-Concepts\'><b>K</b></a> <a href="#missing">x</a> <a href="http://q">q</a>'
    assert column(spark, lambda c: x.anchors_to_links(c, F.lit("E"), known), html, None) == [
        '@UUID[JournalEntry.E.JournalEntryPage.p1]{O} @UUID[JournalEntry.E.JournalEntryPage.p2]{<b>K</b>} x <a href="http://q">q</a>', None,
    ]


def test_captions(spark):
    images = spark.createDataFrame([(1, "a.png", "old"), (2, "a.png", 'new "$1" <x>'), (3, "b.png", None)], "img_ord int, name string, caption string").withColumn("doc", F.lit("d"))
    captions = x.caption_map(images, ["doc"]).first().captions
    assert captions == {"a.png": 'new "$1" <x>'}
    known = F.create_map(*[F.lit(v) for kv in captions.items() for v in kv])
    html = '<img src="assets/a.png"><IMG alt="z" src="a.png" id=1><img src="b.png">'
    alt = "new &quot;$1&quot; &lt;x&gt;"
    assert column(spark, lambda c: x.captions_to_alt(c, known), html) == [f'<img src="assets/a.png" alt="{alt}"><IMG alt="{alt}" src="a.png" id=1><img src="b.png">']


def test_replace_each_equals_re_sub(spark):
    from leafmill.functions.html import replace_each

    values = ["", "xx", "a1b22c", "1", "22x", None]
    n = iter(range(10**6))
    want = []
    for v in values:
        count = iter(range(1, 100))
        want.append(v if v is None else re.sub(r"\d+", lambda m: f"<{m[0]}:{next(count)}>", v))
    del n
    assert column(spark, lambda c: replace_each(c, "[0-9]+", "([0-9]+)", lambda m, i: F.concat(F.lit("<"), m, F.lit(":"), i.cast("string"), F.lit(">"))), *values) == want
