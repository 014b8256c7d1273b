import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.llm import scanfix as x

WORDS = "warden water tower winter garden the and or of fertile errand herald stranger morning linen watch clearing silver half way upper lower polish if it signal come came".split()
PAGE = "\n".join([
    "<div class='ocr_page'>", "<p>7  The Silver Garden and Wiscor</p>", "<p>&nbsp; Vvarden of the watcr tovver, fert-</p>", "<p>ile morn¬</p>", "<p>THE SILVER GARDEN AND WISCOR | 7</p>",
    "<p>&mdash; 7 &mdash;</p>", "<p>ing upper- and</p>", "<p>lower err-</p>", "<p>and winter-</p>", "<p>garden 19l4 K7 Wiscor upper-</p>", "<p>and lower pohsh -</p>", "<p>stranger</p>", "<p>vii</p>",
])


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "word string").withColumn("skeleton", F.lit(1))


def pages(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, doc_id string, page_no int, html string, origin string").withColumn("line_no", F.lit(0)).withColumn("text", F.lit("q"))


def cells(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, text string").withColumn("lines", F.lit(0))


def titles(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, title string")


def found(spark, words, page_rows, cell_rows=(), title_rows=()):
    got = x.find_noise(pages(spark, list(page_rows)), cells(spark, list(cell_rows)), titles(spark, list(title_rows)), words).collect()
    assert len(got) == len(set(got))
    return {(r.tbl, r.row_id, r.line_no, r.kind) for r in got}


def test_kinds(spark, words):
    got = {(n, k) for _, _, n, k in found(spark, words, [(1, "d", 7, PAGE, "scan")])}
    assert got == {(2, "furniture"), (3, "misread"), (3, "break"), (4, "break"), (5, "furniture"), (6, "furniture"), (8, "break"), (9, "break"), (10, "misread"), (11, "misread"), (13, "furniture")}


def test_paragraphs(spark, words):
    got = x.paragraphs(pages(spark, [(1, "d", 7, PAGE, "scan"), (2, "d", 8, "<p>digital</p>", "digital")]), titles(spark, []), words).collect()
    assert [r.text for r in got] == ["Warden of the water tower, fertile morning upper- and lower errand winter-garden 1914 K7 Wiscor upper- and lower polish - stranger"]


def test_paragraphs_of_cells(spark, words):
    rows = [(1, "wat-\ner tower"), (2, "7"), (3, "upper-\nand lower"), (4, "x<y clearlng 2O5"), (5, None), (6, " \n"), (7, "the towcr\n  or garden"), (1, "wat-\ner tower")]
    got = x.paragraphs(pages(spark, [(1, "d", 7, "<p>watcr</p>", "scan")]), titles(spark, []), words, cells(spark, rows)).collect()
    assert sorted((r.tbl, r.row_id, r.paragraph, r.text) for r in got) == [
        ("pages", 1, 1, "water"), ("table_cells", 1, 1, "water tower"), ("table_cells", 2, 1, "7"), ("table_cells", 3, 1, "upper- and lower"),
        ("table_cells", 4, 1, "x<y clearing 205"), ("table_cells", 7, 1, "the tower"), ("table_cells", 7, 2, "or garden"),
    ]


def test_scans_without_origin(spark, words):
    text = "\n3  The Silver Garden and Wiscor\nwarden of the wat-\n- 3 -\ner tovver\n</div>"
    marks = ['class="ocr"', "id='a' class='big ocr_page'", "class=ocrx_word", 'class="mediocre"', 'title="ocr_page"']
    rows = [(i, "d", 3, f"<div {m}>{text}", None) for i, m in enumerate(marks, 1)] + [(6, "d", 3, "<p>the tower</p>", None), (7, "d", 3, "<p>the tovver</p>", "digital"), (8, "d", 3, '<p class="ocr">the tower</p>', None)]
    got = found(spark, words, rows)
    assert {(r, n) for _, r, n, k in got if k == "furniture"} == {(r, n) for r in (1, 2, 3) for n in (2, 4)}
    assert {(r, n) for _, r, n, k in got if k == "break"} == {(r, 3) for r in (1, 2, 3)}
    texts = {r.row_id: r.text for r in x.paragraphs(pages(spark, rows), titles(spark, []), words).collect()}
    assert [texts[r] for r in (1, 2, 3, 8)] == ["warden of the water tower"] * 3 + ["the tower"]
    # no scan, but misread words: kept, with all lines
    assert texts[4] == texts[5] == "3 The Silver Garden and Wiscor warden of the wat- - 3 - er tower" and texts[7] == "the tower" and 6 not in texts


def test_support_comes_from_all_texts(spark, monkeypatch):
    words = spark.createDataFrame([(w,) for w in "at of look the".split()], "word string")
    rows = [(1, "d", 1, "<p>look ot the</p>", "scan"), (2, "d", 2, "<p>the ot</p>", "scan"), (3, "d", 3, "<p>look of</p>", "digital"), (4, "d", 4, "<p>of of</p>", "digital")]
    texts = lambda *c: sorted((r.tbl, r.row_id, r.text) for r in x.paragraphs(pages(spark, rows), titles(spark, []), words, cells(spark, list(c))).collect() if r.text.startswith(("look", "the")))
    # by context, and by frequency where neither word follows "the"
    assert texts() == [("pages", 1, "look of the"), ("pages", 2, "the of")]
    more = [(n, "look at") for n in range(5, 10)]
    assert texts(*more)[:2] == [("pages", 1, "look at the"), ("pages", 2, "the at")]
    for few in ("PATTERN", "LEXICON"):  # the same without a pattern, and without a literal set
        monkeypatch.setattr(x, few, -1 if few == "PATTERN" else 0)
        assert texts(*more)[:2] == [("pages", 1, "look at the"), ("pages", 2, "the at")]


def test_cells_have_no_furniture_and_no_markup(spark, words):
    rows = [(1, "wat-\ner tower"), (2, "inner\nand upper-\nand lower"), (3, "<b>clearlng</b> 7"), (4, None), (5, ""), (6, "7"), (7, "w​inter silver­"), (1, "wat-\ner tower"), (8, "x<y 2O5")]
    assert found(spark, words, [], rows) == {("table_cells", 1, 1, "break"), ("table_cells", 3, 1, "misread"), ("table_cells", 8, 1, "misread")}


def test_odd_rows(spark, words):
    rows = [(1, None, None, "<p>7</p>", "scan"), (2, "d", 3, None, None), (3, "d", 3, "", "scan"), (4, "d", 3, "<p>3</p>\n<p>watcr</p>", "digital"), (5, "d", 3, "x " * 40_000 + "tovver", None)]
    assert found(spark, words, rows) == {("pages", 4, 2, "misread"), ("pages", 5, 1, "misread")}
    assert found(spark, words, []) == set()
    empty = words.limit(0)
    assert {k for *_, k in found(spark, empty, [(1, "d", 7, PAGE, "scan")])} == {"furniture", "misread"}


def test_head_within_a_page_needs_its_document(spark, words):
    body = "<p>the tower of</p>\n<p>the water</p>\n<p>Silver Tower and Narbel</p>\n<p>the garden or</p>\n<p>the winter</p>\n<p>of it</p>"
    alone = [(1, "d", 4, body, "scan")]
    assert found(spark, words, alone) == set()
    assert found(spark, words, alone, (), [("d", "silver tower and narbel")]) == {("pages", 1, 3, "furniture")}
    assert len(found(spark, words, [*alone, (2, "d", 5, body, "scan")])) == 2


def test_heads_and_numbers_of_any_length(spark, words):
    head = "The " + "Silver Garden of " * 20 + "Wiscor"
    body = "<p>the tower of</p>\n<p>the water</p>\n<p>{0}</p>\n<p>the garden or</p>\n<p>the winter</p>"
    rows = [(i, "d", i, body.format(head), "scan") for i in (1, 2)] + [(3, "d", 3, f"<p>{head} 3</p>\n<p>the tower of it</p>\n<p>or</p>\n<p>and</p>", "scan")]
    rows += [(4, "e", 1447, "<p>the tower of</p>\n<p>MCDXLVII</p>\n<p>the water</p>\n<p>or it</p>", "scan"), (5, "e", 12, f"<p>the tower of</p>\n<p>{'- ' * 30}12{' -' * 30}</p>\n<p>the water</p>\n<p>or it</p>", "scan")]
    assert {(r, n) for _, r, n, k in found(spark, words, rows)} == {(1, 3), (2, 3), (3, 1), (4, 2), (5, 2)}


def test_what_is_found_is_mended(spark, words):
    rows = [(1, "d", 7, PAGE, "scan"), (2, "d", 3, "<p>the tovver</p>\n<p>wat-</p>\n<p>er</p>", "digital"), (3, "d", 4, "<p>2O5 of it</p>", None)]
    cell_rows = [(1, "wat-\ner tower"), (4, "x 2O5 clearlng")]
    lines = {(t, r): raw.split("\n") for t, table in (("pages", [(r[0], r[3]) for r in rows]), ("table_cells", cell_rows)) for r, raw in table}
    texts = {}
    for r in x.paragraphs(pages(spark, rows), titles(spark, []), words, cells(spark, cell_rows)).collect():
        texts[r.tbl, r.row_id] = texts.get((r.tbl, r.row_id), "") + "\n" + r.text
    bare = lambda raw: re.sub("<[^>]*>", "", raw).replace("&nbsp;", "").replace("&mdash;", "\u2014").strip()
    for t, r, n, _ in found(spark, words, rows, cell_rows):
        assert f" {bare(lines[t, r][n - 1])} " not in f" {texts[t, r]} ".replace("\n", " ")


def test_large_lexicon_gives_the_same(spark, words, monkeypatch):
    rows = [(1, "d", 7, PAGE, "scan")]
    small = found(spark, words, rows)
    monkeypatch.setattr(x.Lexicon.__init__, "__defaults__", ("word", 3))
    monkeypatch.setattr(x, "LEXICON", 0)
    monkeypatch.setattr(x, "PATTERN", 0)
    assert found(spark, words, rows) == small


def test_patterns_against_brute_force(spark):
    rng = random.Random(4)
    swaps = [(t, m.replace("\\", "")) for t, ms in x.MISREAD.items() for m in ms.split()]
    cases = []
    for _ in range(300):
        true = rng.choice([w for w in WORDS if len(w) > 3])
        word = true
        for _ in range(rng.randint(0, 2)):
            t, m = rng.choice(swaps)
            spots = [i.start() for i in re.finditer(f"(?={t})", true)]
            if spots and word == true:
                at = rng.choice(spots)
                word = true[:at] + m + true[at + len(t) :]
        cases.append((word, true))
    df = spark.createDataFrame(cases, "word string, expect string")
    lexicon = x.Lexicon(spark.createDataFrame([(w,) for w in WORDS], "word string"))
    got = {(r.word, r.proper) for r in lexicon.match(df).collect()}
    assert set(cases) <= got
    assert not {("read", "lead"), ("main", "mam")} & got


def test_next_line_far_below_and_many_hyphens(spark, words):
    far = "<p>wat-</p>" + "\n<p> </p>" * 500 + "\n<p>er</p>"
    many = "\n".join(["<p>wat-</p>", "<p>er gar-</p>"] + ["<p>den of gar-</p>"] * 3000 + ["<p>den</p>"])
    got = found(spark, words, [(1, "d", 1, far, "scan"), (2, "d", 1, many, "scan")])
    assert ("pages", 1, 1, "break") in got and sum(k == "break" for *_, k in got) == 1 + 3002
