import pytest
from pyspark.sql import functions as F

from leafmill.operators import outline as o
from leafmill.operators import pages as p
from leafmill.operators import sections as s
from leafmill.options import Options, module_id_is_valid


@pytest.mark.parametrize("spec, want", [("1,5-10,15", [1, 5, 6, 7, 8, 9, 10, 15]), ("5,1,3", [1, 3, 5]), ("1,1,3", [1, 3]), ("2-2,4", [2, 4]), (" 1 , 3 , 5 ", [1, 3, 5])])
def test_page_spec(spec, want):
    assert p.parse_page_spec(spec) == want


@pytest.mark.parametrize("spec", ["", " ", "1,,3", "1-2-3", "1--3", "0", "3-1", "a", None])
def test_bad_page_spec(spec):
    with pytest.raises(ValueError):
        p.parse_page_spec(spec)


def test_options():
    assert Options().to_dict()["ocr_threshold"] == 0.05
    for bad in ({"tables": "x"}, {"ocr": "maybe"}, {"pages": (0,)}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert module_id_is_valid("a-b_1") and not module_id_is_valid("--") and not module_id_is_valid("a b")


def test_specs_selection_and_missing(spark):
    pages = spark.createDataFrame([("d", n) for n in (1, 2, 3, 5, 5, None)] + [("e", 7)], "doc_id string, page_no int")
    assert {r.doc_id: r.spec for r in p.page_specs(pages, ["doc_id"]).collect()} == {"d": "1-3,5", "e": "7"}
    assert p.select_pages(pages, []).count() == 0 and p.select_pages(pages, None).count() == 7 and p.select_pages(pages, [5, 7]).count() == 3
    docs = spark.createDataFrame([("d", 3), ("e", None)], "doc_id string, page_count int")
    assert [tuple(r) for r in p.missing_pages(docs, [2, 4]).collect()] == [("d", 4)]


def test_first_deliveries(spark):
    rows = [(1, "d", 1, "late", "2024-01-02"), (2, "d", 1, "first", "2024-01-01"), (3, "d", 1, "tie", "2024-01-01"), (4, "d", 2, None, None)]
    pages = spark.createDataFrame(rows, "row_id bigint, doc_id string, page_no int, html string, loaded_at string")
    assert sorted((r.row_id, r.html) for r in p.first_deliveries(pages).collect()) == [(2, "first"), (4, None)]
    assert p.first_deliveries(pages.limit(0)).collect() == []


NODES = [("d", 1, None, 1, "Chapter A", 1), ("d", 2, 1, 1, "A1", 2), ("d", 3, 1, 2, "A1", 4), ("d", 4, 3, 1, None, None), ("d", 5, None, 2, "B", 4), ("d", 5, None, 2, "B", 4), ("d", 6, 99, 1, "lost", 1)]


def frames(spark, nodes, docs):
    return (
        spark.createDataFrame(nodes, "doc_id string, node_id int, parent_id int, sibling_ord int, title string, page int").withColumn("level", F.lit(9)),
        spark.createDataFrame(docs, "doc_id string, page_count int"),
    )


def test_tree(spark):
    tree = o.outline_tree(*frames(spark, NODES, [("d", 6)]))
    got = {r.node_id: (r.level, r.dfs_ord, r.page_start, r.page_end, r.path) for r in tree.collect()}
    assert got == {
        1: (1, 1, 1, 3, ["chapter-a"]), 2: (2, 2, 2, 3, ["chapter-a", "a1"]), 3: (2, 3, 4, 3, ["chapter-a", "a1"]),
        4: (3, 4, 1, 3, ["chapter-a", "a1", "untitled"]), 5: (1, 5, 4, 6, ["b"]),
    }
    compat = o.outline_tree(*frames(spark, NODES, [("d", 6)]), compat_paths=True)
    assert {r.node_id: r.path for r in compat.collect()}[4] == ["chapter-a", "chapter-a", "untitled"]
    assert {r.node_id: r.unique for r in o.unique_slugs(tree).collect()} == {1: "chapter-a", 2: "a1", 3: "a1-2", 4: "untitled", 5: "b"}
    assert [tuple(r) for r in o.outline_counts(tree).collect()] == [("d", 2, 3)]


def test_deep_tree_and_empty(spark):
    deep = [("d", i, i - 1 or None, 1, f"n{i}", i) for i in range(1, 301)]
    # a chain of 300, two nodes above each other, one above itself, and what is below these
    odd = [("d", 901, 902, 1, "a", 1), ("d", 902, 901, 1, "b", 1), ("d", 903, 903, 1, "c", 1), ("d", 904, 903, 1, "d", 1), ("d", 905, 999, 1, "e", 1), ("d", 906, 905, 1, "f", 1)]
    nodes, docs = frames(spark, deep + odd, [("d", 30)])
    tree = o.outline_tree(nodes, docs)
    got = {r.node_id: (r.level, r.root_id, r.path[0], r.path[-1]) for r in tree.collect()}
    assert got == {i: (i, 1, "n1", f"n{i}") for i in range(1, 301)}
    assert sorted(r.node_id for r in o.unreachable(nodes, tree).collect()) == [901, 902, 903, 904, 905, 906]
    assert o.outline_tree(*frames(spark, [], [])).collect() == []


def test_suffixes_collide_like_plain_counters(spark):
    rows = [("d", i, None, i, t, 1) for i, t in enumerate(["intro", "intro", "intro-2", "intro"], 1)]
    tree = o.outline_tree(*frames(spark, rows, [("d", 1)]))
    assert [r.unique for r in o.unique_slugs(tree).orderBy("dfs_ord").collect()] == ["intro", "intro-2", "intro-2", "intro-3"]


def test_fallback_outline(spark):
    nodes, docs = frames(spark, NODES, [("d", 6), ("e", 2), ("f", 1)])
    blocks = spark.createDataFrame([("e", 1, 2, "heading", None, " The Title "), ("e", 1, 1, "text", 12.0, "no"), ("e", 1, 3, "text", 20.0, "later"), ("e", 2, 1, "title", None, "no")], "doc_id string, page_no int, block_ord int, type string, font_size double, text string")
    got = o.fallback_outline(docs, nodes, o.title_blocks(blocks)).collect()
    assert sorted((r.doc_id, r.title) for r in got) == [("e", "The Title"), ("f", "Document")]


def test_sections(spark):
    nodes = [("d", 1, None, 1, "A", 1), ("d", 2, 1, 1, "S1", 1), ("d", 3, 1, 2, "S2", 2), ("d", 4, None, 2, "B", 4)]
    tree = o.outline_tree(*frames(spark, nodes, [("d", 5)]))
    pages = spark.createDataFrame([("d", 1, "<p>p1</p>"), ("d", 2, "<p>p2</p>"), ("d", 3, "<p>p3</p>"), ("d", 4, None)], "doc_id string, page_no int, html string")
    got = s.merge_pages(s.spans(tree), pages).orderBy("chapter_ord", "section_ord").collect()
    assert [(r.title, r.html, "/".join(r.id_path)) for r in got] == [
        ("S1", "<p>p1</p>", "a/s1"), ("S2", "<p>p2</p>\n\n<p>p3</p>", "a/s2"), ("Page 4", "", "b/page-004"), ("Page 5", "", "b/page-005"),
    ]


def test_pages_before_the_first_section(spark):
    nodes = [("d", 1, None, 1, "A", 1), ("d", 2, 1, 1, "S1", 3)]
    tree = o.outline_tree(*frames(spark, nodes, [("d", 4)]))
    assert [(r.title, r.page_start, r.page_end) for r in s.spans(tree, first_pages=True).orderBy("section_ord").collect()] == [("A", 1, 2), ("S1", 3, 4)]
