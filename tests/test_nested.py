import json

from pyspark.sql import functions as F

from leafmill.operators.nested import flatten_tables


def rows(spark, payloads, target="items", extra=False):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "raw_id bigint, payload string")
    if extra:
        for c in ("tables", "item", "table_key", "level"):
            df = df.withColumn(c, F.lit(1))
    return [tuple(r) for r in flatten_tables(df, target).collect()]


def items(spark, *payloads, **kw):
    return sorted((r[0], r[3], r[2], *r[4:]) for r in rows(spark, payloads, **kw))


def test_nested_table_in_cell(spark):
    inner = {"id": "b", "rows": [[{"text": "x"}, None, {"text": "y"}]], "meta": {"notes": [{"code": "n1"}]}}
    outer = {"kind": "k", "wrap": [{"id": "a", "rows": [{"cells": [{"text": "1", "table": inner}]}, []]}]}
    assert items(spark, json.dumps(outer)) == [(0, "", "a", "cell", 1, 1), (0, "a", "b", "cell", 1, 1), (0, "a", "b", "cell", 1, 3), (0, "a", "b", "note", 1, 0)]


def test_not_json_and_odd_values(spark):
    good = '{"id":"a","rows":[[{"text":"x"}]]}'
    assert items(spark, None, "", "not json", good[:-3], good + " x", "null", "3", "[]", '{"id":"a","rows":7}', '{"id":"a","rows":[3,null,{"cells":"x"}]}') == []
    assert items(spark, good, json.dumps(good), f" [{good}]\n") == [(i, "", "a", "cell", 1, 1) for i in range(3)]
    assert items(spark, '{"id":null,"rows":[[{}]]}') == [(0, "", "", "cell", 1, 1)]
    assert items(spark, '{"\\u0069d":"a","\\u0072ows":[[{"t":{"id":"b","r\\u006fws":[[{}]]}}]]}') == [(0, "", "a", "cell", 1, 1), (0, "a", "b", "cell", 1, 1)]


def test_members_that_repeat(spark):
    twice = '{"id":"a","id":"b","rows":[[{}]]}'
    assert items(spark, twice) == [] and rows(spark, [twice], "unparsed") == [(0, "not JSON")]
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        assert items(spark, twice) == [(0, "", "b", "cell", 1, 1)]
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def test_what_is_no_json_is_listed(spark):
    payloads = [None, "", " \n", "{", "1 2", '"{"', '{"id":"a","rows":[]}', "null", json.dumps('{"id":"a","rows":[]}')]
    assert [r[0] for r in rows(spark, payloads, "unparsed")] == [0, 1, 2, 3, 4, 5]
    nest = lambda n: "[" * n + "]" * n
    # one level is this package's own; Spark's parser ends at 1,000
    assert [r[0] for r in rows(spark, [nest(999), nest(1000)], "unparsed")] == [1]
    at = '{"id":"a","rows":[[{}]]}'
    assert items(spark, "[" * 990 + at + "]" * 990) == [(0, "", "a", "cell", 1, 1)]


def test_deep_and_long(spark):
    table = {"id": "t60", "rows": [[{"text": "end"}]]}
    for i in range(59, -1, -1):
        table = {"id": f"t{i}", "rows": [[{"text": "x", "table": table}]]}
    got = items(spark, json.dumps(table))
    assert len(got) == 61 and (0, "t59", "t60", "cell", 1, 1) in got
    wide = {"id": "w", "rows": [[{"text": "é" * 200}] * 500] * 4}
    assert len(items(spark, json.dumps(wide))) == 2000


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    good = '{"id":"a","rows":[[{"text":"x"}]]}'
    assert len(items(spark, good, good, extra=True)) == 2
    assert rows(spark, []) == []


def test_boxes_and_tables(spark):
    p = '{"id":"a","bbox":[1,2,3,4.5],"caption":7,"meta":{"source_page":"3","detector":{"name":"grid"}},"rows":[[{"bbox":{"x":1}},{"bbox":null},{"bbox":"q"}]]}'
    assert rows(spark, [p], "boxes") == [(0, "", 0, 0, 1.0, 2.0, 3.0, 4.5), (0, "", 1, 1, 1.0, None, None, None)]
    assert rows(spark, [p], "tables")[0][1:] == ("", None, "a", "", None, None, "7", 1, 3, None, "grid", None, None, None, None)
    assert [r[4:6] for r in rows(spark, [p], "cells")] == [(1, 1), (1, 2), (1, 3)]


def test_keys_join_children_to_parents(spark):
    p = '{"id":"a","rows":[[{"t":{"id":"b","rows":[[{}]]}}]]}'
    by = {r[3]: r for r in rows(spark, [p], "tables")}
    assert by["b"][2] == by["a"][1] and by["a"][2] is None


WHOLE = {
    "id": "a", "bbox": [1, 2, 3, 4], "caption": "c", "lang": "en",
    "meta": {
        "source_page": 3, "confidence": 0.5, "detector": {"name": "grid", "version": {"major": 1, "minor": 4}}, "continued_from": {"id": "z", "page": 2}, "by": {"who": [1]},
        "notes": [{"code": "n1", "cells": [[1, 2], [3, 4]], "x": 1}, {"code": None}],
    },
    "rows": [
        {"cells": [{"text": "t", "row_span": 2, "col_span": 1, "is_header": True, "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}, "marks": [{"kind": "note", "refs": [{"n": 9}, {"n": None}], "m": 0}], "font": "f"}], "height": 16, "style": None},
        [None, {"content": [{"kind": "text", "value": "see", "p": 1}, {"kind": "structured", "structured_table": {"id": "b", "rows": [[{"text": "in"}]]}}]}],
    ],
}


def test_every_member_is_in_a_target(spark):
    got = {t: [r[1:] for r in rows(spark, [json.dumps(WHOLE)], t)] for t in ("tables", "rows", "cells", "boxes", "notes", "note_cells", "marks", "mark_refs", "content", "others", "unparsed")}
    inner = "/rows/1/1/content/1/structured_table"
    assert got["tables"] == [
        ("", None, "a", "", None, None, "c", 2, 3, 0.5, "grid", 1, 4, "z", 2), (inner, "", "b", "a", 2, 2, None, 1, None, None, None, None, None, None, None),
    ]
    assert got["rows"] == [("", "a", "", 1, 1, 16.0), ("", "a", "", 2, 2, None), (inner, "b", "a", 1, 1, None)]
    assert got["cells"] == [("", "a", "", 1, 1, "t", 2, 1, True), ("", "a", "", 2, 2, None, None, None, None), (inner, "b", "a", 1, 1, "in", None, None, None)]
    assert got["boxes"] == [("", 0, 0, 1.0, 2.0, 3.0, 4.0), ("", 1, 1, 1.0, 2.0, 3.0, 4.0)]
    assert got["notes"] == [("", "a", "", 1, "n1"), ("", "a", "", 2, None)] and got["note_cells"] == [("", 1, 1, 1, 2), ("", 1, 2, 3, 4)]
    assert got["marks"] == [("", 1, 1, 1, "note")] and got["mark_refs"] == [("", 1, 1, 1, 1, 9), ("", 1, 1, 1, 2, None)]
    assert got["content"] == [("", 2, 2, 1, "text", "see"), ("", 2, 2, 2, "structured", None)]
    assert sorted(got["others"]) == [
        ("", "", "lang", '"en"'), ("", "/meta", "by", '{"who":[1]}'), ("", "/meta/notes/0", "x", "1"), ("", "/rows/0", "style", "null"),
        ("", "/rows/0/0", "font", '"f"'), ("", "/rows/0/0/marks/0", "m", "0"), ("", "/rows/1/1/content/0", "p", "1"),
    ]
    assert got["unparsed"] == []


def test_odd_types_in_every_target(spark):
    odd = ['{"id":1,"rows":[{"cells":[7,{"marks":3,"content":{"a":1},"bbox":5}]},3],"meta":[],"bbox":{}}', '{"id":"a/b~","rows":{},"meta":{"notes":[3,null,{"cells":[1,[],[2]]}],"detector":7,"continued_from":"z"}}', "[]", None]
    for target in ("tables", "rows", "cells", "boxes", "notes", "note_cells", "marks", "mark_refs", "content", "others", "unparsed"):
        rows(spark, odd, target, extra=True)
        assert rows(spark, [], target) == []
    assert rows(spark, odd, "note_cells") == [(1, "", 3, 1, None, None), (1, "", 3, 2, None, None), (1, "", 3, 3, 2, None)]
    assert rows(spark, ['{"a/b":{"c~d":{"id":"k","rows":[]}}}'], "tables")[0][1] == "/a~1b/c~0d"
