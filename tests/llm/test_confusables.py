from pyspark.sql import functions as F

from leafmill.llm import confusables as c

LABELS = [(1, "Smörgås Tide-Table"), (2, "Office Field Guide"), (3, "Παλιά αγορά"), (4, None), (2, "Office Field Guide")]
SAME = {
    1: ["Smörgås Tide-Table", "Ѕmörɡåѕ Τіԁе-Τаblе", "​Smörgås Tide‑Table ", "Ｓｍöｒｇåｓ　Ｔｉｄｅ－Ｔａｂｌｅ"],
    2: ["Oﬃce Field Guide", " Office Field Guide\t", "Of­fice Fie͏ld Guide"],
    3: ["Πaλιά αγoρά", "Παλιά αγορά"],
}
OTHER = ["Smorgas Tide-Table", "smörgås tide-table", "Smörgås Tide–Table", "Smörgås Tide-Tables", "Office  Field Guide", "Office Field Guide 2", "", " ", None, "Παλια αγορα", "x" * 50_000]


def texts(spark, values):
    return spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], "tbl string, row_id bigint, text string").withColumn("label", F.lit("x"))


def test_labels(spark):
    labels = spark.createDataFrame(LABELS, "ref_id bigint, label string").withColumn("text", F.lit(1))
    values = [v for vs in SAME.values() for v in vs] + OTHER + ["Office Field Guide"] + SAME[2][:1] * 50
    want = {(i, ref) for i, v in enumerate(values) for ref, vs in SAME.items() if v in vs}
    got = [(r.row_id, r.ref_id) for r in c.look_like_labels(texts(spark, values), labels).collect()]
    assert sorted(got) == sorted(want)


def test_canonical_member(spark):
    values = ["Ab", "Ab", "Аb", "A​b", "é", "é", "", " ", None]
    got = {r.text: r.canonical for r in c.canonical_members(texts(spark, values), spark.createDataFrame([(1, "zz")], "ref_id bigint, label string")).collect()}
    assert got == {"Ab": "Ab", "Аb": "Ab", "A​b": "Ab", "é": "é", "é": "é", "": "", " ": ""}
    assert c.canonical_members(texts(spark, []), spark.createDataFrame([], "ref_id bigint, label string")).collect() == []


def test_headings(spark):
    pages = spark.createDataFrame([(1, "<h2>A <b>b</b>&#8209;c</h2>x<h3 class='q'>d\ne</h3><h1>no</h1><h4>f"), (2, None), (3, "")], "row_id bigint, html string")
    assert [tuple(r) for r in c.headings(pages).collect()] == [(1, "A b‑c"), (1, "d\ne")]


def test_look_alikes_by_rule(spark):
    latin = c._look_alikes()
    assert {a: latin[a] for a in "\u0410\u0391\u13aa\u0406\u0456\u04c0\u043e\u03bf\u0585\u0261\u2c9f\u15c5"} == dict(zip("\u0410\u0391\u13aa\u0406\u0456\u04c0\u043e\u03bf\u0585\u0261\u2c9f\u15c5", "AAAIiIooogoA"))
    assert not {"\u00e9", "\u00f8", "\u044f", "\u0431", "\u4e00", "\u00df"} & set(latin) and len(latin) > 400
    forms = spark.createDataFrame([("\u15c5\u15f7\u2ca5",), ("\u1d00\u0299",), ("\u0416\u044f",), (None,)], "t string").select(c.form(F.col("t")).alias("f"))
    assert [r.f for r in forms.collect()][:3] == ["ABc", "\u1d00\u0299", "\u0416\u044f"]


def test_unified(spark):
    got = c.unified(texts(spark, ["\u0410b", "Ab", "Ab", None, "\uff21b"]), spark.createDataFrame([], "ref_id bigint, label string")).collect()
    assert sorted((r.row_id, r.canonical) for r in got) == [(0, "Ab"), (1, "Ab"), (2, "Ab"), (4, "Ab")]
