import html
import random
import re
from collections import Counter, defaultdict

from leafmill.llm import boilerplate as b

NOTICE = ["<p>Printed from the Old Press on {0}</p>", "  <b>PRINTED</b> from&nbsp;the &Old; press, {0}!", "Caf&eacute; gu&#105;de &amp; m{0}ap of the town"]


def frames(spark, rows, docs):
    pages = spark.createDataFrame(rows, "row_id bigint, doc_id string, html string").selectExpr("*", "1 as source", "2 as h1", "3 as line_no")
    parsed = spark.createDataFrame(docs, "doc_id string, source string, received_at timestamp_ntz").selectExpr("doc_id", "source", "cast(received_at as timestamp) received_at", "4 as html")
    return pages, parsed


def letters(line):
    return "".join(c for c in html.unescape(re.sub("<[^<>]*>", "", line)) if c.isalpha()).lower()


def brute(rows, docs, least=3, share=0.1):
    source = {d: s for d, s, _ in docs}
    of, seen = Counter(source.values()), defaultdict(set)
    for _, d, h in rows:
        for line in (h or "").split("\n"):
            if d in source and len(k := letters(line)) >= 12:
                seen[source[d], k].add(d)
    good = {k for k, ds in seen.items() if len(ds) >= least and len(ds) >= share * of[k[0]]}
    return Counter((r, n) for r, d, h in rows for n, line in enumerate((h or "").split("\n"), 1) if (source.get(d), letters(line)) in good)


def test_against_brute_force(spark):
    rng = random.Random(1)
    docs = [(f"d{i}", "big" if i % 3 else f"s{i % 7}", None) for i in range(60)]
    rows = []
    for i in range(250):
        d = f"d{rng.randrange(64)}" if i % 3 else "d1"
        body = [rng.choice(NOTICE).format(rng.randint(1, 999)) if rng.random() < 0.3 else " ".join(rng.choices("alpha beta gamma delta epsilon".split(), k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6))]
        rows.append((i, d, rng.choice(["\n".join(body)] * 8 + [None, ""])))
    rows.append((999, "d5", "x" * 50_000 + "\n" + NOTICE[0]))
    rows.append(rows[-1])
    pages, parsed = frames(spark, rows, docs)
    own = b.lines(pages, ["row_id", "doc_id"])
    repeated = b.repeated_lines(own, parsed)
    want = brute(rows, docs)
    for limit in (500_000, 0):
        got = b.find_lines(own, parsed, repeated, "row_id", broadcast_rows=limit)
        assert Counter((r.row_id, r.line_no) for r in got.collect()) == want
    for limit in (500_000, 0):
        clean = {r.row_id: r.html for r in b.remove_lines(pages, got, "row_id", broadcast_rows=limit).collect()}
        for r, _, h in rows:
            assert clean[r] == (h and "\n".join(x for n, x in enumerate(h.split("\n"), 1) if (r, n) not in want))


def test_republished_documents_are_one_cluster(spark):
    page = "An article that was printed again\nand its second line of text"
    rows = [(i, f"d{i}", page) for i in range(5)] + [(9, "d9", "quite another line of the text")]
    docs = [(f"d{i}", "s", None) for i in range(10)]
    pages, parsed = frames(spark, rows, docs)
    own = b.lines(pages, ["row_id", "doc_id"])
    got = b.repeated_lines(own, parsed).collect()
    assert len(got) == 2 and all((r.documents, r.clusters) == (5, 1) for r in got)
    assert b.repeated_lines(own, parsed, min_clusters=2).count() == 0


def test_empty(spark):
    pages, parsed = frames(spark, [], [])
    own = b.lines(pages, ["row_id", "doc_id"])
    found = b.find_lines(own, parsed, b.repeated_lines(own, parsed), "row_id")
    assert found.collect() == [] and b.remove_lines(pages, found, "row_id").collect() == []
