import random

import pytest

from leafmill.llm import splitting as s


def check(text, limit, overlap):
    pieces = s.cut(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e in pieces) == text
    for start, body, end in pieces:
        assert 0 <= start <= body <= end and end - start <= limit and body - start <= overlap
        assert body == 0 or overlap == 0 or start < body
    assert len(pieces) > 1 or len(text) <= limit
    return pieces


def test_random_markup():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<li>", "</ul>", " ", "word", ". ", "\n", "\n\n", "&lt;", "<h2>", "</h2>", "<b>", "é", "<", "# "]
    for _ in range(300):
        limit = rng.choice((50, 120, 400))
        check("".join(rng.choices(bits, k=rng.randint(1, 800))), limit, rng.choice((0, limit // 5)))


@pytest.mark.parametrize("text", ["x" * 9000, "word " * 5000, "<div>" * 4000, "<div>x " * 4000, "<ul><li>a b. " * 5000 + "</li></ul>" * 5000, "<a href='" + "z" * 5000 + "'>x</a>", " " * 5000, "文。" * 3000])
def test_extremes(text):
    check(text, 1000, 100)


def test_cuts_at_the_highest_structure():
    part = "<h2>Head</h2>\n" + "<p>One two three. Four five six.</p>\n" * 5
    pieces = check(part * 8, 450, 40)
    assert all((part * 8)[b:].startswith("<h2>") for _, b, _ in pieces)
    long = "<ul>" + "".join(f"<li>{'item word ' * 8}</li>" for _ in range(30)) + "</ul>"
    assert all(long[b:].startswith(("<ul>", "<li>")) for _, b, _ in check(long, 500, 60))
    prose = "A sentence of words. " * 200
    assert all(prose[b - 2 : b] == ". " for _, b, _ in check(prose, 500, 50)[1:])


def test_levels_count_however_deep_they_are():
    for depth in (5, 60, 700):
        text = "<div>" * depth + "".join(f"<p>{'item word ' * 8}</p>" for _ in range(60)) + "</div>" * depth
        pieces = check(text, 500, 60)
        assert all(text[b:].startswith(("<div>", "<p>", "</div>")) for _, b, _ in pieces)
    inner = "<li>" + "word " * 30 + "<ul>" + "".join(f"<li>{'deep word ' * 6}</li>" for _ in range(10)) + "</ul></li>"
    text = "<ol>" * 40 + inner * 6 + "</ol>" * 40
    assert all(text[b:].startswith(("<ol>", "<li>", "<ul>", "</ol>")) for _, b, _ in check(text, 1200, 100))


def test_limits():
    assert s.cut("a" * 10, 10, 2) == [(0, 0, 10)]
    with pytest.raises(ValueError):
        s.cut("a" * 11, 10, 5)


def test_frames(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "a b. " * 100), (4, "a b. " * 100), (None, "🙂" * 60)]
    df = spark.createDataFrame(rows, "k bigint, body string").selectExpr("*", "1 as piece", "2 as start", "3 as __text")
    got = s.split_items(df, ("k",), "body", 50, 10).collect()
    assert {r.k for r in got} == {4, None}
    assert "".join(r.piece[r.body_start - r.start :] for r in sorted(got, key=lambda r: r.piece_no) if r.k is None) == "🙂" * 60
    assert len({r.piece_no for r in got if r.k == 4}) * 2 == sum(r.k == 4 for r in got)
    assert s.split_items(df.limit(0), ("k",), "body", 50, 10).collect() == []
