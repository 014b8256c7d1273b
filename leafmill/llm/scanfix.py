"""Noise in text from scanned pages: furniture, divided words, misread characters; repair to paragraphs (problem 5).

* Words are compared by a skeleton of confusable glyphs (the strokes they are made of, so that m, rn and in fall
  together): a word that is not in the lexicon is joined to the lexicon words of its skeleton, and an exact check
  against the known misreadings of that word follows. Of several words the nearest is chosen, of equally near ones the
  one that follows the same word most often in all texts, then the most frequent one.
* Running heads and page numbers are found by masking the page's own number in a line: what is left is nothing, or a
  line in title case that recurs in the document, is its title, stands at a page's edge or carries the number.
* A word is divided if a line ends in a hyphen within letters and the word formed with the next line of text is a
  lexicon word, or both parts are (a compound at its own hyphen); hyphens left hanging before "and" and "or" are not.
* Lines are joined to paragraphs with SQL windows over each row's lines.

All of it is built-in expressions. Texts are read once, line by line, and never shuffled; the few lines with something
to look into are written once to the shared checkpoint folder, and every step works on these, pages and cells together.
What there is to mend comes out as one table (`repairs`); finding lists it, and the paragraphs apply it, so they agree.
The lexicon is counted first: up to `LEXICON` words it is a literal set and a broadcast side, beyond that both are
shuffled joins. What is gathered per document is two numbers per head, added up before the shuffle.

Defined results: null and empty texts have no lines; a null page number matches no number; null origin counts as a
scan where the page carries OCR classes (ocr, ocr_page, ...); a page that is no scan has no furniture, and is repaired to
paragraphs if words of it are divided or misread; rows are found once however often they are repeated; an empty lexicon finds
furniture only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.html import let, strip_tags, unescape
from leafmill.functions.text import SPACES
from leafmill.state import materialized

#: So many words are taken as a literal set and broadcast.
LEXICON = 50_000
#: So many words make a pattern.
PATTERN = 200
#: So many lines are looked at first for a line of text, and all of them if there is none among these.
NEAR = 6
#: What a line is known by.
LINE = ["tbl", "row_id", "line_no"]

# What a glyph or two are read as, by what they are.
MISREAD = {
    "a": "o", "b": "6", "c": "e", "d": "cl", "e": "c", "f": "t", "g": "9", "h": "b", "i": "1 l", "l": "1 i \\|", "m": "rn",
    "n": "u ri", "o": "0", "s": "5", "t": "f", "u": "ii", "w": "vv", "cl": "d", "in": "m", "li": "h", "rn": "m",
}
# Digits read as letters, hyphens that divide words, and words before which a hyphen hangs.
_DIGITS = ("OoIl|SB", "0011158")
_HYPHENS = "-\u00ad\u00ac\u2010\u2011"
_HANGING = ("and", "or")
_SPACES = SPACES + "\t\r\x0b\x0c\u3000"
_NUMBER = r"[0-9OoIl|SB]+"


def skeleton(word: Column) -> Column:
    """A word's strokes: equal for words that differ by known misreadings only."""
    out = F.lower(word)
    for glyph, strokes in (("m", "nr"), ("w", "vv"), ("d", "cl"), ("n", "ii"), ("u", "ii"), ("h", "ii"), ("b", "ii"), ("6", "ii")):
        out = F.replace(out, F.lit(glyph), F.lit("iii" if glyph == "m" else strokes))
    return F.translate(out, "rl1|ea0f59", "iiiicootsg")


def _pattern(word: str) -> Column:
    """The pattern of all misreadings of the lexicon word in column `word`, built from its end; in pairs both ways."""

    def either(true: str) -> str:
        return "".join(f"|{x}" for x in MISREAD[true].split())

    one = " ".join(f"when '{t}' then '(?:{t}{either(t)})'".replace("\\", "\\\\") for t in MISREAD if len(t) == 1)
    two = " ".join(f"when '{t}' then '{MISREAD[t]}'" for t in MISREAD if len(t) == 2)
    at = f"substr({word}, length({word}) - k, 1)"
    pair = f"case substr({word}, length({word}) - k, 2) {two} end"
    single = f"case {at} {one} else {at} end"
    step = (
        f"if(k > 0 and {pair} is not null, concat('(?:', {single}, acc.p1, '|', {pair}, acc.p2, ')'), concat({single}, acc.p1))"
    )
    return F.expr(
        f"aggregate(sequence(0, length({word}) - 1), named_struct('p1', '', 'p2', ''),"
        f" (acc, k) -> named_struct('p1', {step}, 'p2', acc.p1), acc -> concat('(?i)^', acc.p1, '$'))"
    )


class Lexicon:
    """A table of words, lower-case, with skeleton and pattern."""

    def __init__(self, words: DataFrame, column: str = "word", limit: int = LEXICON):
        plain = words.select(F.lower(F.col(f"`{column}`")).alias("proper")).where("proper rlike '^[a-z]+$'").distinct()
        head = [r.proper for r in plain.limit(limit + 1).collect()]
        self.small = len(head) <= limit
        self.words = head if self.small else None
        rows = plain.select("proper", skeleton(F.col("proper")).alias("skeleton"), _pattern("proper").alias("pattern"))
        self.rows = F.broadcast(rows) if self.small else rows

    def unknown(self, words: Column) -> Column:
        """Of an array of words those outside the lexicon; all of them if it is too large to be a literal."""
        return F.filter(words, lambda w: ~F.lower(w).isin(self.words)) if self.small and self.words else words

    def match(self, df: DataFrame, word: str = "word") -> DataFrame:
        """`df` joined to the lexicon words that its word is, or is a misreading of (`proper`)."""
        return df.withColumn("skeleton", skeleton(F.col(word))).join(self.rows, "skeleton").where(f"{word} rlike pattern").drop("skeleton", "pattern")

    def misread(self, df: DataFrame, word: str = "word") -> DataFrame:
        """As `match`, for words that are themselves in no lexicon."""
        if not self.small:
            df = df.join(self.rows.select("proper"), F.lower(F.col(word)) == F.col("proper"), "left_anti")
        return self.match(df, word)


def _digits(text: Column) -> Column:
    return F.translate(text, *_DIGITS)


def _roman(number: Column) -> Column:
    """Of 1 to 3999, which is what there are, else ''."""
    places = (("m", "mm", "mmm"), ("c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))
    parts = [F.coalesce(F.try_element_at(F.array(*map(F.lit, p)), F.nullif((F.floor(number / 10**e) % 10).cast("int"), F.lit(0))), F.lit("")) for p, e in zip(places, (3, 2, 1, 0))]
    return F.when(number.between(1, 3999), F.concat(*parts)).otherwise("")


_MINOR = r"^(?:[o0][ft]|t[hb][ec]|[ao0](?:n|u|ri)(?:d|cl)|[o0](?:n|u|ri)|a)$"


def _head_parts(text: Column, page: Column) -> tuple[Column, Column, Column]:
    """Whether a line is a page number only; its text without the page's number; whether it had one."""
    own = page.cast("string")
    alone = F.regexp_extract(text, rf"^[\[(|–—\- ]*(?:[Pp][ao0][g9][ec]|[Pp]\.?)? *({_NUMBER}|[ivxlcdmIVXLCDM]+)(?: +(?:[o0][ft]|/) +{_NUMBER})?[\])|–—\- ]*$", 1)
    number = (alone != "") & ((_digits(alone) == own) | (F.lower(alone) == _roman(page)))
    lead = F.regexp_extract(text, rf"^({_NUMBER}) +", 1)
    tail = F.regexp_extract(text, rf" (?:\| *)?({_NUMBER})$", 1)
    first, last = (lead != "") & (_digits(lead) == own), (tail != "") & (_digits(tail) == own)
    core = F.when(first, F.regexp_replace(text, rf"^{_NUMBER} +", "")).when(last, F.regexp_replace(text, rf" (?:\| *)?{_NUMBER}$", "")).otherwise(text)
    return F.coalesce(number, F.lit(False)), F.trim(core), F.coalesce(first | last, F.lit(False))


def _title_case(core: Column) -> Column:
    words = F.split(core, " ")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^[A-Z0-9|]")))
    minor = F.size(F.filter(words, lambda w: w.rlike(_MINOR)))
    return ~core.rlike(r"[.,;:!?]") & (capital >= 2) & (F.size(words) >= 3) & (capital + minor >= F.size(words)) & core.rlike(r"(?:^| )[A-Z0-9|][^ ]*$")


def _bare(raw: Column, markup: bool) -> Column:
    """A line without tags; cells and breaks keep words apart."""
    if not markup:
        return raw
    apart = F.when(raw.contains("</t") | raw.contains("<br>"), F.regexp_replace(raw, r"(?i)<(?:/td|/th|br)\b", " $0")).otherwise(raw)
    return F.when(raw.contains("<"), strip_tags(apart)).otherwise(raw)


def _plain(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x20-\x7e]"), F.translate(text, _SPACES, " " * len(_SPACES))).otherwise(text)


def _single(text: Column) -> Column:
    return F.trim(F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text))


def _shown(raw: Column, markup: bool) -> Column:
    """A line as a reader sees it: no tags, entities decoded, trimmed, single plain spaces. For use in lambdas."""
    decoded = (lambda x: let(_bare(x, True), unescape)) if markup else (lambda x: x)
    return let(decoded(raw), lambda x: let(_plain(x), _single))


_TAGS = r"<!--.*?-->|</?[A-Za-z][^<>]*>|<![^<>]*>"


def _blank(raw: Column, markup: bool) -> Column:
    """Whether nothing of a line shows. A letter or digit outside tags is seen at once, as is a line of tags and spaces;
    only what is left, as lines of entities or with comments, is decoded."""
    if not markup:
        return _shown(raw, False) == ""
    return (
        F.when(~raw.contains("<!") & raw.rlike(r"(?:^|>)(?:[^<>&A-Za-z0-9]|&[A-Za-z0-9#]+;)*+[A-Za-z0-9]"), False)
        .when(~raw.contains("&"), raw.rlike(rf"^(?:{_TAGS}|[ {_SPACES}])*$")).otherwise(_shown(raw, True) == "")
    )


def _with_text(lines: DataFrame, markup: bool) -> DataFrame:
    """`lines` with `text`, the shown form of `raw`, step by step so that no step is repeated."""
    if markup:
        lines = _staged(_staged(lines, text=_bare(F.col("raw"), True)), text=unescape(F.col("text")))
    else:
        lines = lines.withColumn("text", F.col("raw"))
    return _staged(_staged(lines, text=_plain(F.col("text"))), text=_single(F.col("text"))).where("text <> ''")


def _staged(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that are computed once: a generator keeps the optimizer from repeating them where they are used."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


_FIRST = r"^[^\p{L}\p{N}|]*([\p{L}\p{N}|]+)"
_ENDS = rf"(?:[{_HYPHENS}]|&[#A-Za-z0-9]+;)(?:\s|\u00a0|<[^<>]*>)*$"


def _is_head(text: Column, page: Column) -> Column:
    number, core, _ = _head_parts(text, page)
    return number | (~text.rlike(r"[.,;:!?]") & _title_case(core))


def text_lines(df: DataFrame, keys: list[str], text: str, page: Column | None = None, scan: Column | None = None, markup: bool = True) -> DataFrame:
    """(keys, line_no, text, raw, last, next_first, next_no, head, core, numbered, edge) per non-blank line.

    `last` is a line's last word if a hyphen follows, and `next_first` and `next_no` are then
    of the next line of text in the row, passing over blank lines and what looks like furniture. `head` is whether a
    line of a scan looks like furniture, `core` its text without page numbers, `edge` whether it is the first or one
    of the last two lines of its page.

    Rows are exploded to lines at once, so that lines are handled in generated code; only where a line ends like a
    divided word are the lines behind it looked at.
    """
    with_page = df.select(*keys, (page if page is not None else F.lit(None).cast("int")).alias("page"), (scan if scan is not None else F.lit(False)).alias("scan"), F.split(text, "\n", -1).alias("raws"))

    def position(raws: Column, nth: int) -> Column:
        """How many lines of `raws` it takes to see `nth` non-blank ones."""
        start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at"))
        look = lambda some: F.aggregate(some, start, lambda acc, x: F.when(acc.seen >= nth, acc).otherwise(F.struct((acc.seen + (~_blank(x, markup)).cast("int")).alias("seen"), (acc.at + 1).alias("at"))))
        return let(look(F.slice(raws, 1, NEAR)), lambda n: F.when((n.seen >= nth) | (F.size(raws) <= NEAR), n).otherwise(look(raws)))["at"]

    if scan is not None:
        edges = F.when(F.col("scan"), F.struct(position(F.col("raws"), 1).alias("top"), (F.size("raws") + 1 - position(F.reverse("raws"), 2)).alias("foot")))
    else:
        edges = F.lit(None).cast("struct<top:int,foot:int>")
    def following(acc: Column, x: Column) -> Column:
        def see(shown: Column) -> Column:
            skip = shown == ""
            if scan is not None:
                skip = skip | F.coalesce(F.col("scan") & _is_head(shown, F.col("page")), F.lit(False))
            return F.struct((acc.at + 1).alias("at"), F.when(skip, "").otherwise(F.regexp_extract(shown, _FIRST, 1)).alias("word"))

        return F.when(acc.word != "", acc).otherwise(let(_shown(x, markup), see))

    def ahead(i: Column) -> Column:
        """The next line of text behind line i: among the next few lines, or else among all."""
        near = F.aggregate(F.slice("raws", i + 2, NEAR), F.struct(F.lit(0).alias("at"), F.lit("").alias("word")), following)
        far = F.aggregate(F.slice("raws", i + 2 + NEAR, F.size("raws")), F.struct(F.lit(NEAR).alias("at"), F.lit("").alias("word")), following)
        return let(near, lambda n: F.when((n.word != "") | (F.size("raws") <= i + 1 + NEAR), n).otherwise(far))

    ends = lambda x: reduce(Column.__or__, [x.contains(h) for h in _HYPHENS + ";"]) & x.rlike(_ENDS)
    parts = F.transform("raws", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("raw"), F.when(ends(x), ahead(i)).alias("ahead")))
    lines = with_page.select(*keys, "page", "scan", edges.alias("edges"), parts.alias("parts")).select(*keys, "page", "scan", "edges", F.inline_outer("parts"))
    lines = _with_text(lines, markup)
    lines = lines.withColumn("last", F.when(F.substring("text", -1, 1).isin(*_HYPHENS), F.regexp_extract("text", rf"([\p{{L}}\p{{N}}|]+)[{_HYPHENS}]$", 1)).otherwise(""))

    number, core, numbered = _head_parts(F.col("text"), F.col("page"))
    lines = lines.withColumn("ahead", F.when(F.col("last") != "", F.col("ahead")))
    if scan is None:
        lines = lines.withColumns({"core": F.lit(None).cast("string"), "numbered": F.lit(False), "head": F.lit(False)})
    else:
        named = F.col("scan") & ~F.col("text").rlike(r"[.,;:!?]")
        lines = _staged(lines, number=F.coalesce(F.col("scan") & number, F.lit(False)), core=F.when(named, core), numbered=F.coalesce(named & numbered, F.lit(False)))
        lines = _staged(lines, core=F.when(F.col("number"), "").otherwise(F.col("core")), head=F.coalesce(F.col("number") | F.when(F.col("core").isNotNull(), _title_case(F.col("core"))), F.lit(False)))
    return lines.select(
        *keys, "line_no", "text", "raw", "last",
        F.coalesce("ahead.word", F.lit("")).alias("next_first"), (F.col("line_no") + F.col("ahead.at")).alias("next_no"), "head",
        F.when(F.col("head"), F.coalesce("core", F.lit(""))).alias("core"), (F.col("head") & F.col("numbered")).alias("numbered"),
        F.coalesce((F.col("line_no") <= F.col("edges.top")) | (F.col("line_no") >= F.col("edges.foot")), F.lit(False)).alias("edge"),
    )


_OCR_CLASS = r"""(?i)<[a-z][^<>]*\sclass\s*=\s*["']?(?:[^"'<>]*\s)?ocrx?(?![a-z0-9])"""


def has_ocr_class() -> Column:
    """Whether a page's html has an element of a class ocr, ocr_page, ocr-content and the like."""
    return F.coalesce(F.when(F.col("html").rlike("(?i)ocr"), F.col("html").rlike(_OCR_CLASS)), F.lit(False))


def is_scan() -> Column:
    """Whether a page (origin, html) is a scan; without an origin, by its OCR classes."""
    return F.when(F.col("origin").isNull(), has_ocr_class()).otherwise(F.col("origin") == "scan")


def text_table(pages: DataFrame, cells: DataFrame | None) -> DataFrame:
    """`text_lines` of all pages (row_id, doc_id, page_no, html, origin) and cells (row_id, text; plain text), by `tbl`."""
    key = ["tbl", "row_id", "doc_id", "page_no"]
    out = text_lines(pages.where("html is not null").withColumn("tbl", F.lit("pages")), key, "html", F.col("page_no"), is_scan())
    if cells is None:
        return out
    plain = cells.where("text is not null").select(F.lit("table_cells").alias("tbl"), "row_id", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("int").alias("page_no"), "text")
    return out.unionByName(text_lines(plain, key, "text", markup=False))


def suspects(lines: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The lines with something to look into, written once: heads, lines that end in a hyphen, and lines with words
    outside the lexicon (`words`) or numbers with letters (`numbers`). Everything else reads this narrow table."""
    quiet = F.lit(None).cast("array<string>")
    words = F.when(~F.col("head"), _tokens(lexicon)).otherwise(quiet)
    numbers = F.when(~F.col("head") & F.col("text").rlike("[0-9]"), F.filter(F.regexp_extract_all("text", F.lit(_MIXED), F.lit(0)), lambda w: w.rlike("[0-9]") & w.rlike(r"[OoIl|SB]"))).otherwise(quiet)
    kept = _staged(lines.drop("raw"), words=words, numbers=numbers)
    return materialized(kept.where("head or (last <> '' and next_first <> '') or size(words) > 0 or size(numbers) > 0"))


def furniture(found: DataFrame, titles: DataFrame) -> DataFrame:
    """(tbl, row_id, line_no) of running heads and feet and page numbers among `suspects`; `titles` has (doc_id, title)."""
    heads = found.where("head").select(*LINE, "doc_id", "page_no", "numbered", "edge", F.replace(skeleton(F.col("core")), F.lit(" ")).alias("mask"))
    sure = (F.col("mask") == "") | F.col("numbered") | F.col("edge")
    # a head within a page needs its document: it recurs on other pages, or is the title
    recurs = heads.where("mask <> ''").groupBy("doc_id", "mask").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b"), F.max("numbered").alias("n")).where("a < b or n").select("doc_id", "mask")
    named = titles.select("doc_id", F.replace(skeleton(F.col("title")), F.lit(" ")).alias("mask")).where("mask <> ''")
    rest = heads.where(~sure).join(recurs.unionByName(named).distinct(), ["doc_id", "mask"], "left_semi")
    return heads.where(sure).select(*LINE).unionByName(rest.select(*LINE)).distinct()


def divided(found: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(tbl, row_id, line_no, next_no, joined) of `suspects` whose last word goes on in the next one; `joined` is the whole word, set right."""
    at = found.where("last <> '' and next_first <> ''").select(*LINE, "next_no", "last", "next_first").distinct()
    hanging = F.lower("next_first").isin(*_HANGING)
    parts = at.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat("last", "next_first").alias("word")),
        F.struct(F.lit(1).alias("part"), F.when(~hanging, F.col("last")).alias("word")),
        F.struct(F.lit(2).alias("part"), F.when(~hanging & F.col("next_first").rlike("^[^A-Z]"), F.col("next_first")).alias("word")),
    )).alias("p")).select(*LINE, "next_no", "last", "p.part", "p.word")
    found = lexicon.match(parts).groupBy(*LINE, "next_no", "last").agg(*[F.min(F.when(F.col("part") == n, F.struct(F.lower("word") != F.col("proper"), "proper"))).alias(f"is{n}") for n in range(3)])
    whole, compound = F.col("is0.proper"), F.concat_ws("-", "is1.proper", "is2.proper")
    found = found.where("is0 is not null or is1 is not null and is2 is not null")
    return found.select(*LINE, "next_no", _cased(F.coalesce(whole, compound), F.col("last")).alias("joined"))


def _cased(word: Column, like: Column) -> Column:
    """A small-letter word with capitals as `like` has them."""
    return F.when((F.length(like) > 1) & (F.upper(like) == like) & like.rlike("[A-Z]"), F.upper(word)).when(like.rlike("^[A-Z]"), F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))).otherwise(word)


def _tokens(lexicon: Lexicon) -> Column:
    """The ASCII words with a letter outside the lexicon of a line."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{M}\p{N}\p{Cf}|]+"), F.lit(0))
    return F.filter(lexicon.unknown(words), lambda w: w.rlike(r"^(?=[0-9|]*[A-Za-z])[A-Za-z0-9|]+$"))


def misread_words(found: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(tbl, row_id, line_no, word, proper, before) of `suspects`' words with each lexicon word that they are once set
    right, but for the parts of a divided word; `before` are the words that stand before it in the line."""
    goes_on = (F.col("last") != "") & (F.col("next_first") != "") & ~F.lower("next_first").isin(*_HANGING)
    words = found.select(*LINE, "text", F.regexp_extract("text", _FIRST, 1).alias("first"), F.when(goes_on, F.col("last")).otherwise("").alias("last"), F.explode("words").alias("word"))
    # what stands before a word is looked up where its line lies, for the few words that may be misread
    before = F.expr("array_distinct(transform(filter(sequence(0, size(w) - 1), i -> w[i] = lower(word)), i -> if(i > 0, w[greatest(i - 1, 0)], null)))")
    fit = lexicon.misread(words.where("word <> last")).select(*LINE, "first", "word", "proper", _WORDS(F.col("text")).alias("w"))
    fit = fit.select(*LINE, "first", "word", "proper", before.alias("before")).distinct()
    taken = found.where(goes_on).select("tbl", "row_id", F.col("next_no").alias("line_no"), F.col("next_first").alias("word"), F.col("next_first").alias("first")).distinct()
    return fit.join(taken, [*LINE, "word", "first"], "left_anti").drop("first")


#: A number with letters among its digits.
_MIXED = rf"(?<![\p{{L}}\p{{N}}|.,-])(?=[^ ]*[0-9])(?=[^ ]*[OoIl|SB]){_NUMBER}(?:[.,]{_NUMBER})*(?![\p{{L}}\p{{N}}|-])"


def misread_numbers(found: DataFrame) -> DataFrame:
    """(tbl, row_id, line_no, word, proper) of `suspects`' numbers with letters in place of digits."""
    return found.select(*LINE, F.explode("numbers").alias("word")).distinct().withColumn("proper", _digits(F.col("word")))


_WORDS = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9|]+"), F.lit(0))


def word_uses(pages: DataFrame, cells: DataFrame | None, asked: DataFrame) -> DataFrame:
    """(proper, prev, together): how often each of the words `asked` for (`proper`) follows another one in a line of all
    `pages` and `cells`, scanned or not; null begins a line. Written once.

    The words asked for are counted: up to `LEXICON` they are a literal set, so that only they and their forerunners
    leave the texts; beyond that all words do, and meet them in a join. Few of them make a pattern that passes over most
    lines. Uses are added up before they move.
    """
    head = [r.proper for r in asked.limit(LEXICON + 1).collect()]
    few = len(head) <= LEXICON
    if few and not head:
        return asked.select("proper", F.lit(None).cast("string").alias("prev"), F.lit(0).cast("long").alias("together")).limit(0)
    texts = pages.select(F.col("html").alias("t"), F.lit(True).alias("markup"))
    if cells is not None:
        texts = texts.unionAll(cells.select("text", F.lit(False)))
    lines = texts.select("markup", F.explode(F.split("t", "\n", -1)).alias("line"))
    if len(head) <= PATTERN:
        lines = lines.where(F.col("line").rlike(rf"(?iu)(?<![a-z0-9|])(?:{'|'.join(sorted(head))})(?![a-z0-9|])"))
    words = lines.select(_WORDS(F.when(F.col("markup"), strip_tags(F.col("line"), " ")).otherwise(F.col("line"))).alias("w")).where("size(w) > 0")
    # one look at each word; what is asked for is then put together with its forerunner
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(head) if few else F.lit(True))
    pairs = F.transform(at, lambda i: F.struct(F.get("w", i).alias("proper"), F.get("w", i - 1).alias("prev")))
    uses = words.select(F.inline(pairs)).groupBy("proper", "prev").agg(F.count("*").alias("together"))
    return materialized(uses if few else uses.join(asked, "proper", "left_semi"))


def supported(pages: DataFrame, cells: DataFrame | None, fit: DataFrame) -> DataFrame:
    """`fit` (line, word, proper, before) with one `proper` each: where a misreading has several, the nearest, of these the
    one that follows the same word most often in all texts, then the most frequent, then the first by letter."""
    each = materialized(fit.groupBy(*LINE, "word").agg(F.collect_set("proper").alias("propers"), F.first("before").alias("before")))
    several = each.where("size(propers) > 1").withColumn("proper", F.explode("propers"))
    uses = word_uses(pages, cells, several.select("proper").distinct())
    alone = uses.groupBy("proper").agg(F.sum("together").alias("alone"))
    # a word that never follows this one still counts by itself
    weighed = several.withColumn("prev", F.explode_outer("before")).join(uses, ["proper", "prev"], "left").join(alone, "proper", "left")
    best = F.min_by("proper", F.struct(F.levenshtein(F.lower("word"), F.col("proper")), -F.coalesce("together", F.lit(0)), -F.coalesce("alone", F.lit(0)), "proper"))
    chosen = weighed.groupBy(*LINE, "word").agg(best.alias("proper"))
    return each.where("size(propers) = 1").select(*LINE, "word", F.col("propers")[0].alias("proper")).unionAll(chosen)


def repairs(pages: DataFrame, cells: DataFrame | None, titles: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(tbl, row_id, line_no, fixes, joined, out): what there is to mend in each line that has something: `fixes` (word,
    proper), the divided word that begins here, whole, and whether the line is furniture. Written once."""
    found = suspects(text_table(pages, cells), lexicon)
    fixes = supported(pages, cells, misread_words(found, lexicon)).select(*LINE, "word", _cased(F.col("proper"), F.col("word")).alias("proper"))
    fix = F.struct("word", "proper").alias("fix")
    none, no_fix = F.lit(None).cast("string").alias("joined"), F.lit(None).cast("struct<word:string,proper:string>").alias("fix")
    known = (
        fixes.unionByName(misread_numbers(found)).select(*LINE, fix, none, F.lit(False).alias("out"))
        .unionAll(divided(found, lexicon).select(*LINE, no_fix, "joined", F.lit(False)))
        .unionAll(furniture(found, titles).select(*LINE, no_fix, none, F.lit(True)))
    )
    return materialized(known.groupBy(*LINE).agg(F.array_sort(F.collect_set("fix")).alias("fixes"), F.max("joined").alias("joined"), F.max("out").alias("out")))


def find_noise(pages: DataFrame, cells: DataFrame, titles: DataFrame, words: DataFrame) -> DataFrame:
    """(tbl, row_id, line_no, kind) for the lines of pages and table cells that `repairs` mends; each once per kind."""
    kinds = F.array(F.when(F.col("out"), "furniture"), F.when(~F.col("out") & F.col("joined").isNotNull(), "break"), F.when(~F.col("out") & (F.size("fixes") > 0), "misread"))
    mended = repairs(pages, cells, titles, Lexicon(words))
    return mended.select(*LINE, F.explode(F.array_compact(kinds)).alias("kind"))


# By whether a line has markup.
_INDENT = {True: r"^(?:\s*<[^<>]*>)*(?:&nbsp;|&#160;|&#xa0;|\u00a0|\t|  )", False: r"^(?:\u00a0|\t|  )"}
#: Up to so many row ids are broadcast.
BROADCAST = 1_000_000


def paragraphs(pages: DataFrame, titles: DataFrame, words: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(tbl, row_id, paragraph, text) of the scans among `pages`, all other pages in which there is something to mend,
    and all `cells`: without furniture (pages only), words whole and set right, reflowed.

    A paragraph begins at an indented line and at a row's first line. What is known of a row's lines comes to the row
    as one small map, so a row moves once, to its row_id; lines, windows and paragraphs are made where it then lies.
    Pages with nothing to mend stay where they are. Rows delivered twice under one row_id count once (the first in order
    of their columns).
    """
    mended = repairs(pages, cells, titles, Lexicon(words))
    known = mended.groupBy("tbl", "row_id").agg(F.map_from_entries(F.collect_list(F.struct("line_no", F.struct("fixes", "joined", "out").alias("at")))).alias("known"))
    rows = mended.where("tbl = 'pages'").select("row_id").distinct()
    some = F.broadcast(rows) if rows.count() <= BROADCAST else rows
    read = pages.where("html is not null")
    read = read.where(is_scan()).unionAll(read.where(~F.coalesce(is_scan(), F.lit(False))).join(some, "row_id", "left_semi").select(*read.columns))
    # moved first, so that texts are sorted once, where they then lie
    once = read.repartition("row_id").groupBy("row_id").agg(F.min(F.struct("doc_id", "page_no", "html")).alias("p")).select("row_id", F.col("p.html").alias("text"))
    out = _reflowed(once, known, "pages")
    if cells is None:
        return out
    once = cells.where("text is not null").repartition("row_id").groupBy("row_id").agg(F.min("text").alias("text"))
    return out.unionAll(_reflowed(once, known, "table_cells"))


def _reflowed(rows: DataFrame, known: DataFrame, tbl: str) -> DataFrame:
    """(tbl, row_id, paragraph, text) of `rows` (row_id, text), their lines mended as `known` of them."""
    markup = tbl == "pages"
    own = known.where(F.col("tbl") == tbl).drop("tbl")
    lines = rows.join(own, "row_id", "left").select("row_id", "known", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    lines = lines.select("row_id", (F.col("pos") + 1).alias("line_no"), "raw", F.try_element_at("known", F.col("pos") + 1).alias("at")).where("at is null or not at.out")
    lines = _with_text(lines, markup)
    fixed = F.expr(
        r"aggregate(coalesce(at.fixes, array()), text, (t, f) -> regexp_replace(t, concat('(?<![\\p{L}\\p{N}|])\\Q', f.word, '\\E(?![\\p{L}\\p{N}|])'), f.proper))"
    )
    in_row = Window.partitionBy("row_id").orderBy("line_no")
    body = lines.select("row_id", "line_no", fixed.alias("text"), F.col("raw").rlike(_INDENT[markup]).alias("indent"), F.col("at.joined").alias("joined"), F.lag("at.joined").over(in_row).alias("after"))
    text = F.when(F.col("after").isNotNull(), F.regexp_replace("text", r"^[^\p{L}\p{N}|]*[\p{L}\p{N}|]+", "")).otherwise(F.col("text"))
    text = F.when(F.col("joined").isNotNull(), F.concat(F.regexp_replace(text, rf"[\p{{L}}\p{{N}}|]+[{_HYPHENS}]$", ""), "joined")).otherwise(text)
    begins = (F.row_number().over(in_row) == 1) | F.col("indent") & F.col("after").isNull()
    body = body.select("row_id", "line_no", text.alias("text"), "after", begins.cast("int").alias("begins"))
    body = body.withColumn("paragraph", F.sum("begins").over(in_row))
    piece = F.concat(F.when(F.col("after").isNull() & (F.col("begins") == 0), " ").otherwise(""), "text")
    whole = body.withColumn("piece", piece).groupBy("row_id", "paragraph").agg(F.expr("listagg(piece, '') within group (order by line_no)").alias("text"))
    return whole.select(F.lit(tbl).alias("tbl"), "row_id", "paragraph", "text")
