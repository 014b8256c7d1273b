"""One consistent form for text that looks the same (problem 3).

Every distinct text is mapped to a form without invisible characters, with one kind of space, with wide, narrow and
ligature characters in their plain spelling, and with look-alike letters of other scripts as Latin ones. Which letters
look alike is by rule: those whose Unicode skeleton is that of one ASCII letter of their case, as the ICU that Spark
ships with tells for some 60,000 letters, and a short list before it. Forms are then
grouped under ICU's accent- and case-sensitive Unicode collation, which also equates composed and decomposed accents
and ignores what has no weight. Each class has one canonical member, and it is joined back to every text.

Scale: texts are counted with map-side aggregation before anything else moves, so a text that makes up a third of the
rows is one row from there on; the join back to the rows is on the text, and adaptive execution splits a hot one.
All work is built-in expressions.

What shows (and so separates classes): case, accents, letters, words, digits, the length of dashes, and spaces between
words in number, not in kind. Null texts have no class and are left out; empty and blank texts form a class of their
own. The canonical member is, of a class: a reference label if it has one, else its most frequent text, of equally
frequent ones the first in code point order.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.html import visible_text

# Look-alike letters that a skeleton does not tell, by the Latin letter that they look like.
LOOK_ALIKES = {"N": "\u0546", "Q": "\u051a", "l": "\u04cf", "u": "\u057d\u03c5", "y": "\u03b3\u04af", "i": "\u03b9"}
# Characters without a shape of their own, and hyphens as long as the plain one.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿"
HYPHENS = "‐‑﹣－"


@lru_cache(maxsize=1)
def _look_alikes() -> dict[str, str]:
    """Letters outside ASCII by the ASCII letter that they look like: those of one skeleton, and of one case."""
    session = SparkSession.active()
    checker = session._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    latin = [chr(c) for c in (*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1))]
    # ideographs, syllables and surrogates have no Latin look-alikes
    others = [chr(c) for c in (*range(0x80, 0x3000), *range(0xA000, 0xAC00), *range(0xFB00, 0x12000), *range(0x16F00, 0x17000), *range(0x1E000, 0x20000))]
    others = [c for c in others if unicodedata.category(c)[0] == "L"]
    skeletons = checker.getSkeleton(0, "\n".join(latin + others)).split("\n")
    own: dict[str, list[str]] = {}
    for char, skeleton in zip(latin, skeletons):
        own.setdefault(skeleton, []).append(char)
    found = {}
    for char, skeleton in zip(others, skeletons[len(latin) :]):
        if skeleton in own:
            found[char] = min(own[skeleton], key=lambda x: x.islower() != (unicodedata.category(char) == "Ll"))
    return found | {other: letter for letter, each in LOOK_ALIKES.items() for other in each}


@lru_cache(maxsize=1)
def _maps() -> tuple[str, str, dict[str, str]]:
    """Characters and what `translate` puts for them (nothing, for the rest of the first), and ligatures, by rule."""
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    for point in range(0x80, 0x20000):
        char = chr(point)
        kind = unicodedata.decomposition(char).split(" ")[0]
        if unicodedata.category(char) == "Zs":
            one[char] = " "
        elif kind in ("<wide>", "<narrow>", "<font>") or 0xFB00 <= point <= 0xFB06:
            plain = unicodedata.normalize("NFKC", char)
            (one if len(plain) == 1 else several)[char] = plain
    one |= dict.fromkeys("\t\n\r\x0b\x0c\x85\u2028\u2029", " ") | dict.fromkeys(HYPHENS, "-")
    latin = _look_alikes()
    one |= {c: x for c, x in latin.items() if c not in one}
    for point in range(0x370, 0x530):  # accented look-alikes keep their accent
        bare, marks = unicodedata.normalize("NFD", chr(point))[:1], unicodedata.normalize("NFD", chr(point))[1:]
        if marks and bare in latin and len(whole := unicodedata.normalize("NFC", latin[bare] + marks)) == 1:
            one[chr(point)] = whole
    for char in INVISIBLE:
        one.pop(char, None)
    return "".join(one) + INVISIBLE, "".join(one.values()), several


def form(text: Column) -> Column:
    """The look-alike-mapped form of a text; null stays null."""
    chars, plain, several = _maps()
    mapped = F.translate(text, chars, plain)
    for char, letters in several.items():
        mapped = F.replace(mapped, F.lit(char), F.lit(letters))
    return F.trim(F.when(text.rlike(r"[^\x20-\x7e]"), mapped).otherwise(text))


def canonical_members(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, canonical) for each distinct non-null `text` of `texts`; `labels` has the preferred texts (`label`)."""
    counted = texts.select("text").where("text is not null").groupBy("text").agg(F.count("*").alias("n"), F.lit(1).alias("rank"))
    preferred = labels.select(F.col("label").alias("text")).where("text is not null").distinct()
    keyed = counted.unionByName(preferred.select("text", F.lit(0).cast("long").alias("n"), F.lit(0).alias("rank")))
    keyed = keyed.withColumn("look", F.collate(form(F.col("text")), "UNICODE"))
    classes = keyed.groupBy("look").agg(F.min(F.struct("rank", -F.col("n"), "text")).alias("best"))
    classes = classes.select("look", F.col("best.text").alias("canonical"))
    return keyed.where("rank = 1").join(classes, "look").select("text", "canonical")


def unified(texts: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("tbl", "row_id")) -> DataFrame:
    """(keys, text, canonical) for each non-null text: the one string that stands for all that look like it."""
    return texts.join(canonical_members(texts, labels), "text").select(*keys, "text", "canonical")


def look_like_labels(texts: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("tbl", "row_id")) -> DataFrame:
    """(keys, ref_id) for each text that looks like a label and is another string; `labels` has (ref_id, label)."""
    members = canonical_members(texts, labels).where("text <> canonical")
    refs = labels.select("ref_id", F.col("label").alias("canonical")).where("canonical is not null").distinct()
    found = members.join(refs, "canonical").select("text", "ref_id")
    return texts.join(found, "text").select(*keys, "ref_id").distinct()


def headings(pages: DataFrame, key: str = "row_id", html: str = "html") -> DataFrame:
    """(key, text) of each h2, h3 and h4 in a page, without tags and with entities decoded."""
    found = F.regexp_extract_all(F.col(f"`{html}`"), F.lit(r"(?is)<h([234])\b[^>]*>(.*?)</h\1\s*>"), F.lit(2))
    return pages.where(F.col(f"`{html}`").rlike("<[hH][234]")).select(F.col(f"`{key}`"), F.explode(found).alias("text")).withColumn("text", visible_text(F.col("text")))
