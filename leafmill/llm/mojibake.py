"""Text decoded with the wrong character encoding: finding and restoring it (problem 8).

Round trips: the non-ASCII runs of a text are encoded again under a legacy encoding and strictly decoded as UTF-8. A
round trip is kept if it makes the run clearly cheaper by a cost of garbling (unassigned and control characters, symbols
within words, capitals after small letters, scripts mixed in a word, rare letters). This repeats until nothing is
gained, so nested layers come off one by one however many there are; each makes the run shorter, so it ends.

Where words stay implausible, pairs of legacy encodings are tried. The evidence for a pair is pooled over the distinct
words of the whole document, so short lines count with the rest; a few characters alone must show what no right text
shows (see `_convincing`). The pair with the greatest gain is then applied to the words that it makes cheaper, and
the rest is looked at again, so a text that is wrong in part, or in parts differently, is restored
in these parts only. Letters must stay letters, of one script in a word: a reading that turns words to symbols is none.

A text counts as garbled if a round trip was kept, or if it holds what only a wrong decoder writes: U+FFFD or C1
controls (a lone U+0085, a line end on some systems, is none).

Texts of ASCII and of single accents are filtered out in the scan; the rest runs in Arrow batches, without a shuffle,
over whole texts. The work on a text is bounded by its length times the encodings and layers.

Defined results: null and empty texts are not garbled and stay as they are; what cannot be restored stays as it is, as
does a lone word of fewer than four foreign letters, which proves nothing; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The encodings that text is commonly mistaken for; "western" is Windows-1252 with Latin-1's controls.
LEGACY = ("western", "cp1250", "cp1251", "cp1253", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "iso8859_2", "iso8859_7", "cp1254", "cp1257", "mac_latin2")
_INTENDED = ("western", "cp1251", "cp1253", "cp1250", "iso8859_2", "koi8_r", "cp866", "mac_roman", "cp437")
_MISTAKEN = ("western", "cp1251", "cp1250", "cp1253", "koi8_r", "cp866", "cp437", "mac_roman")
_PAIRS = [(a, b) for a in _MISTAKEN for b in _INTENDED if a != b]
_CYRILLIC = [(a, b) for a, b in _PAIRS if {a, b} <= {"cp1251", "koi8_r", "cp866"}]
#: A round trip is kept if it leaves at most this share of the cost.
KEEP = 0.67
#: Runs up to this length are remembered; longer ones hardly repeat and would take memory.
CACHED = 200


@lru_cache(maxsize=None)
def _upper(encoding: str) -> dict[int, int]:
    """The code points that an encoding's bytes 0x80 to 0xFF stand for, with those bytes."""
    name = "cp1252" if encoding == "western" else encoding
    to: dict[int, int] = {b: b for b in range(0x80, 0xA0)} if encoding == "western" else {}
    for b in range(0x80, 0x100):
        try:
            to[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            to[b] = b
    return to


@lru_cache(maxsize=None)
def _runs(encoding: str) -> tuple[re.Pattern, re.Pattern]:
    """Runs of an encoding's upper half, and those that begin like UTF-8 read in it."""
    to = _upper(encoding)
    every = "".join(map(re.escape, map(chr, to)))
    lead = "".join(re.escape(chr(c)) for c, b in to.items() if 0xC2 <= b <= 0xF4)
    rest = "".join(re.escape(chr(c)) for c, b in to.items() if b < 0xC0)
    return re.compile(f"[{every}]{{2,}}"), re.compile(f"[{lead}][{rest}]")


_WRONG = re.compile("[\x80-\x84\x86-\x9f�]")
_FOREIGN = re.compile("[^\x00-\x7f]+")
_MARKS = set("\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030b\u030c\u0327\u0328")
# How often Russian and Greek texts use a letter, in percent.
_OFTEN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (11.0, 8.5, 8.0, 7.4, 6.7, 6.3, 5.5, 4.7, 4.5, 4.4, 3.5, 3.2, 3.0, 2.8, 2.6, 2.0, 1.9, 1.7, 1.7, 1.6, 1.6, 1.4, 1.2, 1.0, 0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.3, 0.1, 1.0)))
_OFTEN |= dict(zip("αοιετσνηυρπκμλςωγδθχφβξζψάέήίόύώϊϋΐΰ", (10.0, 8.0, 7.0, 7.0, 8.5, 5.0, 6.5, 4.5, 4.0, 4.3, 4.0, 4.0, 3.4, 3.0, 4.0, 2.0, 1.8, 1.7, 1.3, 1.2, 0.9, 0.8, 0.6, 0.4, 0.2, 2.5, 2.0, 2.0, 2.5, 2.5, 1.5, 1.0, 0.1, 0.1, 0.05, 0.05)))
_IN_WORD = set("’‘'·-–­​‌‍")


def _letter(char: str) -> float:
    return 1.0 + 0.35 * max(0.0, math.log(4 / _OFTEN.get(char.lower(), 1.0)))


@lru_cache(maxsize=70_000)
def _kind(char: str) -> tuple[str, float]:
    """A script or '' for what is no letter, and the cost of a character in good company."""
    c, category = ord(char), unicodedata.category(char)
    if c < 0x80:
        return ("latin" if char.isalpha() else "", 0.0)
    if category in ("Cc", "Cn", "Co", "Cs") or char == "�":
        return "", 6.0
    if category.startswith("M"):
        return ("mark", 1.0) if char in _MARKS else ("mark", 4.0)
    if category.startswith("L"):
        if char in "ªº":
            return "", 1.0
        if c < 0x180:
            return "latin", 1.0
        if c < 0x250:
            return "latin", 1.5 if 0x218 <= c <= 0x21B else 4.0
        if 0x386 <= c <= 0x3CE:
            return "greek", _letter(char)
        if 0x410 <= c <= 0x44F or c in (0x401, 0x451):
            return "cyrillic", _letter(char)
        if 0x402 <= c <= 0x45F or c in (0x490, 0x491):
            return "cyrillic", 2.0
        if 0x3040 <= c <= 0x30FF or 0x4E00 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3:
            return "cjk", 1.0
        return "other", 4.0
    if 0x2500 <= c <= 0x259F:
        return "", 4.0
    if c < 0x100 or 0x2010 <= c <= 0x203F or c in (0x20AC, 0x2116, 0x2122, 0xFEFF) or 0x3000 <= c <= 0x303F or 0xFF00 <= c <= 0xFF65:
        return "", 1.0
    if 0x2190 <= c <= 0x22FF:
        return "", 1.5
    if 0x1F300 <= c <= 0x1FAFF:
        return "", 1.0
    return "", 4.0


def cost(run: str, before: str = "", after: str = "") -> float:
    """How unlikely a run is as text, between the characters before and after it."""
    total, chars = 0.0, [before, *run, after]
    for i in range(1, len(chars) - 1):
        char, left, right = chars[i], chars[i - 1], chars[i + 1]
        script, own = _kind(char)
        total += own
        ls = _kind(left)[0] if left else ""
        rs = _kind(right)[0] if right else ""
        if script == "mark":
            total += 3.0 * (ls == "")
        elif script:
            if ls and ls != "mark" and ls != script or rs and rs != "mark" and rs != script:
                total += 3.0
            if left == "ς" and ls == script:
                total += 2.0
            if ls == script:
                if char.isupper() and left.islower():
                    total += 2.0
                elif script == "latin" and left > "\x7f":
                    total += 1.5
                elif script == "cyrillic" and char.isupper() and left.isupper():
                    total += 0.4
        elif char not in _IN_WORD and ls and rs and ls != "cjk" and rs != "cjk":
            total += 2.0
        elif left > "\x7f" and ls == "" and char == left and own > 1:
            total += 0.5
    return total


@lru_cache(maxsize=1 << 17)
def _cost(run: str, before: str, after: str) -> float:
    return cost(run, before, after)


def _side(char: str) -> str:
    """What counts of an ASCII neighbour: a small letter, a capital, or neither."""
    return "a" if "a" <= char <= "z" else "A" if "A" <= char <= "Z" else ""


def _utf8_again(run: str, encoding: str, before: str, after: str, last: bool, keep: float = KEEP) -> tuple[float, str]:
    """The gain and the run after decoding what was UTF-8 before it was read in `encoding`, where it costs `keep` of before."""
    every, begin = _runs(encoding)
    if not begin.search(run):
        return 0.0, run
    to, gain, out, at = _upper(encoding), 0.0, [], 0
    for m in every.finditer(run):
        part = m[0]
        if not begin.match(part):
            continue
        data = bytes([to[ord(c)] for c in part])
        try:
            good = data.decode("utf-8")
        except UnicodeDecodeError as e:
            if not last or m.end() != len(run) or e.end != len(data) or not len(data) - 3 <= e.start >= 2:
                continue
            good = data[: e.start].decode("utf-8")  # cut off at the end of the text
        if len(good) == 1 and len(part) > 2 and part.isalpha() and good.isalpha():
            continue  # three letters in a row may be one ideograph by chance
        left, right = run[m.start() - 1] if m.start() else before, run[m.end()] if m.end() < len(run) else after
        old, new = cost(part, left, right), cost(good, left, right)
        # bytes that happen to be two characters of UTF-8 in a row are rare enough to count by themselves
        if new <= max(keep, 0.9 * (len(good) > 1)) * old:
            gain += old - new
            out += [run[at : m.start()], good]
            at = m.end()
    return gain, "".join([*out, run[at:]])


@lru_cache(maxsize=1 << 17)
def _layers(run: str, before: str, after: str, last: bool) -> str:
    """A non-ASCII run with its layers of UTF-8 read in a legacy encoding taken off; runs repeat, so they are kept."""
    while not run.isascii():
        gain, better = max((_utf8_again(run, e, before, after, False) for e in LEGACY), key=lambda x: x[0])
        if not gain and last:
            gain, better = max((_utf8_again(run, e, before, after, True) for e in LEGACY), key=lambda x: x[0])
        if not gain:  # an inner layer may look no better than the outer one: look through it
            through = {r for _, r in (_utf8_again(run, e, before, after, last, math.inf) for e in LEGACY)} - {run}
            found = [better for r in through for g, better in (_utf8_again(r, e, before, after, last) for e in LEGACY) if g]
            better = min(found, key=lambda r: cost(r, before, after), default=run)
            if cost(better, before, after) > KEEP * cost(run, before, after) or better == run:
                break
        run = better
    return run


@lru_cache(maxsize=None)
def _pair(mistaken: str, intended: str) -> dict[int, int]:
    back = {b: c for c, b in _upper(intended).items() if not (0x80 <= c < 0xA0)}
    return {c: back[b] for c, b in _upper(mistaken).items() if b in back and back[b] != c}


#: Words with a foreign character.
_WORD = re.compile("[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
# Typographic marks that no word holds between its letters.
_NEVER_INSIDE = re.compile("(?<=[A-Za-z])[\u201a\u201e\u2030\u02c6\u00a4\u00a6\u00b8](?=[A-Za-z])")
_CAPITAL_INSIDE = re.compile("(?<=[a-z])[\u00c0-\u00d6\u00d8-\u00de]")
_LETTER_INSIDE = re.compile("(?<=[A-Za-z])[\u0370-\u03ff\u0400-\u04ff]+(?=[A-Za-z])")
# Greek and Cyrillic letters that pass for Latin ones, and stand among them for other reasons.
_LOOK_ALIKE = set("\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0423\u0425\u0405\u0406\u0408\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0455\u0456\u0458\u0391\u0392\u0395\u0396\u0397\u0399\u039a\u039c\u039d\u039f\u03a1\u03a4\u03a5\u03a7\u03bf\u03bd\u03b9")


def _foreign_cost(text: str) -> tuple[float, int]:
    """The cost of the foreign runs of a text, and how many characters they have."""
    total, n = 0.0, 0
    for m in _FOREIGN.finditer(text):
        a, b = m.span()
        total += (_cost if b - a <= CACHED else cost)(m[0], _side(text[a - 1 : a]) if a else "", _side(text[b : b + 1]))
        n += b - a
    return total, n


def _plausible(old: str, new: str) -> bool:
    """Whether letters stay letters, of one script."""
    kinds = [k for k in (_kind(c)[0] for c in new if c > "\x7f") if k]
    return len(kinds) >= 0.8 * sum(_kind(c)[0] != "" for c in old if c > "\x7f") and len(set(kinds) - {"mark"}) < 2 and "other" not in kinds


def _tells(word: str) -> bool:
    """Whether a word can be evidence: letters of another script beside Latin ones are not, if they are look-alikes, or
    Greek ones as formulas have them (unless they stand within a longer word)."""
    if not re.search("[A-Za-z]", word):
        return True
    other = [c for c in word if "\u0370" <= c <= "\u04ff"]
    if other and all(c in _LOOK_ALIKE for c in other):
        return False
    return not any(c < "\u0400" for c in other) or _LETTER_INSIDE.search(word) is not None and len(re.findall("[A-Za-z]", word)) >= 3


def _convincing(mistaken: str, intended: str, better: list[tuple[str, float, int, str, float]]) -> bool:
    """Whether the words that a pair of encodings makes cheaper (word, cost, foreign characters, reading, its cost) prove it.

    From 8 characters on, three of them different, the cost decides: it must fall to 0.55 of what it was, or within
    Cyrillic, where letters alone tell, to 0.78. Fewer must be clear in themselves: a word of 4 foreign letters or more
    and none else, Cyrillic or Greek letters between Latin ones, accented capitals behind small letters that become small
    ones, or marks between letters that become letters.
    """
    old, new, n = sum(b[1] for b in better), sum(b[4] for b in better), sum(b[2] for b in better)
    cyrillic = {mistaken, intended} <= {"cp1251", "koi8_r", "cp866"} and all(_cyrillic(b[0]) for b in better)
    chars = {c for b in better for c in b[0] if c > "\x7f"}
    if n >= 8 and len(chars) >= 3:
        return new < 0.78 * old if cyrillic and all(_cyrillic(b[3]) for b in better) else new < 0.55 * old and new <= 1.4 * n
    if cyrillic:
        return n >= 4 and len(chars) >= 3 and new < 0.65 * old
    if new > 0.55 * old or new > 1.8 * n or old < 1.9 * n:
        return False
    if any(b[2] >= 4 and b[0].isalpha() and not re.search("[A-Za-z]", b[0]) for b in better) and len(chars) >= 3:
        return True
    between = sum(len(m) for b in better for m in _LETTER_INSIDE.findall(b[0]))
    capitals = [b for b in better if _CAPITAL_INSIDE.search(b[0]) and all(c.islower() for c in b[3] if c > "\x7f") and new <= 1.1 * n]
    marks = sum(len(_NEVER_INSIDE.findall(b[0])) for b in better if b[3].isalpha())
    return between >= 2 and len(chars) >= 2 or bool(capitals) or marks >= 2


def _cyrillic(line: str) -> bool:
    letters = [c for c in line if c > "\x7f" and c.isalpha()]
    return sum("\u0400" <= c <= "\u04ff" for c in letters) > 0.8 * len(letters)


def _reread(text: str, table: dict[int, int]) -> str:
    """A text with the words read by another pair that this makes cheaper; words that tell nothing go with those before
    and behind them."""
    words = [(m.span(), m[0], m[0].translate(table)) for m in _WORD.finditer(text)]
    votes: list[bool | None] = []
    for _, old, new in words:
        (a, n), b = _foreign_cost(old), _foreign_cost(new)[0]
        votes.append(False if not _plausible(old, new) else None if abs(a - b) <= 0.35 * n else b < a)
    behind: list[bool | None] = [None] * (len(votes) + 1)
    for i in range(len(votes) - 1, -1, -1):
        behind[i] = votes[i] if votes[i] is not None else behind[i + 1]
    out, at, before = [], 0, None
    for i, ((a, b), _, new) in enumerate(words):
        if votes[i] or votes[i] is None and False not in (before, behind[i]) and (before or behind[i]):
            out += [text[at:a], new]
            at = b
        before = votes[i] if votes[i] is not None else before
    return "".join([*out, text[at:]])


def _legacy_again(text: str) -> str:
    """Lines and words that cost too much, read as another legacy encoding if the document as a whole says so."""
    while True:
        odd = [(w, c, n) for w, (c, n) in ((w, _foreign_cost(w)) for w in dict.fromkeys(_WORD.findall(text))) if c >= 1.4 * n and _tells(w)]
        best, choice = 0.0, None
        for mistaken, intended in _PAIRS if odd else ():
            table, better = _pair(mistaken, intended), []
            for w, c, n in odd:
                read = w.translate(table)
                if read != w:
                    new = _foreign_cost(read)[0]
                    if new <= 0.8 * c and _plausible(w, read):
                        better.append((w, c, n, read, new))
            gain = sum(b[1] - b[4] for b in better)
            if gain > best and _convincing(mistaken, intended, better):
                best, choice = gain, table
        if choice is None:
            return text
        again = _reread(text, choice)
        if _foreign_cost(again)[0] >= _foreign_cost(text)[0]:
            return text
        text = again


_CONTROLS = {b: ord(bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def repair(text: str) -> str:
    """The text with every round trip that makes it cheaper."""
    if text.isascii():
        return text
    end = len(text)

    def fix(m: re.Match) -> str:
        run, (a, b) = m[0], m.span()
        if b - a == 1:
            return run
        layers = _layers if b - a <= CACHED else _layers.__wrapped__
        return layers(run, _side(text[a - 1 : a]) if a else "", _side(text[b : b + 1]), b == end)

    text = _FOREIGN.sub(fix, text)
    if _WRONG.search(text):
        read = text.translate(_CONTROLS)
        if _foreign_cost(read)[0] < _foreign_cost(text)[0]:
            text = read
    return _legacy_again(text)


def garbled(text: str, repaired: str) -> bool:
    return repaired != text or _WRONG.search(text) is not None


#: One accent between ASCII characters is only garbled if it is a capital behind a small letter, a symbol or a letter of
#: another script in a word, or a control. Each branch begins at a foreign character, so that ASCII is passed over fast.
_SUSPECT = (
    "[^\\x00-\\x7f](?:[^\\x00-\\x7f]|(?<=[\\x{80}-\\x{9f}\\x{fffd}])|(?<=[a-z][\\x{c0}-\\x{d6}\\x{d8}-\\x{de}])"
    "|(?<=[A-Za-z][^\\x00-\\x7f\\p{L}\\p{M}’‘–·\\x{ad}])[A-Za-z]|(?<=[A-Za-z][\\x{370}-\\x{4ff}])[A-Za-z])"
)


def repair_texts(df: DataFrame, key: str = "doc_id", text: str = "text", suspects: bool = False) -> DataFrame:
    """(key, text, garbled) of every row; with `suspects` only of rows that could be garbled."""
    source = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text"))
    suspect = (F.octet_length("text") > F.length("text")) & F.col("text").rlike(_SUSPECT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(1).to_pylist()
            new = [repair(t) for t in old]
            flags = pa.array([garbled(a, b) for a, b in zip(old, new)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), flags], [key, "text", "garbled"])

    kind = source.schema[key].dataType.simpleString()
    repaired = source.where(suspect).mapInArrow(run, f"`{key}` {kind}, text string, garbled boolean")
    if suspects:
        return repaired
    return repaired.unionAll(source.where(~F.coalesce(suspect, F.lit(False))).withColumn("garbled", F.lit(False)))
