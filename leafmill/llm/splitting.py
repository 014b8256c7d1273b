"""Cutting oversized texts into overlapping pieces along their structure (problem 4).

A text above the limit is read as a tree: headings open sections by their level, block elements (lists, rows, cells,
paragraphs ...) nest inside these, blank lines and lines divide blocks, sentences lines, words sentences. Only nodes
above the limit are entered; what comes back from below is merged with its neighbours, in order and up to the limit,
at every level on the way up. A word longer than the limit is cut anywhere. Markup tags and entities are never cut
unless one alone exceeds the limit.

Pieces are slices of the text: `start` to `end`, of which `start` to `body_start` repeats the piece before (about
`overlap` characters, from the next word on), so the bodies joined in order are the text. Texts up to the limit are
filtered out in the scan and never reach Python; the rest runs in Arrow batches without a shuffle. What is repeated
begins within a tag only where a tag longer than the overlap is all that stands before.

Defined results: null, empty and short texts give no pieces; positions count characters (code points) from 0;
repeated rows give their pieces each time. `overlap` must be below half the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 8_000, 200

# Elements that stand as blocks.
_BLOCKS = frozenset("address article aside blockquote body caption dd div dl dt figure footer form head header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*>|&[A-Za-z0-9#]{1,32};|\n[^\S\n]*\n\s*|^#{1,6} ", re.M)
_LINE, _SENTENCE, _WORD = (re.compile(p) for p in (r"\n", r"[.!?…。！？][\"'”’»)\]]*\s*(?=\s|[^\s.!?…。！？\"'”’»)\]])", r"\s+"))
#: Levels: headings 1 to 6, blank lines, blocks by how deep they nest, and behind all of these the ends of headings.
_BLANK, _BLOCK, _FINE = 7, 8, 1 << 40


def _outline(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(position, level) of every structural boundary, lower levels dividing higher ones, and the spans not to cut."""
    cuts: list[tuple[int, int]] = []
    whole: list[tuple[int, int]] = []
    depth = 0
    for m in _TAG.finditer(text):
        if m[0][0] == "\n":
            cuts.append((m.end(), _BLANK))
            continue
        if m[0][0] == "#":
            cuts.append((m.start(), len(m[0]) - 1))
            continue
        whole.append(m.span())
        name = (m[2] or "").lower()
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            if m[1]:
                cuts.append((m.end(), _FINE))
            else:
                cuts.append((m.start(), int(name[1])))
        elif name in _BLOCKS:
            if m[1]:
                depth = max(0, depth - 1)
                cuts.append((m.end(), _BLOCK + depth))
            else:
                cuts.append((m.start(), _BLOCK + depth))
                depth += name != "hr"
    return cuts, whole


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, body_start, end) of the pieces of a text; one piece if it is within the limit."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be below half the limit")
    room = limit - overlap
    cuts, whole = _outline(text)
    begins = [a for a, _ in whole]

    def free(position: int) -> bool:
        i = bisect_right(begins, position) - 1
        return i < 0 or position >= whole[i][1] or position == whole[i][0]

    by_level: dict[int, list[int]] = {}
    for position, level in sorted(cuts):
        by_level.setdefault(level, []).append(position)
    levels = sorted(by_level)

    def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in parts:
            if out and b - out[-1][0] <= room:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def between(a: int, b: int, at: list[int]) -> list[tuple[int, int]]:
        edges = [a, *(p for p in dict.fromkeys(at) if a < p < b), b]
        return list(zip(edges, edges[1:]))

    def divide(a: int, b: int, step: int) -> tuple[int, list[int]]:
        """The next step at which a node can be divided, and where: levels of structure, then lines, sentences, words."""
        while step < len(levels):
            at = by_level[levels[step]]
            at = at[bisect_right(at, a) : bisect_left(at, b)]
            if at:
                return step, at
            step += 1
        while step < len(levels) + 3:
            at = [m.end() for m in (_LINE, _SENTENCE, _WORD)[step - len(levels)].finditer(text, a, b) if a < m.end() < b and free(m.end())]
            if at:
                return step, at
            step += 1
        return step, []

    def anywhere(a: int, b: int) -> list[int]:
        at, p = [], a
        while b - p > room:
            q = p + room
            i = bisect_right(begins, q) - 1
            if i >= 0 and whole[i][0] < q < whole[i][1] and whole[i][0] > p:
                q = whole[i][0]
            at.append(q)
            p = q
        return at

    def pack() -> list[tuple[int, int]]:
        """The parts of the text within the room. A stack of its own, as markup may nest deeper than calls can."""
        done: list[list[tuple[int, int]]] = [[]]
        todo: list[tuple[int, int, int] | None] = [(0, len(text), 0)]
        while todo:
            node = todo.pop()
            if node is None:  # all below a node is done
                parts = done.pop()
                done[-1] += merged(parts)
                continue
            a, b, step = node
            if b - a <= room:
                done[-1].append((a, b))
                continue
            step, at = divide(a, b, step)
            if not at:
                done[-1] += between(a, b, anywhere(a, b))
                continue
            done.append([])
            todo.append(None)
            todo += [(x, y, step + 1) for x, y in reversed(between(a, b, at))]
        return done[0]

    pieces = []
    for a, b in pack():
        start = a
        if a and overlap:
            start = next((m.end() for m in _WORD.finditer(text, max(0, a - overlap), a) if m.end() < a and free(m.end())), max(0, a - overlap))
            if not free(start) and free(a):  # inside a tag: from behind it, unless only the tag is there to repeat
                behind = whole[bisect_right(begins, start) - 1][1]
                start = behind if behind < a else start
        pieces.append((start, a, b))
    return pieces


def split_items(items: DataFrame, keys: tuple[str, ...], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys, piece_no, start, body_start, end, piece) of every item of `items` longer than `limit`."""
    source = items.where(F.length(F.col(f"`{text}`")) > limit).select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__text"))
    names = [*keys, "piece_no", "start", "body_start", "end", "piece"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # an item's pieces at a time bound the memory
                content = batch.column(len(keys))[row].as_py()
                pieces = cut(content, limit, overlap)
                fixed = [pa.array([batch.column(i)[row].as_py()] * len(pieces), batch.column(i).type) for i in range(len(keys))]
                numbers = [pa.array(n, pa.int32()) for n in (range(1, len(pieces) + 1), *zip(*pieces))]
                yield pa.RecordBatch.from_arrays([*fixed, *numbers, pa.array([content[a:c] for a, _, c in pieces])], names)

    return source.mapInArrow(run, f"{schema}, piece_no int, start int, body_start int, end int, piece string")
