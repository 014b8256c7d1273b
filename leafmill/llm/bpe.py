"""Byte-level BPE encoding of a whole corpus with a public vocabulary (problem 6).

Each text is cut into pretokens; each pretoken's bytes form a doubly linked list of symbols, and a heap of merge ranks
gives the next pair to merge. A merge leaves the heap alone: entries whose symbols have changed since are stale and are
skipped when they come up. Decoding concatenates the vocabulary's byte strings.

The encoder runs in Arrow batches (`mapInArrow`): a narrow projection, no shuffle. Pretokens repeat heavily, so each
Python worker keeps the ids of pretokens it has merged; the cache is emptied when it reaches `CACHE` entries, which
changes speed only, never a result.

Defined results: null and empty texts have the empty list of ids (0 tokens). No special token is added, and strings
that look like special tokens are ordinary text. The whole text is encoded, whatever its length. Rows are kept as they
come: repeated rows give repeated results. Lone surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie, and which one is used unless a caller names another.
TOKENIZERS = os.environ.get("LEAFMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Pretokens whose ids a worker remembers at once.
CACHE = 1 << 18

# The pretoken pattern of the vocabulary; \s of it is Unicode's White_Space, spelled out for `regex`.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
# The same over ASCII, where the standard library's matcher is faster.
_ASCII = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


class Encoder:
    """Encodes with one vocabulary given as ranks of byte strings; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        import re

        import regex

        self.ranks = ranks
        self.strings = {i: b for b, i in ranks.items()}
        self._wide = regex.compile(_PATTERN).findall
        self._narrow = re.compile(_ASCII).findall
        self._seen: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pretoken's bytes."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return (whole,)
        n = len(data)
        symbols: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, size = heappop(queue)
            left = symbols[i]
            if left is None or (j := after[i]) >= n:
                continue
            joined = left + symbols[j]  # type: ignore[operator]
            if len(joined) != size:
                continue  # stale: one of the two has grown since
            symbols[i], symbols[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                right = joined + symbols[k]  # type: ignore[operator]
                if (r := ranks.get(right)) is not None:
                    heappush(queue, (r, i, len(right)))
            if (h := before[i]) >= 0:
                pair = symbols[h] + joined  # type: ignore[operator]
                if (r := ranks.get(pair)) is not None:
                    heappush(queue, (r, h, len(pair)))
        return tuple([ranks[s] for s in symbols if s is not None])

    def pretokens(self, text: str) -> list[str]:
        return self._narrow(text) if text.isascii() else self._wide(text)

    def _known(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        seen = self._seen
        if len(seen) > CACHE:
            seen.clear()
        for p in set(pieces).difference(seen):
            seen[p] = self.merge(p.encode())
        return seen

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = self.pretokens(text)
        return list(chain.from_iterable(map(self._known(pieces).__getitem__, pieces)))

    def count(self, text: str | None) -> int:
        """As many as `encode` gives, without the list."""
        if not text:
            return 0
        pieces = self.pretokens(text)
        return sum(map(len, map(self._known(pieces).__getitem__, pieces)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> Encoder:
    """The encoder of a rank file; one per worker process."""
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>) of every row; see the module for null, empty and odd texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds what a batch's ids take
                part = batch.slice(at, 256)
                ids = pa.array(map(enc.encode, part.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    source = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens int) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for batch in batches:
            n = pa.array(map(enc.count, batch.column(1).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], [key, "n_tokens"])

    source = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, n_tokens int")


def decode(df: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) from (key, ids): the vocabulary's strings one after the other; null ids give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for batch in batches:
            out = pa.array([enc.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], [key, "text"])

    source = df.select(F.col(f"`{key}`"), "ids")
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, text string")
