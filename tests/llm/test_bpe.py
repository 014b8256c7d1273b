import random

import pytest

from leafmill.llm import bpe

ODD = ["", "<|endoftext|>", "it's  two\n\n words\r\n", "naïve 中文 🙂 x", " ", "a  b", "x" * 30_000, "�‍"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_equals_library(library):
    enc, rng = bpe.encoder(), random.Random(5)
    pool = [chr(c) for c in (*range(0x250), 0x85, 0x1680, 0x2028, 0x3000, 0xFEFF, 0x1C, 0x661, 0xB2, 0x301, 0x4E2D, 0x1F642)] + [" "] * 200 + ["'s", "'re"]
    for text in ODD + ["".join(rng.choices(pool, k=rng.randint(1, 20))) for _ in range(3000)]:
        ids = enc.encode(text)
        assert ids == library(text)
        assert enc.count(text) == len(ids)
        assert enc.decode(ids) == text


def test_merge_is_greedy_by_rank():
    enc, rng = bpe.encoder(), random.Random(6)

    def slow(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            ranked = [(enc.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in enc.ranks]
            if not ranked:
                return tuple(enc.ranks[p] for p in parts)
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(500):
        data = bytes(rng.choices(b"abcdeehlo \xc3\xa9", k=rng.randint(1, 25)))
        assert enc.merge(data) == slow(data)


def test_frames(spark):
    rows = [(i, t) for i, t in enumerate([None, *ODD, "again", "again"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as ids", "2 as n_tokens")
    ids = bpe.encode(df)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: bpe.encoder().encode(t) for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()} == {i: bpe.encoder().count(t) for i, t in rows}
    assert {r.doc_id: r.text for r in bpe.decode(ids).collect()} == {i: t or "" for i, t in rows}
    assert bpe.encode(df.limit(0)).collect() == []
