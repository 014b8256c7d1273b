import random
from collections import Counter, defaultdict
from itertools import product

from leafmill.llm import packing


def test_partition_is_near_equal_and_whole():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 40):
        sizes = [rng.randint(0, 1000) for _ in range(200)]
        subsets = packing.partition(sizes, k)
        assert len(subsets) == k and sorted(p for s in subsets for p in s) == list(range(200))
        sums = [sum(sizes[p] for p in s) for s in subsets]
        assert max(sums) - min(sums) <= max(sizes) // 4
    assert packing.partition([], 3) == [[], [], []]


def test_container_count_against_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.randint(1, 10) for _ in range(6)]
        best = min(
            len(set(a)) for a in product(range(6), repeat=6)
            if max(Counter({c: sum(s for s, x in zip(sizes, a) if x == c) for c in set(a)}).values()) <= 10
        )
        for exchange in (False, True):
            load = Counter()
            for s, c in zip(sizes, packing.assign(sizes, 10, exchange)):
                load[c] += s
            assert max(load.values()) <= 10 and len(load) <= best + 1


def packed(spark, rows, capacity, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int").selectExpr("*", "1 as key", "2 as size", "3 as container_id")
    return packing.pack(df, capacity, **kw).collect()


def test_whole_result(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.lognormvariate(4, 1))) for i in range(3000)] + [(9001, None), (9002, 0), (9003, 25_000), (9004, 1000), (9005, -4)]
    rows += [(9010, 50)] * 1500  # a third of the rows is one repeated row
    got = packed(spark, rows, 1000, windows=32)
    load, pieces = Counter(), defaultdict(list)
    for r in got:
        load[r.container_id] += r.piece_size
        pieces[r.doc_id, r.copy_no, r.piece_no].append((r.piece_start, r.piece_size))
    assert max(load.values()) <= 1000
    assert all(len(p) == 1 for p in pieces.values())
    assert sum(load.values()) == sum(max(0, n or 0) for _, n in rows)
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    assert [sorted(v)[0] for k, v in sorted(pieces.items()) if k[0] == 9003] == [(i * 1000, 1000) for i in range(25)]
    assert sum(r.piece_no > 1 for r in got) == sum(-(-(n or 1) // 1000) - 1 for _, n in rows if (n or 0) > 1000)
    assert sum(load.values()) / 1000 / len(load) > 0.93
    assert len({r.container_id for r in packed(spark, rows, 1000, windows=32, exchange=True)}) <= len(load)
    assert sum(1 for r in got if r.doc_id == 9010) == 1500


def test_empty_table_and_only_zeroes(spark):
    assert packed(spark, [], 10) == []
    assert len(packed(spark, [(1, 0), (1, 0), (2, None)], 10)) == 3


def test_a_row_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 7)
    got = packed(spark, [(1, 3)] * 50 + [(2, 5)] * 7 + [(3, 25)], 10)
    assert sorted((r.doc_id, r.copy_no) for r in got if r.doc_id < 3) == [(1, i) for i in range(1, 51)] + [(2, i) for i in range(1, 8)]
    load = Counter()
    for r in got:
        load[r.container_id] += r.piece_size
    assert max(load.values()) <= 10 and sum(load.values()) == 50 * 3 + 35 + 25
