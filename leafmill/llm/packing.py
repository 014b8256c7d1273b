"""Filling containers of fixed capacity by Karmarkar-Karp differencing (problem 7).

Items are spread by a hash over groups whose number follows the corpus (so that a group has about `windows` containers
and at most about `group_items` items); each group is packed in one task. Within a group, every item starts as a
partial partition; the two partial partitions with the greatest imbalance are merged with opposing order, largest
subset to smallest, until one is left. Whenever a subset exceeds the capacity, the number of containers rises and the
differencing starts over. A container count of about `windows` per group bounds the room lost to grouping to well under
one percent, and no task ever sees more than its group.

`exchange`, off unless asked for, is a step that differencing does not have: where a subset exceeds the capacity by the
little that subsets differ, items are exchanged between subsets, and the number rises only if that does not do.

Equal items are counted before the shuffle, so one key or one repeated row can't make a group large.

Defined results: items of size 0 or null size are placed like others and take no room; an item above the capacity is
divided into pieces of exactly the capacity, each with a container to itself, and a rest that is packed like an item;
no other item is divided. Repeated rows are packed each. An empty table gives no rows. A negative size counts as 0.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.state import materialized


#: So many equal rows are expanded at a time.
COPIES = 100_000


def partition(sizes: list[int], k: int) -> list[list[int]]:
    """Multiway differencing: the positions of `sizes` in k subsets of near-equal sums.

    A partial partition is kept as its non-empty subsets, largest first; a subset is a sum and a tree of positions.
    """
    if not sizes:
        return [[] for _ in range(k)]

    def imbalance(part: list) -> int:
        return part[0][0] - (part[-1][0] if len(part) == k else 0)

    queue = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    if k == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(queue)
    serial = len(sizes)
    while len(queue) > 1:
        a, b = heapq.heappop(queue)[2], heapq.heappop(queue)[2]
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the smallest `over` of each meet: the largest of these of one with the smallest of the other
            x, y = a[len(a) - over :], b[len(b) - over :]
            merged = a[: len(a) - over] + b[: len(b) - over] + [(p[0] + q[0], (p[1], q[1])) for p, q in zip(x, reversed(y))]
        merged.sort(key=lambda s: -s[0])
        heapq.heappush(queue, (-imbalance(merged), serial, merged))
        serial += 1
    subsets = []
    for _, tree in queue[0][2]:
        positions, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                positions.append(node)
        subsets.append(positions)
    return subsets + [[] for _ in range(k - len(subsets))]


def settle(sizes: np.ndarray, where: np.ndarray, k: int, capacity: int) -> np.ndarray | None:
    """`where` (an item's subset of k) with items exchanged until no subset exceeds the capacity, or None.

    Differencing leaves subsets that differ by a little; at a tight count some are over by that little. The fullest
    gives an item for a smaller one of a subset with room: the least exchange that suffices, else the largest possible.
    After four exchanges a subset it gives up, which costs a container and no more.
    """
    where, load = where.copy(), np.bincount(where, weights=sizes, minlength=k).astype(np.int64)
    for _ in range(4 * k):
        fullest = int(load.argmax())
        excess = load[fullest] - capacity
        if excess <= 0:
            return where
        mine, others = np.flatnonzero(where == fullest), np.flatnonzero(where != fullest)
        gain = sizes[mine][:, None] - sizes[others][None, :]
        fits = (gain > 0) & (gain <= capacity - load[where[others]][None, :])
        if not fits.any():
            return None
        enough = fits & (gain >= excess)
        at = np.where(enough, gain, np.iinfo(np.int64).max).argmin() if enough.any() else np.where(fits, gain, -1).argmax()
        i, j = mine[at // len(others)], others[at % len(others)]
        moved = sizes[i] - sizes[j]
        load[fullest] -= moved
        load[where[j]] += moved
        where[i], where[j] = where[j], where[i]
    return None


def assign(sizes: list[int], capacity: int, exchange: bool = False) -> list[int]:
    """The container, from 0, of each item; no container holds more than `capacity`. Sizes are at most `capacity`."""
    out = [0] * len(sizes)
    full = [i for i, s in enumerate(sizes) if s >= capacity]
    for n, i in enumerate(full):
        out[i] = n
    rest = [i for i, s in enumerate(sizes) if s < capacity]
    if not rest:
        return out
    own = [sizes[i] for i in rest]
    k = max(1, -(-sum(own) // capacity), sum(2 * s > capacity for s in own))
    lengths = np.array(own, dtype=np.int64)
    while True:
        placed = np.zeros(len(own), dtype=np.int64)
        for n, subset in enumerate(partition(own, k)):
            placed[subset] = n
        load = np.bincount(placed, weights=lengths, minlength=k).astype(np.int64)
        excess = int(np.maximum(load - capacity, 0).sum())
        settled = placed if not excess else settle(lengths, placed, k, capacity) if exchange else None
        if settled is not None:
            break
        k += max(1, excess // capacity)
    for i, n in zip(rest, settled.tolist()):
        out[i] = len(full) + n
    return out


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", windows: int = 256, group_items: int = 20_000, exchange: bool = False) -> DataFrame:
    """Each item's container: (key, copy_no, piece_no, container_id, piece_start, piece_size).

    `copy_no` numbers equal rows from 1; `piece_no` numbers an item's pieces from 1, and `piece_start` is where a piece
    begins in the item. Containers are numbered group by group: container_id = group * 2**20 + place in the group.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    counted = materialized(
        items.select(F.col(f"`{key}`").alias("key"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("size"))
        .groupBy("key", "size").agg(F.count("*").alias("copies"))
    )
    total = counted.agg(F.sum(F.col("copies") * F.col("size")).alias("size"), F.sum("copies").alias("items"), F.max("copies").alias("most")).first()
    groups = max(1, -(-(total["size"] or 0) // (capacity * windows)), -(-(total["items"] or 0) // group_items))
    long = lambda x: F.lit(x).cast("long")
    whole = counted.withColumn("first", long(1)).withColumn("last", F.col("copies"))
    if (total["most"] or 0) > COPIES:  # a row repeated that often is expanded by several tasks
        chunks = counted.select("key", "size", "copies", F.explode(F.sequence(long(0), F.expr(f"(copies - 1) div {COPIES}"))).alias("chunk"))
        whole = chunks.withColumn("first", F.col("chunk") * COPIES + 1).withColumn("last", F.least("copies", (F.col("chunk") + 1) * COPIES)).repartition("key", "size", "chunk")
    pieces = (
        whole.select("key", "size", F.explode(F.sequence("first", "last")).alias("copy_no"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(size - 1) div {capacity}")))).alias("piece"))
        .select(
            "key", "copy_no", (F.col("piece") + 1).cast("int").alias("piece_no"),
            (F.col("piece") * capacity).alias("piece_start"),
            F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity).alias("piece_size"),
            F.pmod(F.xxhash64("key", "size", "copy_no", "piece"), F.lit(groups)).cast("int").alias("group"),
        )
    )

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["piece_size", "key", "copy_no", "piece_no"], ascending=[False, True, True, True])
        places = assign(group["piece_size"].tolist(), capacity, exchange)
        group["container_id"] = group["group"].astype("int64") * 2**20 + places
        return group[["key", "copy_no", "piece_no", "container_id", "piece_start", "piece_size"]]

    kind = items.schema[key].dataType.simpleString()
    # partitions by the number of groups, not by their bytes: packing costs time, not memory; beyond 10,000 tasks, which
    # keep any cluster busy, a task has several groups, one after the other
    placed = pieces.repartition(min(groups, 10_000), "group").groupBy("group").applyInPandas(
        place, f"key {kind}, copy_no long, piece_no int, container_id long, piece_start long, piece_size long"
    )
    return placed.withColumnRenamed("key", key)
