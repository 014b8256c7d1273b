"""Page geometry: how many columns a page has, and the reading order of its blocks.

Blocks: (doc_id, page_no, block_ord, type, x0, y0, x1, y1, ...). Column counts by the widest gap and by histogram are
window and aggregate expressions; the iterative clustering runs per page on Arrow data, and a page is all that one call sees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PAGE = ["doc_id", "page_no"]
WIDTH = 612.0


def centers(blocks: DataFrame) -> DataFrame:
    """`blocks` with `x` (horizontal middle; null without both sides), `y` (top) and `kind` (type, 'text' if null)."""
    return blocks.withColumn("x", (F.col("x0") + F.col("x1")) / 2).withColumn("y", F.col("y0")).withColumn("kind", F.lower(F.coalesce("type", F.lit("text"))))


def column_counts(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, columns): 2 where the first widest gap between block middles splits the page, else 1.

    A split needs at least 8 blocks with a middle, a gap of 0.3 of their spread (1 at least), 0.3 of the blocks on the
    smaller side, and more than one block behind the gap.
    """
    all_ = centers(blocks)
    total = all_.groupBy(*_PAGE).agg(F.count("*").alias("blocks"))
    at = Window.partitionBy(*_PAGE).orderBy("x", "block_ord")
    gaps = all_.where("x is not null").select(*_PAGE, "x", (F.row_number().over(at) - 1).alias("i"), (F.col("x") - F.lag("x").over(at)).alias("gap"))
    widest = gaps.groupBy(*_PAGE).agg(
        F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("spread"),
        F.max_by(F.struct("i", "gap"), F.struct(F.coalesce("gap", F.lit(-1.0)), -F.col("i"))).alias("w"),
    )
    i, gap = F.col("w.i"), F.col("w.gap")
    two = (F.col("blocks") >= 8) & (F.col("n") >= 8) & (gap > 0) & (i > 0) & (i < F.col("n") - 1)
    two = two & (gap / F.greatest(F.lit(1.0), F.col("spread")) >= 0.3) & (F.least(i, F.col("n") - i) / F.col("n") >= 0.3)
    return total.join(widest, _PAGE, "left").select(*_PAGE, F.when(F.coalesce(two, F.lit(False)), 2).otherwise(1).alias("columns"))


def histogram_split(blocks: DataFrame, width: float = WIDTH) -> DataFrame:
    """(doc_id, page_no, boundary): where an empty bin between fuller ones splits the text blocks of a page in two.

    Needs at least 8 middles, 3 on either side, and 0.08 of the page width between the sides; of several such bins the
    first counts, as does its failure. Pages without a split have no row.
    """
    points = centers(blocks).where("kind = 'text' and x is not null").select(*_PAGE, "x")
    page = points.groupBy(*_PAGE).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("n >= 8 and hi > lo")
    page = page.withColumn("bins", F.least(F.lit(20), F.floor(F.col("n") / 2)).cast("int")).withColumn("step", (F.col("hi") - F.col("lo")) / F.col("bins"))
    filled = points.join(page, _PAGE).select(*_PAGE, "lo", "step", "bins", F.least(F.floor((F.col("x") - F.col("lo")) / F.col("step")).cast("int"), F.col("bins") - 1).alias("bin"))
    full = filled.groupBy(*_PAGE, "lo", "step").agg(F.array_sort(F.collect_set("bin")).alias("bins"))
    # an empty bin with full neighbours: two full bins that are two apart
    first = F.array_min(F.filter("bins", lambda b: F.array_contains("bins", b + 2) & ~F.array_contains("bins", b + 1))) + 1
    valley = full.select(*_PAGE, (F.col("lo") + (first + F.lit(0.5)) * F.col("step")).alias("boundary")).where("boundary is not null")
    sides = points.join(valley, _PAGE).groupBy(*_PAGE, "boundary").agg(
        F.count_if(F.col("x") < F.col("boundary")).alias("l"), F.count_if(F.col("x") > F.col("boundary")).alias("r"),
        F.max(F.when(F.col("x") < F.col("boundary"), F.col("x"))).alias("a"), F.min(F.when(F.col("x") > F.col("boundary"), F.col("x"))).alias("b"),
    )
    return sides.where((F.col("l") >= 3) & (F.col("r") >= 3) & (F.col("b") - F.col("a") >= 0.08 * width)).select(*_PAGE, "boundary")


def cluster(points: np.ndarray, k: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """k groups of points on a line: centres spread evenly first, the nearest (first of equals) takes a point."""
    if len(points) < k:
        return np.arange(len(points)), points.copy()
    lo, hi = points.min(), points.max()
    if lo == hi:
        return np.zeros(len(points), dtype=int), np.array([lo])
    middle = np.linspace(lo, hi, k)
    group = np.zeros(len(points), dtype=int)
    for _ in range(rounds):
        nearest = np.abs(points[:, None] - middle[None, :]).argmin(axis=1)
        if (nearest == group).all():
            break
        group = nearest
        size = np.bincount(group, minlength=k)
        middle = np.where(size > 0, np.bincount(group, weights=points, minlength=k) / np.maximum(size, 1), middle)
    return group, middle


def silhouette(points: np.ndarray, group: np.ndarray) -> float:
    """The mean silhouette of a grouping on a line; 0 for a single group.

    Distances to sorted groups come from prefix sums, so that it is O(n k log n), not O(n^2).
    """
    labels = np.unique(group)
    if len(labels) < 2:
        return 0.0
    mean = np.empty((len(points), len(labels)))
    for j, label in enumerate(labels):
        own = np.sort(points[group == label])
        before = np.concatenate([[0.0], np.cumsum(own)])
        left = np.searchsorted(own, points)
        total = points * left - before[left] + (before[-1] - before[left]) - points * (len(own) - left)
        count = np.where(group == label, len(own) - 1, len(own))
        mean[:, j] = np.where(count > 0, total / np.maximum(count, 1), 0.0)
    at = np.searchsorted(labels, group)
    a = mean[np.arange(len(points)), at]
    mean[np.arange(len(points)), at] = np.inf
    b = mean.min(axis=1)
    most = np.maximum(a, b)
    return float(np.where(most > 0, (b - a) / np.where(most > 0, most, 1), 0.0).mean())


def _columns(x: np.ndarray, is_text: np.ndarray, width: float) -> np.ndarray | None:
    """The column of each block of a page, or None where the order should stay; x is NaN for blocks without a place."""
    points = x[is_text & ~np.isnan(x)]
    if len(x) < 6 or len(points) < 6:
        return None
    best = max(((silhouette(points, g), -k, g, m) for k in (2, 3) if len(points) >= 2 * k for g, m in [cluster(points, k)]), key=lambda t: t[:2], default=(0, 0, None, None))
    if best[0] > 0.2:
        _, _, group, middle = best
        order = np.sort(middle)
        if (np.diff(order) < 0.08 * width).any():
            return None
        widths = np.array([np.ptp(points[group == i]) for i in range(len(middle)) if (group == i).sum() >= 2])
        if len(widths) >= 2 and widths.mean() > 0 and widths.std() / widths.mean() > 0.25:
            return None
        near = np.abs(np.nan_to_num(x)[:, None] - middle[None, :]).argmin(axis=1)
        return np.where(np.isnan(x), 0, near)
    split = _valley(points, width)
    return None if split is None else np.where(np.isnan(x), 0, np.nan_to_num(x) > split).astype(int)


def _valley(points: np.ndarray, width: float) -> float | None:
    if len(points) < 8 or points.max() <= points.min():
        return None
    n = min(20, len(points) // 2)
    lo, step = points.min(), (points.max() - points.min()) / n
    full = np.bincount(np.minimum(((points - lo) / step).astype(int), n - 1), minlength=n) > 0
    empty = [i for i in range(1, n - 1) if not full[i] and full[i - 1] and full[i + 1]]
    if not empty:
        return None
    at = lo + (empty[0] + 0.5) * step
    left, right = points[points < at], points[points > at]
    good = len(left) >= 3 and len(right) >= 3 and right.min() - left.max() >= 0.08 * width
    return float(at) if good else None


def reading_order(blocks: DataFrame, width: float = WIDTH) -> DataFrame:
    """(doc_id, page_no, block_ord, column_no, read_ord): blocks column by column, each from top to bottom.

    Pages where no columns are found, or not clearly, keep their order with column_no 0.
    """

    def order(page: pa.Table) -> pa.Table:
        page = page.sort_by("block_ord")
        x, y = (page[c].to_numpy().astype(float) for c in ("x", "y"))
        column = _columns(x, np.asarray(page["is_text"].to_numpy(), dtype=bool), width)
        if column is not None:
            at = np.lexsort((np.nan_to_num(y), column))  # stable: equal heights keep their order
            page, column = page.take(at), column[at]
        else:
            column = np.zeros(len(x))
        numbers = {"column_no": pa.array(column.astype("int32")), "read_ord": pa.array(np.arange(1, len(x) + 1, dtype="int32"))}
        return pa.table({c: page[c] for c in (*_PAGE, "block_ord")} | numbers)

    source = centers(blocks).select(*_PAGE, "block_ord", "x", "y", (F.col("kind") == "text").alias("is_text"))
    types = {f.name: f.dataType.simpleString() for f in source.schema}
    # as many partitions as a shuffle has: a page costs time, not bytes, so that coalescing by size would put all in one
    spread = source.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_PAGE)
    return spread.groupBy(*_PAGE).applyInArrow(order, f"doc_id {types['doc_id']}, page_no {types['page_no']}, block_ord {types['block_ord']}, column_no int, read_ord int")
