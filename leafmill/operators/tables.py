"""Structured tables: assembling grids from positioned cells, choosing the best one, rendering HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.html import escape
from leafmill.functions.ids import short_hash

_TABLE = ["doc_id", "page_no", "table_id"]


def overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """The share of box a (x, y, w, h) that box b covers; 0 for boxes that only touch or have no area."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.when((w > 0) & (h > 0) & (aw * ah > 0), w * h / (aw * ah)).otherwise(F.lit(0.0))


def resolve_references(items: DataFrame, store: DataFrame) -> DataFrame:
    """Table items with the id of a stored table (`ref`) as that table's row; references to nothing are dropped."""
    direct = items.where("ref is null").drop("ref")
    return direct.unionByName(items.where("ref is not null").select("doc_id", "page_no", "ref").join(store.withColumnRenamed("table_id", "ref"), ["doc_id", "ref"]).withColumnRenamed("ref", "table_id"), allowMissingColumns=True)


def table_grid(cells: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_id, row_idx, col_idx, text, rowspan, colspan, is_header): a dense grid per table.

    Tables without a box are left out, as are cells without a row or column. Of cells at one place the last delivered
    counts (`loaded_at`, then `row_id`). Places that no cell covers, by its spans, get an empty cell, so that all rows
    of a table have equal width and spanned places are not filled. Rows and columns keep the numbers they came with.
    The expansion is bounded by a table's own extent and joined by equality.
    """
    placed = cells.where("tbl_x0 is not null and tbl_y0 is not null and tbl_x1 is not null and tbl_y1 is not null and row_idx is not null and col_idx is not null")
    last = F.max_by(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.greatest(F.lit(1), F.coalesce("rowspan", F.lit(1))).alias("rowspan"), F.greatest(F.lit(1), F.coalesce("colspan", F.lit(1))).alias("colspan"), F.coalesce("is_header", F.lit(False)).alias("is_header")), F.struct("loaded_at", "row_id")).alias("c")
    own = placed.groupBy(*_TABLE, "row_idx", "col_idx").agg(last).select(*_TABLE, "row_idx", "col_idx", "c.*")
    covered = own.select(*_TABLE, F.explode(F.sequence("row_idx", F.col("row_idx") + F.col("rowspan") - 1)).alias("r"), "col_idx", "colspan").select(*_TABLE, "r", F.explode(F.sequence("col_idx", F.col("col_idx") + F.col("colspan") - 1)).alias("c"))
    extent = covered.groupBy(*_TABLE).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    places = extent.select(*_TABLE, F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1").select(*_TABLE, "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    empty = places.join(covered.distinct(), [*_TABLE, "r", "c"], "left_anti").select(*_TABLE, F.col("r").alias("row_idx"), F.col("c").alias("col_idx"), F.lit("").alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(False).alias("is_header"))
    return own.unionByName(empty)


def table_ids(cells: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_id, id): each table's content-derived id."""
    return cells.select(*_TABLE).distinct().select(*_TABLE, short_hash(F.concat(F.lit("table_"), F.col("page_no").cast("string"), F.lit("_"), "table_id")).alias("id"))


def _cell(tag: str) -> Column:
    spans = F.concat(
        F.when(F.col("colspan") > 1, F.concat(F.lit(' colspan="'), F.col("colspan").cast("string"), F.lit('"'))).otherwise(""),
        F.when(F.col("rowspan") > 1, F.concat(F.lit(' rowspan="'), F.col("rowspan").cast("string"), F.lit('"'))).otherwise(""),
    )
    return F.concat(F.lit(f"<{tag}"), spans, F.lit(">"), escape(F.col("text")), F.lit(f"</{tag}>"))


def render_tables(grid: DataFrame, captions: DataFrame | None = None, boxes: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, table_id, html) of `table_grid`: head cells of the first row in thead, all else in tbody.

    `captions` (table keys, caption) and `boxes` (table keys, box) are put in where given. Three ordered aggregations:
    cells to rows, rows to a body, and that is all that comes together in one place.
    """
    first = F.min("row_idx").over(Window.partitionBy(*_TABLE))
    marked = grid.withColumn("head", (F.col("row_idx") == first) & F.col("is_header"))
    marked = marked.withColumn("td", F.when(~F.col("head"), _cell("td"))).withColumn("th", F.when(F.col("head"), _cell("th")))
    rows = marked.groupBy(*_TABLE, "row_idx").agg(F.expr("listagg(td, '') within group (order by col_idx)").alias("td"), F.expr("listagg(th, '') within group (order by col_idx)").alias("th"))
    rows = rows.withColumn("tr", F.concat(F.lit("<tr>"), F.coalesce("td", F.lit("")), F.lit("</tr>")))
    body = rows.groupBy(*_TABLE).agg(F.expr("listagg(tr, '') within group (order by row_idx)").alias("body"), F.max("th").alias("head"))
    for extra, column in ((captions, "caption"), (boxes, "box")):
        body = body.join(extra.select(*_TABLE, column), _TABLE, "left") if extra is not None else body.withColumn(column, F.lit(None).cast("string"))
    html = F.concat(
        F.lit("<table"), F.when(F.col("box").isNotNull(), F.concat(F.lit(' data-bbox="'), "box", F.lit('"'))).otherwise(""), F.lit(">"),
        F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("<caption>"), escape(F.col("caption")), F.lit("</caption>"))).otherwise(""),
        F.when(F.col("head").isNotNull(), F.concat(F.lit("<thead><tr>"), "head", F.lit("</tr></thead>"))).otherwise(""),
        F.lit("<tbody>"), "body", F.lit("</tbody></table>"),
    )
    return body.select(*_TABLE, html.alias("html"))


def best_tables(tables: DataFrame, region: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(doc_id, page_no, table_id, confidence): per page the table with the highest confidence, times its overlap with
    the region if one is given (below a tenth it is out); the first of equals; none with a confidence of 0."""
    scored = tables
    confidence = F.coalesce("confidence", F.lit(0.0))
    if region is not None:
        box = (F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        scored = scored.withColumn("__over", overlap(box, tuple(F.lit(float(v)) for v in region))).where("__over >= 0.1")
        confidence = confidence * F.col("__over")
    scored = scored.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))).where("score > 0")
    best = scored.groupBy("doc_id", "page_no").agg(F.max_by(F.struct("table_id", F.col("score").alias("confidence")), F.struct("score", -F.col("table_ord"), "table_id")).alias("t"))
    return best.select("doc_id", "page_no", "t.table_id", "t.confidence")


def raster_fallback(tables: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_id, text): the one cell that stands for a table known only as an image."""
    return tables.select(*_TABLE, F.concat(F.lit("[Rasterized table: "), F.col("table_id"), F.lit("]")).alias("text"))
