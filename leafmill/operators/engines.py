"""Pluggable engines: conversion, text recognition, image captions. Each distinct image is worked on once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.html import escape
from leafmill.functions.text import needs_ocr, tidy_caption
from leafmill.options import FeatureMissing


class Recognizer(Protocol):
    """Built once per worker; called with an image's bytes: [(text, confidence 0 to 1, language or None)]."""

    def __call__(self, image: bytes) -> list[tuple[str, float, str | None]]: ...


class Captioner(Protocol):
    def __call__(self, image: bytes) -> str | None: ...


def content_hash(content: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of an image's bytes."""
    return F.substring(F.sha2(content, 256), 1, 16)


def once_per_content(images: DataFrame, work: Callable[[DataFrame], DataFrame], content: str = "content") -> DataFrame:
    """`images` joined with `work` over their distinct contents; `work` maps (hash, content) to rows with a hash.

    The contents are reduced by hash before the shuffle moves them, and an image that makes up a third of the rows is
    worked on once; the join back carries hashes only. Null contents have no result.
    """
    hashed = images.withColumn("hash", content_hash(F.col(content)))
    distinct = hashed.where(F.col(content).isNotNull()).groupBy("hash").agg(F.first(content).alias("content"))
    return hashed.drop(content).join(work(distinct), "hash", "left")


def recognize(images: DataFrame, make: Callable[[], Recognizer]) -> DataFrame:
    """(hash, ord, text, confidence, language, error) of distinct images (hash, content); a failure is a row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for batch in batches:
            rows = []
            for h, content in zip(batch["hash"], batch["content"]):
                try:
                    rows += [(h, i, t, float(c), lang, None) for i, (t, c, lang) in enumerate(engine(content), 1)]
                except Exception as e:  # noqa: BLE001 - one bad image must not end the job
                    rows.append((h, 0, None, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["hash", "ord", "text", "confidence", "language", "error"])

    return images.select("hash", "content").mapInPandas(run, "hash string, ord int, text string, confidence double, language string, error string")


def describe(images: DataFrame, make: Callable[[], Captioner]) -> DataFrame:
    """(hash, caption, error) of distinct images (hash, content), captions tidied."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for batch in batches:
            rows = []
            for h, content in zip(batch["hash"], batch["content"]):
                try:
                    rows.append((h, engine(content), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((h, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["hash", "caption", "error"])

    raw = images.select("hash", "content").mapInPandas(run, "hash string, caption string, error string")
    return raw.withColumn("caption", tidy_caption(F.col("caption")))


def mean_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confidence): the mean of word confidences above 0, of 100, as a share; 0 if there are none."""
    return words.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))) / 100, F.lit(0.0)).alias("confidence"))


def _ocr_attributes(results: DataFrame) -> Column:
    """What is known of a recognised text, as attributes; confidence only above 0, language and box where there are any."""
    box = F.concat_ws(",", *[F.col(c).cast("string") for c in ("x", "y", "w", "h")]) if "x" in results.columns else F.lit(None).cast("string")
    return F.concat(
        F.lit(' data-ocr="true"'),
        F.when(F.col("confidence") > 0, F.concat(F.lit(' data-ocr-confidence="'), F.format_string("%.3f", "confidence"), F.lit('"'))).otherwise(""),
        F.when(F.coalesce("language", F.lit("")) != "", F.concat(F.lit(' data-ocr-language="'), "language", F.lit('"'))).otherwise(""),
        F.when(box.isNotNull() & (box != ""), F.concat(F.lit(' data-bbox="'), box, F.lit('"'))).otherwise(""),
    )


def ocr_spans(results: DataFrame) -> DataFrame:
    """`results` with `span`: each recognised text as an HTML span of its own."""
    return results.withColumn("span", F.concat(F.lit("<span"), _ocr_attributes(results), F.lit(">"), escape(F.coalesce("text", F.lit(""))), F.lit("</span>")))


def ocr_block(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block): recognised texts as one HTML block, in order of `ord`; blank texts are left out."""
    shown = results.where(F.col("text").rlike(r"(?U)\S")).withColumn("p", F.concat(F.lit("<p"), _ocr_attributes(results), F.lit(">"), escape(F.col("text"), quotes=False), F.lit("</p>\n")))
    block = shown.groupBy(*keys).agg(F.expr("listagg(p, '') within group (order by ord)").alias("ps"))
    return block.select(*keys, F.concat(F.lit('<div class="ocr-content" data-source="ocr">\n'), "ps", F.lit("</div>")).alias("block"))


def put_ocr(html: Column, block: Column) -> Column:
    """The page with the block before its body's end, else before its end, else behind it; null blocks change nothing."""
    put = F.when(html.contains("</body>"), F.replace(html, F.lit("</body>"), F.concat(block, F.lit("\n</body>")))).when(
        html.contains("</html>"), F.replace(html, F.lit("</html>"), F.concat(block, F.lit("\n</html>")))
    ).otherwise(F.concat(html, F.lit("\n"), block))
    return F.when(block.isNull(), html).otherwise(put)


def ocr_pages(pages: DataFrame, images: DataFrame, mode: str, make: Callable[[], Recognizer] | None, threshold: float = 0.05) -> DataFrame:
    """`pages` with recognised text put in where it is needed; `images` has (doc_id, page_no, content).

    Mode on without an engine raises; auto without one changes nothing. Failures leave a page as it was.
    """
    if make is None:
        if mode == "on":
            raise FeatureMissing("recognition is on, but there is no engine")
        return pages
    wanted = pages.where(needs_ocr(F.col("html"), mode, threshold)).select("doc_id", "page_no").distinct()
    found = once_per_content(images.join(wanted, ["doc_id", "page_no"], "left_semi"), lambda d: recognize(d, make)).where("error is null")
    blocks = ocr_block(found, ["doc_id", "page_no"])
    return pages.join(blocks, ["doc_id", "page_no"], "left").withColumn("html", put_ocr(F.coalesce("html", F.lit("")), F.col("block"))).drop("block")
