"""Documents and images as files, and converters that turn a document into pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.options import FeatureMissing

PAGES = "doc_id string, page_no int, html string, error string"


class Converter(Protocol):
    """Built once per worker; called with a document's bytes, gives the HTML of its pages in order."""

    def __call__(self, content: bytes) -> list[str]: ...


def documents(spark: SparkSession, path: str, pattern: str = "*.pdf", smallest: int = 0) -> DataFrame:
    """(doc_id, path, length, content) of the files under `path`; files under `smallest` bytes are left out.

    The id is the hash of the bytes, so a document delivered under two names is one document.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") >= smallest).select(F.substring(F.sha2("content", 256), 1, 16).alias("doc_id"), "path", "length", "content")


def image_files(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,gif,svg}") -> DataFrame:
    """(path, length): a listing that never reads the images."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def convert_documents(docs: DataFrame, make: Callable[[], Converter] | None) -> DataFrame:
    """(doc_id, page_no, html, error) of each distinct document; one that fails is a row with page 0 and an error."""
    if make is None:
        raise FeatureMissing("documents need a converter")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        convert = make()
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"]):
                try:
                    rows += [(doc, n, h, None) for n, h in enumerate(convert(content), 1)]
                except Exception as e:  # noqa: BLE001 - one bad document must not end the job
                    rows.append((doc, 0, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "html", "error"])

    distinct = docs.groupBy("doc_id").agg(F.first("content").alias("content"))
    return distinct.mapInPandas(run, PAGES)
