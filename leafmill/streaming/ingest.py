"""Incremental ingestion: pages that arrive as files, cleaned and deduplicated as they come.

Which document, page and content was seen is kept as two 64-bit hashes in the stream's own state, spread by hash; no
batch reads what was written before. State and output are committed together, so a batch that is replayed after a
failure changes nothing. The state grows by some 50 bytes a page; on a cluster it belongs in RocksDB
(spark.sql.streaming.stateStore.providerClass). No page is dropped for being late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.functions.html import clean_fragment

PAGES = "row_id long, doc_id string, page_no int, html string, origin string, extracted_at timestamp, loaded_at timestamp"


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Pages from Parquet files as they appear in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly_deliveries(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """(window, origin, pages): deliveries per hour of loading, with a watermark for late ones."""
    return pages.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", "1 hour"), "origin").agg(F.count("*").alias("pages"))


def ingest(pages: DataFrame, target: str, checkpoint: str, repair: bool = True) -> StreamingQuery:
    """Appends (doc_id, page_no, key, html) to Parquet files in `target`, each document, page and content once."""
    html = F.coalesce("html", F.lit(""))
    seen = pages.withColumns({"key": F.sha2(html, 256), "h1": F.xxhash64("doc_id", "page_no", html), "h2": F.xxhash64(F.lit(1), "doc_id", "page_no", html)})
    once = seen.dropDuplicates(["h1", "h2"]).select("doc_id", "page_no", "key", clean_fragment(F.col("html"), repair).alias("html"))
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
