"""Writing what was converted: entries, manifests, styles, images.

What is written goes through Spark's commit, in a number of files that does not grow with the documents. What is exported
is one file for each entry, image, manifest or style sheet, for a host that wants these.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.text import slug


def file_names(entries: DataFrame, order: str = "chapter_ord", name: str = "name") -> DataFrame:
    """`entries` with `file_name`: NNN-slug.json, unique within a document since the number is."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(order, "entry_id"))
    return entries.withColumn("file_name", F.concat(F.format_string("%03d-", n), slug(F.col(name)), F.lit(".json")))


def entry_json(entries: DataFrame) -> DataFrame:
    """(doc_id, file_name, json) of nested entries, nulls kept (folder is always null)."""
    body = F.struct(
        F.col("entry_id").alias("_id"), "name", "pages", F.lit(None).cast("string").alias("folder"), "flags",
        F.struct(F.lit(0).alias("default")).alias("ownership"), "_key",
    )
    return file_names(entries).select("doc_id", "file_name", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def write_entries(entries: DataFrame, path: str, files: int = 64) -> None:
    """Lines of JSON {doc_id, file_name, entry}, sorted by document within `files` files, however many documents there are."""
    made = entry_json(entries).select("doc_id", "file_name", F.col("json").alias("entry"))
    line = F.to_json(F.struct("doc_id", "file_name", "entry")).alias("value")
    made.repartition(files, "doc_id").sortWithinPartitions("doc_id", "file_name").select(line).write.mode("overwrite").text(path)


def write_images(images: DataFrame, path: str, files: int = 64) -> None:
    """(doc_id, name, content) as Parquet, sorted by document; the bytes stay with their names."""
    images.select("doc_id", "name", "content").repartition(files, "doc_id").sortWithinPartitions("doc_id", "name").write.mode("overwrite").parquet(path)


def write_manifests(manifests: DataFrame, path: str) -> None:
    """Lines of JSON {doc_id, manifest}; a null license is left out."""
    manifests.select(F.to_json(F.struct("doc_id", "manifest")).alias("value")).write.mode("overwrite").text(path)


def export_files(rows: DataFrame, path: str) -> None:
    """(folder, name, content: string or binary) each as a file path/folder/name: an explicit export, for few documents.

    A file is written under another name and then moved, so that none is ever half there; a task that runs again writes
    the same files. `path` is a folder that all executors share, or a URI that pyarrow knows.
    """

    def write(part: Iterator[Row]) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
        for row in part:
            folder = f"{base}/{row.folder}"
            system.create_dir(folder, recursive=True)
            half = f"{folder}/.{row.name}.{uuid.uuid4().hex}"
            with system.open_output_stream(half) as f:
                f.write(row.content.encode("utf-8") if isinstance(row.content, str) else bytes(row.content or b""))
            system.move(half, f"{folder}/{row.name}")

    rows.select("folder", "name", "content").foreachPartition(write)


def export_entries(entries: DataFrame, path: str) -> None:
    """Each entry as doc_id/NNN-slug.json."""
    export_files(entry_json(entries).select(F.col("doc_id").alias("folder"), F.col("file_name").alias("name"), F.col("json").alias("content")), path)


def export_images(images: DataFrame, path: str) -> None:
    """Each image (doc_id, name, content) as doc_id/assets/name; content that is null is an empty file."""
    export_files(images.select(F.concat("doc_id", F.lit("/assets")).alias("folder"), "name", "content"), path)


def export_manifests(manifests: DataFrame, path: str) -> None:
    """Each manifest as doc_id/module.json. Ones that break rules are written too; `manifest.manifest_issues` lists why."""
    export_files(manifests.select(F.col("doc_id").alias("folder"), F.lit("module.json").alias("name"), F.to_json("manifest").alias("content")), path)


def export_style(spark: SparkSession, folders: DataFrame, path: str, scope: str = "leafmill") -> None:
    """The style sheet of the scope class as folder/styles/scope.css of each of `folders` (doc_id)."""
    sheet = f".{scope} {{ line-height: 1.5; }}\n"
    export_files(folders.select(F.concat("doc_id", F.lit("/styles")).alias("folder"), F.lit(f"{scope}.css").alias("name"), F.lit(sheet).alias("content")), path)
