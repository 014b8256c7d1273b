"""python -m leafmill convert IN OUT [--pages SPEC] [--tables MODE] [--no-repair] [--first-pages] [--export]   or   python -m leafmill doctor"""

from __future__ import annotations

import argparse
import importlib
import sys


def doctor() -> int:
    """What is installed; 1 if something needed is missing."""
    missing = 0
    for name in ("pyspark", "pyarrow", "numpy"):
        try:
            print(f"{name} {importlib.import_module(name).__version__}")
        except ImportError:
            print(f"{name} is missing")
            missing = 1
    return missing


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor")
    convert = commands.add_parser("convert")
    convert.add_argument("source", help="folder with parsed_documents, pages and outline as Parquet")
    convert.add_argument("target")
    convert.add_argument("--pages")
    convert.add_argument("--tables", choices=("structured", "auto", "image-only"), default="auto")
    convert.add_argument("--export", action="store_true", help="also write each entry, image and manifest as a file of its own")
    convert.add_argument("--no-repair", action="store_true")
    convert.add_argument("--first-pages", action="store_true", help="keep pages before a chapter's first section")
    asked = parser.parse_args(argv)
    if asked.command == "doctor":
        return doctor()

    from pyspark.sql import SparkSession

    from leafmill.operators.manifest import manifests
    from leafmill.operators.pages import parse_page_spec
    from leafmill.options import Options
    from leafmill.plans.convert import convert_tables
    from leafmill.sources import sinks

    pages = tuple(parse_page_spec(asked.pages)) if asked.pages else None
    options = Options(tables=asked.tables, pages=pages, repair=not asked.no_repair, compat=not asked.first_pages)
    spark = SparkSession.builder.appName("leafmill").getOrCreate()
    converted = convert_tables(spark, asked.source, options)
    documents = spark.read.parquet(f"{asked.source}/parsed_documents.parquet")
    sinks.write_entries(converted.entries, f"{asked.target}/entries")
    sinks.write_images(converted.extracted.images, f"{asked.target}/images")
    sinks.write_manifests(manifests(documents), f"{asked.target}/manifests")
    if asked.export:
        files = f"{asked.target}/files"
        sinks.export_entries(converted.entries, files)
        sinks.export_images(converted.extracted.images, files)
        sinks.export_manifests(manifests(documents), files)
        sinks.export_style(spark, documents.select("doc_id"), files)
    return 0


if __name__ == "__main__":
    sys.exit(main())
