"""Manifests: what a package of entries says about itself, and what is wrong with one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lowest host version that a manifest may ask for.
MINIMUM = 13


def manifests(documents: DataFrame, version: str = "0.1.0", style: str = "styles/leafmill.css") -> DataFrame:
    """(doc_id, manifest struct) of (doc_id, mod_id, title, author, license, pack_name); a blank author gives no
    authors, a blank license is null and left out of the JSON."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    author = blank(F.col("author"))
    manifest = F.struct(
        F.col("mod_id").alias("id"), F.col("title"), F.concat(F.lit("Entries of "), F.col("title")).alias("description"), F.lit(version).alias("version"),
        F.struct(F.lit(str(MINIMUM)).alias("minimum")).alias("compatibility"),
        F.when(author.isNull(), F.expr("cast(array() as array<struct<name:string>>)")).otherwise(F.array(F.struct(author.alias("name")))).alias("authors"),
        F.array(F.struct(F.col("pack_name").alias("name"), F.concat("title", F.lit(" Journals")).alias("label"), F.concat(F.lit("packs/"), "pack_name").alias("path"), F.lit("JournalEntry").alias("type"))).alias("packs"),
        F.array(F.lit(style)).alias("styles"), blank(F.col("license")).alias("license"),
    )
    return documents.select("doc_id", manifest.alias("manifest"))


def manifest_issues(manifests_: DataFrame) -> DataFrame:
    """(doc_id, issue) for each rule that a manifest breaks; the minimum version is compared as a number."""
    m = F.col("manifest")
    pack = F.try_element_at(m["packs"], F.lit(1))
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    rules: list[tuple[Column, str]] = [(text(m[name]), f"{name} is missing") for name in ("id", "title", "version")]
    rules += [
        (m["compatibility"].isNotNull() & (m["compatibility"]["minimum"].try_cast("int") >= MINIMUM), f"compatibility.minimum is below {MINIMUM}"),
        (F.size(m["packs"]) > 0, "there are no packs"), (F.size(m["styles"]) > 0, "there are no styles"),
        (pack.isNull() | (pack["type"] == "JournalEntry"), "the first pack is not of type JournalEntry"),
        (pack.isNull() | pack["path"].endswith(pack["name"]), "the first pack's path does not end with its name"),
    ]
    broken = F.filter(F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(said)) for good, said in rules]), lambda x: x.isNotNull())
    return manifests_.select("doc_id", F.explode(broken).alias("issue"))
