"""What pages hold: links, images, tables, link targets and anchors. One row in, many rows out, or one rewritten."""

from __future__ import annotations

import struct
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.html import escape, replace_each
from leafmill.functions.ids import uuid_link
from leafmill.functions.text import asset_name, dashed, image_extension, slug

# What counts as a link, an image, a table, a placeholder, a link notation and an anchor in a page.
_LINK = r'(?i)<a\s+[^>]*href="([^"]+)"'
_EXTERNAL = ("http://", "https://", "mailto:")
_EMBEDDED = r'src="data:image/[^;"]+;base64,[^"]+"'
_EMBEDDED_PARTS = r'src="data:image/([^;"]+);base64,([^"]+)"'
_REFERENCED = r'(?i)src="(?!data:|https?://|mailto:|assets/)[^"]+"'
_REFERENCED_PARTS = r'(?i)src="((?!data:|https?://|mailto:|assets/)[^"]+)"'
_TABLE = r"(?is)<table.*?</table>"
_PLACEHOLDER = r"(?i)<!--\s*structured\s+table\s+[0-9]{1,9}\s*-->"
_PLACEHOLDER_PARTS = r"(?i)(<!--\s*structured\s+table\s+([0-9]{1,9})\s*-->)"
_UUID = r"(?i)@UUID\[JournalEntry\.([A-Za-z0-9]+)\.JournalEntryPage\.([A-Za-z0-9]+)\]\{([\s\S]*?)\}"
_ANCHOR = r"(?iU)<a\s+[^>]*href\s*=\s*['\"][^'\"]+['\"][^>]*>[\s\S]*?</a>"
_ANCHOR_PARTS = r"(?iU)(<a\s+[^>]*href\s*=\s*['\"]([^'\"]+)['\"][^>]*>([\s\S]*?)</a>)"
_IMAGE_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg")


def _numbered(matches: Column) -> Column:
    return F.posexplode(matches).alias("at", "found")


def links(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, link_ord, kind, target) of each link in double quotes; external if it names http, https or mailto."""
    found = pages.where(F.col(html).contains("href")).select(*keys, _numbered(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))))
    external = reduce(Column.__or__, [F.col("found").startswith(p) for p in _EXTERNAL])
    return found.select(*keys, (F.col("at") + 1).alias("link_ord"), F.when(external, "external").otherwise("internal").alias("kind"), F.col("found").alias("target"))


def embedded_images(pages: DataFrame, keys: list[str], html: str = "html", page: str = "page_no") -> DataFrame:
    """(keys, img_ord, name, src, content) of each base64 image in a page, numbered from 1 within the page.

    Content that cannot be decoded is empty, not null.
    """
    types, data = (F.regexp_extract_all(html, F.lit(_EMBEDDED_PARTS), F.lit(i)) for i in (1, 2))
    found = pages.where(F.col(html).contains(";base64,")).select(*keys, F.col(page).alias("__page"), F.posexplode(F.arrays_zip(types.alias("type"), data.alias("data"))).alias("at", "found"))
    name = asset_name(F.col("__page"), F.col("at") + 1, "img", image_extension(F.col("found.type")))
    content = F.coalesce(F.try_to_binary(F.col("found.data"), F.lit("base64")), F.to_binary(F.lit(""), F.lit("utf-8")))
    return found.select(*keys, (F.col("at") + 1).alias("img_ord"), name.alias("name"), F.concat(F.lit("assets/"), name).alias("src"), content.alias("content"))


def embedded_images_to_assets(html: Column, page_no: Column) -> Column:
    """The page with the sources of its embedded images replaced by their asset names."""
    kind = _EMBEDDED_PARTS.replace('base64,([^"]+)', 'base64,[^"]+')
    return replace_each(html, _EMBEDDED, kind, lambda ext, n: F.concat(F.lit('src="assets/'), asset_name(page_no, n, "img", image_extension(ext)), F.lit('"')))


def referenced_images(pages: DataFrame, files: DataFrame, keys: list[str], html: str = "html", page: str = "page_no", by_page: bool = True) -> DataFrame:
    """(keys, img_ord, src, path, name) of image sources that exist in `files` (path, as binaryFile lists it).

    With `by_page` the name begins with the page, so that files of one name on several pages are kept apart.
    """
    found = pages.where(F.col(html).contains('src="')).select(*keys, F.col(page).alias("__page"), _numbered(F.regexp_extract_all(html, F.lit(_REFERENCED_PARTS), F.lit(1))))
    path = F.regexp_replace("found", "(?i)^file://", "")
    listed = files.select(F.regexp_replace("path", "(?i)^file:(//)?", "").alias("path")).distinct()
    base = F.element_at(F.split("path", "/"), -1)
    name = F.concat(F.format_string("page-%04d_", F.col("__page")), base) if by_page else base
    return found.withColumn("path", path).join(listed, "path").select(*keys, (F.col("at") + 1).alias("img_ord"), F.col("found").alias("src"), "path", name.alias("name"))


def referenced_to_assets(html: Column, names: Column) -> Column:
    """The page with the image sources that are keys of the map `names` replaced by assets/ and their name."""

    def by(src: Column, _: Column) -> Column:
        name = F.try_element_at(names, src)
        return F.concat(F.lit('src="'), F.coalesce(F.concat(F.lit("assets/"), name), src), F.lit('"'))

    return F.when(names.isNull(), html).otherwise(replace_each(html, _REFERENCED, _REFERENCED_PARTS, by))


def tables_to_images(html: Column, page_no: Column) -> Column:
    """The page with each table replaced by the image that stands for it."""
    return replace_each(html, _TABLE, r"(?is)(<table.*?</table>)", lambda _, n: F.concat(F.lit('<img src="assets/'), asset_name(page_no, n, "table", F.lit("png")), F.lit('">')))


def _png(width: int, height: int) -> bytes:
    """A white picture: what an image-only table is until a renderer makes its picture."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = zlib.compress((b"\0" + b"\xff" * width) * height)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


PLACEHOLDER = _png(1, 1)


def html_tables(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, table_ord, html) of each table; a nested one ends its outer one, as matching is not recursive."""
    found = pages.where(F.lower(html).contains("<table")).select(*keys, _numbered(F.regexp_extract_all(html, F.lit(_TABLE), F.lit(0))))
    return found.select(*keys, (F.col("at") + 1).alias("table_ord"), F.col("found").alias("html"))


def decide_tables(tables: DataFrame, structured: DataFrame, keys: list[str], mode: str, threshold: float = 0.6) -> DataFrame:
    """(keys, table_ord, kind, name): what becomes of the k-th HTML table, given the k-th structured one of its page.

    image-only: all become images. Else a table without a structured partner stays HTML; with one it becomes
    structured, in mode auto only from the confidence threshold on (an unknown confidence counts as 0.5).
    """
    if mode == "image-only":
        name = asset_name(F.col("page_no"), F.col("table_ord"), "table", F.lit("png"))
        return tables.select(*keys, "table_ord", F.lit("image").alias("kind"), name.alias("name"))
    both = tables.join(structured.select(*keys, "table_ord", "confidence", F.lit(True).alias("has")), [*keys, "table_ord"], "left")
    good = F.coalesce("has", F.lit(False))
    if mode == "auto":
        good = good & (F.coalesce("confidence", F.lit(0.5)) >= threshold)
    return both.select(*keys, "table_ord", F.when(good, "structured").otherwise("html").alias("kind"), F.lit(None).cast("string").alias("name"))


def put_tables(html: Column, rendered: Column) -> Column:
    """The page with its k-th table replaced by the k-th of `rendered`, where that is not null.

    Tables are paired by their place, so no placeholder text is needed.
    """
    return replace_each(html, _TABLE, r"(?is)(<table.*?</table>)", lambda old, n: F.coalesce(F.try_element_at(rendered, n), old))


def fill_placeholders(html: Column, rendered: Column) -> Column:
    """`<!-- structured table N -->` replaced by the N-th of `rendered`; out of range it stays."""

    def by(parts: Column, _: Column) -> Column:
        n = parts[1].cast("int")
        return F.coalesce(F.when(n > 0, F.try_element_at(rendered, F.greatest(n, F.lit(1)))), parts[0])

    return replace_each(html, _PLACEHOLDER, _PLACEHOLDER_PARTS, by, 2)


def uuid_targets(df: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, link_ord, entry_id, page_id, label) of each link notation."""
    parts = [F.regexp_extract_all(html, F.lit(_UUID), F.lit(i)).alias(n) for i, n in ((1, "entry_id"), (2, "page_id"), (3, "label"))]
    found = df.where(F.upper(html).contains("@UUID[")).select(*keys, F.posexplode(F.arrays_zip(*parts)).alias("at", "t"))
    return found.select(*keys, (F.col("at") + 1).alias("link_ord"), "t.entry_id", "t.page_id", "t.label")


def anchor_tokens(pages: DataFrame, keys: list[str], name: str, page_id: str, order: str) -> DataFrame:
    """(keys, anchors): per entry a map of anchor tokens to page ids; of pages with one token the first counts."""
    tokens = pages.select(*keys, order, page_id, F.explode(F.array_distinct(F.array(slug(F.col(name)), dashed(F.col(name))))).alias("token"))
    first = tokens.where("token is not null").groupBy(*keys, "token").agg(F.min_by(page_id, F.struct(order, page_id)).alias("id"))
    return first.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "id")))).alias("anchors"))


def anchors_to_links(html: Column, entry: Column, anchors: Column) -> Column:
    """Anchors to `#token` as link notation where the token is known, else as their label; other links stay."""

    def by(parts: Column, _: Column) -> Column:
        token = parts[1].substr(F.lit(2), F.length(parts[1]))
        page = F.coalesce(F.try_element_at(anchors, slug(token)), F.try_element_at(anchors, F.lower(token)))
        return F.when(~parts[1].startswith("#"), parts[0]).when(page.isNotNull(), uuid_link(entry, page, parts[2])).otherwise(parts[2])

    return replace_each(html, _ANCHOR, _ANCHOR_PARTS, by, 3)


def captions_to_alt(html: Column, captions: Column) -> Column:
    """Image tags with the caption of their file (a map by file name) as alt text, escaped; others stay."""

    def by(tag: Column, _: Column) -> Column:
        name = F.regexp_extract(tag, rf'(?i)src="(?:[^"]*/)?([^"/]+[.](?:{"|".join(_IMAGE_ENDINGS)}))"', 1)
        caption = F.try_element_at(captions, name)
        alt = F.concat(F.lit('alt="'), escape(caption), F.lit('"'))
        held = tag.rlike('alt="[^"]*"')
        quoted = F.regexp_replace(alt, r"([\\$])", r"\\$1")
        put = F.when(held, F.regexp_replace(tag, F.lit('alt="[^"]*"'), quoted)).otherwise(F.concat(F.regexp_replace(tag, ">$", ""), F.lit(" "), alt, F.lit(">")))
        return F.when((name != "") & caption.isNotNull(), put).otherwise(tag)

    return replace_each(html, "(?i)<img[^>]*>", "(?i)(<img[^>]*>)", by)


def caption_map(images: DataFrame, keys: list[str], order: str = "img_ord") -> DataFrame:
    """(keys, captions): a map of file names to captions; of images with one name the last captioned counts."""
    last = images.where("caption is not null and caption <> ''").groupBy(*keys, "name").agg(F.max_by("caption", F.struct(order, "caption")).alias("caption"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "caption")))).alias("captions"))


def image_tags(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, img_ord, src, name, alt) of each image tag with a source in double quotes; alt is null without one."""
    found = pages.where(F.col(html).contains("<img")).select(*keys, _numbered(F.regexp_extract_all(html, F.lit(r'<img[^>]*\ssrc="[^"]*"[^>]*>'), F.lit(0))))
    src = F.regexp_extract("found", r'\ssrc="([^"]*)"', 1)
    alt = F.when(F.col("found").rlike(r'\salt="'), F.regexp_extract("found", r'\salt="([^"]*)"', 1))
    return found.select(*keys, (F.col("at") + 1).alias("img_ord"), src.alias("src"), F.element_at(F.split(src, "/"), -1).alias("name"), alt.alias("alt"))


def all_images(embedded: DataFrame, referenced: DataFrame, keys: list[str]) -> DataFrame:
    """Embedded images of a page first, then those it refers to, numbered through: (keys, img_ord, name, origin)."""
    both = embedded.select(*keys, "img_ord", "name", F.lit("embedded").alias("origin")).unionByName(referenced.select(*keys, "img_ord", "name", F.lit("referenced").alias("origin")))
    return both.withColumn("img_ord", F.row_number().over(Window.partitionBy(*keys).orderBy("origin", "img_ord")))


def pages_with_tables(pages: DataFrame, rendered: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """`pages` with their k-th HTML table replaced by the k-th rendered one (keys, table_ord, html) of the page."""
    by_place = rendered.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("table_ord", F.col("html").alias("h")))).alias("__by"), F.max("table_ord").alias("__most"))
    listed = by_place.select(*keys, F.transform(F.sequence(F.lit(1), F.greatest("__most", F.lit(1))), lambda n: F.try_element_at("__by", n)).alias("__tables"))
    none = F.array().cast("array<string>")
    return pages.join(listed, keys, "left").withColumn(html, put_tables(F.col(html), F.coalesce("__tables", none))).drop("__tables")
