"""Identifiers derived from content: the same input gives the same id, on any executor and in any run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(value: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-1 of the UTF-8 text."""
    return F.substring(F.sha1(value), 1, 16)


def entry_id(module: Column, path: Column) -> Column:
    """Of a module and the path (array of segments) of an entry in it."""
    return short_hash(F.concat_ws("|", module, F.array_join(path, "/"), F.lit("entry")))


def page_id(module: Column, path: Column, name: Column) -> Column:
    """Of a page's name under its entry's path."""
    return short_hash(F.concat_ws("|", module, F.array_join(path, "/"), F.lit("page"), name))


def uuid_link(entry: Column, page: Column, label: Column) -> Column:
    """The link notation of a page."""
    return F.concat(F.lit("@UUID[JournalEntry."), entry, F.lit(".JournalEntryPage."), page, F.lit("]{"), label, F.lit("}"))
