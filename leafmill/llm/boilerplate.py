"""Lines repeated across one source's documents: finding and removing them (problem 2).

Two lines are the same if their visible text (no tags, entities decoded) has the same letters in the same order,
whatever the case, digits, white space and other characters. A line is stood for by two 64-bit hashes of its letters.

1. Lines of pages become pairs of hashes, written once to the shared checkpoint folder with the row and place they
   stand at; everything after reads these, so a text is looked at once.
2. Documents with the same set of lines are one cluster: a document's set is folded to a signature (counts and XORs,
   which combine before the shuffle), and of each cluster only one member's lines go on, with the cluster's size. A
   page delivered again, or longer, is a page of the same document and makes no other cluster.
3. Each line is counted per source over clusters, documents and publication dates, again with partial aggregation, so
   a line that stands in every document of the largest source is added up where it is read.
4. Lines of pages and sections are matched with the few repeated ones: by broadcast if they are fewer than
   `broadcast_rows`, which is counted first, else by a shuffled join.

Texts are read whole; finding does not shuffle them, and removing only if the lines to remove are too many to be
broadcast, which is counted. Defined results: null and empty html has no lines; a line with fewer than
`min_letters` letters is never repeated; documents missing from the document table have no source and no repeated
lines; repeated rows count once, and are each given their lines; an empty table gives no rows. Source and key columns
are picked by name, others are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.html import visible_text
from leafmill.state import materialized

MIN_LETTERS, MIN_DOCUMENTS, MIN_SHARE = 12, 3, 0.1
#: Up to so many hashes or line numbers are broadcast.
BROADCAST = 500_000


def letters(line: Column) -> Column:
    """The letters of a line's visible text, lower-case."""
    return F.lower(F.regexp_replace(visible_text(line), r"\P{L}+", ""))


def lines(df: DataFrame, keys: list[str], html: str = "html", min_letters: int = MIN_LETTERS) -> DataFrame:
    """(keys, line_no, h1, h2) of the lines with at least `min_letters` letters."""
    split = df.where(f"length(`{html}`) >= {min_letters}").select(*keys, F.posexplode(F.split(F.col(f"`{html}`"), "\n", -1)).alias("at", "line"))
    kept = split.where(f"length(line) >= {min_letters}").select(*keys, (F.col("at") + 1).alias("line_no"), letters(F.col("line")).alias("letters"))
    return kept.where(f"length(letters) >= {min_letters}").select(
        *keys, "line_no", F.xxhash64("letters").alias("h1"), F.xxhash64(F.lit(1), "letters").alias("h2")
    )


def repeated_lines(
    lines_: DataFrame, documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE,
    min_clusters: int = 1, min_dates: int = 1,
) -> DataFrame:
    """(source, h1, h2, documents, clusters, dates) of the lines repeated within a source; written once.

    `lines_` has (doc_id, h1, h2) as `lines` gives them, `documents` (doc_id, source, received_at). A line needs
    `min_documents` documents and `min_share` of the source's; `min_clusters` and `min_dates` let a caller ask for as
    many clusters of copies and days of publication too, so that an article republished under many ids does not make
    its lines boilerplate.
    """
    pairs = lines_.select("doc_id", "h1", "h2").distinct()
    signature = pairs.groupBy("doc_id").agg(F.count("*").alias("n"), F.expr("bit_xor(h1)").alias("x1"), F.expr("bit_xor(h2)").alias("x2"))
    published = documents.groupBy("doc_id").agg(F.min("source").alias("source"), F.min(F.to_date("received_at")).alias("date")).where("source is not null")
    clusters = (
        signature.join(published, "doc_id").groupBy("source", "n", "x1", "x2")
        .agg(F.min(F.struct("date", "doc_id")).alias("first"), F.count("*").alias("members"))
        .select("source", "members", "first.doc_id", "first.date")
    )
    counted = (
        pairs.join(clusters, "doc_id").groupBy("source", "h1", "h2", "date")
        .agg(F.sum("members").alias("documents"), F.count("*").alias("clusters"))
        .groupBy("source", "h1", "h2")
        .agg(F.sum("documents").alias("documents"), F.sum("clusters").alias("clusters"), F.count("*").alias("dates"))
        .where(f"documents >= {min_documents} and clusters >= {min_clusters} and dates >= {min_dates}")
    )
    sizes = published.groupBy("source").agg(F.count("*").alias("of"))
    return materialized(counted.join(sizes, "source").where(f"documents >= of * {min_share}D").drop("of"))


def find_lines(lines_: DataFrame, documents: DataFrame, repeated: DataFrame, key: str, broadcast_rows: int = BROADCAST) -> DataFrame:
    """(key, line_no) of the lines (key, doc_id, line_no, h1, h2) that are repeated lines of their document's source."""
    few = repeated.count() <= broadcast_rows

    def side(x: DataFrame) -> DataFrame:
        return F.broadcast(x) if few else x

    known = repeated.select("source", "h1", "h2")
    candidates = lines_.join(side(known.select("h1", "h2").distinct()), ["h1", "h2"], "left_semi")
    sources = documents.groupBy("doc_id").agg(F.min("source").alias("source"))
    return candidates.join(sources, "doc_id").join(side(known), ["source", "h1", "h2"], "left_semi").select(key, "line_no")


def remove_lines(df: DataFrame, found: DataFrame, key: str, html: str = "html", broadcast_rows: int = BROADCAST) -> DataFrame:
    """`df` with the found lines (key, line_no) taken out of `html`; rows without any stay as they are. The lines are
    put together per row first; only the rows that have some and the rows of `df` meet."""
    drop = materialized(found.groupBy(F.col(key).alias("__key")).agg(F.collect_set("line_no").alias("__lines")))
    side = F.broadcast(drop) if (drop.agg(F.sum(F.size("__lines"))).first()[0] or 0) <= broadcast_rows else drop
    kept = F.array_join(F.filter(F.split(F.col(f"`{html}`"), "\n", -1), lambda x, i: ~F.array_contains("__lines", i + 1)), "\n")
    joined = df.join(side, F.col(f"`{key}`") == F.col("__key"), "left")
    return joined.withColumn(html, F.when(F.col("__lines").isNull(), F.col(f"`{html}`")).otherwise(kept)).drop("__key", "__lines")
