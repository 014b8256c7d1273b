"""The queries of problems 2 to 8 and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import boilerplate, bpe, confusables, mojibake, packing, scanfix, splitting
from leafmill.state import materialized

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Tokens that a container of p7_pack holds.
CONTAINER = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# entities stand for no letters in lines that repeat, so that SQL can drop them
_LETTERS = r"""lower(regexp_replace(regexp_replace(regexp_replace(line, '<!--.*?-->|</?[A-Za-z][^<>]*>|<![^<>]*>', '', 'g'),
    '&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);', '', 'g'), '[^\p{L}]', '', 'g'))"""
_P2 = f"""
with l as (select 'pages' as tbl, row_id, doc_id, unnest(string_split(html, chr(10))) as line, generate_subscripts(string_split(html, chr(10)), 1)::int as line_no from pages
    union all select 'sections', section_id, doc_id, unnest(string_split(html, chr(10))), generate_subscripts(string_split(html, chr(10)), 1)::int from sections),
k as (select tbl, row_id, line_no, source, doc_id, {_LETTERS} as letters from l join (select doc_id, min(source) as source from parsed_documents group by 1) d using (doc_id)),
c as (select source, count(distinct doc_id) as n from parsed_documents group by 1),
r as (select source, letters from k join c using (source) where tbl = 'pages' and length(letters) >= 12 group by source, letters, n having count(distinct doc_id) >= 3 and count(distinct doc_id) >= 0.1 * n),
f as (select tbl, row_id, line_no from k join r using (source, letters))
"""


def repeated_in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(row_id, line_no) of the repeated lines in pages, and (section_id, line_no) of those in sections."""
    pages, sections, documents = (table(spark, sf_dir, n) for n in ("pages", "sections", "parsed_documents"))
    page_lines = materialized(boilerplate.lines(pages, ["row_id", "doc_id"]))
    repeated = boilerplate.repeated_lines(page_lines, documents)
    in_sections = boilerplate.find_lines(boilerplate.lines(sections, ["section_id", "doc_id"]), documents, repeated, "section_id")
    return boilerplate.find_lines(page_lines, documents, repeated, "row_id"), in_sections


@query("p2_found", _P2 + "select tbl, row_id, line_no from f")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_pages, in_sections = repeated_in(spark, sf_dir)
    return in_pages.select(F.lit("pages").alias("tbl"), "row_id", "line_no").unionAll(
        in_sections.select(F.lit("sections").alias("tbl"), F.col("section_id").alias("row_id"), "line_no")
    )


@query(
    "p2_cleaned",
    _P2 + """, g as (select tbl, row_id, list(line_no) as gone from f group by 1, 2), h as (select 'pages' as tbl, row_id, html from pages union all select 'sections', section_id, html from sections)
    select tbl, row_id, case when gone is null then html else array_to_string(list_filter(string_split(html, chr(10)), lambda x, i: not list_contains(gone, i)), chr(10)) end as html
    from h left join g using (tbl, row_id)""",
)
def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The html of all pages and sections without the lines repeated within their source."""
    in_pages, in_sections = repeated_in(spark, sf_dir)
    pages = boilerplate.remove_lines(table(spark, sf_dir, "pages").select("row_id", "html"), in_pages, "row_id")
    sections = boilerplate.remove_lines(table(spark, sf_dir, "sections").select("section_id", "html"), in_sections, "section_id")
    return pages.select(F.lit("pages").alias("tbl"), "row_id", "html").unionAll(sections.select(F.lit("sections"), "section_id", "html"))


# The SQL of problem 3 has look-alikes of its own: what the titles and cells hold, written out.
_CYRILLIC = ("АВЕЅІЈКМНОРСТУХѕаеһіјорсухԁ", "ABESIJKMHOPCTYXsaehijopcyxd")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιυαργνάίόύ", "ABEZHIKMNOPTYXoiuapyváíóú")
_BLANKS = [9, 10, 11, 12, 13, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_UNSEEN = [173, 847, 1564, *range(6155, 6159), *range(8203, 8208), *range(8234, 8239), *range(8288, 8293), *range(8294, 8298), *range(65024, 65040), 65279]
_WIDE = range(65281, 65375)


def _form_sql(x: str) -> str:
    """The look-alike-mapped form; composition stands in for the collation."""
    chars = "".join(map(chr, _WIDE)) + _CYRILLIC[0] + _GREEK[0] + "ɡ‐‑﹣" + "".join(map(chr, _BLANKS))
    plain = "".join(chr(c - 65248) for c in _WIDE) + _CYRILLIC[1] + _GREEK[1] + "g---" + " " * len(_BLANKS)
    quoted = [t.replace("'", "''") for t in (chars, plain)]
    out = f"translate(nfc_normalize(translate({x}, '{''.join(map(chr, _UNSEEN))}', '')), '{quoted[0]}', '{quoted[1]}')"
    for char, letters in zip("ﬀﬁﬂﬃﬄ", ("ff", "fi", "fl", "ffi", "ffl")):
        out = f"replace({out}, '{char}', '{letters}')"
    return f"trim(nfc_normalize({out}), ' ')"


_DECIMAL = "list_reduce(list_prepend(h, list_distinct(regexp_extract_all(h, '&#[0-9]+;'))), lambda a, e: replace(a, e, chr(regexp_extract(e, '[0-9]+')::int)))"
_HEX = "list_reduce(list_prepend(h, list_distinct(regexp_extract_all(h, '&#x[0-9A-Fa-f]+;'))), lambda a, e: replace(a, e, chr(('0x' || e[4:-2])::int)))"
_TITLES = f"""
with h0 as (select row_id, unnest(regexp_extract_all(html, '(?is)<h2[^>]*>(.*?)</h2>', 1) || regexp_extract_all(html, '(?is)<h3[^>]*>(.*?)</h3>', 1) || regexp_extract_all(html, '(?is)<h4[^>]*>(.*?)</h4>', 1)) as h from pages),
h1 as (select row_id, replace(regexp_replace(h, '</?[A-Za-z][^<>]*>', '', 'g'), '&nbsp;', chr(160)) as h from h0), h2 as (select row_id, {_DECIMAL} as h from h1), h3 as (select row_id, {_HEX} as h from h2),
t as (select 'pages' as tbl, row_id, replace(h, '&amp;', '&') as text from h3 union all select 'outline', row_id, title from outline union all select 'table_cells', row_id, text from table_cells)
"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, text) of headings, outline titles and cells."""
    return (
        confusables.headings(table(spark, sf_dir, "pages")).select(F.lit("pages").alias("tbl"), "row_id", "text")
        .unionByName(table(spark, sf_dir, "outline").select(F.lit("outline").alias("tbl"), "row_id", F.col("title").alias("text")))
        .unionByName(table(spark, sf_dir, "table_cells").select(F.lit("table_cells").alias("tbl"), "row_id", "text"))
    )


@query("p3_found", _TITLES + f"select distinct tbl, row_id, ref_id from t join ref_titles on {_form_sql('text')} = {_form_sql('label')} and text <> label")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.look_like_labels(titles(spark, sf_dir), table(spark, sf_dir, "ref_titles"))


@query(
    "p3_unified",
    _TITLES + f""", n as (select text, {_form_sql("text")} as look, 1 as rank, count(*) as n from t where text is not null group by 1
        union all select distinct label, {_form_sql("label")}, 0, 0 from ref_titles where label is not null),
    best as (select look, text as canonical from n qualify row_number() over (partition by look order by rank, n.n desc, text) = 1)
    select tbl, row_id, md5(text) as text_hash, md5(canonical) as canonical_hash from t join n using (text) join best using (look) where rank = 1""",
)
def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and cell with the one string that stands for all that look like it."""
    both = confusables.unified(titles(spark, sf_dir), table(spark, sf_dir, "ref_titles"))
    return both.select("tbl", "row_id", F.md5("text").alias("text_hash"), F.md5("canonical").alias("canonical_hash"))


_P4 = """
select 'sections' as tbl, section_id::varchar as item_key from sections where length(html) > 8000
union
select 'entries', p.page_id from (select unnest(pages) as p from entries) where length(p.content) > 8000
"""


def oversized_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every item above 8,000 characters, once per item and text."""
    sections = table(spark, sf_dir, "sections").select(F.lit("sections").alias("tbl"), F.col("section_id").cast("string").alias("item_key"), F.col("html").alias("content"))
    exported = table(spark, sf_dir, "entries").select(F.explode("pages").alias("p")).select(F.lit("entries").alias("tbl"), F.col("p.page_id").alias("item_key"), "p.content")
    return splitting.split_items(sections.unionAll(exported), ("tbl", "item_key"), "content")


@query("p4_found", _P4)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an item above the limit is one that has a second piece
    return oversized_pieces(spark, sf_dir).where("piece_no = 2").select("tbl", "item_key").distinct()


@query("p4_pieces")
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_pieces(spark, sf_dir)


@query(
    "p4_reassembled",
    """select tbl, item_key, md5(content) as h, length(content)::bigint as chars, true as within, true as repeats from (
    select 'sections' as tbl, section_id::varchar as item_key, html as content from sections union select 'entries', p.page_id, p.content from (select unnest(pages) as p from entries)) where length(content) > 8000""",
)
def p4_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of an item say of themselves: joined without their overlaps they are the item, none is above the
    limit, and each repeats up to 200 characters of the one before."""
    pieces = oversized_pieces(spark, sf_dir).distinct().withColumn("own", F.expr("substr(piece, body_start - start + 1)"))
    again = F.col("body_start") - F.col("start")
    # an item exported with another text under one key has pieces of its own: told apart by where its last one ends
    return pieces.withColumn("chars", F.max("end").over(Window.partitionBy("tbl", "item_key"))).groupBy("tbl", "item_key", "chars").agg(
        F.md5(F.expr("listagg(own, '') within group (order by piece_no)")).alias("h"),
        F.every((F.length("piece") <= splitting.LIMIT) & (F.length("piece") == F.col("end") - F.col("start"))).alias("within"),
        F.every((F.col("piece_no") == 1) | again.between(1, splitting.OVERLAP)).alias("repeats"),
    ).select("tbl", "item_key", "h", F.col("chars").cast("long").alias("chars"), "within", "repeats")


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, cells, titles, words = (table(spark, sf_dir, n) for n in ("pages", "table_cells", "parsed_documents", "lexicon"))
    return scanfix.find_noise(pages, cells, titles, words)


@query("p5_paragraphs")
def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, cells, titles, words = (table(spark, sf_dir, n) for n in ("pages", "table_cells", "parsed_documents", "lexicon"))
    return scanfix.paragraphs(pages, titles, words, cells)


@query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


@query("p6_decoded", "select doc_id, md5(coalesce(text, '')) as h from documents")
def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids decoded again."""
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents"))).select("doc_id", F.md5("text").alias("h"))


@query("p7_pack")
def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = bpe.count_tokens(table(spark, sf_dir, "documents"))
    return packing.pack(sizes, CONTAINER)


@query("p7_invariants", "select count(*) as documents, 0::bigint as overfull, 0::bigint as divided, 0::bigint as gaps from documents")
def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: every document is in it, no container is above its capacity, none that fits is
    divided, and the pieces of a document are without gaps."""
    packed = p7_pack(spark, sf_dir)
    loads = packed.groupBy("container_id").agg(F.sum("piece_size").alias("load")).agg(F.count_if(F.col("load") > CONTAINER).alias("overfull"))
    each = packed.groupBy("doc_id", "copy_no").agg(F.count("*").alias("n"), F.sum("piece_size").alias("size"), F.max(F.col("piece_start") + F.col("piece_size")).alias("end"))
    items = each.agg(F.count("*").alias("documents"), F.count_if((F.col("n") > 1) & (F.col("size") <= CONTAINER)).alias("divided"), F.count_if(F.col("end") != F.col("size")).alias("gaps"))
    none = F.lit(0).cast("long")
    both = items.withColumn("overfull", none).unionByName(loads.select(none.alias("documents"), none.alias("divided"), none.alias("gaps"), "overfull"))
    return both.agg(*[F.sum(c).alias(c) for c in ("documents", "overfull", "divided", "gaps")])


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair_texts(table(spark, sf_dir, "documents"), suspects=True).where("garbled").select("doc_id")


@query("p8_repaired")
def p8_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, the garbled ones with their text restored as far as it can be."""
    return mojibake.repair_texts(table(spark, sf_dir, "documents"))
