"""The core queries and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import html as html_
from leafmill.functions import text
from leafmill.operators import diagnostics as diagnose
from leafmill.operators import engines, entries, extract, layout, manifest, outline, pages, sections, tables, toc
from leafmill.operators.nested import flatten_tables
from leafmill.options import MODULE_ID, Options
from leafmill.plans import convert
from leafmill.plans import extract as extract_plan
from leafmill.sources import json_cache as cache
from leafmill.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL, if it has any."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_KEY = "replace(regexp_replace(substr(F, 2), '\\[(\\d+)\\]', '.\\1', 'g'), '.', '/')"
_NESTED = f"""
with p as (select raw_id, case when json_valid(payload) then
             case when json_type(payload) = 'VARCHAR' then json_extract_string(payload, '$') else payload end end as j
           from structured_tables),
q as (select raw_id, j from p where json_valid(j)),
n as (select q.raw_id, t.fullkey, t.type, t.value from q, json_tree(q.j::json) t),
tab as (select raw_id, fullkey, value, coalesce(json_extract_string(value, '$.id'), '') as id from n
        where type = 'OBJECT' and json_exists(value, '$.id') and json_exists(value, '$.rows')),
parent as (select a.raw_id, a.fullkey, arg_max(b.id, length(b.fullkey)) as id, arg_max(b.fullkey, length(b.fullkey)) as pkey from tab a join tab b
           on a.raw_id = b.raw_id and (starts_with(a.fullkey, b.fullkey || '.') or starts_with(a.fullkey, b.fullkey || '['))
           group by 1, 2),
own as (select tab.raw_id, {_KEY.replace("F", "tab.fullkey")} as table_key, {_KEY.replace("F", "parent.pkey")} as parent_key, coalesce(parent.id, '') as parent_table_id, tab.id as table_id, tab.value
        from tab left join parent using (raw_id, fullkey)),
r as (select raw_id, table_key, parent_table_id, table_id, generate_subscripts(l, 1)::int as row_pos, unnest(l) as row from
      (select *, json_extract(value, '$.rows[*]') as l from own)),
c0 as (select *, case when json_type(row) = 'ARRAY' then json_extract(row, '$[*]') else json_extract(row, '$.cells[*]') end as l from r),
c as (select * from (select raw_id, table_key, parent_table_id, table_id, row_pos, generate_subscripts(l, 1)::int as cell_pos, unnest(l) as cell from c0) where json_type(cell) <> 'NULL'),
m as (select raw_id, table_key, parent_table_id, table_id, generate_subscripts(l, 1)::int as note_pos, unnest(l) as note from
      (select *, json_extract(value, '$.meta.notes[*]') as l from own))
"""


def _at(path: str, kind: str, of: str) -> str:
    return f"try_cast(json_extract_string({of}, '{path}') as {kind})"


def _list_sql(name: str, source: str, keys: str, of: str, path: str, place: str) -> str:
    return f", {name} as (select {keys}, generate_subscripts(l, 1)::int as {place}, unnest(l) as x from (select *, json_extract({of}, '{path}[*]') as l from {source}))"


_BOX = ", ".join(f"coalesce({_at('$.' + n, 'double', 'b')}, {_at(f'$[{i}]', 'double', 'b')}) as {n}" for i, n in enumerate("xywh"))
_INSIDE = "substr(table_key, length(parent_key) + 1), '^/rows/(\\d+)(?:/cells)?/(\\d+)/'"
_MARK = _list_sql("k", "c", "raw_id, table_key, row_pos, cell_pos", "cell", "$.marks", "mark_pos")
_NESTED_SQL = {
    "tables": f"""select raw_id, table_key, parent_key, table_id, parent_table_id, try_cast(regexp_extract({_INSIDE}, 1) as int) + 1 as parent_row_pos, try_cast(regexp_extract({_INSIDE}, 2) as int) + 1 as parent_cell_pos,
        {_at("$.caption", "varchar", "value")} as caption, case when json_type(value, '$.rows') = 'ARRAY' then json_array_length(value, '$.rows') else 0 end::int as n_rows,
        {_at("$.meta.source_page", "int", "value")} as source_page, {_at("$.meta.confidence", "double", "value")} as confidence,
        case when json_type(value, '$.meta.detector') = 'OBJECT' then {_at("$.meta.detector.name", "varchar", "value")} else {_at("$.meta.detector", "varchar", "value")} end as detector,
        {_at("$.meta.detector.version.major", "int", "value")} as detector_major, {_at("$.meta.detector.version.minor", "int", "value")} as detector_minor,
        {_at("$.meta.continued_from.id", "varchar", "value")} as continued_from_id, {_at("$.meta.continued_from.page", "int", "value")} as continued_from_page from own""",
    "rows": f"select raw_id, table_key, table_id, parent_table_id, row_pos, len(l)::int as n_cells, {_at('$.height', 'double', 'row')} as height from c0",
    "cells": f"""select raw_id, table_key, table_id, parent_table_id, row_pos, cell_pos, {_at("$.text", "varchar", "cell")} as text, {_at("$.row_span", "int", "cell")} as row_span,
        {_at("$.col_span", "int", "cell")} as col_span, {_at("$.is_header", "boolean", "cell")} as is_header from c""",
    "boxes": f"""select * from (select raw_id, table_key, row_pos, cell_pos, {_BOX} from (select raw_id, table_key, row_pos, cell_pos, json_extract(cell, '$.bbox') as b from c
        union all select raw_id, table_key, 0, 0, json_extract(value, '$.bbox') from own)) where coalesce(x, y, w, h) is not null""",
    "notes": f"select raw_id, table_key, table_id, parent_table_id, note_pos, {_at('$.code', 'varchar', 'note')} as code from m",
    "note_cells": _list_sql("k", "m", "raw_id, table_key, note_pos", "note", "$.cells", "ref_pos") + f" select raw_id, table_key, note_pos, ref_pos, {_at('$[0]', 'int', 'x')} as row_no, {_at('$[1]', 'int', 'x')} as col_no from k",
    "marks": _MARK + f" select raw_id, table_key, row_pos, cell_pos, mark_pos, {_at('$.kind', 'varchar', 'x')} as kind from k",
    "mark_refs": _MARK + _list_sql("f", "k", "raw_id, table_key, row_pos, cell_pos, mark_pos", "x", "$.refs", "ref_pos") + f" select raw_id, table_key, row_pos, cell_pos, mark_pos, ref_pos, {_at('$.n', 'int', 'x')} as n from f",
    "content": _list_sql("k", "c", "raw_id, table_key, row_pos, cell_pos", "cell", "$.content", "part_pos") + f" select raw_id, table_key, row_pos, cell_pos, part_pos, {_at('$.kind', 'varchar', 'x')} as kind, {_at('$.value', 'varchar', 'x')} as value from k",
    "unparsed": "select raw_id from p where j is null or not json_valid(j)",
}


@query(
    "p1_found",
    _NESTED + """
    select raw_id, parent_table_id, table_id, 'cell' as item, row_pos as pos1, cell_pos as pos2 from c
    union all
    select raw_id, parent_table_id, table_id, 'note', note_pos, 0 from m""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = flatten_tables(table(spark, sf_dir, "structured_tables"), "items")
    return items.select("raw_id", "parent_table_id", "table_id", "item", "pos1", "pos2")


def _register_target(target: str, sql: str) -> None:
    """p1_<target>: one of the flat tables that the payloads come apart into."""

    @query(f"p1_{target}", _NESTED + sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten_tables(table(spark, sf_dir, "structured_tables"), target).drop("reason")


for _target, _sql in _NESTED_SQL.items():
    _register_target(_target, _sql)


# Functions on characters and words

_SP = "chr(160)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8239)||chr(8287)"
_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def normal_sql(x: str) -> str:
    out = f"translate({x}, {_SP}||chr(9), repeat(' ', 13))"
    for pattern, by in ((" {2,}", "' '"), ("\\n{3,}", "chr(10)||chr(10)"), (" +\\n", "chr(10)"), (f"^{_WHITE}+|{_WHITE}+$", "''")):
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    return out


@query("plain_characters", "select doc_id, md5(translate(text, chr(8260)||chr(8209)||chr(8722)||chr(173)||chr(65533)||chr(8203)||chr(8204)||chr(8205)||chr(65279), '/--')) as h from documents")
def plain_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.plain_characters(F.col("text"))).alias("h"))


@query("normalize_whitespace", f"select doc_id, md5({normal_sql('text')}) as h from documents")
def normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_whitespace(F.col("text"))).alias("h"))


_L = "A-Za-zÀ-ÖØ-öø-ÿ"


@query("join_apostrophes", f"select doc_id, md5(regexp_replace(regexp_replace(text, '([''’]){_WHITE}+([{_L}])', '\\1\\2', 'g'), '([{_L}]){_WHITE}+([''’])', '\\1\\2', 'g')) as h from documents")
def join_apostrophes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.join_apostrophes(F.col("text"))).alias("h"))


def _slug_sql(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled')"


@query("slugs", f"select row_id, {_slug_sql('title')} as slug, replace(lower(title), ' ', '-') as dashed from outline")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "outline").select("row_id", text.slug(F.col("title")).alias("slug"), text.dashed(F.col("title")).alias("dashed"))


_COVER = f"length(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[^a-zA-Z0-9.,;:!?\\-{_WHITE[1:]}', '', 'g'))"


@query("text_coverage", f"select row_id, coalesce({_COVER}, 0)::int as chars, least(coalesce({_COVER}, 0) / 3000.0::double, 1.0::double) as coverage, coalesce({_COVER}, 0) / 3000.0 < 0.05 as wanted from pages")
def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("row_id", F.coalesce(text.coverage_characters(html), F.lit(0)).alias("chars"), text.text_coverage(html).alias("coverage"), text.needs_ocr(html, "auto").alias("wanted"))


@query("escape_html", "select row_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as escaped from table_cells")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "table_cells").select("row_id", html_.escape(F.col("text")).alias("escaped"))


# Functions on fragments

_BODY = r"case when regexp_matches(html, '(?is)<body[^>]*>(.*?)</body>') then regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) else html end"


@query("body_inner", f"select row_id, md5({_BODY}) as h from pages")
def body_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("row_id", F.md5(html_.body_inner(F.col("html"))).alias("h"))


def _scaffold_sql(x: str) -> str:
    for pattern in ("<!DOCTYPE[^>]*>", "<head[^>]*>.*?</head>", "</?html[^>]*>", "<style[^>]*>.*?</style>"):
        x = f"regexp_replace({x}, '(?is){pattern}{_WHITE}*', '', 'g')"
    return x


@query("without_scaffold", f"select row_id, md5({_scaffold_sql('html')}) as h from pages")
def without_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("row_id", F.md5(html_.without_scaffold(F.col("html"))).alias("h"))


@query(
    "scoped_pages",
    "select row_id, md5('<div class=''leafmill''>' || regexp_replace(coalesce(html, ''), '(?i)(<img\\b[^>]*?\\bsrc\\s*=\\s*[''\"])(assets/)', '\\1modules/' || mod_id || '/\\2', 'g') || '</div>') as h from pages join parsed_documents using (doc_id)",
)
def scoped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "pages").join(table(spark, sf_dir, "parsed_documents").select("doc_id", "mod_id"), "doc_id")
    return both.select("row_id", F.md5(html_.module_image_sources(html_.wrap_scope(F.col("html")), F.col("mod_id"))).alias("h"))


# The clean-up in SQL, a step per function of (x). RE2 knows no Unicode word boundary, so that is written out.
_OUTSIDE = r"(^|[^\p{L}\p{N}\p{M}_])"
_NAMES = {"nbsp": 160, "raquo": 187, "laquo": 171, "copy": 169, "middot": 183, "mdash": 8212, "ndash": 8211, "gt": 62, "lt": 60, "quot": 34, "eacute": 233, "hellip": 8230}
_HEADING = r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"
_HEADING_PARTS = r"(?is)^(<h[1-6]\b[^>]*>)(.*?)(</h[1-6]>)$"


def unescape_sql(x: str) -> str:
    """Named references as the data has them, then decimal and hexadecimal ones, the ampersand last."""
    for name, point in _NAMES.items():
        x = f"replace({x}, '&{name};', chr({point}))"
    decimal = f"list_reduce(list_prepend({x}, list_distinct(regexp_extract_all({x}, '&#[0-9]+;'))), lambda a, e: replace(a, e, chr(regexp_extract(e, '[0-9]+')::int)))"
    return decimal


def hex_sql(x: str) -> str:
    points = f"list_reduce(list_prepend({x}, list_distinct(regexp_extract_all({x}, '&#[xX][0-9A-Fa-f]+;'))), lambda a, e: replace(a, e, chr(('0x' || e[4:-2])::int)))"
    return f"replace({points}, '&amp;', '&')"


def split_zip(x: str, pattern: str, by: str) -> str:
    """Each match of a pattern replaced by `by`, an expression of p[2], the match, and i, its number from 1."""
    return f"case when {x} is not null then array_to_string(list_transform(list_zip(string_split_regex({x}, '{pattern}'), regexp_extract_all({x}, '{pattern}')), lambda p, i: p[1] || case when p[2] is null then '' else {by} end), '') end"


def plain_sql(x: str) -> str:
    return f"translate({x}, chr(8260)||chr(8209)||chr(8722)||chr(173)||chr(65533)||chr(8203)||chr(8204)||chr(8205)||chr(65279), '/--')"


def body_sql(x: str) -> str:
    pattern = "'(?is)<body[^>]*>(.*?)</body>'"
    return f"case when regexp_matches({x}, {pattern}) then regexp_extract({x}, {pattern}, 1) else {x} end"


def apostrophes_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '([\'\'’]){_WHITE}+([{_L}])', '\\1\\2', 'g'), '([{_L}]){_WHITE}+([\'\'’])', '\\1\\2', 'g')"


def ligatures_sql(x: str) -> str:
    for _ in range(2):
        x = f"regexp_replace(regexp_replace({x}, '{_OUTSIDE}(fi|fl|ff|ffi|ffl){_WHITE}+([{_L}])', '\\1\\2\\3', 'g'), 'ff{_WHITE}+([{_L}])', 'ff\\1', 'g')"
    return x


def initials_sql(x: str) -> str:
    return f"regexp_replace({x}, '{_OUTSIDE}([A-ZÀ-Ö]){_WHITE}+([a-zà-öø-ÿ]{{2,}})', '\\1\\2\\3', 'g')"


def headings_sql(x: str) -> str:
    part = lambda n: f"regexp_extract(p[2], '{_HEADING_PARTS}', {n})"
    inner = f"regexp_replace({part(2)}, '(?i)^{_WHITE}*[wx]{_WHITE}+|{_WHITE}+[wx]{_WHITE}*$', '', 'g')"
    return split_zip(x, _HEADING, f"{part(1)} || {inner} || {part(3)}")


def bullets_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '<li>{_WHITE}*[iI]{_WHITE}*</li>', '', 'g'), '(<li(?:{_WHITE}[^>]*)?>){_WHITE}*[iI]{_WHITE}+([^<])', '\\1\\2', 'g')"


_CLEAN = (unescape_sql, hex_sql, plain_sql, body_sql, lambda x: _scaffold_sql(x), apostrophes_sql, ligatures_sql, initials_sql, headings_sql, bullets_sql, normal_sql)


def steps_sql(source: str, keys: str, steps: tuple = _CLEAN, name: str = "k") -> str:
    """Common table expressions k0 .. kN: (keys, x) of `source`, step by step; the last is named `done`."""
    out = [f"{name}0 as ({source})"]
    for n, step in enumerate(steps, 1):
        out.append(f"{'done' if n == len(steps) else f'{name}{n}'} as (select {keys}, {step('x')} as x from {name}{n - 1})")
    return ", ".join(out)


@query("unescaped", f"with {steps_sql('select row_id, html as x from pages', 'row_id', (unescape_sql, hex_sql))} select row_id, md5(x) as h from done")
def unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("row_id", F.md5(html_.unescape(F.col("html"))).alias("h"))


@query("join_ligatures", f"select doc_id, md5({ligatures_sql('text')}) as h from documents")
def join_ligatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.join_ligatures(F.col("text"))).alias("h"))


@query("join_initials", f"select row_id, md5({initials_sql('html')}) as h from pages")
def join_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("row_id", F.md5(text.join_initials(F.col("html"))).alias("h"))


# pages with the ornaments and bullets that extraction leaves
_DIRTY = "replace(replace(replace(replace(html, '<h2>', '<h2>w '), '</h3>', ' X </h3>'), '<li>', '<li> i '), '<ul>', '<ul><li>I</li>')"


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("row_id", F.expr(_DIRTY).alias("html"))


@query("tidy_headings", f"with {steps_sql(f'select row_id, {_DIRTY} as x from pages', 'row_id', (headings_sql,))} select row_id, md5(x) as h from done")
def tidy_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).select("row_id", F.md5(html_.tidy_headings(F.col("html"))).alias("h"))


@query("tidy_bullets", f"with {steps_sql(f'select row_id, {_DIRTY} as x from pages', 'row_id', (bullets_sql,))} select row_id, md5(x) as h from done")
def tidy_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).select("row_id", F.md5(html_.tidy_bullets(F.col("html"))).alias("h"))


@query("clean_pages", f"with {steps_sql('select row_id, html as x from pages', 'row_id')} select row_id, x as html from done")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("row_id", html_.clean_fragment(F.col("html")).alias("html"))


# What pages hold

_LINKS = """
select row_id, generate_subscripts(m, 1)::int as link_ord, unnest(m) as target from
(select row_id, regexp_extract_all(html, '(?i)<a\\s+[^>]*href="([^"]+)"', 1) as m from pages)
"""
_KIND = "case when starts_with(target, 'http://') or starts_with(target, 'https://') or starts_with(target, 'mailto:') then 'external' else 'internal' end"


@query("links", f"select row_id, link_ord, {_KIND} as kind, target from ({_LINKS})")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links(table(spark, sf_dir, "pages"), ["row_id"])


@query("link_counts", f"select doc_id, {_KIND} as kind, count(*) as n from ({_LINKS}) join pages using (row_id) group by 1, 2")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links(table(spark, sf_dir, "pages"), ["doc_id"]).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


_SOURCE = 'src="data:image/[^;"]+;base64,[^"]+"'
_EXT = "lower(trim(regexp_extract(p[2], 'data:image/([^;\"]+);', 1)))"
_ASSET = f"'src=\"assets/page-' || lpad(page_no::varchar, 4, '0') || '_img_' || lpad(i::varchar, 4, '0') || '.' || case when {_EXT} = 'jpeg' then 'jpg' when contains({_EXT}, 'svg') then 'svg' else {_EXT} end || '\"'"
_EMBEDDED = """
select row_id, page_no, generate_subscripts(m, 1)::int as img_ord, lower(trim(unnest(m))) as ext from
(select row_id, page_no, regexp_extract_all(html, 'src="data:image/([^;"]+);base64,([^"]+)"', 1) as m from pages)
"""
_NAME = "'page-' || lpad(page_no::varchar, 4, '0') || '_img_' || lpad(img_ord::varchar, 4, '0') || '.' || case when ext = 'jpeg' then 'jpg' when contains(ext, 'svg') then 'svg' else ext end"


@query("embedded_images", f"select row_id, img_ord, {_NAME} as name, 'assets/' || {_NAME} as src from ({_EMBEDDED})")
def embedded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.embedded_images(table(spark, sf_dir, "pages"), ["row_id"]).drop("content")


@query("assets_rewritten", f"select row_id, md5({split_zip('html', _SOURCE, _ASSET)}) as h from pages")
def assets_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("row_id", F.md5(extract.embedded_images_to_assets(F.col("html"), F.col("page_no"))).alias("h"))


_HTML_TABLES = """
select row_id, doc_id, page_no, generate_subscripts(m, 1)::int as table_ord, unnest(m) as t from
(select *, regexp_extract_all(html, '(?is)<table.*?</table>') as m from pages)
"""


@query("html_tables", f"select row_id, table_ord, md5(t) as h from ({_HTML_TABLES})")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.html_tables(table(spark, sf_dir, "pages"), ["row_id"]).select("row_id", "table_ord", F.md5("html").alias("h"))


_FIRST = "select * from pages qualify row_number() over (partition by doc_id, page_no order by loaded_at, row_id) = 1"
_STRUCTURED = "select doc_id, page_no, table_ord, max(confidence) as confidence from table_cells group by all"


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "table_cells").groupBy("doc_id", "page_no", "table_ord").agg(F.max("confidence").alias("confidence"))


@query(
    "table_decisions",
    f"""select h.doc_id, h.page_no, h.table_ord, case when s.doc_id is not null and coalesce(s.confidence, 0.5) >= 0.6 then 'structured' else 'html' end as kind
    from ({_HTML_TABLES.replace("from pages", f"from ({_FIRST})")}) h left join ({_STRUCTURED}) s on (h.doc_id, h.page_no, h.table_ord) = (s.doc_id, s.page_no, s.table_ord)""",
)
def table_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = pages.first_deliveries(table(spark, sf_dir, "pages"))
    found = extract.html_tables(once, ["doc_id", "page_no"])
    return extract.decide_tables(found, _structured(spark, sf_dir), ["doc_id", "page_no"], "auto").drop("name")


_TABLE = "(?is)<table.*?</table>"


def extracted_sql(mode: str) -> str:
    """Common table expressions up to `extracted` (doc_id, page_no, html): first deliveries with images renamed and tables as the mode asks; needs `grid`."""
    image = "'<img src=\"assets/page-' || lpad(page_no::varchar, 4, '0') || '_table_' || lpad(i::varchar, 4, '0') || '.png\">'"
    own = f"renamed as (select doc_id, page_no, {split_zip('html', _SOURCE, _ASSET)} as html from (select doc_id, page_no, coalesce(html, '') as html from ({_FIRST})))"
    if mode == "image-only":
        return own + f", extracted as (select doc_id, page_no, {split_zip('html', _TABLE, image)} as html from renamed)"
    least = "coalesce(s.confidence, 0.5) >= 0.6" if mode == "auto" else "true"
    return own + f""", placed as (select doc_id, page_no, table_id, min(table_ord) as table_ord, max(confidence) as confidence from table_cells where table_id is not null group by all),
    segs as (select doc_id, page_no, string_split_regex(html, '{_TABLE}') as a, regexp_extract_all(html, '{_TABLE}') as b from renamed),
    parts as (select doc_id, page_no, generate_subscripts(a, 1) as i, unnest(a) as piece, b from segs),
    extracted as (select p.doc_id, p.page_no, string_agg(p.piece || coalesce(r.html, p.b[p.i], ''), '' order by p.i) as html
        from parts p left join (select s.doc_id, s.page_no, s.table_ord, t.html from placed s join rendered t using (doc_id, page_no, table_id) where {least}) r
        on (r.doc_id, r.page_no, r.table_ord) = (p.doc_id, p.page_no, p.i) and p.i <= len(p.b) group by 1, 2)"""


@query("content_hashes", "select substring(sha256(text), 1, 16) as hash, count(*) as n from documents where text is not null group by 1")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").where("text is not null")
    return texts.groupBy(engines.content_hash(F.col("text").cast("binary")).alias("hash")).agg(F.count("*").alias("n"))


# Which pages

@query("first_deliveries", f"select row_id, doc_id, page_no, md5(html) as h from ({_FIRST})")
def first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.first_deliveries(table(spark, sf_dir, "pages")).select("row_id", "doc_id", "page_no", F.md5("html").alias("h"))


@query(
    "page_specs",
    """select doc_id, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) as spec from (
    select doc_id, min(page_no) as a, max(page_no) as b from (select doc_id, page_no, page_no - row_number() over (partition by doc_id order by page_no) as run
    from (select distinct doc_id, page_no from pages where page_no is not null)) group by doc_id, run) group by doc_id""",
)
def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_specs(table(spark, sf_dir, "pages"), ["doc_id"])


@query("page_selection", "select row_id, doc_id, page_no from pages where page_no in (1, 3, 4, 5)")
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.select_pages(table(spark, sf_dir, "pages"), pages.parse_page_spec("1,3-5")).select("row_id", "doc_id", "page_no")


@query("missing_pages", "select doc_id, p as page_no from parsed_documents, (select unnest([3, 4, 5])::int as p) where p > page_count")
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.missing_pages(table(spark, sf_dir, "parsed_documents"), pages.parse_page_spec("3-5"))


# Outlines and sections

_TREE = """
with recursive once as (select doc_id, node_id, parent_id, sibling_ord, title, page from outline
    qualify row_number() over (partition by doc_id, node_id order by sibling_ord nulls first, title nulls first, page nulls first) = 1),
n as (select *, greatest(1, coalesce(page, 1)) as page_start, SLUG as slug,
    lpad((row_number() over (partition by doc_id, parent_id order by sibling_ord, node_id))::varchar, 8, '0') as place from once),
t as (select doc_id, node_id, node_id as root_id, 1 as level, title, page_start, place as key, [slug] as path from n where parent_id is null
    union all
    select n.doc_id, n.node_id, t.root_id, t.level + 1, n.title, n.page_start, t.key || n.place, list_append(t.path, n.slug)
    from t join n on n.doc_id = t.doc_id and n.parent_id = t.node_id),
o as (select t.*, row_number() over (partition by doc_id order by key) as dfs_ord from t),
c as (select doc_id, max(coalesce(page_count, 0)) as pages from parsed_documents group by 1),
nxt as (select a.doc_id, a.dfs_ord, min(b.dfs_ord) as nx from o a join o b on a.doc_id = b.doc_id and b.dfs_ord > a.dfs_ord and b.level <= a.level group by all),
tree as (select o.doc_id, o.node_id, o.root_id, o.level, o.dfs_ord::int as dfs_ord, o.title, o.page_start, o.path,
    least(case when nxt.nx is null then greatest(coalesce(c.pages, 0), 1) else greatest(1, b.page_start - 1) end, greatest(coalesce(c.pages, 0), 1)) as page_end
    from o left join nxt using (doc_id, dfs_ord) left join o b on b.doc_id = o.doc_id and b.dfs_ord = nxt.nx left join c on c.doc_id = o.doc_id),
named as (select *, case when r = 1 then path[-1] else path[-1] || '-' || r end as uniq from
    (select *, row_number() over (partition by doc_id, level, path[-1] order by dfs_ord) as r from tree)),
roots as (select doc_id, root_id, (row_number() over (partition by doc_id order by dfs_ord))::int as chapter_ord, title as chapter_title, uniq as chapter_slug, page_start as f, page_end as e from named where level = 1),
below as (select doc_id, root_id, dfs_ord, level, title, page_start, page_end, uniq from named where level >= 2),
synth as (select doc_id, root_id, p::int as dfs_ord, 2 as level, 'Page ' || p as title, p::int as page_start, p::int as page_end, 'page-' || lpad(p::varchar, 3, '0') as uniq from
    (select doc_id, root_id, unnest(generate_series(f, e)) as p from roots where e >= f and not exists (select 1 from below b where b.doc_id = roots.doc_id and b.root_id = roots.root_id))),
spans as (select s.doc_id, r.chapter_ord, (row_number() over (partition by s.doc_id, s.root_id order by s.dfs_ord))::int as section_ord, s.level, s.title, s.page_start, s.page_end, r.chapter_slug, s.uniq, r.chapter_title
    from (select * from below union all select * from synth) s join roots r using (doc_id, root_id))
""".replace("SLUG", _slug_sql("title"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.outline_tree(table(spark, sf_dir, "outline"), table(spark, sf_dir, "parsed_documents"))


@query("outline_tree", _TREE + "select doc_id, node_id, root_id, level, dfs_ord, title, page_start, page_end, array_to_string(path, '/') as path from tree")
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).withColumn("path", F.array_join("path", "/"))


@query("unique_paths", _TREE + 'select doc_id, node_id, uniq as "unique" from named')
def unique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.unique_slugs(_tree(spark, sf_dir)).select("doc_id", "node_id", "unique")


_LOST = "select row_id, doc_id, node_id, case when node_id % 7 = 3 then 100000 when node_id % 7 = 5 then node_id else parent_id end as parent_id, sibling_ord, title, page from outline"


@query("outline_unreachable", _TREE.replace("from outline\n    qualify", f"from ({_LOST})\n    qualify") + "select distinct doc_id, node_id from outline o where not exists (select 1 from tree t where t.doc_id = o.doc_id and t.node_id = o.node_id)")
def outline_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes lost where some parents are missing and some nodes are their own parents."""
    parent = F.expr("case when node_id % 7 = 3 then 100000 when node_id % 7 = 5 then node_id else parent_id end")
    nodes = table(spark, sf_dir, "outline").withColumn("parent_id", parent)
    return outline.unreachable(nodes, outline.outline_tree(nodes, table(spark, sf_dir, "parsed_documents")))


@query("outline_counts", _TREE + "select doc_id, count(*) filter (level = 1) as chapters, count(*) filter (level >= 2) as sections from tree group by 1")
def outline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.outline_counts(_tree(spark, sf_dir))


@query("outline_fallback", "select distinct doc_id, 1 as node_id, 'Document' as title, 1 as page from parsed_documents where doc_id not in (select doc_id from outline where doc_id is not null)")
def outline_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.fallback_outline(table(spark, sf_dir, "parsed_documents"), table(spark, sf_dir, "outline")).select("doc_id", "node_id", "title", "page")


@query("section_spans", _TREE + "select doc_id, chapter_ord, section_ord, level, title, page_start, page_end, chapter_slug || '/' || uniq as id_path from spans")
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.spans(_tree(spark, sf_dir)).select("doc_id", "chapter_ord", "section_ord", "level", "title", "page_start", "page_end", F.array_join("id_path", "/").alias("id_path"))


_MERGED = f"""
, first as ({_FIRST}), lastp as (select doc_id, max(page_no) as last from first group by 1),
merged as (select s.doc_id, s.chapter_ord, s.section_ord, string_agg(coalesce(p.html, ''), chr(10) || chr(10) order by p.page_no) as html
    from spans s join first p on p.doc_id = s.doc_id and p.page_no between s.page_start and s.page_end group by all)
"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.merge_pages(sections.spans(_tree(spark, sf_dir)), pages.first_deliveries(table(spark, sf_dir, "pages")))


@query("section_html", _TREE + _MERGED + "select s.doc_id, s.chapter_ord, s.section_ord, md5(coalesce(m.html, '')) as h from spans s left join merged m using (doc_id, chapter_ord, section_ord)")
def section_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("doc_id", "chapter_ord", "section_ord", F.md5("html").alias("h"))


# Entries and tables of contents

_STRIP = f"nullif(regexp_replace(T, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '')"
_PAGES = f"""
, raws as (select s.*, d.mod_id, coalesce({_STRIP.replace("T", "s.title")}, 'Untitled Section ' || section_ord) as raw,
    coalesce({_STRIP.replace("T", "s.chapter_title")}, 'Untitled Chapter ' || chapter_ord) as entry_name
    from spans s join (select doc_id, min(mod_id) as mod_id from parsed_documents group by 1) d using (doc_id)),
nm as (select *, case when k = 1 then raw else raw || ' (' || k || ')' end as name from
    (select *, row_number() over (partition by doc_id, chapter_ord, raw order by section_ord) as k from raws)),
pg as (select doc_id, chapter_ord, section_ord, substring(sha1(mod_id || '|' || chapter_slug || '|entry'), 1, 16) as entry_id, entry_name,
    substring(sha1(mod_id || '|' || chapter_slug || '|page|' || name), 1, 16) as page_id, name, greatest(1, least(3, level - 1)) as level, section_ord * 1000 as sort from nm)
"""


def _page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.name_pages(sections.spans(_tree(spark, sf_dir)), table(spark, sf_dir, "parsed_documents"))


@query("page_names", _TREE + _PAGES + "select * from pg")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_names(spark, sf_dir).select("doc_id", "chapter_ord", "section_ord", "entry_id", "entry_name", "page_id", "name", "level", "sort")


_TOC = """
, ch as (select doc_id, chapter_ord, '<section class="toc-chapter"><h2>' || entry_name || '</h2><ul>' ||
    string_agg('<li>@UUID[JournalEntry.' || entry_id || '.JournalEntryPage.' || page_id || ']{' || name || '}</li>', '' order by sort, section_ord) || '</ul></section>' as part from pg group by doc_id, chapter_ord, entry_name),
toc as (select doc_id, '<div class="leafmill toc"><h1>Table of Contents</h1>' || string_agg(part, '' order by chapter_ord) || '</div>' as html from ch group by 1)
"""


@query("toc_html", _TREE + _PAGES + _TOC + "select doc_id, md5(html) as h from toc")
def toc_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.render_toc(_page_names(spark, sf_dir)).select("doc_id", F.md5("html").alias("h"))


@query(
    "toc_broken",
    _TREE + _PAGES + """, ex as (select distinct doc_id, entry_id, p.page_id from (select doc_id, entry_id, unnest(pages) as p from entries))
    select doc_id, '''' || name || ''' targets missing ' || case when exists (select 1 from ex d where d.doc_id = p.doc_id and d.entry_id = p.entry_id) then 'page ' || page_id || ' in entry ' || entry_id else 'entry ' || entry_id end as issue
    from pg p where not exists (select 1 from ex d where d.doc_id = p.doc_id and d.entry_id = p.entry_id and d.page_id = p.page_id)""",
)
def toc_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the tables of contents checked against the exported entries."""
    exported = table(spark, sf_dir, "entries").select("doc_id", "entry_id", F.explode("pages.page_id").alias("page_id"))
    return toc.broken_links(toc.render_toc(_page_names(spark, sf_dir)), exported).select("doc_id", "issue")


def content_sql(source: str) -> str:
    """Common table expressions up to `content` (doc_id, chapter_ord, section_ord, content) of merged sections (..., x); needs `pg`."""
    keys = "doc_id, chapter_ord, section_ord"
    anchor = r"(?i)<a\s+[^>]*href\s*=\s*['\'\"][^'\'\"]+['\'\"][^>]*>[\s\S]*?</a>".replace("'\\'", "''")
    parts = r"(?i)^<a\s+[^>]*href\s*=\s*['\'\"]([^'\'\"]+)['\'\"][^>]*>([\s\S]*?)</a>$".replace("'\\'", "''")
    href, label = (f"regexp_extract(p[2], '{parts}', {n})" for n in (1, 2))
    target = f"coalesce(anchors[{_slug_sql(f'substr({href}, 2)')}], anchors[lower(substr({href}, 2))])"
    link = f"case when not starts_with({href}, '#') then p[2] when {target} is not null then '@UUID[JournalEntry.' || entry_id || '.JournalEntryPage.' || {target} || ']{{' || {label} || '}}' else {label} end"
    return f"""{steps_sql(source, keys)},
    toks as (select doc_id, chapter_ord, token, arg_min(page_id, section_ord) as id from (select doc_id, chapter_ord, section_ord, page_id, {_slug_sql("name")} as token from pg
        union all select doc_id, chapter_ord, section_ord, page_id, replace(lower(name), ' ', '-') from pg) group by 1, 2, 3),
    anch as (select doc_id, chapter_ord, map(list(token), list(id)) as anchors from toks group by 1, 2),
    scoped as (select {keys}, entry_id, anchors, regexp_replace('<div class=''leafmill''>' || x || '</div>', '(?i)(<img\\b[^>]*?\\bsrc\\s*=\\s*[''\"])(assets/)', '\\1modules/' || mod_id || '/\\2', 'g') as x
        from done join pg using ({keys}) join (select doc_id, min(mod_id) as mod_id from parsed_documents group by 1) using (doc_id) join anch using (doc_id, chapter_ord)),
    content as (select {keys}, {split_zip("x", anchor, link)} as content from scoped)"""


_SECTION = "select s.doc_id, s.chapter_ord, s.section_ord, coalesce(m.html, '') as x from spans s left join merged m using (doc_id, chapter_ord, section_ord)"


@query("entry_pages", _TREE + _MERGED + _PAGES + ", " + content_sql(_SECTION) + " select doc_id, entry_id, page_id, name, level, sort, content from pg join content using (doc_id, chapter_ord, section_ord)")
def entry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.entry_pages(_merged(spark, sf_dir), table(spark, sf_dir, "parsed_documents")).select("doc_id", "entry_id", "page_id", "name", "level", "sort", "content")


# pages with a rule broken here and there
_BREAK = {
    "level": "case when section_ord % 5 = 1 then 7 else level end", "name": "case when section_ord % 5 = 2 then chr(160) || ' ' else name end",
    "page_id": "case when section_ord % 5 = 3 then upper(page_id) || 'X' else page_id end", "content": "case when section_ord % 5 = 4 then null else 'x' end",
}


@query("invalid_pages", _TREE + _PAGES + f""", b as (select doc_id, {", ".join(f"{sql} as {c}" for c, sql in _BREAK.items())} from pg)
    select doc_id, page_id, 'level is not 1 to 3' as issue from b where level not between 1 and 3 union all select doc_id, page_id, 'the name is blank' from b where not regexp_matches(name, '[^\\s\\x{{a0}}]')
    union all select doc_id, page_id, 'the id is not 16 hexadecimal digits' from b where not regexp_full_match(page_id, '[a-f0-9]{{16}}') union all select doc_id, page_id, 'there is no content' from b where content is null""")
def invalid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _page_names(spark, sf_dir)
    broken = named.select("doc_id", *[F.expr(sql.replace("chr(160)", "'\u00a0'")).alias(c) for c, sql in _BREAK.items()])
    return entries.invalid_pages(broken)


@query("anchor_tokens", f"""
with p as (select e.entry_id, x.page_id, x.name, x.sort_ord from (select distinct on (entry_id) entry_id, pages from entries order by entry_id, exported_at desc) e, unnest(e.pages) as u(x)),
t as (select entry_id, page_id, sort_ord, {_slug_sql('name')} as token from p union all select entry_id, page_id, sort_ord, replace(lower(name), ' ', '-') from p)
select entry_id, token, arg_min(page_id, sort_ord) as page_id from t where token is not null group by 1, 2
""")
def anchor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "entries").groupBy("entry_id").agg(F.max_by("pages", "exported_at").alias("pages"))
    listed = latest.select("entry_id", F.inline("pages"))
    tokens = extract.anchor_tokens(listed, ["entry_id"], "name", "page_id", "sort_ord")
    return tokens.select("entry_id", F.explode("anchors").alias("token", "page_id"))


# Tables and layout

_OWN = """
with own as (select doc_id, page_no, table_id, row_idx, col_idx, coalesce(text, '') as text, greatest(1, coalesce(rowspan, 1)) as rowspan, greatest(1, coalesce(colspan, 1)) as colspan, coalesce(is_header, false) as is_header
    from table_cells where tbl_x0 is not null and tbl_y0 is not null and tbl_x1 is not null and tbl_y1 is not null and row_idx is not null and col_idx is not null
    qualify row_number() over (partition by doc_id, page_no, table_id, row_idx, col_idx order by loaded_at desc, row_id desc) = 1),
cov as (select doc_id, page_no, table_id, r, unnest(generate_series(col_idx, col_idx + colspan - 1)) as c from (select *, unnest(generate_series(row_idx, row_idx + rowspan - 1)) as r from own)),
ext as (select doc_id, page_no, table_id, min(r) as r0, max(r) as r1, min(c) as c0, max(c) as c1 from cov group by all),
places as (select doc_id, page_no, table_id, r, unnest(generate_series(c0, c1)) as c from (select *, unnest(generate_series(r0, r1)) as r from ext)),
grid as (select * from own union all select p.doc_id, p.page_no, p.table_id, p.r::int, p.c::int, '', 1, 1, false from places p
    where not exists (select 1 from cov where (cov.doc_id, cov.page_no, cov.table_id, cov.r, cov.c) = (p.doc_id, p.page_no, p.table_id, p.r, p.c)))
"""


@query("table_grid", _OWN + "select * from grid")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_grid(table(spark, sf_dir, "table_cells"))


_CELL = "'<' || TAG || case when colspan > 1 then ' colspan=\"' || colspan || '\"' else '' end || case when rowspan > 1 then ' rowspan=\"' || rowspan || '\"' else '' end || '>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '</' || TAG || '>'"


_RENDERED = f""", m as (select *, is_header and row_idx = min(row_idx) over (partition by doc_id, page_no, table_id) as head from grid),
    rws as (select doc_id, page_no, table_id, row_idx, string_agg(case when not head then {_CELL.replace("TAG", "'td'")} end, '' order by col_idx) as td, string_agg(case when head then {_CELL.replace("TAG", "'th'")} end, '' order by col_idx) as th from m group by all),
    rendered as (select doc_id, page_no, table_id, '<table>' || case when max(th) is not null then '<thead><tr>' || max(th) || '</tr></thead>' else '' end || '<tbody>' || string_agg('<tr>' || coalesce(td, '') || '</tr>', '' order by row_idx) || '</tbody></table>' as html from rws group by 1, 2, 3)
"""


@query("table_html", _OWN + _RENDERED + "select doc_id, page_no, table_id, md5(html) as h from rendered")
def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.render_tables(tables.table_grid(table(spark, sf_dir, "table_cells"))).select("doc_id", "page_no", "table_id", F.md5("html").alias("h"))


@query("table_ids", "select distinct doc_id, page_no, table_id, substring(sha1('table_' || page_no || '_' || table_id), 1, 16) as id from table_cells")
def table_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_ids(table(spark, sf_dir, "table_cells"))


@query("best_tables", """select doc_id, page_no, table_id, least(1.0, confidence) as confidence from (select doc_id, page_no, table_id, table_ord, max(confidence) as confidence from table_cells group by all)
    where confidence > 0 qualify row_number() over (partition by doc_id, page_no order by confidence desc, table_ord, table_id desc) = 1""")
def best_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "table_cells").groupBy("doc_id", "page_no", "table_id", "table_ord").agg(F.max("confidence").alias("confidence"))
    return tables.best_tables(each)


_W, _H = "least(x1, tbl_x1) - greatest(x0, tbl_x0)", "least(y1, tbl_y1) - greatest(y0, tbl_y0)"


@query("cell_overlap", f"""select row_id, round(case when {_W} > 0 and {_H} > 0 and (x1 - x0) * (y1 - y0) > 0 then ({_W}) * ({_H}) / ((x1 - x0) * (y1 - y0)) else 0.0 end, 6) as overlap
    from table_cells where x0 is not null and y0 is not null and x1 is not null and y1 is not null and tbl_x0 is not null and tbl_y0 is not null and tbl_x1 is not null and tbl_y1 is not null""")
def cell_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    cells = table(spark, sf_dir, "table_cells").where(" and ".join(f"{p}{s} is not null" for p in ("", "tbl_") for s in ("x0", "y0", "x1", "y1")))
    a, b = ((c(f"{p}x0"), c(f"{p}y0"), c(f"{p}x1") - c(f"{p}x0"), c(f"{p}y1") - c(f"{p}y0")) for p in ("", "tbl_"))
    return cells.select("row_id", F.round(tables.overlap(a, b), 6).alias("overlap"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cells as positioned blocks of their pages."""
    cells = table(spark, sf_dir, "table_cells")
    return cells.select("doc_id", "page_no", F.col("row_id").alias("block_ord"), F.when(F.col("is_header"), "heading").otherwise("text").alias("type"), "x0", "y0", "x1", "y1", "text")


@query("column_counts", """
with b as (select doc_id, page_no, row_id, (x0 + x1) / 2 as x from table_cells), n as (select doc_id, page_no, count(*) as blocks from b group by all),
g as (select doc_id, page_no, x, row_number() over w - 1 as i, x - lag(x) over w as gap from b where x is not null window w as (partition by doc_id, page_no order by x, row_id)),
a as (select doc_id, page_no, count(*) as n, max(x) - min(x) as spread from g group by all),
m as (select doc_id, page_no, i, gap from g where gap > 0 qualify row_number() over (partition by doc_id, page_no order by gap desc, i) = 1)
select n.doc_id, n.page_no, case when blocks >= 8 and a.n >= 8 and i < a.n - 1 and gap / greatest(1.0, spread) >= 0.3 and least(i, a.n - i)::double / a.n >= 0.3 then 2 else 1 end as columns
from n left join a using (doc_id, page_no) left join m using (doc_id, page_no)""")
def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_counts(_blocks(spark, sf_dir))


@query("histogram_split", """
with p as (select doc_id, page_no, (x0 + x1) / 2 as x from table_cells where x0 is not null and x1 is not null and not coalesce(is_header, false)),
g as (select doc_id, page_no, min(x) as lo, least(20, count(*) // 2) as bins, (max(x) - min(x)) / least(20, count(*) // 2) as step from p group by all having count(*) >= 8 and max(x) > min(x)),
b as (select distinct doc_id, page_no, least(floor((x - lo) / step)::int, bins - 1) as bin from p join g using (doc_id, page_no)),
v as (select doc_id, page_no, min(a.bin) + 1 as bin from b a where exists (select 1 from b c where (c.doc_id, c.page_no, c.bin) = (a.doc_id, a.page_no, a.bin + 2))
    and not exists (select 1 from b c where (c.doc_id, c.page_no, c.bin) = (a.doc_id, a.page_no, a.bin + 1)) group by all),
s as (select doc_id, page_no, lo + (bin + 0.5) * step as boundary from v join g using (doc_id, page_no))
select doc_id, page_no, boundary from p join s using (doc_id, page_no) group by all
having count(*) filter (x < boundary) >= 3 and count(*) filter (x > boundary) >= 3 and min(x) filter (x > boundary) - max(x) filter (x < boundary) >= 0.08 * 612""")
def histogram_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.histogram_split(_blocks(spark, sf_dir))


@query("reading_order")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_blocks(spark, sf_dir))


# Manifests

_AUTHOR = "nullif(trim(coalesce(author, '')), '')"


@query("manifests", f"""select doc_id, mod_id as id, title, '13' as minimum, {_AUTHOR} as author, pack_name as pack, title || ' Journals' as label, 'packs/' || pack_name as path, nullif(trim(coalesce(license, '')), '') as license from parsed_documents""")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("manifest")
    made = manifest.manifests(table(spark, sf_dir, "parsed_documents"))
    first = lambda a, f: F.try_element_at(a, F.lit(1))[f]
    return made.select(
        "doc_id", m["id"].alias("id"), m["title"].alias("title"), m["compatibility"]["minimum"].alias("minimum"), first(m["authors"], "name").alias("author"),
        first(m["packs"], "name").alias("pack"), first(m["packs"], "label").alias("label"), first(m["packs"], "path").alias("path"), m["license"].alias("license"),
    )


# documents whose manifests break a rule: by the number of pages, a field is blank or the version is low
_MEMBER = {"mod_id": 1, "title": 2}


@query("manifest_issues", """
    with d as (select doc_id, coalesce(page_count, 0) % 6 as r, mod_id, title from parsed_documents)
    select doc_id, 'id is missing' as issue from d where coalesce(mod_id, '') = '' or r = 1 union all select doc_id, 'title is missing' from d where coalesce(title, '') = '' or r = 2
    union all select doc_id, 'compatibility.minimum is below 13' from d where r = 3 union all select doc_id, 'there are no packs' from d where r = 4
    union all select doc_id, 'the first pack is not of type JournalEntry' from d where r = 5 union all select doc_id, 'the first pack''s path does not end with its name' from d where r = 5""")
def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "parsed_documents").withColumn("r", F.coalesce("page_count", F.lit(0)) % 6)
    blank = documents.withColumns({c: F.when(F.col("r") == n, "").otherwise(F.col(c)) for c, n in _MEMBER.items()})
    m = F.col("manifest")
    pack = m["packs"][0]
    made = manifest.manifests(blank).join(documents.select("doc_id", "r"), "doc_id")
    other = m.withField("packs", F.array(pack.withField("type", F.lit("Item")).withField("path", F.lit("packs/none"))))
    broken = F.when(F.col("r") == 3, m.withField("compatibility", F.struct(F.lit("9").alias("minimum")))).when(F.col("r") == 4, m.withField("packs", F.filter(m["packs"], lambda p: F.lit(False)))).when(F.col("r") == 5, other).otherwise(m)
    return manifest.manifest_issues(made.select("doc_id", broken.alias("manifest")))


# Recognised text

@query("ocr_blocks", """select doc_id, md5('<div class="ocr-content" data-source="ocr">' || chr(10) || string_agg('<p data-ocr="true" data-ocr-confidence="0.500">' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' || chr(10), '' order by row_id) || '</div>') as h
    from outline where regexp_matches(title, '[^\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]') group by 1""")
def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "outline").select("doc_id", F.col("row_id").alias("ord"), F.col("title").alias("text"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("language"))
    return engines.ocr_block(results, ["doc_id"]).select("doc_id", F.md5("block").alias("h"))


@query("mean_confidence", "select doc_id, coalesce(avg(confidence) filter (confidence > 0) / 100, 0.0) as confidence from table_cells group by 1")
def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engines.mean_confidence(table(spark, sf_dir, "table_cells"), ["doc_id"])


# Whole pipeline: extraction, outlines with a chapter for documents without, sections, entries, contents

_ALL_NODES = """from (select doc_id, node_id, parent_id, sibling_ord, title, page from outline union all
    select distinct doc_id, 1, null, 1, 'Document', 1 from parsed_documents where doc_id not in (select doc_id from outline where doc_id is not null))
    qualify"""
_CONVERTED = (
    _TREE.replace("from outline\n    qualify", _ALL_NODES) + ", " + (_OWN + _RENDERED).strip().removeprefix("with ") + ", " + extracted_sql("auto")
    + _MERGED.replace(f"first as ({_FIRST})", "first as (select * from extracted)") + _PAGES + _TOC + ", " + content_sql(_SECTION)
    + """, whole as (select doc_id, chapter_ord, entry_id, entry_name, chapter_ord::varchar as dummy, page_id, name, sort, content from pg join content using (doc_id, chapter_ord, section_ord)
    union all select doc_id, 0, substring(sha1(mod_id || '|toc|entry'), 1, 16), 'Table of Contents', '', substring(sha1(mod_id || '|toc|page|Table of Contents'), 1, 16), 'Table of Contents', 1000, html
        from toc join (select doc_id, min(mod_id) as mod_id from parsed_documents group by 1) using (doc_id))"""
)


@query("entries_nested", _CONVERTED + """
    select doc_id, chapter_ord, entry_id, entry_name as name, '!journal!' || entry_id as _key, count(*)::int as n, string_agg('!journal.pages!' || entry_id || '.' || page_id, ',' order by sort) as pages,
    string_agg(name, '/' order by sort) as names, md5(string_agg(content, '' order by sort)) as h from whole group by 1, 2, 3, 4""")
def entries_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = convert.convert_tables(spark, sf_dir).entries
    return nested.select("doc_id", "chapter_ord", "entry_id", "name", "_key", F.size("pages").alias("n"), F.array_join("pages._key", ",").alias("pages"), F.array_join("pages.name", "/").alias("names"), F.md5(F.array_join("pages.text.content", "")).alias("h"))


@query("conversion_counts", _CONVERTED + "select doc_id, count(distinct entry_id) as entries, count(*) as pages, sum(length(content))::bigint as chars from whole group by 1")
def conversion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.convert_tables(spark, sf_dir).pages.groupBy("doc_id").agg(F.countDistinct("entry_id").alias("entries"), F.count("*").alias("pages"), F.sum(F.length("content")).alias("chars"))


# What is wrong, images, titles

_DOCS = "(select doc_id, min(page_count) as page_count from parsed_documents group by 1)"


@query("diagnostics", _TREE + f"""
select doc_id, null::int as page_no, 'outline-missing' as code, 'warning' as severity, 'no outline' as message from {_DOCS} where doc_id not in (select doc_id from outline where doc_id is not null)
union all select doc_id, null, 'page-count-missing', 'warning', 'no page count' from {_DOCS} where page_count is null
union all select doc_id, page_no, 'page-empty', 'warning', 'no html' from pages where html is null or html = ''
union all select doc_id, page_no, 'page-beyond-end', 'error', 'behind the last page' from pages join {_DOCS} using (doc_id) where page_no > page_count
union all select doc_id, null, 'outline-page-invalid', 'warning', 'node ' || node_id from outline join {_DOCS} using (doc_id) where page is null or page < 1 or page > page_count
union all select doc_id, page_no, 'page-delivered-again', 'info', count(*) || ' deliveries' from pages group by doc_id, page_no having count(*) > 1
union all select distinct doc_id, page_no, 'table-without-box', 'warning', table_id from table_cells where tbl_x0 is null or tbl_y0 is null or tbl_x1 is null or tbl_y1 is null
union all select distinct doc_id, null, 'outline-node-unreachable', 'error', 'node ' || node_id from outline o where not exists (select 1 from tree t where t.doc_id = o.doc_id and t.node_id = o.node_id)
""")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.diagnostics(*(table(spark, sf_dir, n) for n in ("parsed_documents", "pages", "outline", "table_cells")))


_TAGS = """
select row_id, generate_subscripts(m, 1)::int as img_ord, unnest(m) as tag from (select row_id, regexp_extract_all(html, '<img[^>]*\\ssrc="[^"]*"[^>]*>') as m from pages)
"""


@query("image_tags", f"""select row_id, img_ord, regexp_extract(tag, '\\ssrc="([^"]*)"', 1) as src, string_split(regexp_extract(tag, '\\ssrc="([^"]*)"', 1), '/')[-1] as name,
    case when regexp_matches(tag, '\\salt="') then regexp_extract(tag, '\\salt="([^"]*)"', 1) end as alt from ({_TAGS})""")
def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.image_tags(table(spark, sf_dir, "pages"), ["row_id"])


@query("all_images", f"""select row_id, (row_number() over (partition by row_id order by origin, img_ord))::int as img_ord, name, origin from (
    select row_id, img_ord, {_NAME} as name, 'embedded' as origin from ({_EMBEDDED})
    union all select row_id, img_ord, string_split(regexp_extract(tag, '\\ssrc="([^"]*)"', 1), '/')[-1], 'referenced' from ({_TAGS}) where not contains(tag, 'src="data:'))""")
def all_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "pages")
    referenced = extract.image_tags(source, ["row_id"]).where(~F.col("src").startswith("data:"))
    return extract.all_images(extract.embedded_images(source, ["row_id"]), referenced, ["row_id"])


@query("title_blocks", """select doc_id, trim(arg_min(text, row_id), ' ') as title from table_cells where page_no = 1 and is_header and regexp_matches(text, '[^\\s]') group by 1""")
def title_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.title_blocks(_blocks(spark, sf_dir).withColumn("font_size", F.lit(None).cast("double")))


@query("pages_with_tables", _OWN + _RENDERED + ", " + extracted_sql("structured").replace(split_zip("html", _SOURCE, _ASSET), "html") + " select doc_id, page_no, md5(html) as h from extracted")
def pages_with_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "table_cells")
    places = cells.select("doc_id", "page_no", "table_id", "table_ord").distinct()
    rendered = tables.render_tables(tables.table_grid(cells)).join(places, ["doc_id", "page_no", "table_id"])
    first = pages.first_deliveries(table(spark, sf_dir, "pages"))
    return extract.pages_with_tables(first, rendered, ["doc_id", "page_no"]).select("doc_id", "page_no", F.md5(F.coalesce("html", F.lit(""))).alias("h"))


def _register_extraction(mode: str) -> None:
    """pages_extracted_<mode>: pages after extraction with tables in one mode."""

    @query(f"pages_extracted_{mode.replace('-', '_')}", _OWN + _RENDERED + ", " + extracted_sql(mode) + " select doc_id, page_no, md5(html) as h from extracted")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        first = pages.first_deliveries(table(spark, sf_dir, "pages"))
        got = extract_plan.extract_pages(first, Options(tables=mode), cells=table(spark, sf_dir, "table_cells"))
        return got.pages.select("doc_id", "page_no", F.md5("html").alias("h"))


for _mode in ("auto", "structured", "image-only"):
    _register_extraction(_mode)


# The cache of converted documents

@query("json_cache", f"""
    with f as ({_FIRST}), n as (select doc_id, greatest(coalesce(page_count, 0), coalesce(last, 0))::int as n from (select doc_id, max(page_count) as page_count from parsed_documents group by 1) left join (select doc_id, max(page_no) as last from f group by 1) using (doc_id))
    select a.doc_id, a.page_no, md5(coalesce(f.html, '')) as h from (select doc_id, unnest(generate_series(1, n))::int as page_no from n) a left join f using (doc_id, page_no)""")
def json_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON and read back, page by page."""
    first = pages.first_deliveries(table(spark, sf_dir, "pages"))
    good, _ = cache.parse_cache(cache.to_cache(table(spark, sf_dir, "parsed_documents"), first), "json")
    return cache.cached_pages(good).select("doc_id", "page_no", F.md5("html").alias("h"))


@query("cache_rerun", f"""
    with f as ({_FIRST}), n as (select doc_id, greatest(coalesce(page_count, 0), coalesce(last, 0))::int as n from (select doc_id, max(page_count) as page_count from parsed_documents group by 1) left join (select doc_id, max(page_no) as last from f group by 1) using (doc_id))
    select doc_id, case when n > 10 then 'converted' else 'cached' end as source, case when n > 10 then 1 else n end::bigint as pages from n where n > 0""")
def cache_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run from a cache in which longer documents are cut off: these are converted again, the rest is read."""
    documents = table(spark, sf_dir, "parsed_documents")
    cached = cache.to_cache(documents, pages.first_deliveries(table(spark, sf_dir, "pages")))
    cut = cached.withColumn("json", F.when(F.get_json_object("json", "$.num_pages").cast("int") > 10, F.expr("left(json, 30)")).otherwise(F.col("json")))
    longer = cached.where(F.get_json_object("json", "$.num_pages").cast("int") > 0).select("doc_id").distinct()
    again = lambda left: left.join(longer, "doc_id", "left_semi").select("doc_id", F.lit(1).alias("page_no"), F.lit("").alias("html"), F.lit("converted").alias("error"))
    return cache.reused(documents, cut, again, "json").groupBy("doc_id", F.coalesce("error", F.lit("cached")).alias("source")).agg(F.count("*").alias("pages"))


@query("file_names", _TREE + f"""select distinct doc_id, chapter_ord, lpad(chapter_ord::varchar, 3, '0') || '-' || {_slug_sql('entry_name')} || '.json' as file_name
    from (select doc_id, chapter_ord, coalesce({_STRIP.replace("T", "chapter_title")}, 'Untitled Chapter ' || chapter_ord) as entry_name from spans)""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _page_names(spark, sf_dir).select("doc_id", "chapter_ord", "entry_id", F.col("entry_name").alias("name")).distinct()
    return sinks.file_names(named).select("doc_id", "chapter_ord", "file_name")


# Further operators, each on what the tables have

_CAPTION = "case row_id % 5 when 0 then ' a photo of ' when 1 then 'The image shows ' when 2 then 'IMAGE: ' when 3 then 'this is ' else '' end || coalesce(title, '')"
_BARE = f"regexp_replace(regexp_replace(c, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '(?i)^(a photo of |an image of |this is |the image shows |image: )', '')"


@query("tidy_captions", f"select row_id, nullif(upper(substr(b, 1, 1)) || substr(b, 2), '') as caption from (select row_id, {_BARE} as b from (select row_id, {_CAPTION} as c from outline))")
def tidy_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "outline").select("row_id", text.tidy_caption(F.expr(_CAPTION)).alias("caption"))


_MODULE = "case coalesce(page_count, 0) % 4 when 0 then mod_id when 1 then '-_-' when 2 then mod_id || chr(233) else mod_id || ' x' end"


@query("module_ids", f"select doc_id, regexp_full_match({_MODULE}, '[-_]*[A-Za-z0-9][-_A-Za-z0-9]*') as valid from parsed_documents where mod_id is not null")
def module_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_documents").where("mod_id is not null").select("doc_id", F.expr(_MODULE).rlike(MODULE_ID).alias("valid"))


@query("captions_put", f"""
    with f as (select row_id, html, list_distinct(regexp_extract_all(html, '(?i)<img[^>]*>')) as tags from pages)
    select row_id, md5({split_zip("html", "(?i)<img[^>]*>", """case when regexp_extract(p[2], '(?i)src="(?:[^"]*/)?([^"/]+[.](?:png|jpg|jpeg|gif|svg))"', 1) = '' then p[2]
        when regexp_matches(p[2], 'alt="[^"]*"') then regexp_replace(p[2], 'alt="[^"]*"', 'alt="A &lt;' || regexp_extract(p[2], '(?i)src="(?:[^"]*/)?([^"/]+[.](?:png|jpg|jpeg|gif|svg))"', 1) || '&gt;"', 'g')
        else regexp_replace(p[2], '>$', '') || ' alt="A &lt;' || regexp_extract(p[2], '(?i)src="(?:[^"]*/)?([^"/]+[.](?:png|jpg|jpeg|gif|svg))"', 1) || '&gt;">' end""")}) as h from f where contains(html, '<img')""")
def captions_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions by file name as alternative texts of the images of each page."""
    source = table(spark, sf_dir, "pages").where("html like '%<img%'")
    images = extract.image_tags(source, ["row_id"]).where("src not like 'data:%'").withColumn("caption", F.concat(F.lit("A <"), "name", F.lit(">")))
    known = source.join(extract.caption_map(images, ["row_id"]), "row_id", "left")
    return known.select("row_id", F.md5(extract.captions_to_alt(F.col("html"), F.coalesce("captions", F.create_map().cast("map<string,string>")))).alias("h"))


@query("placeholders_filled", """select row_id, md5('a' || case row_id % 4 when 1 then '<T1>' when 2 then '<T2>' else '<!-- Structured  Table ' || row_id % 4 || ' -->' end || coalesce(title, '')) as h from outline""")
def placeholders_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.expr("concat('a<!-- Structured  Table ', row_id % 4, ' -->', coalesce(title, ''))")
    return table(spark, sf_dir, "outline").select("row_id", F.md5(extract.fill_placeholders(html, F.array(F.lit("<T1>"), F.lit("<T2>")))).alias("h"))


_REGION = (100.0, 100.0, 300.0, 400.0)
_RW, _RH = "least(x1, 400.0) - greatest(x0, 100.0)", "least(y1, 500.0) - greatest(y0, 100.0)"


@query("best_tables_in_region", f"""
    with t as (select doc_id, page_no, table_id, table_ord, max(confidence) as confidence, min(tbl_x0) as x0, min(tbl_y0) as y0, max(tbl_x1) as x1, max(tbl_y1) as y1 from table_cells group by all),
    o as (select *, case when {_RW} > 0 and {_RH} > 0 and (x1 - x0) * (y1 - y0) > 0 then ({_RW}) * ({_RH}) / ((x1 - x0) * (y1 - y0)) else 0.0 end as share from t)
    select doc_id, page_no, table_id, round(least(1.0, confidence * share), 6) as confidence from o where share >= 0.1 and confidence * share > 0
    qualify row_number() over (partition by doc_id, page_no order by confidence * share desc, table_ord, table_id desc) = 1""")
def best_tables_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "table_cells").groupBy("doc_id", "page_no", "table_id", "table_ord").agg(
        F.max("confidence").alias("confidence"), F.min("tbl_x0").alias("x0"), F.min("tbl_y0").alias("y0"), F.max("tbl_x1").alias("x1"), F.max("tbl_y1").alias("y1")
    )
    return tables.best_tables(each, _REGION).withColumn("confidence", F.round("confidence", 6))


@query("table_references", """
    with s as (select doc_id, page_no, table_id, max(confidence) as confidence from table_cells group by all),
    i as (select doc_id, page_no, case when page_no % 3 > 0 then table_id || case when page_no % 3 = 2 then 'x' else '' end end as ref, case when page_no % 3 = 0 then table_id end as table_id from s)
    select doc_id, page_no, table_id, null::double as confidence from i where ref is null
    union all select i.doc_id, i.page_no, s.table_id, s.confidence from i join (select doc_id, table_id, max(confidence) as confidence from s group by 1, 2) s on s.doc_id = i.doc_id and s.table_id = i.ref""")
def table_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are tables, that refer to a stored one, and that refer to none."""
    own = table(spark, sf_dir, "table_cells").groupBy("doc_id", "page_no", "table_id").agg(F.max("confidence").alias("confidence"))
    ref = F.expr("case when page_no % 3 > 0 then table_id || case when page_no % 3 = 2 then 'x' else '' end end")
    items = own.select("doc_id", "page_no", ref.alias("ref"), F.expr("case when page_no % 3 = 0 then table_id end").alias("table_id"))
    return tables.resolve_references(items, own.groupBy("doc_id", "table_id").agg(F.max("confidence").alias("confidence"))).select("doc_id", "page_no", "table_id", "confidence")


@query("raster_cells", "select distinct doc_id, page_no, table_id, '[Rasterized table: ' || table_id || ']' as text from table_cells")
def raster_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.raster_fallback(table(spark, sf_dir, "table_cells").select("doc_id", "page_no", "table_id").distinct())


@query("toc_united", _TREE + _PAGES + _TOC + """
    select doc_id, 0 as chapter_ord, 1 as section_ord, substring(sha1(mod_id || '|toc|entry'), 1, 16) as entry_id, substring(sha1(mod_id || '|toc|page|Table of Contents'), 1, 16) as page_id, md5(html) as h
        from toc join (select doc_id, min(mod_id) as mod_id from parsed_documents group by 1) using (doc_id)
    union all select doc_id, chapter_ord, section_ord, entry_id, page_id, md5('') from pg""")
def toc_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry pages with the table of contents before them."""
    named = _page_names(spark, sf_dir)
    both = toc.toc_entries(named).unionByName(named.withColumn("content", F.lit("")))
    return both.select("doc_id", "chapter_ord", "section_ord", "entry_id", "page_id", F.md5("content").alias("h"))


@query("ocr_put", """select row_id, md5(case when contains(h, '</body>') then replace(h, '</body>', b || chr(10) || '</body>') when contains(h, '</html>') then replace(h, '</html>', b || chr(10) || '</html>') else h || chr(10) || b end) as h
    from (select row_id, coalesce(html, '') as h, '<div>' || row_id || '</div>' as b from pages)""")
def ocr_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("<div>"), F.col("row_id").cast("string"), F.lit("</div>"))
    return table(spark, sf_dir, "pages").select("row_id", F.md5(engines.put_ocr(F.coalesce("html", F.lit("")), block)).alias("h"))


@query("ocr_spans", f"""select row_id, '<span data-ocr="true"' || case when confidence > 0 then ' data-ocr-confidence="' || printf('%.3f', confidence) || '"' else '' end || ' data-ocr-language="en">' ||
    replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</span>' as span from table_cells""")
def ocr_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "table_cells").select("row_id", "text", "confidence", F.lit("en").alias("language"))
    return engines.ocr_spans(results).select("row_id", "span")


@query("ocr_once", "select doc_id, case when text is not null then 1 end as ord, case when text is not null then text end as text from documents")
def ocr_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition of each distinct content once, joined back to all that have it; the engine reads the bytes as text."""
    images = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    read = engines.once_per_content(images, lambda d: engines.recognize(d, lambda: lambda image: [(image.decode("utf-8"), 0.5, None)]))
    return read.select("doc_id", "ord", "text")


@query("page_iteration", "select row_id, page_no, page_no - 1 as page_index from pages where page_no in (1, 2, 9)")
def page_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.select_pages(table(spark, sf_dir, "pages"), [9, 1, 2, 1]).select("row_id", "page_no", (F.col("page_no") - 1).alias("page_index"))
