"""Nested table records to related flat tables (problem 1).

Payloads are JSON of unknown depth: table objects stand alone, in lists, in wrapper objects, and within cells of other
tables. One SQL projection does the work per payload:

* a fold (`aggregate`) goes down the value level by level; nested `transform` calls hand each child the key and id of
  the nearest table around it, and `flatten` joins the children to the next level. It ends with the last level, or as
  soon as as many tables were met as the text has members named "rows",
* every table object met is kept with its own key and its parent's,
* per target table one `inline` over flattened, nested `transform`s emits rows with their positions.

Everything is a narrow, JVM-side projection over each payload; no shuffle, no Python. The text is parsed once. A
payload's memory is that of its own parsed value.

Targets, each keyed by `keys` and `table_key` (the table's place in the payload as a JSON pointer):

* `tables` (parent_key, and the place of the cell around it), `rows`, `cells`, `boxes` (of tables: places 0, 0),
* `notes` and the cells they name (`note_cells`), the marks of cells (`marks`) and what these refer to (`mark_refs`),
* `content`, the parts of a cell that has several; a part that is a table is the table whose place it is,
* `others`: every member of a table, its meta, a row, a cell, a note, a mark or a part that no other target has, as JSON,
* `items`: cells and notes in one pass, keys and places only; `unparsed`: the payloads that are no JSON, with the reason.

Defined results: a null, empty or cut-off payload, and one with anything behind its value, gives no rows but in
`unparsed`; JSON quoted once more as a JSON string is parsed again (once). Spark parses JSON of up to 1,000 levels;
deeper values count as no JSON. An object that has a member twice is parsed, with the last value, if the session sets
spark.sql.variant.allowDuplicateKeys, else it is no JSON. A table object is an object with the members `id` and `rows`;
an id that is null gives the table id ''; a member of another type than expected counts as missing (and is null), a row
that is neither a list nor an object with a list `cells` has no cells, but keeps its place; null cells keep their place
and give no row. Repeated payloads give rows each, under their own `raw_id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODE = "struct<v:variant,k:string,tid:string,tk:string>"
_TABLE = "struct<table_key:string,parent_key:string,table_id:string,parent_table_id:string,obj:map<string,variant>>"
_LIST, _OBJECT = "array<variant>", "map<string,variant>"
#: Fold steps that are taken together; what is done after so many is looked at before the next.
_STRIDE = 16


def _parsed(text: str) -> str:
    """SQL: a text as a variant; null if it is no JSON or has anything behind its value."""
    return f"try_element_at(transform(filter(array(try_variant_get(try_parse_json(concat('[', {text}, ']')), '$', '{_LIST}')), a -> size(a) = 1), a -> a[0]), 1)"


def _table_objects() -> Column:
    """All table objects of a payload (root, most, depth), outermost first."""
    # a level is opened once: lists and objects are cast side by side, then their members are handed on
    opened = (
        "transform(acc.level, n -> named_struct('k', n.k, 'tid', n.tid, 'tk', n.tk,"
        f" 'arr', try_variant_get(n.v, '$', '{_LIST}'), 'obj', try_variant_get(n.v, '$', '{_OBJECT}')))"
    )
    is_table = "(map_contains_key(o.obj, 'id') and map_contains_key(o.obj, 'rows'))"
    own_id = "coalesce(try_variant_get(o.obj['id'], '$', 'string'), '')"
    members = "transform(o.arr, (x, i) -> named_struct('v', x, 'k', concat(o.k, '/', i), 'tid', o.tid, 'tk', o.tk))"
    fields = (
        "transform(map_entries(o.obj), e -> named_struct('v', e.value, 'k', concat(o.k, '/', replace(replace(e.key, '~', '~0'), '/', '~1')),"
        f" 'tid', if({is_table}, {own_id}, o.tid), 'tk', if({is_table}, o.k, o.tk)))"
    )
    none = f"cast(array() as array<{_NODE}>)"
    deeper = f"flatten(transform(s, o -> coalesce({members}, {fields}, {none})))"
    met = (
        f"transform(filter(s, o -> o.obj is not null and {is_table}), o -> named_struct('table_key', o.k,"
        f" 'parent_key', o.tk, 'table_id', {own_id}, 'parent_table_id', o.tid, 'obj', o.obj))"
    )
    step = (
        f"if(size(acc.level) = 0, acc, transform(array({opened}), s -> transform(array(concat(acc.met, {met})), m ->"
        f" named_struct('level', if(size(m) >= most, {none}, {deeper}), 'met', m))[0])[0])"
    )
    return F.expr(
        f"aggregate(sequence(1, depth), named_struct("
        f"'level', filter(array(named_struct('v', root, 'k', '', 'tid', '', 'tk', cast(null as string))), n -> n.v is not null),"
        f"'met', cast(array() as array<{_TABLE}>)), (all, d) -> if(size(all.level) = 0, all,"
        f" aggregate(sequence(1, {_STRIDE}), all, (acc, e) -> {step})), all -> all.met)"
    )


def parsed_payloads(df: DataFrame, payload: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, text, root): each payload's text, unquoted if it was quoted once more, and its value."""
    name = f"`{payload}`"
    text = F.expr(f"if({name} rlike '^\\\\s*\"', try_variant_get({_parsed(name)}, '$', 'string'), {name})")
    return df.select(*[F.col(f"`{k}`") for k in keys], text.alias("text")).withColumn("root", F.expr(_parsed("text")))


_ROWS = f"coalesce(try_variant_get(t.obj['rows'], '$', '{_LIST}'), cast(array() as {_LIST}))"
_CELLS = f"coalesce(try_variant_get(r, '$', '{_LIST}'), try_variant_get(r, '$.cells', '{_LIST}'), cast(array() as {_LIST}))"
_NOTES = f"coalesce(try_variant_get(t.obj['meta'], '$.notes', '{_LIST}'), cast(array() as {_LIST}))"
_KEYS = "'table_key', t.table_key, 'table_id', t.table_id, 'parent_table_id', t.parent_table_id"


def _per_cell(struct: str) -> str:
    """SQL: an array of `struct` for each non-null cell `c` at (i, j) of each table `t`."""
    cells = f"transform({_CELLS}, (c, j) -> if(c is null or is_variant_null(c), null, {struct}))"
    return (
        f"filter(flatten(transform(tables, t -> flatten(transform({_ROWS}, (r, i) -> {cells})))), x -> x is not null)"
    )


def _per_note(struct: str) -> str:
    return f"flatten(transform(tables, t -> transform({_NOTES}, (c, j) -> {struct})))"


def _per_row(struct: str) -> str:
    return f"flatten(transform(tables, t -> transform({_ROWS}, (r, i) -> {struct})))"


def _get(path: str, kind: str, of: str = "c") -> str:
    return f"try_variant_get({of}, '{path}', '{kind}')"


def _each(value: str, of: str = "c") -> str:
    """SQL: the list that a member is, empty if it is none."""
    return f"coalesce({_get(value, _LIST, of)}, cast(array() as {_LIST}))"


def _unless_known(value: str, known: str, where: str) -> str:
    """SQL: an array of (place, member, value) for the members of an object that are not `known`."""
    skip = ", ".join(f"'{k}'" for k in known.split())
    return (
        f"transform(filter(map_entries(coalesce({value}, map())), e -> e.key not in ({skip})), e -> named_struct('table_key', t.table_key,"
        f" 'place', {where}, 'member', e.key, 'value', to_json(e.value)))"
    )


def _box(value: str) -> str:
    """x, y, w and h of a box given as an object or a list of four; null where there is none."""
    return ", ".join(
        f"'{n}', coalesce(try_variant_get({value}, '$.{n}', 'double'), try_variant_get({value}, '$[{i}]', 'double'))"
        for i, n in enumerate("xywh")
    )


_AT = "'row_pos', i + 1, 'cell_pos', j + 1"
_META = "t.obj['meta']"
_MARKS, _PARTS = _each("$.marks"), _each("$.content")
#: The cell of its parent that a table stands in.
_INSIDE = "substring(t.table_key, length(t.parent_key) + 1), '^/rows/([0-9]+)(?:/cells)?/([0-9]+)/'"

_TARGETS = {
    "tables": (
        "transform(tables, t -> named_struct('table_key', t.table_key, 'parent_key', t.parent_key, 'table_id', t.table_id, 'parent_table_id', t.parent_table_id,"
        f" 'parent_row_pos', try_cast(regexp_extract({_INSIDE}, 1) as int) + 1, 'parent_cell_pos', try_cast(regexp_extract({_INSIDE}, 2) as int) + 1,"
        " 'caption', " + _get("$", "string", "t.obj['caption']") + f", 'n_rows', size({_ROWS}), 'source_page', " + _get("$.source_page", "int", _META)
        + ", 'confidence', " + _get("$.confidence", "double", _META)
        + ", 'detector', coalesce(" + _get("$.detector.name", "string", _META) + f", if({_get('$.detector', _OBJECT, _META)} is null, {_get('$.detector', 'string', _META)}, null))"
        + ", 'detector_major', " + _get("$.detector.version.major", "int", _META) + ", 'detector_minor', " + _get("$.detector.version.minor", "int", _META)
        + ", 'continued_from_id', " + _get("$.continued_from.id", "string", _META) + ", 'continued_from_page', " + _get("$.continued_from.page", "int", _META) + "))"
    ),
    "rows": _per_row(f"named_struct({_KEYS}, 'row_pos', i + 1, 'n_cells', size({_CELLS}), 'height', {_get('$.height', 'double', 'r')})"),
    "cells": _per_cell(
        f"named_struct({_KEYS}, {_AT}, 'text', {_get('$.text', 'string')}, 'row_span', {_get('$.row_span', 'int')},"
        f" 'col_span', {_get('$.col_span', 'int')}, 'is_header', {_get('$.is_header', 'boolean')})"
    ),
    "boxes": (
        "filter(concat(transform(tables, t -> named_struct('table_key', t.table_key, 'row_pos', 0, 'cell_pos', 0, "
        + _box("t.obj['bbox']")
        + ")), "
        + _per_cell(f"named_struct('table_key', t.table_key, {_AT}, " + _box("try_variant_get(c, '$.bbox', 'variant')") + ")")
        + "), b -> coalesce(b.x, b.y, b.w, b.h) is not null)"
    ),
    "notes": _per_note(f"named_struct({_KEYS}, 'note_pos', j + 1, 'code', {_get('$.code', 'string')})"),
    "note_cells": "flatten(" + _per_note(
        f"transform({_each('$.cells')}, (x, k) -> named_struct('table_key', t.table_key, 'note_pos', j + 1, 'ref_pos', k + 1,"
        f" 'row_no', {_get('$[0]', 'int', 'x')}, 'col_no', {_get('$[1]', 'int', 'x')}))"
    ) + ")",
    "marks": "flatten(" + _per_cell(f"transform({_MARKS}, (m, k) -> named_struct('table_key', t.table_key, {_AT}, 'mark_pos', k + 1, 'kind', {_get('$.kind', 'string', 'm')}))") + ")",
    "mark_refs": "flatten(flatten(" + _per_cell(
        f"transform({_MARKS}, (m, k) -> transform({_each('$.refs', 'm')}, (x, l) -> named_struct('table_key', t.table_key, {_AT}, 'mark_pos', k + 1,"
        f" 'ref_pos', l + 1, 'n', {_get('$.n', 'int', 'x')})))"
    ) + "))",
    "content": "flatten(" + _per_cell(
        f"transform({_PARTS}, (m, k) -> named_struct('table_key', t.table_key, {_AT}, 'part_pos', k + 1, 'kind', {_get('$.kind', 'string', 'm')}, 'value', {_get('$.value', 'string', 'm')}))"
    ) + ")",
    "others": "flatten(array("
    + "flatten(transform(tables, t -> concat(" + _unless_known("t.obj", "id rows bbox caption meta", "''") + ", "
    + _unless_known(_get("$", _OBJECT, _META), "source_page confidence detector continued_from notes", "'/meta'") + "))), "
    + "flatten(" + _per_row(_unless_known(_get("$", _OBJECT, "r"), "cells height", "concat('/rows/', i)")) + "), "
    + "flatten(" + _per_cell(_unless_known(_get("$", _OBJECT), "text bbox row_span col_span is_header marks content table tables", "concat('/rows/', i, '/', j)")) + "), "
    + "flatten(" + _per_note(_unless_known(_get("$", _OBJECT), "code cells", "concat('/meta/notes/', j)")) + "), "
    + "flatten(flatten(" + _per_cell(f"transform({_MARKS}, (m, k) -> " + _unless_known(_get("$", _OBJECT, "m"), "kind refs", "concat('/rows/', i, '/', j, '/marks/', k)") + ")") + ")), "
    + "flatten(flatten(" + _per_cell(f"transform({_PARTS}, (m, k) -> " + _unless_known(_get("$", _OBJECT, "m"), "kind value structured_table", "concat('/rows/', i, '/', j, '/content/', k)") + ")") + "))))",
    # cells and notes in one pass over the payload
    "items": (
        "concat("
        + _per_cell(f"named_struct({_KEYS}, 'item', 'cell', 'pos1', i + 1, 'pos2', j + 1)")
        + ", "
        + _per_note(f"named_struct({_KEYS}, 'item', 'note', 'pos1', j + 1, 'pos2', 0)")
        + ")"
    ),
}


def flatten_tables(df: DataFrame, target: str, payload: str = "payload", keys: tuple[str, ...] = ("raw_id",)) -> DataFrame:
    """Rows of one target (see above) for all payloads of `df`.

    `keys` are columns of `df` to carry along; (keys, table_key) joins the targets, (keys, parent_key) a table with the
    one around it. Other columns of `df` are pruned, whatever their names.
    """
    own = [F.col(f"`{k}`") for k in keys]
    parsed = parsed_payloads(df, payload, keys)
    if target == "unparsed":
        reason = F.when(F.expr("trim(both ' \t\n\r' from text) = ''"), "empty").otherwise("not JSON")
        return parsed.where("root is null").select(*own, F.when(F.col("text").isNull(), "null, or not JSON once unquoted").otherwise(reason).alias("reason"))
    # a table has a member named rows; where letters of it may be written as escapes, nothing is known
    most = F.expr("if(text rlike '\\\\\\\\u00[67]', 2147483647, (length(text) - length(replace(text, '\"rows\"', ''))) div 6)")
    # no value is deeper than it has opening brackets
    depth = F.expr(f"1 + coalesce(least(1001, 1 + length(text) - length(translate(text, '{{[', ''))), 0) div {_STRIDE}")
    bounded = parsed.where("root is not null").select(*own, "root", most.alias("most"), depth.alias("depth"))
    return bounded.select(*own, _table_objects().alias("tables")).select(*own, F.expr(f"inline({_TARGETS[target]})"))
