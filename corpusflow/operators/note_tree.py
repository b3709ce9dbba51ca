"""Rendering of recursive note trees: a bottom-up fold, one aggregation for each depth, the deepest first.

A tree is tree(note_id, path, parent, depth, ord, node, text, name, title, flag): top nodes have depth 1 and the empty parent. At each depth the
texts of a node's children are gathered in order and its own text is made of them by one expression, so the work is one join and one group-by
for each depth, whatever the number of notes. Inner quotes, lists and tables nest to any depth.

What a node takes its words from: `text` for leaves, the children for the rest; `name` is a language, address, target, severity,
level or number, `title` a title, caption or cited source, `flag` whether a list is ordered, an item done, a row the head or an equation on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import program, table
from corpusflow.plans.durable import written

# Severities with their sign and style class, languages of fences, and headings of the rendered text.
SEVERITIES = {
    "note": ("📝", "callout-note"), "tip": ("💡", "callout-tip"), "info": ("ℹ️", "callout-info"), "warning": ("⚠️", "callout-warning"), "caution": ("⚠️", "callout-warning"),
    "danger": ("🚫", "callout-danger"), "example": ("📋", "callout-example"), "question": ("❓", "callout-question"), "success": ("✅", "callout-success"), "failure": ("❌", "callout-danger"),
    "bug": ("🐛", "callout-danger"), "quote": ("💬", "callout-note"), "abstract": ("📑", "callout-note"), "security": ("🔒", "callout-danger"), "performance": ("⚡", "callout-warning"),
    "version": ("🏷️", "callout-info"), "deprecated": ("⛔", "callout-warning"), "conflict": ("⚠️", "callout-warning"), "external": ("🔗", "callout-info"), "derived": ("✨", "callout-info"),
}
LANGUAGES = {
    "python": "python", "py": "python", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "bash": "bash", "sh": "bash", "shell": "bash",
    "json": "json", "yaml": "yaml", "yml": "yaml", "sql": "sql", "html": "html", "css": "css", "rust": "rust", "go": "go", "java": "java", "kotlin": "kotlin", "swift": "swift", "ruby": "ruby",
    "c": "c", "cpp": "c++", "c++": "c++", "csharp": "c#", "c#": "c#", "php": "php", "scala": "scala", "mermaid": "mermaid",
}
BACKLINKS = "## Referenciado por"
QUERIES = "## Consultas habituales"
QUERY_NOTE = "> ℹ️ Esta consulta requiere un motor de queries (Dataview/Obsidian, database views). Resultado estático de build-time:"
QUERY_ROW = "(no resuelto en build; ejecutar Dataview para datos en vivo)"
INLINE = ("text", "strong", "em", "code-inline", "link-external", "link-note", "term-ref", "source-ref", "math-inline", "footnote-ref", "keyboard", "placeholder", "deleted")
#: Signs for which a header value is quoted.
QUOTED = ":#{}[]&*!|>'\"%@`"
SCHEMA = "note_id string, path string, parent string, depth int, ord long, node string, text string, name string, title string, flag boolean"


def _case(by: str, values: dict[str, str], other: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


_N = "chr(10)"
_INLINE_KIDS = "array_join(transform(filter(kids, k -> k.inline), k -> k.said), '')"
_BLOCK_KIDS = "array_join(transform(filter(kids, k -> NOT k.inline AND k.said <> ''), k -> k.said), concat(chr(10), chr(10)))"
_BODY = "concat(inl, CASE WHEN inl <> '' AND blk <> '' THEN concat(chr(10), chr(10)) ELSE '' END, blk)"
_QUOTED_BODY = f"array_join(transform(split({_BODY}, '\\n', -1), l -> CASE WHEN l = '' THEN '>' ELSE concat('> ', l) END), {_N})"
# an item holds its words and, on lines of their own, its inner blocks; all lines but the first stand under the first one's words
_ITEM = f"array_join(filter(array(inl, array_join(transform(filter(kids, k -> NOT k.inline AND k.said <> ''), k -> k.said), {_N})), x -> x <> ''), {_N})"
_HANG = "concat({0}, ' ', replace(k.said, chr(10), concat(chr(10), repeat(' ', length({0}) + 1))))"
_EMPTY, _NUMBER, _DASH = "''", "concat(cast(i + 1 AS STRING), '.')", "'-'"
_RULE = "concat('|', array_join(transform(split(r.more, chr(1), -1), c -> '---'), '|'), '|')"
_TABLE = f"array_join(flatten(transform(kids, r -> CASE WHEN r.flag THEN array(r.said, {_RULE}) ELSE array(r.said) END)), {_N})"
_ROWS = "filter(kids, r -> NOT r.flag)"
_SIZE = f"cast(size({_ROWS}) AS STRING)"
_WIDTH = f"cast(coalesce(array_max(transform({_ROWS}, r -> size(split(r.more, chr(1), -1)))), 0) AS STRING)"
_MATRIX = f"array_join(flatten(transform({_ROWS}, (r, i) -> transform(split(r.more, chr(1), -1), c -> concat('| ', cast(i AS STRING), ' | ', c, ' |')))), {_N})"
_MERGED = f"""concat({_TABLE}, {_N}, {_N}, '> ⚠️ **Estructura original con celdas combinadas (', {_SIZE}, ' filas × ', {_WIDTH}, ' cols)** — ver fuente §', CASE WHEN title = '' THEN 'fuente' ELSE title END, {_N}, {_N},
  '<details markdown="1">', {_N}, '<summary>Matriz original con rowspan/colspan (', {_SIZE}, '×', {_WIDTH}, ')</summary>', {_N}, {_N}, '| Fila | Col | Valor |', {_N}, '|---|---|---|', {_N}, {_MATRIX}, {_N}, {_N}, '</details>')"""
_SIGN = _case("name", {k: v[0] for k, v in SEVERITIES.items()}, "'" + SEVERITIES["note"][0] + "'")
_CLASS = _case("name", {k: v[1] for k, v in SEVERITIES.items()}, "'" + SEVERITIES["note"][1] + "'")
_URL = "CASE WHEN startswith(name, 'http://') OR startswith(name, 'https://') OR startswith(name, '/') THEN name ELSE concat('assets/', note_id, '/', regexp_replace(name, '^[./]+', '')) END"
#: Kind of a node -> its text from inl and blk, the texts of its inline and block children, and kids, all of them.
_SAID = {
    "section": f"concat(repeat('#', least(3, greatest(1, coalesce(try_cast(name AS INT), 1)))), ' ', {_BODY})",
    "paragraph": _BODY,
    "item": _ITEM,
    "list": f"array_join(transform(kids, (k, i) -> CASE WHEN flag THEN {_HANG.format(_NUMBER)} ELSE {_HANG.format(_DASH)} END), {_N})",
    "checklist": f"array_join(transform(kids, k -> concat('- ', CASE WHEN k.flag THEN '[x] ' ELSE '[ ] ' END, replace(k.said, chr(10), concat(chr(10), '  ')))), {_N})",
    "cell": f"concat(text, {_BODY})",
    "row": "concat('| ', array_join(transform(kids, k -> k.said), ' | '), ' |')",
    "table": f"CASE WHEN name = 'merged' THEN {_MERGED} ELSE {_TABLE} END",
    "parameter-table": _TABLE,
    "code": f"concat('```', {_case('lower(name)', LANGUAGES, _EMPTY)}, {_N}, text, {_N}, '```')",
    "console": f"array_join(transform(split(text, '\\n', -1), l -> CASE WHEN startswith(l, '$') THEN l ELSE concat('$ ', l) END), {_N})",
    "equation": f"CASE WHEN flag THEN concat('$$', {_N}, text, {_N}, '$$') ELSE concat('$', text, '$') END",
    "figure": f"concat('![', text, '](', {_URL}, ')', CASE WHEN title <> '' THEN concat({_N}, '*', title, '*') ELSE '' END)",
    "diagram": f"concat('```mermaid', {_N}, text, {_N}, '```')",
    "admonition": f"concat('> [!', CASE WHEN name = '' THEN 'note' ELSE name END, ']+ ', {_SIGN}, CASE WHEN title <> '' THEN concat(' ', title) ELSE '' END, ' {{.callout-', {_CLASS}, '}}', {_N}, {_QUOTED_BODY})",
    "collapsible": f"concat('<details markdown=\"1\">', {_N}, '<summary>', CASE WHEN title = '' THEN 'Detalles' ELSE title END, '</summary>', {_N}, {_N}, {_BODY}, {_N}, {_N}, '</details>')",
    "quote": f"concat({_QUOTED_BODY}, CASE WHEN title <> '' THEN concat({_N}, '> — ', title) ELSE '' END)",
    "columns": _BODY,
    "divider": "'---'",
    "query": f"concat('{QUERIES}', {_N}, {_N}, '{QUERY_NOTE}', {_N}, {_N}, '| Query | Resultado |', {_N}, '|---|---|', {_N}, '| `', text, '` | {QUERY_ROW} |')",
    "question": f"concat('**Pregunta:** ', title, {_N}, {_N}, {_BODY})",
    "step": f"concat('**Paso ', CASE WHEN name = '' THEN '1' ELSE name END, ':** ', {_BODY})",
    "text": "text",
    "strong": "concat('**', inl, '**')",
    "em": "concat('*', inl, '*')",
    "deleted": "concat('~~', inl, '~~')",
    "code-inline": "concat('`', text, '`')",
    "keyboard": "concat('`', text, '`')",
    "placeholder": "concat('{{', text, '}}')",
    "math-inline": "concat('$', text, '$')",
    "link-external": "concat('[', CASE WHEN text = '' THEN name ELSE text END, '](', name, ')')",
    "link-note": "concat('[', CASE WHEN text = '' THEN name ELSE text END, '](', name, '.md)')",
    "term-ref": "concat('[[term:', name, '|', CASE WHEN text = '' THEN name ELSE text END, ']]')",
    "source-ref": "concat('<!-- src: ', name, ' (', substr(title, 1, 8), ') -->')",
    "footnote-ref": "concat('[^', name, ']', CASE WHEN text <> '' THEN concat(': ', text) ELSE '' END)",
}


def _literal(text: str) -> str:
    return f"'{text}'"


def _expression() -> str:
    return "CASE node " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _SAID.items()) + " ELSE '' END"


_ROW_MORE = "CASE node WHEN 'row' THEN array_join(transform(kids, (k, c) -> concat(cast(c AS STRING), ' | ', k.said, CASE WHEN k.name <> '' THEN concat(' (', k.name, ')') ELSE '' END)), chr(1)) ELSE '' END"


def stored(tree: DataFrame) -> DataFrame:
    """The nodes as a written table, nulls as empty texts."""
    return written(tree.select("note_id", "path", "parent", F.col("depth").cast("int").alias("depth"), "ord", "node", *(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "name", "title")), F.coalesce("flag", F.lit(False)).alias("flag")), "tree")


def folded(nodes: DataFrame) -> DataFrame:
    """From stored nodes: note_id, ord, node and said, the text of every top node."""
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    kid = "struct<ord:bigint,inline:boolean,said:string,flag:boolean,name:string,more:string>"
    below = None
    for depth in range(deepest, 0, -1):
        own = nodes.where(F.col("depth") == depth)
        own = own.withColumn("kids", F.lit(None).cast(f"array<{kid}>")) if below is None else own.join(below, ["note_id", "path"], "left")
        own = own.withColumn("kids", F.coalesce("kids", F.expr(f"cast(array() AS array<{kid}>)"))).withColumns({"inl": F.expr(_INLINE_KIDS), "blk": F.expr(_BLOCK_KIDS)})
        own = own.withColumns({"said": F.expr(_expression()), "more": F.expr(_ROW_MORE)})
        if depth == 1:
            return own.select("note_id", "ord", "node", "said")
        told = F.struct("ord", F.col("node").isin(*INLINE).alias("inline"), "said", "flag", "name", "more")
        below = own.groupBy("note_id", F.col("parent").alias("path")).agg(F.array_sort(F.collect_list(told)).alias("kids"))
    return nodes.select("note_id", "ord", "node", F.col("text").alias("said")).limit(0)


def yaml_value(value):
    """Column of a header value, quoted where it holds a sign of QUOTED."""
    signs = "[" + "".join("\\" + c for c in QUOTED) + "]"
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return F.when(value.rlike(signs), quoted).otherwise(value)


def markdown(tree: DataFrame, notes: DataFrame, rendered_at: str = "1970-01-01T00:00:00Z", version: str = "1.0.0") -> DataFrame:
    """note_id and text, the whole Markdown file of notes(note_id, title, source_hash, ir_hash): header, title, body in order and who links to it."""
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    # the first of a name holds, in the order of the whole tree
    step = F.transform(F.split("path", "/"), lambda x: x.cast("long"))
    tree = stored(tree)
    own = tree.where("node = 'property-block' AND name <> ''").groupBy("note_id", "name").agg(F.min_by("text", step).alias("value"), F.min(step).alias("at"))
    fixed = ["schema_version", "target", "note_id", "source_hash", "ir_sha256", "rendered_at", "renderer_version"]
    own = own.where(~F.col("name").isin(*fixed, "title")).groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("name", F.lit(": "), yaml_value(F.col("value")), F.lit("\n")).alias("line")))), lambda x: x.line), "").alias("props"))
    links = tree.where("node = 'link-note'").select(F.col("name").alias("target"), F.col("note_id").alias("origin")).where("target <> origin").distinct()
    back = links.groupBy(F.col("target").alias("note_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("origin")), lambda o: F.concat(F.lit("- ["), o, F.lit("]("), o, F.lit(".md)"))), "\n").alias("back"))
    body = folded(tree).where("said <> ''").groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "said"))), lambda x: x.said).alias("parts"))
    lines = [F.lit(f'schema_version: "1.0.0"\ntarget: markdown\nnote_id: '), quoted(F.col("note_id")), F.lit("\nsource_hash: "), quoted(F.col("source_hash")), F.lit("\nir_sha256: "), quoted(F.col("ir_hash")), F.lit(f'\nrendered_at: "{rendered_at}"\nrenderer_version: "{version}"\n')]
    title = F.coalesce("title", F.lit(""))
    header = F.concat(F.lit("---\n"), *lines, F.when(title != "", F.concat(F.lit("title: "), quoted(title), F.lit("\n"))).otherwise(""), F.coalesce("props", F.lit("")), F.lit("---\n\n"))
    parts = F.concat(F.when(title != "", F.array(F.concat(F.lit("# "), title, F.lit("\n")))).otherwise(F.array().cast("array<string>")), F.coalesce("parts", F.array().cast("array<string>")), F.when(F.col("back").isNotNull(), F.array(F.concat(F.lit(BACKLINKS + "\n\n"), "back", F.lit("\n")))).otherwise(F.array().cast("array<string>")))
    return notes.join(body, "note_id", "left").join(own, "note_id", "left").join(back, "note_id", "left").select("note_id", F.concat(header, F.array_join(parts, "\n\n"), F.lit("\n")).alias("text"))


# Trees of the documents: each block is one or more nodes, by its type and place; lists, marks and tables nest up to six deep.
_w = lambda a, b: f"$join($slice(words, {a}, {b}), ' ')"
_NODES = [
    # (path below the block's own, node, text, name, title, flag, condition)
    ("", "section", "''", "$text(1 + i % 4)", "''", "false", "type = 'heading'"),
    ("/0", "text", "content", "''", "''", "false", "type = 'heading'"),
    ("", "admonition", "''", "CASE doc_id % 5 WHEN 0 THEN 'note' WHEN 1 THEN 'tip' WHEN 2 THEN 'danger' WHEN 3 THEN 'unheard' ELSE 'version' END", "CASE WHEN doc_id % 2 = 0 THEN 'Mind' ELSE '' END", "false", "type = 'boilerplate'"),
    ("/0", "text", "content || $chr(10) || $chr(10) || 'end'", "''", "''", "false", "type = 'boilerplate'"),
    ("", "paragraph", "''", "''", "''", "false", "k = 0"),
    ("/0", "text", "content", "''", "''", "false", "k = 0"),
    ("/1", "footnote-ref", "'see it'", "$text(i)", "''", "false", "k = 0"),
    ("", "list", "''", "''", "''", "doc_id % 2 = 0", "k = 1"),
    ("/0", "item", "''", "''", "''", "false", "k = 1"),
    ("/0/0", "text", _w(1, 3), "''", "''", "false", "k = 1"),
    ("/0/1", "list", "''", "''", "''", "doc_id % 3 = 0", "k = 1"),
    ("/0/1/0", "item", "''", "''", "''", "false", "k = 1"),
    ("/0/1/0/0", "strong", "''", "''", "''", "false", "k = 1"),
    ("/0/1/0/0/0", "text", _w(4, 2), "''", "''", "false", "k = 1"),
    ("/0/1/1", "item", "''", "''", "''", "false", "k = 1"),
    ("/0/1/1/0", "code-inline", _w(1, 1), "''", "''", "false", "k = 1"),
    ("/1", "item", "''", "''", "''", "false", "k = 1"),
    ("/1/0", "text", "content", "''", "''", "false", "k = 1"),
    ("", "checklist", "''", "''", "''", "false", "k = 2"),
    ("/0", "item", "''", "''", "''", "i % 2 = 0", "k = 2"),
    ("/0/0", "text", "content", "''", "''", "false", "k = 2"),
    ("/1", "item", "''", "''", "''", "false", "k = 2"),
    ("/1/0", "deleted", "''", "''", "''", "false", "k = 2"),
    ("/1/0/0", "text", _w(2, 2), "''", "''", "false", "k = 2"),
    ("", "table", "''", "CASE WHEN doc_id % 4 = 0 THEN 'merged' ELSE '' END", "CASE WHEN doc_id % 8 = 0 THEN $text(doc_id) ELSE '' END", "false", "k = 3"),
    ("/0", "row", "''", "''", "''", "true", "k = 3"),
    ("/0/0", "cell", _w(1, 1), "''", "''", "false", "k = 3"),
    ("/0/1", "cell", _w(2, 1), "''", "''", "false", "k = 3"),
    ("/1", "row", "''", "''", "''", "false", "k = 3"),
    ("/1/0", "cell", _w(3, 1), "CASE WHEN i % 2 = 0 THEN '1×2' ELSE '' END", "''", "false", "k = 3"),
    ("/1/1", "cell", "''", "''", "''", "false", "k = 3"),
    ("/1/1/0", "em", "''", "''", "''", "false", "k = 3"),
    ("/1/1/0/0", "text", _w(4, 1), "''", "''", "false", "k = 3"),
    ("", "code", "content", "CASE doc_id % 4 WHEN 0 THEN 'PY' WHEN 1 THEN 'sh' WHEN 2 THEN 'plain' ELSE 'cobol' END", "''", "false", "k = 4"),
    ("", "quote", "''", "''", "CASE WHEN i % 2 = 0 THEN source ELSE '' END", "false", "k = 5"),
    ("/0", "text", "content || $chr(10) || 'and'", "''", "''", "false", "k = 5"),
    ("", "collapsible", "''", "''", "CASE WHEN i % 2 = 0 THEN 'More' ELSE '' END", "false", "k = 6"),
    ("/0", "paragraph", "''", "''", "''", "false", "k = 6"),
    ("/0/0", "text", "content", "''", "''", "false", "k = 6"),
    ("/1", "divider", "''", "''", "''", "false", "k = 6"),
    ("/2", "console", "'ls' || $chr(10) || '$ ' || source", "''", "''", "false", "k = 6"),
    ("", "paragraph", "''", "''", "''", "false", "k = 7"),
    ("/0", "link-note", "CASE WHEN i % 2 = 0 THEN 'there' ELSE '' END", "'note-' || $text(doc_id + 1 - 2 * (i % 2))", "''", "false", "k = 7"),
    ("/1", "term-ref", "''", "lower(" + _w(1, 1) + ")", "''", "false", "k = 7"),
    ("/2", "source-ref", "''", "block_id", "source_hash", "false", "k = 7"),
    ("/3", "placeholder", "'name'", "''", "''", "false", "k = 7"),
    ("", "property-block", "CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'a: \"' || source || '\" ' || $chr(92) END", "CASE WHEN i % 2 = 0 THEN 'lang' ELSE 'title' END", "''", "false", "k = 8"),
    ("", "figure", _w(1, 2), "CASE WHEN i % 2 = 0 THEN './img/a.png' ELSE 'https://a.b/c.png' END", "CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END", "false", "k = 9"),
    ("", "step", "''", "$text(i)", "''", "false", "k = 10"),
    ("/0", "math-inline", "'x+1'", "''", "''", "false", "k = 10"),
    ("", "equation", "'x^2'", "''", "''", "doc_id % 2 = 0", "k = 11"),
]
table("tree_blocks", "SELECT 'note-' || $text(doc_id) AS note_id, doc_id, block_index AS i, block_id, source, source_hash, lang, content, type, CASE WHEN type = 'paragraph' THEN block_index % 12 ELSE -1 END AS k, $split(content, ' ') AS words FROM {blocks}")


def _fields(p: str, node: str, text: str, name: str, title: str, flag: str) -> dict[str, str]:
    """Columns of a node below a block at path p."""
    above, _, last = p.rpartition("/")
    return {"path": f"$text(i) || '{p}'", "parent": f"$text(i) || '{above}'" if p else _EMPTY, "depth": str(p.count("/") + 1), "ord": f"$long({last})" if p else "i", "node": f"'{node}'", "text": text, "name": name, "title": title, "flag": flag}


# One pass over the blocks, each with its nodes in an array; the oracle has one select for each kind of node.
table(
    "note_tree",
    "SELECT note_id, " + ", ".join(f"n.{k} AS {k}" for k in _fields("", *_NODES[0][1:-1])) + " FROM (SELECT note_id, explode_outer(array("
    + ",\n".join(f"CASE WHEN {where} THEN named_struct(" + ", ".join(f"'{k}', {v}" for k, v in _fields(p, *rest).items()) + ") END" for p, *rest, where in _NODES)
    + ")) AS n FROM {tree_blocks}) WHERE n IS NOT NULL",
    "\nUNION ALL ".join("SELECT note_id, " + ", ".join(f"{v} AS {k}" for k, v in _fields(p, *rest).items()) + f" FROM {{tree_blocks}} WHERE {where}" for p, *rest, where in _NODES),
)
table("tree_notes", "SELECT note_id, title, $sha256(domain) AS source_hash, ir_hash FROM {notes}")


def _oracle() -> str:
    """The fold in the oracle's own functions, one step for each depth of these trees."""
    n = "chr(10)"
    deepest = max(p.count("/") for p, *_ in _NODES) + 1
    inl, blk = "coalesce(inl, '')", "coalesce(blk, '')"
    body = f"({inl} || CASE WHEN {inl} <> '' AND {blk} <> '' THEN {n} || {n} ELSE '' END || {blk})"
    quoted = f"array_to_string(list_transform(string_split({body}, {n}), lambda l: CASE WHEN l = '' THEN '>' ELSE '> ' || l END), {n})"
    number, dash = "(j::VARCHAR || '.')", "'-'"
    hang = lambda m: f"{m} || ' ' || replace(k.said, {n}, {n} || repeat(' ', length({m}) + 1))"
    rows = "list_filter(kids, lambda r: NOT r.flag)"
    rule = "'|' || repeat('---|', len(string_split(r.more, chr(1))))"
    grid = f"array_to_string(list_transform(kids, lambda r: CASE WHEN r.flag THEN r.said || {n} || {rule} ELSE r.said END), {n})"
    size, width = f"len({rows})::VARCHAR", f"coalesce(list_max(list_transform({rows}, lambda r: len(string_split(r.more, chr(1))))), 0)::VARCHAR"
    matrix = f"array_to_string(flatten(list_transform({rows}, lambda r, j: list_transform(string_split(r.more, chr(1)), lambda c: '| ' || (j - 1)::VARCHAR || ' | ' || c || ' |'))), {n})"
    merged = f"{grid} || {n} || {n} || '> ⚠️ **Estructura original con celdas combinadas (' || {size} || ' filas × ' || {width} || ' cols)** — ver fuente §' || CASE WHEN title = '' THEN 'fuente' ELSE title END || {n} || {n} || '<details markdown=\"1\">' || {n} || '<summary>Matriz original con rowspan/colspan (' || {size} || '×' || {width} || ')</summary>' || {n} || {n} || '| Fila | Col | Valor |' || {n} || '|---|---|---|' || {n} || {matrix} || {n} || {n} || '</details>'"
    said = {
        "section": f"repeat('#', least(3, greatest(1, name::INT))) || ' ' || {body}",
        "paragraph": body,
        "item": f"array_to_string(list_filter([{inl}, coalesce(stack, '')], lambda x: x <> ''), {n})",
        "list": f"array_to_string(list_transform(kids, lambda k, j: CASE WHEN flag THEN {hang(number)} ELSE {hang(dash)} END), {n})",
        "checklist": f"array_to_string(list_transform(kids, lambda k: '- [' || CASE WHEN k.flag THEN 'x' ELSE ' ' END || '] ' || replace(k.said, {n}, {n} || '  ')), {n})",
        "cell": f"text || {body}",
        "row": "'| ' || array_to_string(list_transform(kids, lambda k: k.said), ' | ') || ' |'",
        "table": f"CASE WHEN name = 'merged' THEN {merged} ELSE {grid} END",
        "code": f"'```' || CASE lower(name) WHEN 'py' THEN 'python' WHEN 'sh' THEN 'bash' ELSE '' END || {n} || text || {n} || '```'",
        "console": f"array_to_string(list_transform(string_split(text, {n}), lambda l: CASE WHEN l[1] = '$' THEN l ELSE '$ ' || l END), {n})",
        "equation": f"CASE WHEN flag THEN '$$' || {n} || text || {n} || '$$' ELSE '$' || text || '$' END",
        "figure": f"'![' || text || '](' || CASE WHEN name[1:4] = 'http' THEN name ELSE 'assets/' || note_id || '/' || name[3:] END || ')' || CASE WHEN title <> '' THEN {n} || '*' || title || '*' ELSE '' END",
        "admonition": f"'> [!' || name || ']+ ' || CASE name WHEN 'tip' THEN '💡' WHEN 'danger' THEN '🚫' WHEN 'version' THEN '🏷️' ELSE '📝' END || CASE WHEN title <> '' THEN ' ' || title ELSE '' END || ' {{.callout-callout-' || CASE name WHEN 'tip' THEN 'tip' WHEN 'danger' THEN 'danger' WHEN 'version' THEN 'info' ELSE 'note' END || '}}' || {n} || {quoted}",
        "collapsible": f"'<details markdown=\"1\">' || {n} || '<summary>' || CASE WHEN title = '' THEN 'Detalles' ELSE title END || '</summary>' || {n} || {n} || {body} || {n} || {n} || '</details>'",
        "quote": f"{quoted} || CASE WHEN title <> '' THEN {n} || '> — ' || title ELSE '' END",
        "divider": "'---'",
        "step": f"'**Paso ' || name || ':** ' || {body}",
        "text": "text", "strong": f"'**' || {inl} || '**'", "em": f"'*' || {inl} || '*'", "deleted": f"'~~' || {inl} || '~~'",
        "code-inline": "'`' || text || '`'", "placeholder": "'{{' || text || '}}'", "math-inline": "'$' || text || '$'",
        "link-note": "'[' || CASE WHEN text = '' THEN name ELSE text END || '](' || name || '.md)'", "term-ref": "'[[term:' || name || '|' || CASE WHEN text = '' THEN name ELSE text END || ']]'",
        "source-ref": "'<!-- src: ' || name || ' (' || title[1:8] || ') -->'", "footnote-ref": "'[^' || name || ']: ' || text",
    }
    case = "CASE node " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in said.items()) + " ELSE '' END"
    inline = "node IN (" + ", ".join(f"'{x}'" for x in INLINE) + ")"
    more = "CASE node WHEN 'row' THEN array_to_string(list_transform(kids, lambda k, j: (j - 1)::VARCHAR || ' | ' || k.said || CASE WHEN k.name <> '' THEN ' (' || k.name || ')' ELSE '' END), chr(1)) ELSE '' END"
    steps = []
    for d in range(deepest, 0, -1):
        kids = f"LEFT JOIN g{d + 1} g ON g.gn = t.note_id AND g.gp = t.path" if d < deepest else ", (SELECT NULL::VARCHAR AS inl, NULL::VARCHAR AS blk, NULL::VARCHAR AS stack, []::STRUCT(said VARCHAR, flag BOOLEAN, name VARCHAR, more VARCHAR)[] AS kids)"
        steps.append(f"s{d} AS (SELECT note_id, parent, ord, node, flag, name, {inline} AS isin, {case} AS said, {more} AS more FROM (SELECT t.*, inl, blk, stack, coalesce(kids, []) AS kids FROM {{tree}} t {kids} WHERE depth = {d}))")
        steps.append(f"g{d} AS (SELECT note_id AS gn, parent AS gp, string_agg(said, '' ORDER BY ord) FILTER (WHERE isin) AS inl, string_agg(said, {n} || {n} ORDER BY ord) FILTER (WHERE NOT isin AND said <> '') AS blk, string_agg(said, {n} ORDER BY ord) FILTER (WHERE NOT isin AND said <> '') AS stack, list({{'said': said, 'flag': flag, 'name': name, 'more': more}} ORDER BY ord) AS kids FROM s{d} GROUP BY ALL)")
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
props AS (SELECT note_id, string_agg(name || ': ' || CASE WHEN regexp_matches(v, '[:#{{}}\\[\\]&*!|>''"%@`]') THEN '"' || replace(replace(v, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' ELSE v END || {n}, '' ORDER BY place) AS props
  FROM (SELECT note_id, name, arg_min(text, ord) AS v, min(ord) AS place FROM {{tree}} WHERE node = 'property-block' AND name <> 'title' GROUP BY ALL) GROUP BY note_id),
back AS (SELECT name AS note_id, string_agg('- [' || note_id || '](' || note_id || '.md)', {n} ORDER BY note_id) AS back FROM (SELECT DISTINCT name, note_id FROM {{tree}} WHERE node = 'link-note' AND name <> note_id) GROUP BY name)
SELECT t.note_id, '---' || {n} || 'schema_version: "1.0.0"' || {n} || 'target: markdown' || {n} || 'note_id: "' || t.note_id || '"' || {n} || 'source_hash: "' || source_hash || '"' || {n} || 'ir_sha256: "' || ir_hash || '"' || {n}
  || 'rendered_at: "1970-01-01T00:00:00Z"' || {n} || 'renderer_version: "1.0.0"' || {n} || 'title: "' || t.title || '"' || {n} || coalesce(props, '') || '---' || {n} || {n}
  || '# ' || t.title || {n} || coalesce({n} || {n} || g1.blk, '') || coalesce({n} || {n} || '{BACKLINKS}' || {n} || {n} || back || {n}, '') || {n} AS text
FROM {{notes}} t LEFT JOIN g1 ON g1.gn = t.note_id LEFT JOIN props ON props.note_id = t.note_id LEFT JOIN back ON back.note_id = t.note_id
"""
    )


@program("rnd_markdown", _oracle(), tree="note_tree", notes="tree_notes")
def rnd_markdown(tree, notes):
    """Markdown files of notes: header, title, nested blocks and backlinks."""
    return markdown(tree, notes)
