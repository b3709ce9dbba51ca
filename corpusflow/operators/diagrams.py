"""Rules of text diagrams: every line is read once into what it is, blocks are followed by a fold, and rules are conditions on what was gathered.

A diagram is diagrams(diagram_id, src, alt, content). Its lines become an array of records by higher-order functions; the depth of nested groups, which never
falls below zero, is a fold with a struct state; nodes keep the label of their first place. Nothing is shuffled: a diagram is
one row until its violations are laid out.

A null or empty content is of no known type; a null alternative text counts as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import program, table

# Types of diagrams, limits, and severities of the rules.
TYPES = {"flowchart": "WP-1", "graph": "WP-1", "sequencediagram": "WP-2", "statediagram-v2": "WP-3", "statediagram": "WP-3", "erdiagram": "WP-4", "classdiagram": "WP-5", "gantt": "WP-6", "gitgraph": "WP-7", "pie": "WP-8"}
MAX_NODES, MAX_TASKS, MAX_TREE, MAX_LABEL, MAX_BROKEN_LABEL, MAX_DEPTH = 15, 25, 25, 40, 60, 2
SEVERITIES = {
    "S-01": "error", "S-02": "error", "S-03": "error", "S-04": "error", "S-05": "error", "S-06": "warning", "S-07": "error", "S-08": "warning",
    "P-01": "error", "P-02": "error", "P-03": "error", "P-04": "error", "P-05": "error", "P-06": "warning",
    "L-01": "error", "L-02": "info", "L-03": "info", "L-04": "warning", "L-05": "error", "L-06": "warning",
}
_ID = "[A-Za-z_][A-Za-z0-9_]*"
_SHAPE = r'\["[^"]*"\]\(\)|\["[^"]*"\]|\("[^"]*"\)|\{"[^"]*"\}|\[\["[^"]*"\]\]|\[\("[^"]*"\)\]|\(\("[^"]*"\)\)'
_OP = r"-->\|[^|]*\||---|-->|-\.->|==>"
_CARDINALITY = r"(?i)(\|+--o\{|\}+--\|\{|\|\|--o\{|\|\|--\|\{|\|\|--\|<|\|\|--o\}|\|\|--\|\||\|\|--\|\}|\|\|o\{|\|\}o\{|\}o--\|\{|\}o--o\{|\}o--\|--\|\{|\|o--\|\{|\|o--o\{|\|o--\|\|)"
_DIRECTION = r"(?i)^(flowchart|graph)\s+(TB|BT|LR|RL|TD)\b"
_MESSAGE = r"^\s*(\S+)\s*(->>|-->>|->|--x)\s*(\S+)\s*:(.+)"
_COMMENT = r"^\s*(%%.*)?$"


def _bare(line: str) -> str:
    return f"regexp_replace({line}, '\"[^\"]*(\"|$)', '')"


_COUNT = "(length({0}) - length(replace({0}, '{1}', '')))"
#: What a line of a flowchart is, by the first condition that holds.
_LINE = rf"""CASE WHEN l rlike r'(?i)^\s*%%\{{init:' THEN 'init' WHEN l rlike r'{_COMMENT}' THEN 'none'
  WHEN l rlike r'^\s*subgraph\s+{_ID}' THEN 'open' WHEN l rlike r'(^|\s)end(\s|$)' THEN 'close'
  WHEN l rlike r'^\s*class(Def)?\s+' THEN 'class' WHEN l rlike r'(?i)^\s*style\s+\S+\s+(fill|stroke)\s*:\s*#' THEN 'style'
  WHEN l rlike r'^\s*click\s+' THEN 'click' WHEN l rlike r'^\s*linkStyle\s+' THEN 'linkstyle' ELSE 'chain' END"""
_ENDS = r"size(regexp_extract_all(l, r'(^|(?<=\s))end(?=\s|$)', 0))"
_CHAIN = rf"regexp_extract(trim(l), r'^([ \t]*{_ID}\s*({_SHAPE})?[ \t]*({_OP})?)+', 0)"
_UNBALANCED = f"({_COUNT.format(_bare('l'), '[')} <> {_COUNT.format(_bare('l'), ']')} OR {_COUNT.format(_bare('l'), '(')} <> {_COUNT.format(_bare('l'), ')')}) AND l rlike r'\\b{_ID}\\s*\\['"


def parsed(diagrams: DataFrame) -> DataFrame:
    """diagram_id, src, alt, head, type, lines, kinds, nodes (id, label), depth and the texts that rules need."""
    df = diagrams.select("diagram_id", F.coalesce("src", F.lit("")).alias("src"), F.coalesce("alt", F.lit("")).alias("alt"), F.split(F.coalesce("content", F.lit("")), "\n", -1).alias("all"))
    df = df.withColumn("head", F.expr(r"coalesce(trim(get(filter(all, l -> l rlike r'\S'), 0)), '')")).withColumn("first", F.expr(r"lower(regexp_extract(head, r'^\S+', 0))"))
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())
    df = df.withColumn("type", F.expr(f"CASE first {kinds} ELSE '' END"))
    body = r"if(get(all, 0) rlike r'^\s*(flowchart|graph)\b', slice(all, 2, size(all)), all)"
    df = df.withColumn("lines", F.expr(f"CASE WHEN type = 'WP-1' THEN {body} ELSE filter(all, l -> NOT l rlike r'{_COMMENT}') END"))
    flow = F.col("type") == "WP-1"
    df = df.withColumn("kinds", F.when(flow, F.expr(f"transform(lines, l -> named_struct('l', l, 'kind', {_LINE}, 'ends', cast({_ENDS} AS INT)))")))
    deep = "aggregate(kinds, named_struct('now', 0, 'most', 0), (s, x) -> named_struct('now', greatest(0, s.now + if(x.kind = 'open', 1, 0) - if(x.kind IN ('open', 'close'), x.ends, 0)), 'most', greatest(s.most, s.now + if(x.kind = 'open', 1, 0)))).most"
    df = df.withColumn("depth", F.coalesce(F.expr(deep), F.lit(0)))
    df = df.withColumn("chains", F.coalesce(F.expr("transform(filter(kinds, x -> x.kind = 'chain'), x -> x.l)"), F.array().cast("array<string>")))
    tokens = rf"flatten(transform(chains, l -> filter(transform(regexp_extract_all({_CHAIN}, r'({_OP})|({_ID})\s*({_SHAPE})?', 0), t -> named_struct('id', if(t rlike r'^({_OP})$', '', regexp_extract(t, r'^{_ID}', 0)), 'label', regexp_extract(t, r'\"([^\"]*)\"', 1))), t -> t.id <> '')))"
    df = df.withColumn("tokens", F.expr(tokens)).withColumn("ids", F.expr("transform(tokens, t -> t.id)"))
    df = df.withColumn("nodes", F.expr("filter(tokens, (t, i) -> array_position(ids, t.id) = i + 1)"))
    sized = r"CASE type WHEN 'WP-1' THEN size(nodes) WHEN 'WP-6' THEN size(filter(lines, l -> NOT l rlike r'(?i)^\s*(dateFormat|title|axisFormat|section)\b' AND l rlike ':' AND l rlike ',')) WHEN 'WP-8' THEN size(filter(lines, l -> NOT l rlike r'(?i)^\s*title\b' AND l rlike ':')) ELSE 0 END"
    df = df.withColumn("n_nodes", F.expr(sized))
    return df.withColumn("messages", F.expr(rf"filter(lines, l -> type = 'WP-2' AND NOT l rlike r'^\s*(participant|actor)\s+\S+' AND l rlike r'{_MESSAGE}')"))


#: Rule -> how often it is broken.
BROKEN = {
    "S-01": "if(type = '', 1, 0)",
    "S-02": f"if(type = 'WP-1' AND lower(head) IN ('flowchart', 'graph') AND NOT head rlike r'{_DIRECTION}', 1, 0)",
    "S-03": f"if(type = 'WP-1' AND exists(kinds, x -> x.kind NOT IN ('init', 'none') AND exists(array(x.l), l -> {_UNBALANCED})), 1, 0)",
    "S-04": rf"size(filter(messages, l -> regexp_extract(l, r'{_MESSAGE}', 1) rlike r'^\d' OR regexp_extract(l, r'{_MESSAGE}', 3) rlike r'^\d'))",
    "S-05": r"if(type = 'WP-2' AND (exists(lines, l -> l rlike r'^\s*alt\b') AND NOT exists(lines, l -> l rlike r'^\s*else\b') OR exists(lines, l -> l rlike r'^\s*(participant|actor)\s+\S+') AND size(messages) = 0), 1, 0)",
    "S-06": r"if(type = 'WP-3' AND NOT exists(lines, l -> l rlike r'\[\*\]\s*-->' OR l rlike r'-->\s*\[\*\]'), 1, 0)",
    "S-07": rf"if(type = 'WP-4' AND exists(lines, l -> NOT l rlike r'^\s*\S+\s*\{{' AND l rlike r'^\s*(\S+)\s+(\S+)\s+(\S+)\s*:' AND regexp_extract(l, r'^\s*(\S+)\s+(\S+)\s+(\S+)\s*:', 2) rlike r'\?\?|--|~~' AND NOT regexp_extract(l, r'^\s*(\S+)\s+(\S+)\s+(\S+)\s*:', 2) rlike r'{_CARDINALITY}'), 1, 0)",
    "S-08": r"if(type = 'WP-6' AND NOT exists(lines, l -> l rlike r'(?i)^\s*dateFormat\b'), 1, 0)",
    "P-01": rf"if(exists(chains, l -> l rlike r'^\s*({_ID})\s*\[([^\]\"]+)\]'), 1, 0)",
    "P-02": r"if(exists(chains, l -> regexp_extract(regexp_replace(l, '\"[^\"]*\"', ''), r'^\s*([^\s\[\{\(\->][^\s]*?)(?=\s*[\[\{\(]|-->|\s*$)', 1) rlike r'[^\x00-\x7F]'), 1, 0)",
    "P-03": "if(exists(kinds, x -> x.kind = 'style'), 1, 0)",
    "P-04": "if(exists(kinds, x -> x.kind = 'click'), 1, 0) + if(exists(kinds, x -> x.kind = 'linkstyle'), 1, 0)",
    "P-05": "if(exists(kinds, x -> x.kind = 'init'), 1, 0)",
    "P-06": r"if(exists(chains, l -> size(regexp_extract_all(l, r'(?i)<[a-z]+(?:\s+[^>]*)?>', 0)) > 1), 1, 0)",
    "L-01": f"if(n_nodes > {MAX_NODES}, 1, 0)",
    "L-02": f"if(type = 'WP-6' AND n_nodes > {MAX_NODES} AND n_nodes <= {MAX_TASKS}, 1, 0)",
    "L-03": f"if(type = 'WP-1' AND depth BETWEEN 1 AND 4 AND n_nodes > {MAX_NODES} AND n_nodes <= {MAX_TREE}, 1, 0)",
    "L-04": f"size(filter(nodes, x -> type = 'WP-1' AND length(x.label) > if(contains(x.label, '<br/>') OR contains(x.label, '<br>'), {MAX_BROKEN_LABEL}, {MAX_LABEL})))",
    "L-05": f"if(type = 'WP-1' AND depth > {MAX_DEPTH}, 1, 0)",
    "L-06": "if(alt = '', 1, 0)",
}


def violations(diagrams: DataFrame) -> DataFrame:
    """diagram_id, rule_id, severity and n of the rules that a diagram breaks."""
    alt_only = r"type = 'WP-2' AND exists(lines, l -> l rlike r'^\s*alt\b') AND NOT exists(lines, l -> l rlike r'^\s*else\b')"
    found = [F.struct(F.lit(r).alias("rule_id"), F.expr(f"if({alt_only}, 'warning', 'error')" if r == "S-05" else f"'{SEVERITIES[r]}'").alias("severity"), F.coalesce(F.expr(how), F.lit(0)).cast("long").alias("n")) for r, how in BROKEN.items()]
    rows = parsed(diagrams).select("diagram_id", F.array(*found).alias("found"))
    # an outer explode, as the optimiser copies what an inner one reads into a filter, rule by rule
    return rows.select("diagram_id", F.explode_outer("found").alias("x")).where("x.n > 0").select("diagram_id", "x.*")


# Diagrams of the documents: the words of a document as nodes, in a form by its number; some with a fault.
_D = "$chr(10)"
table(
    "diagram_parts",
    "SELECT doc_id, block_index AS i, $replace_all($extract(content, r'^[^ ]+', 0), r'[^A-Za-z]', '') AS w, $replace_all(content, r'[\\\"<>|]', '') AS label, n_words FROM {blocks}",
)
table(
    "diagrams",
    f"""
SELECT doc_id AS diagram_id, 'd' || $text(doc_id) AS src, CASE WHEN doc_id % 6 = 1 THEN '' ELSE 'alt' END AS alt,
  CASE doc_id % 16 WHEN 0 THEN 'flowchart TD' WHEN 1 THEN 'flowchart' WHEN 2 THEN 'graph LR' || {_D} || 'subgraph A' || {_D} || 'subgraph B' || {_D} || 'subgraph C["x"]' WHEN 3 THEN 'sequenceDiagram' || {_D} || 'participant A' WHEN 4 THEN 'sequenceDiagram' || {_D} || 'alt ok'
    WHEN 5 THEN 'stateDiagram-v2' WHEN 6 THEN 'erDiagram' WHEN 7 THEN 'gantt' || CASE WHEN doc_id % 32 = 7 THEN {_D} || 'dateFormat YYYY' ELSE '' END WHEN 8 THEN 'pie' WHEN 9 THEN 'mindmap' WHEN 10 THEN 'flowchart RL' || {_D} || '%%{{init: x' WHEN 11 THEN 'graph TB' || {_D} || 'click a "b"' || {_D} || 'linkStyle 0 s' || {_D} || 'style a fill:#fff'
    WHEN 12 THEN 'classDiagram' WHEN 13 THEN 'flowchart LR' || {_D} || 'niño-->b' WHEN 14 THEN 'flowchart LR' || {_D} || 'a["<b>x</b> <i>y</i>"] --> b[open' ELSE 'flowchart BT' || {_D} || 'a[plain] --> b("r")' END || {_D}
  || $texts(CASE doc_id % 16 WHEN 3 THEN CASE WHEN doc_id % 32 = 3 THEN 'A->>B ' || w ELSE 'A' || w || '->>' || $text(i) || 'B: ' || w END WHEN 4 THEN 'A->>B: ' || w WHEN 5 THEN CASE WHEN doc_id % 32 = 5 THEN w || ' --> b' ELSE '[*] --> ' || w END
    WHEN 6 THEN 'A ' || CASE WHEN doc_id % 32 = 6 THEN '??--' ELSE '||--o{{' END || ' B : ' || w WHEN 7 THEN w || ' : a, ' || $text(i) WHEN 8 THEN '"' || w || '" : 3'
    ELSE 'n' || $text(i) || '["' || CASE WHEN i % 3 = 0 THEN label ELSE w END || '"] -->|to| n' || $text(i + 1) || ' --> ' || w END, i, {_D})
  || CASE WHEN doc_id % 32 = 2 THEN {_D} || 'end end' || {_D} || 'end' || {_D} || 'end' ELSE '' END AS content
FROM {{diagram_parts}} GROUP BY doc_id
""",
)


def _oracle() -> str:
    """The rules over one row for each line; the depth is the walk of openings and ends less the lowest point so far."""
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())
    bare = "regexp_replace(l, '\"[^\"]*(\"|$)', '', 'g')"
    count = lambda c: f"(length({bare}) - length(replace({bare}, '{c}', '')))"
    msg = lambda g: f"regexp_extract(l, '{_MESSAGE}', {g})"
    rel = r"^\s*(\S+)\s+(\S+)\s+(\S+)\s*:"
    severities = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITIES.items())
    chain = rf"^([ \t]*{_ID}\s*({_SHAPE})?[ \t]*({_OP})?)+"
    flags = {
        "S-03": f"bool_or(type = 'WP-1' AND kind NOT IN ('init', 'none') AND ({count('[')} <> {count(']')} OR {count('(')} <> {count(')')}) AND regexp_matches(l, '\\b{_ID}\\s*\\['))::INT",
        "S-04": rf"count(*) FILTER (WHERE message AND (regexp_matches({msg(1)}, '^\d') OR regexp_matches({msg(3)}, '^\d')))",
        "S-05": r"CASE WHEN any_value(type) <> 'WP-2' THEN 0 WHEN bool_or(regexp_matches(l, '^\s*alt\b')) AND NOT bool_or(regexp_matches(l, '^\s*else\b')) THEN 2 WHEN bool_or(regexp_matches(l, '^\s*(participant|actor)\s+\S+')) AND NOT bool_or(message) THEN 1 ELSE 0 END",
        "S-06": r"(any_value(type) = 'WP-3' AND NOT bool_or(regexp_matches(l, '\[\*\]\s*-->') OR regexp_matches(l, '-->\s*\[\*\]')))::INT",
        "S-07": rf"bool_or(type = 'WP-4' AND NOT regexp_matches(l, '^\s*\S+\s*\{{{{') AND regexp_matches(regexp_extract(l, '{rel}', 2), '\?\?|--|~~') AND NOT regexp_matches(regexp_extract(l, '{rel}', 2), '{_CARDINALITY}'))::INT".replace("{{", "{"),
        "S-08": r"(any_value(type) = 'WP-6' AND NOT bool_or(regexp_matches(l, '(?i)^\s*dateFormat\b')))::INT",
        "P-01": rf"bool_or(kind = 'chain' AND regexp_matches(l, '^\s*({_ID})\s*\[([^\]\"]+)\]'))::INT",
        "P-02": r"bool_or(kind = 'chain' AND regexp_matches(regexp_extract(regexp_replace(l, '\"[^\"]*\"', '', 'g'), '^\s*([^\s\[\{\(\->][^\s]*?)(\s*[\[\{\(]|-->|\s*$)', 1), '[^\x00-\x7F]'))::INT",
        "P-03": "bool_or(kind = 'style')::INT",
        "P-04": "bool_or(kind = 'click')::INT + bool_or(kind = 'linkstyle')::INT",
        "P-05": "bool_or(kind = 'init')::INT",
        "P-06": r"bool_or(kind = 'chain' AND len(regexp_extract_all(l, '(?i)<[a-z]+(?:\s+[^>]*)?>')) > 1)::INT",
    }
    return rf"""
WITH t AS (SELECT *, CASE lower(regexp_extract(head, '^\S+')) {kinds} ELSE '' END AS type FROM (SELECT diagram_id, coalesce(alt, '') AS alt, string_split(coalesce(content, ''), chr(10)) AS ls, coalesce(trim(list_filter(string_split(coalesce(content, ''), chr(10)), lambda l: regexp_matches(l, '\S'))[1]), '') AS head FROM {{diagrams}})),
r AS (SELECT diagram_id, type, i, ls[i] AS l FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM t)),
k AS (SELECT *, type = 'WP-2' AND NOT regexp_matches(l, '^\s*(participant|actor)\s+\S+') AND regexp_matches(l, '{_MESSAGE}') AS message, CASE WHEN type <> 'WP-1' THEN 'other'
    WHEN regexp_matches(l, '(?i)^\s*%%\{{init:') THEN 'init' WHEN regexp_matches(l, '{_COMMENT}') THEN 'none' WHEN regexp_matches(l, '^\s*subgraph\s+{_ID}') THEN 'open' WHEN regexp_matches(l, '(^|\s)end(\s|$)') THEN 'close' WHEN regexp_matches(l, '^\s*class(Def)?\s+') THEN 'class'
    WHEN regexp_matches(l, '(?i)^\s*style\s+\S+\s+(fill|stroke)\s*:\s*#') THEN 'style' WHEN regexp_matches(l, '^\s*click\s+') THEN 'click' WHEN regexp_matches(l, '^\s*linkStyle\s+') THEN 'linkstyle' ELSE 'chain' END AS kind
  FROM r WHERE CASE WHEN type = 'WP-1' THEN NOT (i = 1 AND regexp_matches(l, '^\s*(flowchart|graph)\b')) ELSE NOT regexp_matches(l, '{_COMMENT}') END),
f AS (SELECT diagram_id, {", ".join(f'{v} AS "{n}"' for n, v in flags.items())} FROM k GROUP BY diagram_id),
e AS (SELECT diagram_id, i, 0 AS o, 1 AS step FROM k WHERE kind = 'open' UNION ALL SELECT diagram_id, i, unnest(range(1, len(list_filter(string_split_regex(l, '\s'), lambda w: w = 'end')) + 1)), -1 FROM k WHERE kind IN ('open', 'close')),
w AS (SELECT diagram_id, sum(step) OVER (PARTITION BY diagram_id ORDER BY i, o) AS s, i, o FROM e),
p AS (SELECT diagram_id, max(s - least(0, low)) AS depth FROM (SELECT *, min(s) OVER (PARTITION BY diagram_id ORDER BY i, o) AS low FROM w) GROUP BY diagram_id),
c AS (SELECT diagram_id, i, unnest(found) AS tok, generate_subscripts(found, 1) AS j FROM (SELECT diagram_id, i, regexp_extract_all(regexp_extract(trim(l), '{chain}'), '({_OP})|({_ID})\s*({_SHAPE})?') AS found FROM k WHERE kind = 'chain')),
n AS (SELECT diagram_id, regexp_extract(tok, '^{_ID}') AS id, arg_min(regexp_extract(tok, '"([^"]*)"', 1), (i, j)) AS label FROM c WHERE NOT regexp_matches(tok, '^({_OP})$') GROUP BY ALL),
z AS (SELECT diagram_id, count(*) AS n_nodes, count(*) FILTER (WHERE length(label) > CASE WHEN contains(label, '<br/>') OR contains(label, '<br>') THEN {MAX_BROKEN_LABEL} ELSE {MAX_LABEL} END) AS long FROM n WHERE id <> '' GROUP BY diagram_id
  UNION ALL SELECT diagram_id, count(*), 0 FROM k WHERE type = 'WP-6' AND NOT regexp_matches(l, '(?i)^\s*(dateFormat|title|axisFormat|section)\b') AND contains(l, ':') AND contains(l, ',') GROUP BY diagram_id
  UNION ALL SELECT diagram_id, count(*), 0 FROM k WHERE type = 'WP-8' AND NOT regexp_matches(l, '(?i)^\s*title\b') AND contains(l, ':') GROUP BY diagram_id),
g AS (SELECT t.diagram_id, type, head, alt, coalesce(n_nodes, 0) AS n, coalesce(long, 0) AS long, coalesce(depth, 0) AS depth, f.* EXCLUDE (diagram_id) FROM t LEFT JOIN f ON f.diagram_id = t.diagram_id LEFT JOIN z ON z.diagram_id = t.diagram_id LEFT JOIN p ON p.diagram_id = t.diagram_id),
v AS (SELECT diagram_id, unnest([{", ".join(f"{{{{'r': '{n}', 'n': coalesce(\"{n}\", 0)::BIGINT}}}}" for n in flags)},
    {{{{'r': 'S-01', 'n': (type = '')::BIGINT}}}}, {{{{'r': 'S-02', 'n': (type = 'WP-1' AND lower(head) IN ('flowchart', 'graph'))::BIGINT}}}}, {{{{'r': 'L-01', 'n': (n > {MAX_NODES})::BIGINT}}}}, {{{{'r': 'L-02', 'n': (type = 'WP-6' AND n > {MAX_NODES} AND n <= {MAX_TASKS})::BIGINT}}}},
    {{{{'r': 'L-03', 'n': (type = 'WP-1' AND depth BETWEEN 1 AND 4 AND n > {MAX_NODES} AND n <= {MAX_TREE})::BIGINT}}}}, {{{{'r': 'L-04', 'n': (CASE WHEN type = 'WP-1' THEN long ELSE 0 END)::BIGINT}}}}, {{{{'r': 'L-05', 'n': (type = 'WP-1' AND depth > {MAX_DEPTH})::BIGINT}}}}, {{{{'r': 'L-06', 'n': (alt = '')::BIGINT}}}}]) AS x FROM g)
SELECT diagram_id, x.r AS rule_id, CASE WHEN x.r = 'S-05' AND x.n = 2 THEN 'warning' ELSE CASE x.r {severities} END END AS severity, CASE WHEN x.r = 'S-05' THEN 1 ELSE x.n END AS n FROM v WHERE x.n > 0
""".replace("{{'r'", "{'r'").replace("BIGINT}}", "BIGINT}")


@program("val_mermaid", _oracle(), diagrams="diagrams")
def val_mermaid(diagrams):
    """Violations of the twenty rules of text diagrams."""
    return violations(diagrams)
