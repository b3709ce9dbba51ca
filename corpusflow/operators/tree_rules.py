"""Rules of note trees and their headers: kinds, nesting, capabilities, references, severities and what is empty.

A tree is {ir_nodes}: note_id, path, parent, ord, node, text, name, capability, ref_block, ref_hash. Each rule is a projection; nesting meets children with their
parents by an equality join, and what needs all children of a node is one grouping of them.
"""

from __future__ import annotations

from corpusflow.operators import note_tree  # noqa: F401  the tables that operators name
from corpusflow.plans import registry
from corpusflow.plans.catalog import apply, engine_table, operator, table
from corpusflow.plans.durable import written

# Kinds of nodes, capabilities, severities and header rules.
INLINE = ("text", "strong", "em", "code-inline", "link-external", "link-note", "term-ref", "source-ref", "math-inline", "footnote-ref", "keyboard", "placeholder", "deleted")
BLOCKS = ("section", "paragraph", "list", "checklist", "table", "definition-list", "code", "console", "equation", "figure", "diagram", "admonition", "collapsible", "quote", "columns", "divider", "property-block", "question", "step", "parameter-table")
CONTAINERS = ("section", "admonition", "collapsible", "columns", "question", "step")
OF_PARAGRAPHS = ("paragraph", "list", "checklist", "quote")
OF_INLINE = ("table", "parameter-table")
ANSWERS = ("paragraph", "list", "code", "console", "diagram")
CAPABILITIES = (
    "section", "section-h1", "section-h2", "section-h3", "section-h4", "section-h5", "section-h6", "paragraph", "list", "checklist", "table", "definition-list", "code-block-fenced", "console-block", "equation-block",
    "math-inline", "figure", "diagram-mermaid-block", "diagram-railroad", "callout", "callout-note", "callout-tip", "callout-example", "callout-warning", "callout-danger", "callout-security", "callout-performance",
    "callout-version", "callout-deprecated", "callout-conflict", "collapsible", "quote", "columns", "divider", "property-table", "question", "step", "parameter-table", "text", "strong", "em", "code-inline",
    "link-external", "link-note", "link-term", "source-ref", "footnote-ref", "keyboard", "placeholder", "deleted", "layer-mark",
)
SEVERITIES = ("warning", "note", "tip", "example", "danger", "security", "performance", "version", "deprecated", "conflict", "external")
ALWAYS, PUBLISHED = ("title", "note-type", "status"), ("summary", "reading-time-minutes")
SUMMARY_CHARS = 200


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_FITS = f"""CASE WHEN p.node IN {_in(INLINE)} THEN c.node IN {_in(INLINE)} WHEN p.node IN {_in(CONTAINERS)} THEN true WHEN p.node IN {_in(OF_PARAGRAPHS)} THEN c.node IN {_in(INLINE)} OR c.node = 'paragraph'
  WHEN p.node = 'parameter-table' AND c.node = 'table' THEN true WHEN p.node IN {_in(OF_INLINE)} THEN c.node IN {_in(INLINE)} ELSE false END"""
_SHOWN = "trim(coalesce(c.text, '')) <> '' OR (c.node IN ('term-ref', 'link-note', 'link-external', 'footnote-ref') AND trim(coalesce(c.name, '')) <> '')"
#: (rule, severity, condition on a node n with its children k)
_NODE_RULES = [
    ("E1", "error", f"n.node NOT IN {_in(BLOCKS + INLINE)}"),
    ("E2", "error", "n.capability IS NULL"),
    ("W11", "warning", f"n.capability IS NOT NULL AND n.capability NOT IN {_in(CAPABILITIES)}"),
    ("E3", "error", "n.ref_hash IS NOT NULL AND (coalesce(n.ref_block, '') = '' OR NOT $matches(n.ref_block, r'^[0-9a-f]{12}$') OR (n.ref_hash <> '' AND NOT $matches(n.ref_hash, r'^[0-9a-f]{64}$')))"),
    ("E4", "error", f"n.node = 'admonition' AND coalesce(n.name, '') NOT IN {_in(SEVERITIES)}"),
    ("E6", "error", "n.node = 'source-ref' AND NOT $matches(coalesce(n.name, ''), r'^[0-9a-f]{12}$')"),
    ("W2", "warning", "n.node = 'list' AND k.n = 1"),
    ("W3", "warning", "n.node = 'section' AND k.n IS NULL"),
    ("W4", "warning", "n.node = 'paragraph' AND NOT coalesce(k.shown, false)"),
    ("W5", "warning", "n.node = 'code' AND trim($replace_all(coalesce(n.text, ''), r'[\\x09-\\x0D]', ' ')) = ''"),
    ("W6", "warning", "n.node = 'admonition' AND k.n IS NULL"),
    ("W7", "warning", "n.node = 'text' AND coalesce(n.text, '') = ''"),
    ("W8", "warning", "n.node = 'paragraph' AND k.refs > k.distinct_refs"),
    ("W10", "warning", "n.node = 'question' AND NOT coalesce(k.answered, false)"),
]
_MISSING = [("title", "TI"), ("note-type", "NO"), ("status", "ST"), ("summary", "SU"), ("reading-time-minutes", "RE")]
TREE = (
    f"""
WITH k AS (
  SELECT c.note_id, c.parent, count(*) AS n, bool_or({_SHOWN}) AS shown, bool_or(c.node IN {_in(ANSWERS)}) AS answered,
         count(CASE WHEN c.node = 'source-ref' AND c.name <> '' THEN c.name END) AS refs, count(DISTINCT CASE WHEN c.node = 'source-ref' AND c.name <> '' THEN c.name END) AS distinct_refs
  FROM {{ir_nodes}} c WHERE c.parent <> '' GROUP BY c.note_id, c.parent
), known AS (SELECT DISTINCT block_id FROM {{blocks}}),
fields AS (SELECT note_id, key, value FROM {{note_fields}} WHERE NOT is_list),
status AS (SELECT note_id, max(CASE WHEN key = 'status' THEN value END) AS status FROM fields GROUP BY note_id)
"""
    + "\nUNION ALL ".join(f"SELECT '{r}' AS rule_id, '{s}' AS severity, n.note_id, n.path FROM {{ir_nodes}} n LEFT JOIN k ON k.note_id = n.note_id AND k.parent = n.path WHERE {c}" for r, s, c in _NODE_RULES)
    + f"""
UNION ALL SELECT 'E1b', 'error', c.note_id, c.path FROM {{ir_nodes}} c JOIN {{ir_nodes}} p ON p.note_id = c.note_id AND p.path = c.parent WHERE c.node <> '' AND NOT ({_FITS})
UNION ALL SELECT 'E5', 'error', n.note_id, n.path FROM {{ir_nodes}} n LEFT JOIN known b ON b.block_id = n.name WHERE n.node = 'source-ref' AND coalesce(n.name, '') <> '' AND b.block_id IS NULL
"""
    + "\n".join(
        f"UNION ALL SELECT 'E01{code}', CASE WHEN s.status = 'published' THEN 'error' ELSE 'warning' END, s.note_id, '/frontmatter' FROM status s LEFT JOIN fields f ON f.note_id = s.note_id AND f.key = '{key}' AND f.value <> '' WHERE f.note_id IS NULL"
        + ("" if key in ALWAYS else " AND s.status = 'published'")
        for key, code in _MISSING
    )
    + f"""
UNION ALL SELECT 'E03SU', 'error', note_id, '/frontmatter/summary' FROM fields WHERE key = 'summary' AND length(value) > {SUMMARY_CHARS}
UNION ALL SELECT 'E03SC', 'error', note_id, '/frontmatter/summary' FROM fields WHERE key = 'summary' AND length(value) <= {SUMMARY_CHARS} AND $matches(value, r'[\\x00-\\x1F\\x7F]')
UNION ALL SELECT 'E02RT', 'error', note_id, '/frontmatter/reading-time-minutes' FROM fields WHERE key = 'reading-time-minutes' AND NOT $matches(value, r'^ *[+-]?[0-9]+ *$')
UNION ALL SELECT 'E03RT', 'error', note_id, '/frontmatter/reading-time-minutes' FROM fields WHERE key = 'reading-time-minutes' AND $matches(value, r'^ *([+]?0+|-[0-9]+) *$')
"""
)
# The trees of the documents as stored: items are paragraphs, cells inline; some nodes with a fault, by the number of their note.
_d = "$long(substr(note_id, 6))"
table(
    "ir_nodes",
    f"""
SELECT note_id, path, parent, ord,
       CASE WHEN node = 'item' THEN CASE WHEN {_d} % 11 = 1 THEN 'collapsible' ELSE 'paragraph' END WHEN node = 'row' THEN 'strong' WHEN node = 'cell' THEN 'em' WHEN node = 'divider' AND {_d} % 5 = 0 THEN 'rule' WHEN node = 'step' AND {_d} % 3 = 0 THEN 'question' ELSE node END AS node,
       CASE WHEN {_d} % 13 = 2 AND node IN ('text', 'code') THEN '' ELSE text END AS text, CASE WHEN node = 'source-ref' THEN CASE {_d} % 6 WHEN 0 THEN 'blk1' WHEN 1 THEN 'abcdef012345' ELSE name END ELSE name END AS name,
       CASE WHEN {_d} % 17 = 3 AND ord = 0 THEN NULL WHEN {_d} % 17 = 4 AND ord = 1 THEN 'sparkle' WHEN node = 'admonition' THEN 'callout' WHEN node = 'code' THEN 'code-block-fenced' WHEN node = 'term-ref' THEN 'link-term' ELSE 'text' END AS capability,
       CASE WHEN depth = 1 THEN CASE {_d} % 19 WHEN 5 THEN '' WHEN 6 THEN 'XYZ' ELSE substr($sha1(path), 1, 12) END END AS ref_block, CASE WHEN depth = 1 THEN CASE {_d} % 19 WHEN 7 THEN 'short' WHEN 8 THEN '' ELSE $sha256(note_id) END END AS ref_hash
FROM {{note_tree}}
""",
)
operator("val_ir", TREE, "Kinds, nesting, capabilities, references, severities and empty nodes of note trees, E1 to E6 and W2 to W11, and rules of their headers, E01 to E03.")


def val_ir(spark, sf_dir):
    """The rules over the trees of the documents; what they read again and again is written once."""
    made = {}
    inputs = {"ir_nodes": engine_table(spark, sf_dir, "ir_nodes", made), "note_fields": engine_table(spark, sf_dir, "note_fields", made), "blocks": engine_table(spark, sf_dir, "blocks", made).select("block_id")}
    return apply("val_ir", **{name: written(df, name) for name, df in inputs.items()})


registry.QUERIES["val_ir"] = val_ir
