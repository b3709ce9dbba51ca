"""Note files: typed headers, sections by heading, and attributes of tags."""

from __future__ import annotations

from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import operator, table

_KEY = r"^([A-Za-z][A-Za-z0-9_-]*):"
_ITEM = r"^ +- +(.*)$"
# Headers of the notes as files: values plain or quoted, lists one item a line, a line that is neither now and then.
table(
    "header_files",
    """
SELECT note_id, '---' || $chr(10) || $texts(CASE WHEN is_list THEN key || ':' || $chr(10) || '  - ' || value || $chr(10) || '  - "b, c"' WHEN key = 'title' THEN key || ': "' || value || '"' WHEN key = 'status' THEN key || ': ' || value || $chr(10) || '# remark' ELSE key || ': ' || value END, key, $chr(10))
       || $chr(10) || CASE length(note_id) WHEN 6 THEN 'checked: true' WHEN 7 THEN 'checked: ~' ELSE 'checked: 1.50' END || $chr(10) || '---' || $chr(10) || 'body: no' AS text
FROM {note_fields} GROUP BY note_id
""",
)
operator(
    "fn_frontmatter",
    f"""
WITH f AS (SELECT note_id, $split($extract(text, r'(?s)^---\\n(.*?)\\n---', 1), r'\\n') AS ls FROM {{header_files}}),
l AS (SELECT note_id, pos, $at(ls, pos) AS line FROM (SELECT note_id, ls, $explode($range($long(1), $size(ls))) AS pos FROM f)),
k AS (SELECT note_id, pos, line, max(CASE WHEN $matches(line, r'{_KEY}') THEN pos END) OVER (PARTITION BY note_id ORDER BY pos) AS owner FROM l),
v AS (SELECT note_id, owner, max(CASE WHEN pos = owner THEN $extract(line, r'{_KEY}', 1) END) AS key, max(CASE WHEN pos = owner THEN trim($replace_all(line, r'{_KEY}', '')) END) AS scalar,
             $texts(CASE WHEN $matches(line, r'{_ITEM}') THEN $replace_all(trim($extract(line, r'{_ITEM}', 1)), r'^"(.*)"$', '@@1') END, pos, '|') AS items, count(CASE WHEN $matches(line, r'{_ITEM}') THEN 1 END) AS n FROM k WHERE owner IS NOT NULL GROUP BY note_id, owner)
SELECT note_id, key, CASE WHEN n > 0 THEN items WHEN scalar IN ('null', '~', '') THEN NULL ELSE $replace_all(scalar, r'^"(.*)"$', '@@1') END AS value,
       CASE WHEN n > 0 THEN 'list' WHEN scalar IN ('null', '~', '') THEN 'null' WHEN scalar IN ('true', 'false', 'yes', 'no') THEN 'bool' WHEN $matches(scalar, r'^[+-]?[0-9]+$') THEN 'int' WHEN $matches(scalar, r'^[+-]?[0-9]+[.][0-9]+$') THEN 'float' ELSE 'text' END AS kind
FROM v
""",
    "Header fields of a note with their types; lists one item a line.",
)
operator(
    "fn_section_extract",
    """
WITH p AS (SELECT note_id, ord, line, sum(CASE WHEN $matches(line, r'^#{1,6} ') THEN 1 ELSE 0 END) OVER (PARTITION BY note_id ORDER BY ord) AS part FROM {note_lines})
SELECT note_id, $long(part) AS part, trim($replace_all(max(CASE WHEN $matches(line, r'^#{1,6} ') THEN line END), r'^#+ +', '')) AS heading, max(CASE WHEN $matches(line, r'^#{1,6} ') THEN $long(length($extract(line, r'^#+', 0))) END) AS level,
       $replace_all($texts(CASE WHEN NOT $matches(line, r'^#{1,6} ') THEN line END, ord, $chr(10)), r'^\\s+|\\s+$', '') AS body
FROM p WHERE part > 0 GROUP BY note_id, part
""",
    "Text under each heading until the next.",
)
operator(
    "fn_attrs",
    """
SELECT page_id, $long(i) AS place, $extract($at(found, i), r'^([A-Za-z0-9_][A-Za-z0-9_-]*)=', 1) AS key, $replace_all($replace_all($at(found, i), r'^[A-Za-z0-9_-]+=', ''), r'^"([^"]*)"$', '@@1') AS value
FROM (SELECT page_id, found, $explode($range($long(1), $size(found))) AS i FROM (SELECT page_id, $all_matches($join($all_matches(html, r'<[A-Za-z][^>]*>'), ' '), r'[A-Za-z0-9_][A-Za-z0-9_-]*=(?:"[^"]*"|[^ ">]+)') AS found FROM {pages}) WHERE $size(found) >= 1)
""",
    "Attributes of the tags of a page, quoted or not.",
)
