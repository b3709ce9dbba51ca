"""Rules over notes in the note language and over stored blocks.

A note is its header, {note_fields} (note_id, key, value, is_list; an empty header is one row with a null key), and its body,
{note_lines} (note_id, note_type, ord, line; ord rises without ties). Files beside the notes are {note_assets} (path, bytes).
Every operator gives rule_id, severity, note_id and node. All work is by note: windows and joins have it as their key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusflow.plans.catalog import operator, program, run_sql
from corpusflow.plans.dialect import duck_sql
from corpusflow.plans.durable import written

# Names and limits of the rules.
DIRECTIVES = ("warning", "note", "tip", "example", "danger", "security", "performance", "version", "deprecated", "conflict", "external", "collapsible", "columns", "param-table", "step", "question", "diagram", "figure", "equation", "console")
REQUIRED = ("title", "note-type", "status")
LAYERS = ("l1", "l2", "l3")
KEYS = ("title", "note-type", "status", "summary", "reading-time-minutes", "tags", "source", "source-type", "source-anchor", "source-url", "retrieved", "product", "product-version", "vendor", "related", "difficulty", "coverage", "certification-objective", "goal-profile-override", "language")
STATUS = ("draft", "published")
NOTE_TYPES = ("concept", "api-reference", "procedure", "configuration", "error-troubleshooting", "architecture", "syntax", "data-model", "chapter-digest", "comparison", "version-delta", "glossary-term", "cheatsheet", "index-moc", "practice")
SOURCE_TYPES = ("book", "docs", "api", "rfc", "transcription", "article", "release-notes", "other")
REQUIRED_PUBLISHED = ("title", "note-type", "status", "summary", "reading-time-minutes")
IMAGE_FORMATS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".avif")
MOST_BYTES = 10 * 1024 * 1024
MOST_SUMMARY = 200
BLOCK_TYPES = ("prose", "heading", "list", "table", "code", "console", "formula", "figure", "caption", "note", "warning", "example", "syntax-diagram", "footnote", "toc", "boilerplate", "abstract", "theorem", "proof", "algorithm", "reference-list", "reference-entry")
#: words of a summary section by note type, all others 60; lines of a note by type, with the rule and its severity
SUMMARY_WORDS = {"cheatsheet": 30, "chapter-digest": 120}
NOTE_LINES = {"cheatsheet": ("V-LEN-02", "error", 80), "glossary-term": ("V-LEN-03", "error", 30), "index-moc": ("V-LEN-04", "warning", 200)}


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _rows(values: tuple[str, ...], name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{v}' AS {name}" for v in values)


_HEADED = "SELECT DISTINCT note_id FROM {note_fields}"
_HEADLESS = f"SELECT n.note_id FROM (SELECT DISTINCT note_id FROM {{note_lines}}) n LEFT JOIN ({_HEADED}) h ON h.note_id = n.note_id WHERE h.note_id IS NULL"

TEXTS = {}
# A closing line closes the kind that was opened first among the open ones. What the first j kinds leave open is a sum that
# does not fall below zero: its last value less its least. The difference of two such sums is what kind j leaves open.
TEXTS["val_notemark"] = f"""
WITH c_required AS ({_rows(REQUIRED, "key")}), h AS ({_HEADED}),
b AS (SELECT l.note_id, l.ord, l.line, trim(l.line) AS bare FROM {{note_lines}} l JOIN h ON h.note_id = l.note_id),
e AS (SELECT note_id, ord, $extract(bare, r'^:::([a-z-]+)[ ]*(?:[{{][^}}]*[}}])?[ ]*$', 1) AS kind FROM b WHERE $matches(bare, r'^:::(?:[a-z-]+[ ]*(?:[{{][^}}]*[}}])?)?[ ]*$')),
k AS (SELECT note_id, kind, row_number() OVER (PARTITION BY note_id ORDER BY min(ord)) AS j FROM e WHERE kind <> '' GROUP BY note_id, kind),
s AS (SELECT k.note_id, k.kind, k.j, e.ord, sum(CASE WHEN e.kind = '' THEN -1 WHEN o.j <= k.j THEN 1 ELSE 0 END) OVER (PARTITION BY k.note_id, k.j ORDER BY e.ord) AS balance
      FROM k JOIN e ON e.note_id = k.note_id LEFT JOIN k o ON o.note_id = e.note_id AND o.kind = e.kind),
r AS (SELECT note_id, kind, j, $max_by(balance, ord) - least(0, min(balance)) AS still FROM s GROUP BY note_id, kind, j),
w AS (SELECT note_id, kind, still - coalesce(lag(still) OVER (PARTITION BY note_id ORDER BY j), 0) AS still FROM r)
SELECT 'V-NM-01' AS rule_id, 'error' AS severity, note_id, '<frontmatter>' AS node FROM ({_HEADLESS})
UNION ALL SELECT 'V-NM-02', 'error', h.note_id, 'frontmatter.' || q.key FROM h CROSS JOIN c_required q LEFT JOIN {{note_fields}} f ON f.note_id = h.note_id AND f.key = q.key WHERE f.note_id IS NULL
UNION ALL SELECT 'V-NM-03', 'error', note_id, 'line ' || $text(ord) FROM b WHERE $matches(bare, r'^:::[a-z-]+(?:[ \\t]|$)') AND $extract(bare, r'^:::([a-z-]+)', 1) NOT IN {_in(DIRECTIVES)}
UNION ALL SELECT 'V-NM-04', 'error', note_id, 'directive::' || kind FROM w WHERE still > 0
UNION ALL SELECT 'V-NM-05', 'error', note_id, 'line ' || $text(ord) FROM (SELECT note_id, ord, $explode($groups(line, r'[{{]src:blk_([^}}]*)[}}]', 1)) AS id FROM b) WHERE NOT $matches(id, r'^[0-9a-f]{{12}}$')
UNION ALL SELECT 'V-NM-06', 'warning', note_id, 'line ' || $text(ord) FROM b WHERE $matches(line, r'\\[\\[term:[^\\]]*$')
UNION ALL SELECT 'V-NM-07', 'error', note_id, 'line ' || $text(ord) FROM (SELECT note_id, ord, $explode($all_matches(line, r'\\[\\[note:\\]\\]')) AS mark FROM b)
UNION ALL SELECT 'V-NM-08', 'error', note_id, 'line ' || $text(ord) FROM (SELECT note_id, ord, $explode($groups(line, r'[{{]layer:([^}}]+)[}}]', 1)) AS layer FROM b) WHERE trim(layer) NOT IN {_in(LAYERS)}
UNION ALL SELECT 'V-NM-09', 'warning', note_id, 'line ' || $text(ord) FROM (SELECT note_id, ord, $explode($groups(line, r'[{{][{{]([^}}]*)[}}][}}]', 1)) AS name FROM b) WHERE trim(name) = ''
"""
TEXTS["val_properties"] = f"""
WITH f AS (SELECT note_id, key, value, is_list FROM {{note_fields}}), c_required AS ({_rows(REQUIRED_PUBLISHED, "key")}),
p AS (SELECT DISTINCT note_id FROM f WHERE key = 'status' AND value = 'published')
SELECT 'V-PR-01' AS rule_id, 'error' AS severity, note_id, '<frontmatter>' AS node FROM ({_HEADLESS})
UNION ALL SELECT 'V-PR-02', 'error', note_id, key FROM f WHERE key NOT IN {_in(KEYS)}
UNION ALL SELECT 'V-PR-03', CASE key WHEN 'source-type' THEN 'warning' ELSE 'error' END, note_id, key FROM f
  WHERE (key = 'status' AND coalesce(value, '') NOT IN {_in(STATUS)}) OR (key = 'note-type' AND coalesce(value, '') NOT IN {_in(NOTE_TYPES)}) OR (key = 'source-type' AND coalesce(value, '') NOT IN {_in(SOURCE_TYPES)})
UNION ALL SELECT 'V-PR-04', 'error', p.note_id, q.key FROM p CROSS JOIN c_required q LEFT JOIN f ON f.note_id = p.note_id AND f.key = q.key AND f.value <> '' WHERE f.note_id IS NULL
UNION ALL SELECT 'V-PR-05', 'warning', note_id, key FROM f WHERE key = 'tags' AND NOT is_list
UNION ALL SELECT 'V-PR-06', 'error', note_id, key FROM f WHERE key = 'reading-time-minutes' AND value IS NOT NULL AND NOT $matches(value, r'^[ ]*[+]?0*[1-9][0-9]*[ ]*$')
UNION ALL SELECT 'V-PR-07', 'warning', note_id, key FROM f WHERE key = 'summary' AND length(value) > {MOST_SUMMARY}
"""
_most = "CASE note_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SUMMARY_WORDS.items()) + " ELSE 60 END"
# A line belongs to the last heading of level two before it; a heading of level three ends a summary but not its section.
TEXTS["val_lengths"] = f"""
WITH l AS (SELECT note_id, note_type, ord, line, $matches(line, r'^##[ \\t]+[^ \\t]') AS h2, $matches(line, r'^###[ \\t]') AS h3 FROM {{note_lines}}),
s AS (SELECT note_id, note_type, ord, line, h2, h3, sum(CASE WHEN h2 THEN 1 ELSE 0 END) OVER w AS section, max(CASE WHEN h2 THEN ord END) OVER w AS opened, max(CASE WHEN h3 THEN ord END) OVER w AS deeper FROM l WINDOW w AS (PARTITION BY note_id ORDER BY ord)),
t AS (SELECT note_id, note_type, section, max(CASE WHEN h2 THEN trim($extract(line, r'^##[ \\t]+(.+)$', 1)) END) AS title, max(opened) AS opened, sum(CASE WHEN h2 THEN 0 WHEN h3 THEN 50 ELSE length(line) END) AS body,
             sum(CASE WHEN h2 OR h3 OR coalesce(deeper, -1000000) > opened THEN 0 ELSE $count_matches(line, r'[^ \\t]+') END) AS words
      FROM s WHERE section > 0 GROUP BY note_id, note_type, section),
u AS (SELECT note_id, note_type, sum(words) AS words FROM t WHERE lower(title) IN ('tl;dr', 'tldr') GROUP BY note_id, note_type),
n AS (SELECT note_id, note_type, count(*) AS n FROM {{note_lines}} WHERE $matches(line, r'[^ \\t]') GROUP BY note_id, note_type)
SELECT CASE note_type WHEN 'chapter-digest' THEN 'V-LEN-05' ELSE 'V-LEN-01' END AS rule_id, 'warning' AS severity, note_id, '## TL;DR' AS node FROM u WHERE words > {_most}
""" + "".join(f"UNION ALL SELECT '{rule}', '{severity}', note_id, '<root>' FROM n WHERE note_type = '{kind}' AND n > {most}\n" for kind, (rule, severity, most) in NOTE_LINES.items()) + """UNION ALL SELECT 'V-LEN-06', 'warning', note_id, 'line ' || $text(opened) FROM t WHERE body < 30
"""
# Lines with a bar at both ends stand in runs. The table of a run begins at its first separator that has an odd number of other
# lines before it in the run, and the last of those is the header: a line that no separator follows is no header.
TEXTS["val_tables"] = """
WITH l AS (SELECT note_id, ord, $matches(line, r'^[ \\t]*[|].+[|][ \\t]*$') AS barred, $matches(line, r'^[ \\t]*[|]?[ \\t]*:?-+:?[ \\t]*(?:[|][ \\t]*:?-+:?[ \\t]*)+[|]?[ \\t]*$') AS rule,
             $extract(line, r'^[ \\t]*[|](.+)[|][ \\t]*$', 1) AS inner_part FROM {note_lines}),
g AS (SELECT note_id, ord, rule, inner_part, barred, sum(CASE WHEN barred THEN 0 ELSE 1 END) OVER (PARTITION BY note_id ORDER BY ord) AS island FROM l),
o AS (SELECT note_id, island, ord, rule, inner_part, sum(CASE WHEN rule THEN 0 ELSE 1 END) OVER w AS others, max(CASE WHEN rule THEN NULL ELSE ord END) OVER w AS above FROM g WHERE barred WINDOW w AS (PARTITION BY note_id, island ORDER BY ord)),
a AS (SELECT note_id, island, $min_by(above, ord) AS header FROM o WHERE rule AND others % 2 = 1 GROUP BY note_id, island),
r AS (SELECT o.note_id, a.header, o.ord, $split(o.inner_part, r'[|]') AS cells, row_number() OVER (PARTITION BY o.note_id, a.header ORDER BY o.ord) AS k FROM o JOIN a ON a.note_id = o.note_id AND a.island = o.island WHERE NOT o.rule AND o.ord >= a.header),
t AS (SELECT note_id, header, count(*) AS n, min($size(cells)) AS narrow, max($size(cells)) AS wide FROM r GROUP BY note_id, header)
SELECT 'V-TBL-02' AS rule_id, 'warning' AS severity, note_id, 'line ' || $text(header) AS node FROM t WHERE n < 2
UNION ALL SELECT 'V-TBL-04', 'error', note_id, 'line ' || $text(header) FROM t WHERE n >= 2 AND narrow < wide
UNION ALL SELECT 'V-TBL-03', 'warning', note_id, 'line ' || $text(header) || ' row ' || $text(k) || ' column ' || $text(i)
  FROM (SELECT note_id, header, k, i, $at(cells, i) AS cell FROM (SELECT r.note_id, r.header, r.k, r.cells, $explode($range($long(1), $size(r.cells))) AS i FROM r JOIN t ON t.note_id = r.note_id AND t.header = r.header WHERE r.k > 1 AND t.narrow = t.wide)) WHERE trim(cell) = ''
"""
# A figure lasts from the last opening line to the next closing one.
TEXTS["val_images"] = f"""
WITH m AS (SELECT note_id, ord, $explode($all_matches(line, r'!\\[[^\\]]*\\]\\([^)]+\\)')) AS mark FROM {{note_lines}}),
i AS (SELECT note_id, ord, trim($extract(mark, r'^!\\[([^\\]]*)\\]', 1)) AS alt, trim($extract(mark, r'\\(([^)]+)\\)$', 1)) AS path FROM m),
d AS (SELECT i.note_id, i.ord, i.path, x.path AS found, x.bytes FROM i LEFT JOIN {{note_assets}} x ON x.path = i.path WHERE NOT $matches(i.path, r'^(?:https?://|data:)')),
l AS (SELECT note_id, ord, line, trim(line) = ':::figure' AS opens, trim(line) = ':::' AS closes FROM {{note_lines}}),
g AS (SELECT note_id, ord, line, opens, closes, sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY note_id ORDER BY ord) - CASE WHEN closes THEN 1 ELSE 0 END AS part FROM l),
o AS (SELECT note_id, part, max(CASE WHEN opens THEN ord END) AS opened FROM g GROUP BY note_id, part HAVING bool_or(opens) AND bool_or(closes)),
f AS (SELECT g.note_id, o.opened, bool_or($matches(g.line, r'!\\[[^\\]]*\\]\\([^)]+\\)')) AS pictured, bool_or($matches(trim(g.line), r'^[A-Z].{{5,80}}$')) AS captioned FROM g JOIN o ON o.note_id = g.note_id AND o.part = g.part WHERE g.ord >= o.opened GROUP BY g.note_id, o.opened)
SELECT 'V-IMG-01' AS rule_id, 'error' AS severity, note_id, 'line ' || $text(ord) AS node FROM i WHERE alt = ''
UNION ALL SELECT 'V-IMG-02', 'error', note_id, 'line ' || $text(ord) FROM d WHERE found IS NULL
UNION ALL SELECT 'V-IMG-03', 'warning', note_id, 'line ' || $text(ord) FROM d WHERE bytes > {MOST_BYTES}
UNION ALL SELECT 'V-IMG-04', 'warning', note_id, 'line ' || $text(ord) FROM d WHERE found IS NOT NULL AND lower($extract(path, r'([.][^./]*)$', 1)) NOT IN {_in(IMAGE_FORMATS)}
UNION ALL SELECT 'V-IMG-05', 'warning', note_id, 'line ' || $text(opened) FROM f WHERE NOT pictured
UNION ALL SELECT 'V-IMG-05', 'info', note_id, 'line ' || $text(opened) FROM f WHERE NOT captioned
"""
TEXTS["val_sdm"] = f"""
WITH b AS (SELECT note_id, node, block_id, section_path, page, source_hash, origin, confidence, type FROM {{stored_blocks}}),
twice AS (SELECT block_id, min(note_id || ' ' || node) AS first FROM b WHERE block_id <> '' GROUP BY block_id HAVING count(*) > 1)
SELECT 'V-SDM-01' AS rule_id, 'error' AS severity, note_id, node FROM b WHERE block_id <> '' AND NOT $matches(block_id, r'^[0-9a-f]{{12}}$')
UNION ALL SELECT 'V-SDM-02', 'error', note_id, node FROM b WHERE page IS NULL AND coalesce(section_path, '') = ''
UNION ALL SELECT 'V-SDM-03', 'error', b.note_id, b.node FROM b JOIN twice t ON t.block_id = b.block_id WHERE b.note_id || ' ' || b.node <> t.first
UNION ALL SELECT 'V-SDM-04', 'warning', note_id, node FROM b WHERE coalesce(origin, '') = ''
UNION ALL SELECT 'V-SDM-05', 'warning', note_id, node FROM b WHERE origin = 'ocr' AND confidence IS NULL
UNION ALL SELECT 'V-SDM-06', 'error', note_id, node FROM b WHERE type <> '' AND type NOT IN {_in(BLOCK_TYPES)}
UNION ALL SELECT DISTINCT 'V-SDM-07', 'error', note_id, 'source.hash' FROM b WHERE source_hash <> '' AND NOT $matches(source_hash, r'^[0-9a-f]{{64}}$')
"""
# The words before the k-th link of a line are those of the parts up to it and those inside the links before it.
_LINK, _WORD = r"\[\[note:[a-zA-Z0-9_-]+\]\]", r"[\pL\pN_]+"
INTRO_WORDS = 5
TEXTS["val_links"] = f"""
WITH l AS (SELECT note_id, ord, $split(line, r'{_LINK}') AS parts, $all_matches(line, r'{_LINK}') AS marks FROM {{note_lines}} WHERE $matches(line, r'{_LINK}')),
m AS (SELECT note_id, ord, k, $at(parts, k) AS part, $at(marks, k) AS mark FROM (SELECT note_id, ord, parts, marks, $explode($range($long(1), $size(marks))) AS k FROM l)),
p AS (SELECT note_id, ord, $extract(mark, r'note:([a-zA-Z0-9_-]+)', 1) AS target,
             sum($count_matches(part, r'{_WORD}') + $count_matches(mark, r'{_WORD}')) OVER (PARTITION BY note_id, ord ORDER BY k) - $count_matches(mark, r'{_WORD}') AS words FROM m),
e AS (SELECT DISTINCT note_id, target FROM p), i AS (SELECT DISTINCT note_id FROM {{note_lines}})
SELECT 'V-LK-01' AS rule_id, 'error' AS severity, p.note_id, p.target AS node FROM p LEFT JOIN i ON i.note_id = p.target WHERE i.note_id IS NULL
UNION ALL SELECT 'V-LK-02', 'warning', note_id, 'line ' || $text(ord) FROM p WHERE words < {INTRO_WORDS}
UNION ALL SELECT 'V-LK-03', 'info', e.note_id, e.target FROM e JOIN i ON i.note_id = e.target LEFT JOIN e r ON r.note_id = e.target AND r.target = e.note_id WHERE r.note_id IS NULL
UNION ALL SELECT 'V-LK-04', 'warning', a.note_id, a.note_id FROM e a JOIN e b ON b.note_id = a.target AND b.target = a.note_id
"""
# A text of over 20 characters is looked for by its first 30; a note is reported once a destination.
TEXTS["val_destinations"] = """
WITH r AS (SELECT x.note_id, x.dest, x.text FROM {renders} x JOIN {destinations} d ON d.dest = x.dest)
SELECT 'V-DST-00' AS rule_id, 'info' AS severity, n.note_id, d.dest AS node FROM {notes} n CROSS JOIN {destinations} d LEFT JOIN r ON r.note_id = n.note_id AND r.dest = d.dest WHERE r.note_id IS NULL
UNION ALL SELECT DISTINCT 'V-DST-01', 'error', r.note_id, r.dest FROM r JOIN {nodes} n ON n.note_id = r.note_id WHERE length(n.text) > 20 AND position(substr(n.text, 1, 30) IN r.text) = 0
UNION ALL SELECT 'V-DST-02', 'warning', g.note_id, g.dest FROM {degradations} g JOIN r ON r.note_id = g.note_id AND r.dest = g.dest WHERE NOT g.content_intact
UNION ALL SELECT 'V-DST-04', 'warning', '', '' FROM (SELECT count(*) AS n FROM {notes}) t WHERE n = 0
UNION ALL SELECT 'V-DST-05', 'warning', '', '' FROM (SELECT count(*) AS n, count(r.note_id) AS done FROM {notes} x LEFT JOIN r ON r.note_id = x.note_id) t WHERE n > 0 AND done = 0
"""
DOCS = {
    "val_links": "Broken, unintroduced, one-way and mutual links, V-LK-01 to V-LK-04.",
    "val_destinations": "Notes not rendered, lost texts and undocumented degradations, V-DST-00 to V-DST-05.",
    "val_notemark": "Header, directives, source, term, note and layer marks, and placeholders, V-NM-01 to V-NM-09.",
    "val_properties": "Header keys, enumerations and required values, V-PR-01 to V-PR-07.",
    "val_lengths": "Words of the summary, lines of a note and empty sections, V-LEN-01 to V-LEN-06.",
    "val_tables": "Rows, columns and empty cells of tables, V-TBL-02 to V-TBL-04.",
    "val_images": "Alternative texts, paths, sizes, formats and figures, V-IMG-01 to V-IMG-05.",
    "val_sdm": "Ids, anchors, origins, types and hashes of stored blocks, V-SDM-01 to V-SDM-07; a table's types rule out V-SDM-08 to V-SDM-10.",
}
for _name, _text in TEXTS.items():
    if _name != "val_notemark":
        operator(_name, _text, DOCS[_name])


@program("val_notemark", duck_sql(TEXTS["val_notemark"]), first={"blocks": "dealt_blocks"}, note_fields="note_fields", note_lines="note_lines")
def val_notemark(note_fields: DataFrame, note_lines: DataFrame) -> DataFrame:
    fields, lines = written(note_fields.select("note_id", "key"), "fields"), written(note_lines.select("note_id", "ord", "line"), "lines")
    return run_sql(lines.sparkSession, TEXTS["val_notemark"], {"note_fields": fields, "note_lines": lines})


val_notemark.__doc__ = DOCS["val_notemark"]
