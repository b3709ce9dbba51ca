"""Engine tables from the driver's tables; every rule is deterministic.

blocks: one section per document, one block per non-blank line. units: one information unit per block. Word boxes,
section numbers and regions come from order lines, graphs from trade between nations, segments from conversations.
"""

from __future__ import annotations

from corpusflow.plans.catalog import table

#: Types of information units and block types, in their fixed order.
UNIT_TYPES = ("definition", "procedure", "parameter", "default", "warning", "error-code", "formula", "example", "comparison", "constraint", "cross-reference", "version-note", "figure", "claim")

table(
    "lines",
    """
SELECT doc_id, lang, source, pos - 1 AS pos, $at(ls, pos) AS line
FROM (SELECT doc_id, lang, source, ls, $explode($range($long(1), $size(ls))) AS pos
      FROM (SELECT doc_id, lang, source, $split(coalesce(text, ''), r'\\n') AS ls FROM {documents}))
""",
)
_BLOCKS = """
WITH kept AS (
  SELECT doc_id, lang, source, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block_index
  FROM {lines} WHERE $matches(line, r'[^\\x20\\x09-\\x0D]')
), often AS (SELECT line FROM {lines} WHERE $matches(line, r'[^\\x20\\x09-\\x0D]') GROUP BY line HAVING count(DISTINCT doc_id) >= 3)
SELECT substr($sha1($sha256(source) || '/doc-' || $text(doc_id) || $text($long(block_index))), 1, 12) AS block_id,
       doc_id, '/doc-' || $text(doc_id) AS section_path, $long(block_index) AS block_index,
       $sha256(source) AS source_hash, source, lang, kept.line AS content,
       CASE WHEN often.line IS NOT NULL THEN 'boilerplate' WHEN $count_matches(kept.line, r'[^\\x20\\x09-\\x0D]+') <= 3 THEN 'heading' ELSE 'paragraph' END AS type,
       $count_matches(kept.line, r'[^\\x20\\x09-\\x0D]+') AS n_words,
       $div($long(block_index), 10) + 1 AS page,
       $double((block_index * 37 + doc_id * 13) % 100) / 100 AS confidence,
       CASE (block_index + doc_id) % 5 WHEN 0 THEN 'ocr' WHEN 1 THEN 'reconstructed' ELSE 'native' END AS origin
FROM kept LEFT JOIN often ON kept.line = often.line
"""
table("blocks", _BLOCKS)
_said = r"split(coalesce(text, ''), r'\n', -1)"
# Blocks for programs that need all their columns: a line is often or not wherever it stands, so digests tell what the texts would: the digests of a document's often lines come to the document, and the texts
# are dealt once, by document. Missing ids share the place of id -1, where a digest too many does no harm.
# Catalyst can't leave out the types here, so what needs none reads `blocks`.
_columns = _BLOCKS[_BLOCKS.index("SELECT substr") : _BLOCKS.index("FROM kept")].replace("often.line IS NOT NULL", "often")
table(
    "dealt_blocks",
    f"""
WITH said AS (SELECT coalesce(doc_id, -1) AS k, doc_id, unhex(sha1(line)) AS h FROM (SELECT doc_id, explode({_said}) AS line FROM {{documents}}) WHERE $matches(line, r'[^\\x20\\x09-\\x0D]')),
often AS (SELECT h FROM said GROUP BY h HAVING count(DISTINCT doc_id) >= 3),
flags AS (SELECT k, collect_set(said.h) AS hs FROM said JOIN often ON said.h = often.h GROUP BY k),
cut AS (SELECT d.k, doc_id, lang, source, posexplode(transform({_said}, l -> struct(l AS line, coalesce(array_contains(hs, unhex(sha1(l))), false) AS often))) AS (pos, said)
        FROM (SELECT coalesce(doc_id, -1) AS k, doc_id, lang, source, text FROM {{documents}}) d LEFT JOIN flags ON d.k = flags.k),
kept AS (SELECT doc_id, lang, source, said.line, said.often, row_number() OVER (PARTITION BY k, doc_id ORDER BY pos) - 1 AS block_index FROM cut WHERE $matches(said.line, r'[^\\x20\\x09-\\x0D]'))
{_columns}FROM kept
""",
)
_types = "CASE (b.block_index % 14) " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(UNIT_TYPES)) + " END"
table(
    "units",
    f"""
SELECT substr($sha1('u' || b.block_id), 1, 12) AS unit_id,
       CASE WHEN b.doc_id % 17 = 0 THEN substr($sha1('x' || b.block_id), 1, 12) ELSE b.block_id END AS block_id,
       b.doc_id, b.section_path, b.source_hash, b.block_index, {_types} AS type,
       (b.block_index % 3 = 0) AS numbered,
       CASE WHEN b.block_index % 14 IN (2, 3, 4, 5) OR (b.block_index % 14 = 6 AND b.block_index % 3 = 0) THEN 'must-keep' ELSE 'context' END AS criticality,
       CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'discarded' WHEN l.quality = 1 THEN 'written' ELSE 'merged' END AS state,
       CASE WHEN l.toxic = 1 THEN CASE b.block_index % 4 WHEN 0 THEN 'boilerplate' WHEN 1 THEN 'redundant-with:' || substr($sha1('u' || b.block_id), 1, 12) WHEN 2 THEN 'out-of-scope' ELSE 'no-reason' END END AS discard_reason,
       CASE WHEN l.quality = 1 THEN 'note-' || $text(b.doc_id % 50) END AS target_note,
       b.content, b.n_words, lower($extract(b.content, r'([A-Za-z]+)', 1)) AS term
FROM {{blocks}} b LEFT JOIN {{labels}} l ON b.doc_id = l.doc_id
""",
)
table("old_blocks", "SELECT * FROM {blocks} WHERE doc_id % 10 <> 0")
table("new_blocks", "SELECT block_id, doc_id, section_path, block_index, source_hash, source, lang, CASE WHEN doc_id % 10 = 2 THEN content || '!' ELSE content END AS content, type, n_words, page, confidence, origin FROM {blocks} WHERE doc_id % 10 <> 1")
table("notes", "SELECT 'note-' || $text(doc_id) AS note_id, 'note-' || $text(doc_id % 7) AS family, substr(min(content), 1, 40) AS title, CASE doc_id % 4 WHEN 0 THEN 'concept' WHEN 1 THEN 'procedure' WHEN 2 THEN 'reference' ELSE 'error-log' END AS note_type, doc_id, source AS domain, $long(sum(n_words)) AS n_words, $long(count(*)) AS n_blocks, $div($long(sum(n_words)), 200) + 1 AS minutes, $sha256(lower(min(content)) || $text(doc_id)) AS ir_hash FROM {blocks} GROUP BY doc_id, source")
# The similarity of this fixture is that of the sizes; `sequences.decided_pairs` computes the one of the texts.
table("note_pairs", "SELECT a.note_id AS a, b.note_id AS b, lower(a.title) = lower(b.title) AS canonical, a.family = b.family AND a.domain = b.domain AS alias, $double(least(a.n_words, b.n_words)) / greatest(a.n_words, b.n_words) AS sim FROM {notes} a JOIN {notes} b ON a.note_type = b.note_type AND substr(lower(a.title), 1, 12) = substr(lower(b.title), 1, 12) AND a.note_id < b.note_id")
table(
    "nodes",
    """
SELECT 'note-' || $text(doc_id) AS note_id, 'blocks[' || $text(block_index) || ']' AS path, 'blocks' AS parent_path, block_index AS ord,
       CASE type WHEN 'heading' THEN 'heading' WHEN 'boilerplate' THEN 'callout' ELSE CASE WHEN block_index % 24 BETWEEN 4 AND 10 THEN 'bullet' WHEN block_index % 24 BETWEEN 14 AND 18 THEN 'callout' ELSE 'paragraph' END END AS node,
       content AS text, n_words, CASE WHEN doc_id % 11 = 0 AND block_index % 2 = 0 THEN NULL ELSE block_id END AS block_ref,
       (doc_id % 13 = 0 AND block_index % 3 = 0) AS derived, (doc_id % 19 = 0) AS external,
       CASE block_index % 5 WHEN 0 THEN 'callouts' WHEN 1 THEN 'tables' WHEN 2 THEN 'math' WHEN 3 THEN 'footnotes' ELSE 'text' END AS capability, section_path
FROM {blocks}
""",
)
table("destinations", "SELECT 'obsidian' AS dest UNION ALL SELECT 'notion' UNION ALL SELECT 'appflowy' UNION ALL SELECT 'markdown' UNION ALL SELECT 'html'")
table("support", "SELECT 'obsidian' AS dest, 'callouts' AS capability UNION ALL SELECT 'obsidian', 'tables' UNION ALL SELECT 'obsidian', 'math' UNION ALL SELECT 'obsidian', 'footnotes' UNION ALL SELECT 'obsidian', 'text' UNION ALL SELECT 'notion', 'callouts' UNION ALL SELECT 'notion', 'tables' UNION ALL SELECT 'notion', 'math' UNION ALL SELECT 'notion', 'text' UNION ALL SELECT 'appflowy', 'tables' UNION ALL SELECT 'appflowy', 'text' UNION ALL SELECT 'markdown', 'tables' UNION ALL SELECT 'markdown', 'footnotes' UNION ALL SELECT 'markdown', 'text' UNION ALL SELECT 'html', 'callouts' UNION ALL SELECT 'html', 'tables' UNION ALL SELECT 'html', 'text'")
table("manifest", "SELECT note_id, dest AS destination, CASE WHEN doc_id % 3 = 0 THEN $sha256('old' || ir_hash) ELSE ir_hash END AS source_hash, (doc_id % 7 = 0) AS edited, (doc_id % 8) AS seq FROM {notes} CROSS JOIN {destinations} WHERE doc_id % 5 <> 0")
table(
    "links",
    """
SELECT page_id, url, page_path, pos, href, $replace_all(href, r'[?#].*$', '') AS target_path
FROM (SELECT page_id, url, page_path, pos, $at(hrefs, pos) AS href
      FROM (SELECT page_id, url, page_path, hrefs, $explode($range($long(1), $size(hrefs))) AS pos
            FROM (SELECT page_id, url, $replace_all($replace_all(url, r'^https?://[^/]*', ''), r'[?#].*$', '') AS page_path, $groups(html, r'href="([^"]*)"', 1) AS hrefs FROM {pages})
            WHERE $size(hrefs) >= 1))
""",
)
table("note_links", "SELECT 'note-' || $text(doc_id) AS src, 'note-' || $text((doc_id * 7 + 3) % 211) AS dst, $long(doc_id % 3) AS kind FROM {documents} UNION ALL SELECT 'note-' || $text(doc_id), 'note-' || $text(doc_id + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END), 1 FROM {documents} WHERE doc_id % 5 < 2")
table("segments", "SELECT conv_id, turn, role, text, words, $double(coalesce(sum(words) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / 2.5 + turn * (conv_id % 4) AS start_s, $double(sum(words) OVER (PARTITION BY conv_id ORDER BY turn)) / 2.5 + turn * (conv_id % 4) AS end_s FROM (SELECT conv_id, turn, role, text, $count_matches(coalesce(text, ''), r'[^\\x20\\x09-\\x0D]+') AS words FROM {conversations})")
table(
    "boxes",
    """
SELECT l_orderkey AS page, $long(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)) AS word_id,
       $long(l_linenumber % 3) * 260 + (l_partkey % 7) * 20 AS x, l_partkey % 700 AS y, 20 + (l_suppkey % 5) * 18 AS w, $long(8 + l_linenumber) AS h,
       $double(8 + $long(l_quantity) % 7) AS font_size, 'w' || $text(l_partkey) AS text, (l_suppkey % 3 = 0) AS mono, $double(50 + l_partkey % 50) / 100 AS conf
FROM {lineitem}
""",
)
table("regions", "SELECT page, $long(row_number() OVER (PARTITION BY page ORDER BY x, y, word_id)) AS region_id, x - 5 AS x, y - 5 AS y, w + 140 AS w, h + 60 AS h, x AS col_x, CASE (x + y) % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'code' WHEN 2 THEN 'formula' WHEN 3 THEN 'caption' ELSE 'paragraph' END AS cls, conf, text, CASE WHEN x >= 520 THEN 2 WHEN x >= 260 THEN 1 ELSE 0 END AS col FROM {boxes}")
table("numbering", "SELECT l_orderkey AS chapter, $long(l_linenumber) AS section, l_partkey AS page FROM {lineitem}")
table("triage", "SELECT doc_id, $long(pos + 1) AS page, $long(length(line)) * 8 AS chars, $count_matches(line, r'[A-Z]') AS fonts, $double((pos * 31 + doc_id) % 100) / 100 AS image_rate, $double($count_matches(line, r'[#*%&|]')) / greatest(length(line), 1) AS nonprint, $long(length(line)) % 3 AS images FROM {lines}")
table("fragments", "SELECT b.doc_id, b.page, b.block_index, b.content AS text, CASE b.type WHEN 'heading' THEN 14.0E0 + (b.block_index % 3) * 2 WHEN 'boilerplate' THEN 8.0E0 ELSE 10.0E0 END AS font_size, CASE WHEN b.block_index % 4 = 0 THEN 'Serif-Bold' ELSE 'Serif' END AS font_name, 700 - (b.block_index % 10) * 70 AS y, b.type FROM {blocks} b")
table("concepts", "SELECT DISTINCT domain, term AS concept, doc_id FROM (SELECT u.source_hash AS domain, u.term, min(u.doc_id) AS doc_id FROM {units} u WHERE u.type = 'definition' AND length(u.term) >= 4 GROUP BY u.source_hash, u.term)")
table("relations", "SELECT DISTINCT source_hash AS domain, term AS from_concept, lower($extract(content, r'[A-Za-z]+[^A-Za-z]+([A-Za-z]+)', 1)) AS to_concept, CASE WHEN block_index % 2 = 0 THEN 'prerequisite' ELSE 'related' END AS relation FROM {units} WHERE type IN ('cross-reference', 'definition') AND length(term) >= 4")
table("trade", "SELECT DISTINCT a, b FROM (SELECT $long(n_nationkey) AS a, $long((n_nationkey * 3 + 2) % 25) AS b FROM {nation} UNION ALL SELECT $long(n_nationkey), $long((n_nationkey + 7) % 25) FROM {nation} WHERE n_nationkey % 2 = 0 UNION ALL SELECT $long(s_nationkey), $long((s_nationkey * 5 + 1) % 25) FROM {supplier}) WHERE a <> b")
table("precedence", "SELECT a, b FROM {trade} WHERE a < b")
table("runs", "SELECT $long(extract(DAY FROM ts)) AS run, user_id % 6 AS case_id, event_type AS metric, avg(value) AS value, $long(count(*)) AS n FROM {events} GROUP BY extract(DAY FROM ts), user_id % 6, event_type")
table("glossary", "SELECT term AS canonical, CASE WHEN length(term) > 5 THEN substr(term, 1, 5) ELSE term || 's' END AS alias, $long(min(doc_id)) AS doc_id FROM {units} WHERE length(term) >= 4 AND block_index % 4 = 0 GROUP BY term")
table("error_log", "SELECT 'E' || $text(event_id) AS error_id, user_id % 7 AS domain, $date(ts) AS review_next, value, event_type AS kind, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'fix-' || $text(event_id % 50) END AS correction, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'note-' || $text(event_id % 200) END AS note_id FROM {events} WHERE event_type = 'error'")
table("work_items", "SELECT user_id AS book, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal, event_type, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'done' WHEN 'click' THEN 'in-progress' ELSE 'pending' END AS status, event_id % 4 AS attempts, ts FROM {events}")
table("cache_entries", "SELECT substr($sha256($text(event_id)), 1, 16) AS key, event_type AS step, 'engine-' || $text(user_id % 3) AS engine, $long(length(props)) AS bytes, user_id % 3 AS engine_version FROM {events}")
table("glossary_names", "SELECT canonical, alias AS name FROM {glossary} UNION SELECT canonical, canonical FROM {glossary}")
table(
    "issues",
    """
SELECT 'V-LED-02' AS rule_id, 'error' AS severity, 'discard reason not in the list' AS message, unit_id AS node FROM {units} WHERE state = 'discarded' AND NOT $matches(coalesce(discard_reason, ''), r'^(boilerplate|out-of-scope|redundant-with:[0-9a-f]{12})$')
UNION ALL SELECT 'V-LED-03', 'error', 'written unit without note', unit_id FROM {units} WHERE state = 'written' AND target_note IS NULL
UNION ALL SELECT 'V-LED-06', 'warning', 'unit without block', u.unit_id FROM {units} u LEFT JOIN (SELECT DISTINCT block_id FROM {blocks}) b ON u.block_id = b.block_id WHERE b.block_id IS NULL
UNION ALL SELECT 'V-SDM-06', 'warning', 'low confidence', block_id FROM {blocks} WHERE confidence < 0.1 AND origin = 'ocr'
UNION ALL SELECT 'V-LK-01', 'error', 'broken link', l.src FROM {note_links} l LEFT JOIN {notes} n ON l.dst = n.note_id WHERE n.note_id IS NULL
""",
)
# Notes in the note language: a header, and a body of the document's blocks with marks, directives, tables and figures between them; some are faulty.
_note_type = "CASE doc_id % 6 WHEN 0 THEN 'concept' WHEN 1 THEN 'cheatsheet' WHEN 2 THEN 'glossary-term' WHEN 3 THEN 'chapter-digest' WHEN 4 THEN 'index-moc' ELSE 'procedure' END"
table(
    "note_fields",
    f"""
WITH d AS (SELECT DISTINCT doc_id, source, 'note-' || $text(doc_id) AS note_id FROM {{blocks}} WHERE doc_id % 9 <> 4)
SELECT note_id, 'title' AS key, 'Note ' || $text(doc_id) AS value, false AS is_list FROM d WHERE doc_id % 5 <> 1
UNION ALL SELECT note_id, 'note-type', CASE WHEN doc_id % 14 = 3 THEN 'poem' ELSE {_note_type} END, false FROM d
UNION ALL SELECT note_id, 'status', CASE doc_id % 7 WHEN 0 THEN 'published' WHEN 1 THEN 'final' ELSE 'draft' END, false FROM d
UNION ALL SELECT note_id, 'summary', repeat('word ', $long(doc_id % 50)), false FROM d WHERE doc_id % 4 <> 0
UNION ALL SELECT note_id, 'reading-time-minutes', $text(doc_id % 8), false FROM d
UNION ALL SELECT note_id, 'tags', 'a', doc_id % 3 <> 0 FROM d
UNION ALL SELECT note_id, CASE WHEN doc_id % 10 = 0 THEN 'mood' ELSE 'source-type' END, CASE WHEN doc_id % 8 = 0 THEN 'rumour' ELSE 'book' END, false FROM d
""",
)
_at = lambda k, line, where: f"SELECT note_id, note_type, ord + {k}, {line} FROM b WHERE {where}"
table(
    "note_lines",
    "WITH b AS (SELECT 'note-' || $text(doc_id) AS note_id, " + _note_type + """ AS note_type, block_index * 8 + 2 AS ord, doc_id, block_index AS i, block_id, content, type FROM {blocks})
SELECT DISTINCT note_id, note_type, $long(1) AS ord, '## TL;DR' AS line FROM b
"""
    + "".join(
        f"UNION ALL {x}\n"
        for x in (
            _at(0, "CASE type WHEN 'heading' THEN CASE WHEN i % 2 = 0 THEN '## ' ELSE '### ' END || content WHEN 'boilerplate' THEN '- ' || content ELSE content || ' {src:blk_' || CASE WHEN doc_id % 12 = 5 THEN 'x' ELSE '' END || block_id || '}' END", "true"),
            _at(1, "CASE i % 3 WHEN 0 THEN ':::note' WHEN 1 THEN ':::figure' ELSE ':::' || CASE WHEN doc_id % 5 = 0 THEN 'aside' ELSE 'tip {fold=no}' END END", "i % 4 = 1"),
            _at(2, "'![' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'view' END || '](img/' || $text(doc_id % 20) || CASE WHEN i % 8 = 1 THEN '.png' ELSE '.bmp' END || ') and ![web](https://a.b/c.png)'", "i % 4 = 1 AND doc_id % 4 <> 3"),
            _at(3, "CASE WHEN doc_id % 2 = 0 THEN 'Caption of it.' ELSE 'none' END || CASE doc_id % 6 WHEN 0 THEN ' [[term:open' WHEN 1 THEN ' [[note:]] {{ }}' WHEN 2 THEN ' {layer:l4}' ELSE ' {layer:l1} [[term:x]]' END", "i % 4 = 1"),
            _at(4, "':::'", "i % 4 = 1 AND doc_id % 8 <> 6"),
            _at(6, "CASE WHEN i % 2 = 0 THEN '' ELSE 'See also what is said in' END || ' [[note:note-' || $text(doc_id + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) || ']] and [[note:note-' || $text(doc_id * 3) || ']]'", "i % 5 = 3"),
            _at(1, "'| a | b |'", "i % 4 = 2"),
            _at(2, "'|---|:-:|'", "i % 4 = 2 AND doc_id % 7 <> 0"),
            _at(3, "CASE doc_id % 5 WHEN 0 THEN '| x |  |' WHEN 1 THEN '| x |' ELSE '| x | y |' END", "i % 4 = 2 AND doc_id % 5 <> 2"),
            _at(5, "''", "i % 2 = 0"),
        )
    ),
)
table("note_assets", "SELECT DISTINCT 'img/' || $text(doc_id % 15) || '.png' AS path, (doc_id % 15) * 1000000 AS bytes FROM {documents} UNION ALL SELECT DISTINCT 'img/' || $text(doc_id % 10) || '.bmp', $long(1) FROM {documents}")
table(
    "stored_blocks",
    """
SELECT 'note-' || $text(doc_id) AS note_id, 'block ' || $text(block_index) AS node, CASE WHEN doc_id % 20 = 3 THEN 'blk' || $text(block_index) WHEN doc_id % 20 = 4 THEN 'abcdef012345' ELSE block_id END AS block_id,
       CASE WHEN doc_id % 20 IN (5, 6) THEN '' ELSE section_path END AS section_path, CASE WHEN doc_id % 20 = 5 THEN NULL ELSE page END AS page, CASE WHEN doc_id % 20 = 7 THEN 'none' ELSE source_hash END AS source_hash,
       CASE WHEN doc_id % 20 = 8 THEN NULL ELSE origin END AS origin, CASE WHEN doc_id % 20 = 9 THEN NULL ELSE confidence END AS confidence, CASE WHEN type <> 'paragraph' THEN type WHEN doc_id % 20 = 10 THEN 'paragraph' ELSE 'prose' END AS type
FROM {blocks}
""",
)
table(
    "note_blocks",
    f"""
SELECT 'note-' || $text(doc_id) AS note_id, {_note_type} AS note_type, $div(block_index, 12) AS section,
       CASE WHEN block_index < 12 THEN '## TL;DR' WHEN $div(block_index, 12) % 3 = 1 THEN '### Part ' || $text($div(block_index, 12)) WHEN doc_id % 5 = 0 THEN '## Errores registrados' ELSE '## Body ' || $text($div(block_index, 12)) END AS heading,
       $long(doc_id % 130) AS section_lines, block_index AS ord,
       CASE WHEN doc_id % 6 = 5 AND block_index >= 12 THEN 'list' WHEN type = 'heading' THEN 'table' WHEN type = 'boilerplate' THEN CASE doc_id % 9 WHEN 0 THEN 'collapsible' ELSE 'callout' END WHEN block_index % 12 BETWEEN 3 AND 7 THEN CASE doc_id % 2 WHEN 0 THEN 'list' ELSE 'callout' END ELSE 'paragraph' END AS kind,
       n_words, $div(n_words, 12) + 1 AS n_lines, $long(1 + doc_id % 3) AS items, block_index % 12 = 5 AS checklist,
       NOT (doc_id % 6 = 5 AND block_index >= 12) AND type IN ('heading', 'boilerplate') AND doc_id % 9 <> 0 AS anchor, n_words > 3 AS factual, doc_id % 4 <> 0 OR block_index % 2 = 0 AS has_src
FROM {{blocks}}
""",
)
table("renders", "SELECT m.note_id, m.destination AS dest, CASE WHEN m.destination = 'html' AND m.seq < 3 THEN substr(t.text, 1, 200) ELSE t.text END AS text FROM {manifest} m JOIN (SELECT note_id, $texts(text, ord, ' ') AS text FROM {nodes} GROUP BY note_id) t ON t.note_id = m.note_id")
table("degradations", "SELECT DISTINCT n.note_id, d.dest, n.capability, n.capability <> 'math' AS content_intact FROM {nodes} n CROSS JOIN {destinations} d LEFT JOIN {support} s ON s.dest = d.dest AND s.capability = n.capability WHERE s.dest IS NULL")
