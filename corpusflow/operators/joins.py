"""Join operators: equi, anti, full outer, spatial, nearest, next-match and reciprocal joins."""

from __future__ import annotations

from corpusflow.plans.catalog import operator

operator("join_region_table", """
WITH t AS (SELECT page, region_id, text AS headers FROM {regions} WHERE cls = 'table' AND region_id % 2 = 1),
f AS (SELECT page, $min_by(headers, region_id) AS headers FROM t GROUP BY page)
SELECT r.page, r.region_id, coalesce(t.headers, f.headers) AS headers, t.region_id IS NOT NULL AS own
FROM {regions} r LEFT JOIN t ON r.page = t.page AND r.region_id = t.region_id LEFT JOIN f ON r.page = f.page WHERE r.cls IN ('table', 'code', 'formula')
""", "Region with its table, else the first table of its page.")
operator("join_words_in_bbox", """
SELECT r.page, r.region_id, $long(count(*)) AS n_words, min(b.word_id) AS first_word
FROM {regions} r JOIN {boxes} b ON r.page = b.page AND b.x < r.x + r.w AND b.x + b.w > r.x AND b.y < r.y + r.h AND b.y + b.h > r.y
GROUP BY r.page, r.region_id
""", "Words whose box meets a region's box on the same page.")
operator("join_outline_prefix", """
WITH o AS (SELECT doc_id, page, substr(min(text), 1, 30) AS prefix FROM {fragments} WHERE type = 'heading' GROUP BY doc_id, page),
m AS (SELECT o.doc_id, o.page, o.prefix, f.block_index, row_number() OVER (PARTITION BY o.doc_id, o.page ORDER BY f.block_index) AS n
      FROM o JOIN {fragments} f ON o.doc_id = f.doc_id AND o.page = f.page AND $starts(f.text, o.prefix))
SELECT doc_id, page, prefix, block_index FROM m WHERE n = 1
""", "Outline entry to the first fragment on its page that begins with its title.")
operator("join_region_section", """
WITH own AS (SELECT doc_id, block_index, content AS title FROM {blocks} WHERE type = 'heading'),
page_first AS (SELECT doc_id, page, min(block_index) AS b FROM {blocks} WHERE type = 'heading' GROUP BY doc_id, page),
doc_first AS (SELECT doc_id, min(block_index) AS b FROM {blocks} WHERE type = 'heading' GROUP BY doc_id)
SELECT r.doc_id, r.block_index, coalesce(own.block_index, p.b, d.b) AS section, CASE WHEN own.block_index IS NOT NULL THEN 'text' WHEN p.b IS NOT NULL THEN 'page' WHEN d.b IS NOT NULL THEN 'first' ELSE 'none' END AS by_rule
FROM {blocks} r LEFT JOIN own ON r.doc_id = own.doc_id AND r.block_index = own.block_index
LEFT JOIN page_first p ON r.doc_id = p.doc_id AND r.page = p.page LEFT JOIN doc_first d ON r.doc_id = d.doc_id
""", "Section of a region by its text, else its page's first heading, else the document's.")
operator("join_caption_forward", """
SELECT doc_id, block_index, page, caption_index, CASE WHEN caption_page - page <= 1 THEN caption END AS caption
FROM (SELECT doc_id, block_index, page, type, content,
        min(CASE WHEN type = 'heading' THEN block_index END) OVER w AS caption_index,
        first_value(CASE WHEN type = 'heading' THEN content END) IGNORE NULLS OVER w AS caption,
        first_value(CASE WHEN type = 'heading' THEN page END) IGNORE NULLS OVER w AS caption_page
      FROM {blocks} WINDOW w AS (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
WHERE type = 'boilerplate'
""", "A figure's first caption after it in its section, at most one page on.", oracle="""
SELECT f.doc_id, f.block_index, f.page, c.block_index AS caption_index, CASE WHEN c.page - f.page <= 1 THEN c.content END AS caption
FROM blocks f LEFT JOIN LATERAL (SELECT * FROM blocks h WHERE h.doc_id = f.doc_id AND h.type = 'heading' AND h.block_index > f.block_index ORDER BY h.block_index LIMIT 1) c ON true
WHERE f.type = 'boilerplate'
""")
operator("join_nearest_neighbour", """
WITH body AS (SELECT page, min(font_size) AS small, max(font_size) AS large FROM {boxes} GROUP BY page),
c AS (SELECT s.page, s.word_id, n.word_id AS near, abs(s.x - n.x) + abs(s.y - n.y) AS dist, s.y - n.y AS dy,
        row_number() OVER (PARTITION BY s.page, s.word_id ORDER BY abs(s.x - n.x) + abs(s.y - n.y), n.word_id) AS k
      FROM {boxes} s JOIN body ON s.page = body.page AND s.font_size = body.small AND body.small < body.large
      JOIN {boxes} n ON n.page = s.page AND n.word_id <> s.word_id AND n.font_size > s.font_size AND abs(n.y - s.y) <= 200)
SELECT page, word_id, near, dist, CASE WHEN dy < 0 THEN 'superscript' WHEN dy > 0 THEN 'subscript' ELSE 'none' END AS script FROM c WHERE k = 1
""", "Small glyph to its nearest larger word in the same band.")
operator("join_nearest_column", """
WITH c AS (SELECT 0 AS col, 130 AS centre UNION ALL SELECT 1, 390 UNION ALL SELECT 2, 650),
d AS (SELECT b.page, b.word_id, c.col, row_number() OVER (PARTITION BY b.page, b.word_id ORDER BY abs(b.x + $div(b.w, 2) - c.centre), c.col) AS k FROM {boxes} b CROSS JOIN c)
SELECT page, word_id, $long(col) AS col FROM d WHERE k = 1
""", "Word to the column with the nearest centre; columns are a literal table of three rows.")
operator("join_orphans", "SELECT u.unit_id, u.block_id FROM {units} u LEFT ANTI JOIN {blocks} b ON u.block_id = b.block_id", "Units that name a block which is not there.", oracle="SELECT unit_id, block_id FROM units WHERE block_id NOT IN (SELECT block_id FROM blocks)")
operator("join_gaps", "SELECT b.block_id, b.section_path FROM {blocks} b LEFT ANTI JOIN {units} u ON u.block_id = b.block_id WHERE b.type <> 'boilerplate'", "Blocks that no unit names, boilerplate aside.", oracle="SELECT block_id, section_path FROM blocks WHERE type <> 'boilerplate' AND block_id NOT IN (SELECT block_id FROM units)")
operator("join_unused_blocks", "SELECT b.block_id FROM {blocks} b LEFT ANTI JOIN {nodes} n ON n.block_ref = b.block_id", "Blocks that no note refers to.", oracle="SELECT block_id FROM blocks WHERE block_id NOT IN (SELECT block_ref FROM nodes WHERE block_ref IS NOT NULL)")
operator("join_coverage", """
WITH u AS (SELECT DISTINCT block_id FROM {units})
SELECT b.section_path, $long(count(*)) AS n_blocks, $long(count(u.block_id)) AS n_covered, $double(count(u.block_id)) / count(*) AS ratio
FROM {blocks} b LEFT JOIN u ON b.block_id = u.block_id GROUP BY b.section_path
""", "Share of a section's blocks with a unit.")
operator("join_trace_forward", "SELECT n.note_id, n.path, b.block_id, b.section_path FROM {nodes} n JOIN {blocks} b ON n.block_ref = b.block_id", "Note node to its source blocks.")
operator("join_trace_back", "SELECT b.block_id, $long(count(n.path)) AS n_nodes, $texts(n.note_id || n.path, n.note_id || n.path, ',') AS nodes FROM {blocks} b LEFT JOIN {nodes} n ON n.block_ref = b.block_id GROUP BY b.block_id", "Block to the note nodes made from it.")
operator("join_full_outer_diff", """
SELECT coalesce(o.block_id, n.block_id) AS block_id,
       CASE WHEN o.block_id IS NULL THEN 'added' WHEN n.block_id IS NULL THEN 'removed' WHEN o.content = n.content AND o.type = n.type THEN 'unchanged' ELSE 'modified' END AS change
FROM {old_blocks} o FULL OUTER JOIN {new_blocks} n ON o.block_id = n.block_id
""", "Added, removed, modified and unchanged blocks of two versions.")
_diff = "SELECT coalesce(o.block_id, n.block_id) AS block_id, coalesce(o.section_path, n.section_path) AS section_path, CASE WHEN o.block_id IS NULL THEN 'added' WHEN n.block_id IS NULL THEN 'removed' WHEN o.content = n.content AND o.type = n.type THEN 'unchanged' ELSE 'modified' END AS change FROM {old_blocks} o FULL OUTER JOIN {new_blocks} n ON o.block_id = n.block_id"
operator("join_affected_notes", f"""
WITH d AS ({_diff})
SELECT n.note_id, $long(count(*)) AS n_refs, $long(count_if(d.change <> 'unchanged')) AS n_changed, count_if(d.change = 'removed') = count(*) AS obsolete
FROM {{nodes}} n JOIN d ON n.block_ref = d.block_id GROUP BY n.note_id HAVING count_if(d.change <> 'unchanged') > 0
""", "Notes whose sources changed; obsolete if all were removed.")
operator("join_self_pairs", """
SELECT a.note_id AS a, b.note_id AS b, a.note_type FROM {notes} a JOIN {notes} b ON a.note_type = b.note_type AND lower(a.title) = lower(b.title) AND a.note_id < b.note_id
""", "Unordered pairs of notes of one type, blocked by their normalised title.")
operator("join_alias_lookup", "SELECT u.unit_id, u.term, min(g.canonical) AS canonical FROM {units} u JOIN {glossary} g ON u.term = g.name GROUP BY u.unit_id, u.term", "Term or alias to its canonical name.", glossary="glossary_names")
operator("join_links", """
SELECT l.src, l.dst, CASE WHEN n.note_id IS NULL THEN 'missing' WHEN l.src = l.dst THEN 'self' ELSE 'resolved' END AS status
FROM {note_links} l LEFT JOIN {notes} n ON l.dst = n.note_id
""", "Links resolved, missing or to the note itself.")
operator("join_backlinks", "SELECT dst, $join($set(src), ',') AS sources, $long(count(DISTINCT src)) AS n FROM {note_links} WHERE src <> dst GROUP BY dst", "Distinct notes that link to a note.")
operator("join_reciprocal", """
WITH e AS (SELECT DISTINCT src, dst FROM {note_links} WHERE src <> dst)
SELECT a.src, a.dst, b.src IS NOT NULL AS mutual FROM e a LEFT JOIN e b ON a.src = b.dst AND a.dst = b.src
""", "One-way links and mutual pairs.")
operator("join_cross_dest", "SELECT n.note_id, d.dest FROM {notes} n CROSS JOIN {destinations} d", "Every note with every destination; destinations are a literal table of five rows.")
operator("join_publish_state", """
SELECT n.note_id, d.dest, CASE WHEN m.note_id IS NULL THEN 'created' WHEN m.edited THEN 'blocked' WHEN m.source_hash = n.ir_hash THEN 'skipped' ELSE 'updated' END AS action
FROM {notes} n CROSS JOIN {destinations} d LEFT JOIN {manifest} m ON m.note_id = n.note_id AND m.destination = d.dest
""", "What publishing a note to a destination would do.")
operator("join_tex_align", """
WITH e AS (SELECT doc_id, block_index AS eq, CASE WHEN block_index % 3 = 0 THEN block_index % 7 END AS number FROM {blocks} WHERE type = 'heading'),
r AS (SELECT doc_id, block_index AS region, CASE WHEN block_index % 4 = 0 THEN block_index % 7 END AS number FROM {blocks} WHERE type = 'paragraph'),
en AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY eq) AS k FROM e WHERE number IS NOT NULL),
rn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY region) AS k FROM r WHERE number IS NOT NULL),
numbered AS (SELECT en.doc_id, en.eq, rn.region FROM en JOIN rn ON en.doc_id = rn.doc_id AND en.number = rn.number AND en.k = 1 AND rn.k = 1),
eo AS (SELECT e.doc_id, e.eq, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.eq) AS k FROM e LEFT JOIN numbered n ON e.doc_id = n.doc_id AND e.eq = n.eq WHERE n.eq IS NULL),
ro AS (SELECT r.doc_id, r.region, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.region) AS k FROM r LEFT JOIN numbered n ON r.doc_id = n.doc_id AND r.region = n.region WHERE n.region IS NULL)
SELECT doc_id, eq, region, 'number' AS by_rule FROM numbered UNION ALL SELECT eo.doc_id, eo.eq, ro.region, 'order' FROM eo JOIN ro ON eo.doc_id = ro.doc_id AND eo.k = ro.k
""", "Equations to regions by number, the rest by order.")
operator("join_correction_propagate", """
WITH fix AS (SELECT block_id, content AS original, '[' || content || ']' AS fixed FROM {blocks} WHERE doc_id % 23 = 0 AND block_index = 0),
by_text AS (SELECT original, min(fixed) AS fixed FROM fix WHERE length(original) >= 5 GROUP BY original)
SELECT b.block_id, coalesce(f.fixed, t.fixed) AS fixed, CASE WHEN f.block_id IS NOT NULL THEN 'direct' ELSE 'propagated' END AS by_rule
FROM {blocks} b LEFT JOIN fix f ON b.block_id = f.block_id LEFT JOIN by_text t ON b.content = t.original WHERE coalesce(f.fixed, t.fixed) IS NOT NULL
""", "Human corrections by id, then to regions of the same text.")
operator("join_concept_note", "SELECT c.domain, c.concept, n.note_id FROM {concepts} c JOIN {notes} n ON c.doc_id = n.doc_id", "Concept to the note that defines it.")
operator("join_param_coverage", """
WITH names AS (SELECT DISTINCT term FROM {units} WHERE type = 'parameter' AND length(term) >= 4),
bag AS (SELECT DISTINCT lower(w) AS w FROM (SELECT $explode($all_matches(content, r'[A-Za-z]+')) AS w FROM {units} WHERE type = 'default'))
SELECT n.term, b.w IS NOT NULL AS covered FROM names n LEFT JOIN bag b ON n.term = b.w
""", "Parameter names that a bag of words covers.")
operator("join_next_page", """
SELECT doc_id, page, last_text, next_page, CASE WHEN $matches(last_text, r'-$') THEN 'hyphen' WHEN NOT $matches(last_text, r'[.!?]$') THEN 'continues' ELSE 'ends' END AS link
FROM (SELECT doc_id, page, last_text, lead(page) OVER (PARTITION BY doc_id ORDER BY page) AS next_page FROM (SELECT doc_id, page, $max_by(text, block_index) AS last_text FROM {fragments} GROUP BY doc_id, page)) WHERE next_page = page + 1
""", "Whether a page's last text goes on, on the next page.")
operator("join_declared_index", """
WITH declared AS (SELECT DISTINCT doc_id, page + 1 AS page FROM {blocks}), present AS (SELECT DISTINCT doc_id, page FROM {blocks})
SELECT coalesce(d.doc_id, p.doc_id) AS doc_id, coalesce(d.page, p.page) AS page, CASE WHEN p.page IS NULL THEN 'missing' ELSE 'extra' END AS what
FROM declared d FULL OUTER JOIN present p ON d.doc_id = p.doc_id AND d.page = p.page WHERE d.page IS NULL OR p.page IS NULL
""", "Declared pages that are missing, and pages not declared.")
operator("join_run_compare", """
SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.metric, b.metric) AS metric, a.n AS n_a, b.n AS n_b, NOT (coalesce(a.n, -1) = coalesce(b.n, -1)) AS flipped
FROM (SELECT * FROM {runs} WHERE run = 1) a FULL OUTER JOIN (SELECT * FROM {runs} WHERE run = 2) b ON a.case_id = b.case_id AND a.metric = b.metric
""", "Case metrics that differ between two runs.")
