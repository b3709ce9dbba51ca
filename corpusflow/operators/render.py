"""Render operators: note nodes to text by templates."""

from __future__ import annotations

from corpusflow.plans.catalog import operator

operator("rnd_other_dest", """
WITH t AS (SELECT 'html' AS dest, 'heading' AS node, '<h2>' AS before, '</h2>' AS after UNION ALL SELECT 'html', 'paragraph', '<p>', '</p>' UNION ALL SELECT 'html', 'bullet', '<li>', '</li>' UNION ALL SELECT 'html', 'callout', '<aside>', '</aside>'
           UNION ALL SELECT 'obsidian', 'heading', '## ', '' UNION ALL SELECT 'obsidian', 'paragraph', '', '' UNION ALL SELECT 'obsidian', 'bullet', '- ', '' UNION ALL SELECT 'obsidian', 'callout', '> [!note] ', '')
SELECT n.note_id, t.dest, $texts(t.before || n.text || t.after, n.ord, $chr(10)) AS body FROM {nodes} n JOIN t ON n.node = t.node GROUP BY n.note_id, t.dest
""", "Other destinations by a table of templates.")
operator("snk_notes_7dest", "SELECT d.dest, $long(count(DISTINCT n.note_id)) AS notes, $long(sum(length(n.text))) AS chars FROM {nodes} n CROSS JOIN {destinations} d GROUP BY d.dest", "Output size by destination.")
operator("rnd_degrade", "SELECT n.note_id, n.path, d.dest, n.capability, n.capability IN ('tables', 'text', 'callouts') AS content_intact FROM {nodes} n CROSS JOIN {destinations} d LEFT JOIN {support} s ON s.dest = d.dest AND s.capability = n.capability WHERE s.dest IS NULL", "Degradations: capabilities that a destination lacks.")
operator("rnd_flashcards", "SELECT note_id, path, text AS front, $size($split(text, r'[,;.]')) AS clauses, CASE WHEN node = 'paragraph' THEN 'prose refused' WHEN $size($split(text, r'[,;.]')) > 6 THEN 'too many clauses' END AS refused FROM {nodes} WHERE node IN ('bullet', 'paragraph')", "Cards from atomic nodes; prose and long answers are refused.")
operator("rnd_toc_backlinks", "SELECT h.note_id, h.toc, b.sources FROM (SELECT note_id, $texts('- ' || text, ord, $chr(10)) AS toc FROM {nodes} WHERE node = 'heading' GROUP BY note_id) h LEFT JOIN (SELECT dst, $join($set(src), ',') AS sources FROM {note_links} WHERE src <> dst GROUP BY dst) b ON b.dst = h.note_id", "Headings of a note and who links to it.")
operator("rnd_figures", """
WITH p AS (SELECT case_id, metric, $long(sum(n)) AS n FROM {runs} GROUP BY case_id, metric),
s AS (SELECT case_id, metric, n, max(n) OVER (PARTITION BY case_id) AS top, $long(row_number() OVER (PARTITION BY case_id ORDER BY metric)) - 1 AS k FROM p)
SELECT case_id, '<svg xmlns="http://www.w3.org/2000/svg">' || $texts('<rect x="' || $text(k * 30) || '" y="' || $text(100 - $div(n * 100, top)) || '" width="20" height="' || $text($div(n * 100, top)) || '"/>', k, '') || '</svg>' AS svg
FROM s GROUP BY case_id
""", "Bar chart of a case as SVG text, scaled by its largest value.")
operator("snk_html_review", """
SELECT section_path, '<ul>' || $texts('<li id="' || block_id || '">' || replace(replace(content, '&', '&amp;'), '<', '&lt;') || '</li>', block_index, '') || '</ul>' AS html, $long(count(*)) AS n
FROM {blocks} WHERE confidence < 0.3 GROUP BY section_path
""", "Low-confidence blocks of a section as an HTML list.")
