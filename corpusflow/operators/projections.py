"""Projections, filters and classifications."""

from __future__ import annotations

from corpusflow.operators.windows import _class
from corpusflow.plans.catalog import operator

operator("prj_page_class", f"SELECT doc_id, page, {_class} AS cls FROM {{triage}}", "Four-way page class; the order of the rules matters.")
operator("prj_doc_class", f"""
WITH c AS (SELECT doc_id, {_class} AS cls FROM {{triage}}), s AS (SELECT doc_id, avg(CASE WHEN cls = 'readable' THEN 1.0E0 ELSE 0 END) AS r, avg(CASE WHEN cls = 'scanned' THEN 1.0E0 ELSE 0 END) AS s FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN r >= 0.8 THEN 'pdf_native' WHEN s >= 0.8 THEN 'pdf_scanned' ELSE 'pdf_hybrid' END AS cls FROM s
""", "Document class by the share of its page classes.")
operator("prj_heading_role", "SELECT doc_id, block_index, CASE WHEN font_size >= 14 OR (font_size > 10 AND $matches(font_name, r'Bold')) THEN 'heading' WHEN font_size < 9 THEN CASE WHEN $matches(text, r'^(?:Fig|Tab)') THEN 'caption' ELSE 'footnote' END ELSE 'body' END AS role FROM {fragments}", "Role of a fragment by size and style.")
operator("prj_must_keep", "SELECT unit_id, type, CASE WHEN type = 'parameter' THEN 'R1' WHEN type = 'default' THEN 'R2' WHEN type = 'error-code' THEN 'R3' WHEN type = 'warning' THEN 'R4' WHEN type = 'formula' AND numbered THEN 'R5' END AS rule FROM {units}", "Rules that make a unit must-keep.")
operator("prj_editorial_box", """
WITH rules AS (SELECT 1 AS priority, 'src0' AS vendor, '(?i)of' AS pattern, 'caution' AS box, 'high' AS severity UNION ALL SELECT 2, NULL, '(?i)^note', 'note', 'low' UNION ALL SELECT 3, NULL, '(?i)warn', 'warning', 'high' UNION ALL SELECT 4, NULL, '(?i)^th', 'tip', 'low'),
m AS (SELECT b.block_id, r.box, r.severity, row_number() OVER (PARTITION BY b.block_id ORDER BY r.priority) AS k FROM {blocks} b JOIN rules r ON (r.vendor = b.source OR (r.vendor IS NULL AND b.source <> 'src0')) AND $matches(b.content, r.pattern))
SELECT block_id, box, severity FROM m WHERE k = 1
""", "Editorial box by the vendor's rules first, else the general list; the rule table is a literal.")
operator("prj_unknown_convention", "SELECT block_id, source FROM {blocks} WHERE NOT $matches(content, r'^[A-Za-z]')", "Texts that no rule matches.")
operator("prj_region_signals", """
SELECT r.page, r.region_id, round(avg(CASE WHEN b.mono THEN 1.0E0 ELSE 0 END), 6) AS monospace, round(avg(CASE WHEN b.font_size >= 12 THEN 1.0E0 ELSE 0 END), 6) AS large, round(avg($double($count_matches(b.text, r'[^A-Za-z0-9]')) / length(b.text)), 6) AS symbols,
       max(CASE WHEN r.x > 200 THEN 1 ELSE 0 END) AS indent, $long(count(DISTINCT $div(b.y, 40))) AS rows_seen, $long(count(DISTINCT $div(b.x, 40))) AS cols_seen, round(max(CASE WHEN r.y < 60 THEN 1.0E0 ELSE 0 END), 6) AS top_band
FROM {regions} r JOIN {boxes} b ON r.page = b.page AND b.x < r.x + r.w AND b.x + b.w > r.x AND b.y < r.y + r.h AND b.y + b.h > r.y GROUP BY r.page, r.region_id
""", "Numeric signals of a region from its words.")
operator("prj_region_score", """
WITH s AS (SELECT page, region_id, 'mono' AS signal, CASE WHEN cls = 'code' THEN 1.0E0 ELSE 0.1E0 END AS value FROM {regions} UNION ALL SELECT page, region_id, 'grid', CASE WHEN cls = 'table' THEN 0.9E0 ELSE 0.2E0 END FROM {regions} UNION ALL SELECT page, region_id, 'conf', conf FROM {regions}),
w AS (SELECT 'code' AS cls, 'mono' AS signal, 0.8E0 AS weight UNION ALL SELECT 'table', 'grid', 0.8E0 UNION ALL SELECT 'prose', 'conf', 0.5E0 UNION ALL SELECT 'code', 'conf', 0.1E0 UNION ALL SELECT 'table', 'conf', 0.1E0),
t AS (SELECT s.page, s.region_id, w.cls, round(sum(s.value * w.weight), 6) AS score FROM s JOIN w ON s.signal = w.signal GROUP BY s.page, s.region_id, w.cls),
k AS (SELECT *, row_number() OVER (PARTITION BY page, region_id ORDER BY score DESC, cls) AS k, lead(score) OVER (PARTITION BY page, region_id ORDER BY score DESC, cls) AS second FROM t)
SELECT page, region_id, cls, score, score < 0.45 OR score - second < 0.10 AS ambiguous FROM k WHERE k = 1
""", "Class of a region by weighted signals; ambiguous if low or close.")
operator("prj_sdm_block", "SELECT page, region_id, CASE cls WHEN 'table' THEN 'table' WHEN 'code' THEN 'code' WHEN 'formula' THEN 'equation' WHEN 'caption' THEN 'caption' ELSE 'paragraph' END AS type, CASE WHEN conf >= 1 THEN 0.999999 ELSE conf END AS confidence FROM {regions} WHERE NOT (y > 680 AND cls = 'caption')", "Region to typed block; footers are dropped.")
operator("prj_confidence_threshold", """
WITH t AS (SELECT 'heading' AS type, 0.6E0 AS least, true AS critical UNION ALL SELECT 'paragraph', 0.3E0, true UNION ALL SELECT 'boilerplate', 0.1E0, false)
SELECT b.section_path, $long(count_if(b.confidence < t.least)) AS low, count_if(b.confidence < t.least AND t.critical) >= 3 AS blocked FROM {blocks} b JOIN t ON b.type = t.type GROUP BY b.section_path
""", "Low confidence by class threshold; three critical ones block a document.")
_lang = {"python": "(?:^|[^a-z])(?:in|is|as|the)(?:[^a-z]|$)", "sql": "(?:^|[^a-z])(?:of|on|de)(?:[^a-z]|$)", "shell": "(?:^|[^a-z])(?:to|la|y)(?:[^a-z]|$)"}
operator("prj_language", "SELECT block_id, CASE WHEN greatest(p, s, h) = 0 THEN 'unknown' WHEN p = greatest(p, s, h) THEN 'python' WHEN s = greatest(p, s, h) THEN 'sql' ELSE 'shell' END AS language, p, s, h FROM (SELECT block_id, " + ", ".join(f"$count_matches(lower(content), r'{v}') AS {k}" for k, v in zip("psh", _lang.values())) + " FROM {blocks})", "Language by keyword hits with a fixed order on ties.")
operator("prj_prompt_split", "SELECT doc_id, $long(count_if($matches(line, r'^(?:[$>#]|[A-Z][a-z]*\\.$)'))) AS commands, $long(count_if(NOT $matches(line, r'^(?:[$>#]|[A-Z][a-z]*\\.$)'))) AS outputs FROM {lines} GROUP BY doc_id", "Lines that are commands and lines that are output.")
operator("prj_low_confidence", "SELECT block_id, round(1 - 0.1E0 * $count_matches(content, r'[0O1lI|]') / greatest(length(content), 1) - 0.05E0 * (CASE WHEN $matches(content, r'\\x09') THEN 1 ELSE 0 END), 6) AS score, $matches(content, r'[|]') AS ambiguous FROM {blocks}", "Confidence lowered by ambiguous glyphs and mixed indentation.")
operator("prj_is_factual", "SELECT note_id, path, NOT derived AND NOT external AND n_words > 3 AS factual FROM {nodes}", "Whether a node states facts.")
operator("prj_image_class", "SELECT doc_id, page, CASE WHEN images = 0 THEN 'none' WHEN image_rate > 0.8 THEN 'photo' WHEN image_rate > 0.5 THEN 'diagram' WHEN chars > 500 THEN 'screenshot' ELSE 'icon' END AS cls FROM {triage}", "Image class by rules over its metrics.")
operator("prj_image_bytes_type", "SELECT page_id, CASE WHEN $matches(html, r'^<!DOCTYPE html') THEN 'text/html' WHEN $matches(html, r'^%PDF') THEN 'application/pdf' WHEN $matches(html, r'^PK') THEN 'application/zip' ELSE 'unknown' END AS mime FROM {pages}", "Type by leading characters.")
operator("flt_blocks_view", "SELECT block_id, type, confidence FROM {blocks} WHERE type = 'paragraph' AND confidence < 0.5", "Blocks by type and confidence without boilerplate.")
operator("flt_section_query", "SELECT unit_id, section_path FROM {units} WHERE section_path = '/doc-1' OR $starts(section_path, '/doc-1/')", "Units of a section and those below it.")
operator("flt_overdue_reviews", "SELECT error_id, domain, review_next, $days($date('2024-01-20'), review_next) AS days FROM {error_log} WHERE review_next < $date('2024-01-20')", "Reviews overdue at a date.")
operator("prj_capability_diff", "SELECT coalesce(a.capability, b.capability) AS capability, CASE WHEN a.capability IS NULL THEN 'gain' WHEN b.capability IS NULL THEN 'loss' ELSE 'same' END AS change FROM (SELECT * FROM {support} WHERE dest = 'obsidian') a FULL OUTER JOIN (SELECT * FROM {support} WHERE dest = 'notion') b ON a.capability = b.capability", "Capabilities gained and lost between two destinations.")
