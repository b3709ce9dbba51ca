"""Aggregation operators: reports, summaries, gates and statistics."""

from __future__ import annotations

from corpusflow.plans.catalog import operator

operator("sdm_block_summary", "SELECT source, lang, type, $long(count(*)) AS n_blocks, $long(sum(n_words)) AS n_words, $long(count(DISTINCT block_id)) AS n_ids, max(block_index) AS last_index FROM {blocks} GROUP BY source, lang, type", "Flagship: blocks by source, language and type.")
operator("agg_mode_font", "SELECT doc_id, font_size FROM (SELECT doc_id, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, font_size) AS k FROM {fragments} GROUP BY doc_id, font_size) WHERE k = 1", "Body size: the most frequent font size, the smallest on a tie.")
operator("agg_heading_levels", """
WITH n AS (SELECT doc_id, font_size, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM {fragments} GROUP BY doc_id, font_size),
body AS (SELECT doc_id, $max_by(font_size, n * 1000 - font_size) AS body FROM n GROUP BY doc_id)
SELECT n.doc_id, n.font_size, $long(dense_rank() OVER (PARTITION BY n.doc_id ORDER BY n.font_size DESC)) AS level
FROM n JOIN body ON n.doc_id = body.doc_id WHERE n.font_size >= body.body + 0.5E0 AND n.n <= 0.2E0 * n.total
""", "Heading sizes above the body size, ranked.")
operator("agg_boilerplate", "SELECT source, content, $long(count(DISTINCT doc_id)) AS n_docs FROM {blocks} b JOIN (SELECT source AS s, count(DISTINCT doc_id) AS d FROM {blocks} GROUP BY source) t ON b.source = t.s GROUP BY source, content, d HAVING count(DISTINCT doc_id) >= greatest(2, 0.1 * d)", "Texts on many documents of a source.")
operator("agg_ledger_report", """
SELECT state, criticality, discard_reason, $long(count(*)) AS n, $long(count_if(criticality = 'must-keep' AND state <> 'pending')) AS must_done
FROM {units} GROUP BY GROUPING SETS ((state), (criticality, state), (discard_reason), ())
""", "Unit counts by state, criticality and reason, with the grand total.")
operator("agg_pending_sections", "SELECT section_path, $long(count(*)) AS n FROM {units} WHERE state = 'pending' AND criticality = 'must-keep' GROUP BY section_path ORDER BY n DESC, section_path LIMIT 5", "The five sections with the most pending must-keep units.")
operator("agg_units_processed", "SELECT $long(count_if(state <> 'pending')) AS processed, $long(count(*)) AS total FROM {units}", "Units in a terminal state.")
operator("agg_word_coverage", """
WITH u AS (SELECT block_id, max(state IN ('written', 'merged')) AS kept FROM {units} GROUP BY block_id)
SELECT b.type, $long(sum(b.n_words)) AS words, $long(sum(CASE WHEN u.kept THEN b.n_words ELSE 0 END)) AS covered, $double(sum(CASE WHEN u.kept THEN b.n_words ELSE 0 END)) / sum(b.n_words) >= 0.98 AS passes
FROM {blocks} b LEFT JOIN u ON b.block_id = u.block_id GROUP BY b.type
""", "Word-weighted coverage by category, with the 98 % gate.")
operator("agg_block_words", "SELECT block_id, $count_matches(content, r'[\\p{L}\\p{N}_]+') AS n FROM {blocks}", "Words of a block.")
operator("agg_sdm_summary", "SELECT lang, $long(count_if(type = 'heading')) AS headings, $long(count_if(type = 'paragraph')) AS paragraphs, $long(count_if(type = 'boilerplate')) AS boilerplate FROM {blocks} GROUP BY lang", "Blocks by type, one column each.")
operator("agg_confidence_histogram", "SELECT least(9, $floor(confidence * 10)) AS bucket, $long(count(*)) AS n FROM {blocks} GROUP BY least(9, $floor(confidence * 10))", "Ten buckets of confidence.")
operator("agg_index_counts", "SELECT note_type, domain, $long(count(*)) AS n, $long(sum(minutes)) AS minutes FROM {notes} GROUP BY note_type, domain", "Notes by type and chapter.")
operator("agg_link_debt", "SELECT $long(count_if(n.note_id IS NULL)) AS missing, $long(count_if(l.src = l.dst)) AS self_links, $long(count_if(l.kind = 2)) AS redirected, $long(count(*)) AS total FROM {note_links} l LEFT JOIN {notes} n ON l.dst = n.note_id", "Link debt by kind.")
operator("agg_cross_target", """
SELECT note_id, dest, $long(count(*)) AS total, $long(count_if(ok)) AS present, $long(count_if(NOT ok)) AS degraded
FROM (SELECT n.note_id, d.dest, s.dest IS NOT NULL AS ok FROM {nodes} n CROSS JOIN {destinations} d LEFT JOIN {support} s ON s.dest = d.dest AND s.capability = n.capability)
GROUP BY ROLLUP(note_id, dest)
""", "Nodes present and degraded by note and destination, with totals.")
operator("agg_issue_summary", "SELECT severity, rule_id, $long(count(*)) AS n FROM {issues} GROUP BY severity, rule_id", "Issues by severity and rule.")
operator("agg_gate", """
WITH i AS (SELECT count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings FROM {issues}),
c AS (SELECT $double(count(u.block_id)) / count(*) AS coverage FROM {blocks} b LEFT JOIN (SELECT DISTINCT block_id FROM {units}) u ON b.block_id = u.block_id)
SELECT $long(errors) AS errors, $long(warnings) AS warnings, coverage, errors > 0 OR coverage < 0.95 AS blocking,
       CASE WHEN coverage >= 0.99 THEN 3 WHEN coverage >= 0.95 THEN 2 WHEN coverage >= 0.8 THEN 1 ELSE 0 END AS coverage_level FROM i CROSS JOIN c
""", "Summary, coverage and verdict of the quality gate; two one-row inputs.")
operator("agg_rubric_global", """
WITH w AS (SELECT 'view' AS metric, 0.4 AS weight, 1 AS least UNION ALL SELECT 'click', 0.3, 0 UNION ALL SELECT 'purchase', 0.2, 0 UNION ALL SELECT 'signup', 0.1, 0),
s AS (SELECT case_id, metric, $long(sum(n)) % 4 AS score FROM {runs} GROUP BY case_id, metric)
SELECT s.case_id, $long(sum($long(w.weight * 10) * s.score)) AS score10, min(CASE WHEN s.score >= w.least THEN 1 ELSE 0 END) = 1 AS no_violator,
       sum($long(w.weight * 10) * s.score) >= 25 AND min(CASE WHEN s.score >= w.least THEN 1 ELSE 0 END) = 1 AS approved
FROM s JOIN w ON s.metric = w.metric GROUP BY s.case_id
""", "Weighted rubric score in tenths with minima.")
operator("agg_run_stats", "SELECT case_id, metric, round(avg($double(n)), 6) AS mean, round($stddev($double(n)), 6) AS stdev, min(n) AS low, max(n) AS high, max(n) - min(n) AS spread FROM {runs} GROUP BY case_id, metric", "Mean, sample deviation (0 for one run), extremes and range.")
operator("agg_variance_gate", """
WITH s AS (SELECT case_id, metric, $stddev($double(n)) AS stdev, avg($double(n)) AS mean FROM {runs} GROUP BY case_id, metric)
SELECT case_id, bool_and(stdev <= 0.5 * mean) AS within, $long(count_if(stdev > 0.5 * mean)) AS n_over FROM s GROUP BY case_id
""", "Whether every metric of a case varies little enough.")
operator("agg_alias_collision", "SELECT alias, $long(count(DISTINCT canonical)) AS n_terms, $join($set(canonical), ',') AS terms FROM {glossary} GROUP BY alias HAVING count(DISTINCT canonical) > 1", "Aliases of several terms.")
operator("agg_term_candidates", """
WITH t AS (SELECT $explode($all_matches(content, r'[A-Z][a-z]{3,}')) AS term FROM {blocks})
SELECT t.term, $long(count(*)) AS n FROM t LEFT JOIN {glossary} g ON lower(t.term) = g.canonical WHERE g.canonical IS NULL GROUP BY t.term ORDER BY n DESC, t.term LIMIT 50
""", "The first fifty capitalised words that the glossary lacks.")
operator("agg_vocab", "SELECT word, $long(count(*)) AS n FROM (SELECT $explode($all_matches(lower(content), r'[a-z]+(?:-[a-z]+)*')) AS word FROM {blocks}) GROUP BY word", "Word frequencies, hyphen compounds whole.")
operator("agg_cache_info", "SELECT step, engine, $long(count(*)) AS entries, $long(sum(bytes)) AS bytes FROM {cache_entries} GROUP BY step, engine", "Cache entries by step and engine.")
operator("agg_progress", "SELECT book, $long(count_if(status = 'done')) AS done, $long(count(*)) AS total, $floor($double(count_if(status = 'done')) * 100 / count(*)) AS pct FROM {work_items} GROUP BY book", "Progress of each book.")
operator("agg_provenance_methods", """
WITH p AS (SELECT doc_id, 'lang' AS field, CASE WHEN lang IS NULL THEN 'absent' ELSE 'read' END AS method FROM {documents}
           UNION ALL SELECT doc_id, 'source', CASE WHEN doc_id % 3 = 0 THEN 'inferred' ELSE 'read' END FROM {documents}
           UNION ALL SELECT doc_id, 'version', CASE WHEN doc_id % 4 = 0 THEN 'web_docs_metadata' ELSE 'absent' END FROM {documents})
SELECT field, method, $long(count(*)) AS n, CASE method WHEN 'read' THEN 1.0E0 WHEN 'web_docs_metadata' THEN 0.9E0 ELSE 0.0E0 END AS confidence FROM p GROUP BY field, method
""", "Provenance methods by field.", oracle=None)
operator("agg_bbox_union", "SELECT page, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, round(avg($double(y)), 6) AS mean_y FROM {boxes} GROUP BY page", "Box around the words of a page and their mean height.")
operator("agg_size_band", "SELECT target_note, $long(count(*)) AS n, CASE WHEN count(*) <= 15 THEN 'small' WHEN count(*) <= 40 THEN 'medium' ELSE 'large' END AS band, count_if(criticality = 'must-keep') > 30 AS needs_approval FROM {units} WHERE target_note IS NOT NULL GROUP BY target_note", "Size band of a note by its units.")
