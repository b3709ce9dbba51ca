"""Ledger, audit, diff, publication and study pipelines composed of relational steps."""

from __future__ import annotations

from corpusflow.operators.joins import _diff
from corpusflow.plans.catalog import operator

operator("led_init", "SELECT source_hash, $long(count(*)) AS units, $long(count(DISTINCT section_path)) AS sections FROM {units} GROUP BY source_hash", "A new ledger per source.")
operator("led_add", """
WITH batch AS (SELECT unit_id, block_id, type, criticality, doc_id FROM {units} WHERE doc_id % 3 = 0), have AS (SELECT DISTINCT unit_id FROM {units} WHERE doc_id % 6 = 0), b AS (SELECT DISTINCT block_id FROM {blocks})
SELECT batch.unit_id, CASE WHEN have.unit_id IS NOT NULL THEN 'duplicate' WHEN b.block_id IS NULL THEN 'unknown-block' ELSE 'added' END AS outcome
FROM batch LEFT JOIN have ON batch.unit_id = have.unit_id LEFT JOIN b ON batch.block_id = b.block_id
""", "A batch of new units validated as a set.")
operator("led_mark", """
SELECT unit_id, state, wanted, CASE WHEN state <> 'pending' AND state <> wanted THEN 'refused' WHEN wanted = 'discarded' AND discard_reason IS NULL THEN 'no-reason' ELSE 'applied' END AS outcome
FROM (SELECT unit_id, state, discard_reason, CASE block_index % 3 WHEN 0 THEN 'written' WHEN 1 THEN 'merged' ELSE 'discarded' END AS wanted FROM {units})
""", "A batch of state changes validated as a set.")
operator("led_check", """
SELECT 'orphan' AS kind, u.unit_id AS id FROM {units} u LEFT JOIN (SELECT DISTINCT block_id FROM {blocks}) b ON u.block_id = b.block_id WHERE b.block_id IS NULL
UNION ALL SELECT 'gap', b.block_id FROM {blocks} b LEFT JOIN (SELECT DISTINCT block_id FROM {units}) u ON u.block_id = b.block_id WHERE u.block_id IS NULL
""", "Orphans and gaps between units and blocks.")
operator("led_validate", """
SELECT 'V-LED-01' AS rule_id, unit_id AS node FROM {units} WHERE criticality = 'must-keep' AND state = 'pending'
UNION ALL SELECT 'V-LED-02', unit_id FROM {units} WHERE state = 'discarded' AND NOT $matches(coalesce(discard_reason, ''), r'^(boilerplate|out-of-scope|redundant-with:[0-9a-f]{12})$')
UNION ALL SELECT 'V-LED-03', unit_id FROM {units} WHERE state = 'written' AND target_note IS NULL
UNION ALL SELECT 'V-LED-04', unit_id FROM {units} GROUP BY unit_id HAVING count(*) > 1
UNION ALL SELECT 'V-LED-05', u.unit_id FROM {units} u LEFT JOIN (SELECT DISTINCT unit_id AS id FROM {units}) t ON t.id = substr(u.discard_reason, 16) WHERE $starts(coalesce(u.discard_reason, ''), 'redundant-with:') AND (t.id IS NULL OR t.id = u.unit_id)
UNION ALL SELECT 'V-LED-06', unit_id FROM {units} WHERE block_id IS NULL
""", "Six ledger rules.")
operator("aud_completeness", """
WITH f AS (SELECT u.unit_id, u.criticality, u.state, b.block_id, u.content AS have, b.content AS want FROM {units} u LEFT JOIN {blocks} b ON u.block_id = b.block_id)
SELECT unit_id AS node, 'missing-forward' AS category, 'critical' AS severity FROM f WHERE block_id IS NULL
UNION ALL SELECT unit_id, 'mutilated', 'critical' FROM f WHERE block_id IS NOT NULL AND trim($replace_all(lower(have), r'[\\x20\\x09-\\x0D]+', ' ')) <> trim($replace_all(lower(want), r'[\\x20\\x09-\\x0D]+', ' '))
UNION ALL SELECT unit_id, 'pending-must-keep', 'critical' FROM f WHERE criticality = 'must-keep' AND state = 'pending'
UNION ALL SELECT b.block_id, 'missing-backward', 'warning' FROM {blocks} b LEFT JOIN (SELECT DISTINCT block_id FROM {units}) u ON b.block_id = u.block_id WHERE u.block_id IS NULL AND b.type <> 'boilerplate'
""", "Forward pass, backward pass and threshold gate of the completeness audit.")
operator("aud_fidelity", """
SELECT note_id, path, 'V-FAUDIT-01' AS rule_id FROM {nodes} WHERE NOT derived AND NOT external AND n_words > 3 AND block_ref IS NULL
UNION ALL SELECT note_id, path, 'V-FAUDIT-02' FROM {nodes} WHERE $matches(text, r'[0-9]+') AND NOT $matches(text, r'[0-9]+ ?(?:%|ms|s|MB|GB|KB|px)')
UNION ALL SELECT n.note_id, n.path, 'V-FAUDIT-03' FROM {nodes} n LEFT JOIN (SELECT DISTINCT block_id FROM {blocks}) b ON n.block_ref = b.block_id WHERE n.block_ref IS NOT NULL AND b.block_id IS NULL
""", "Factual nodes without sources, numbers without units, and invented references.")
operator("aud_trace", """
SELECT note_id, path, 'orphan-A' AS kind FROM {nodes} WHERE block_ref IS NULL AND NOT derived
UNION ALL SELECT note_id, path, 'orphan-B' FROM {nodes} WHERE n_words >= 20 AND NOT external AND $matches(lower(text), r'(?:perhaps|likely|seems|erhaps)')
UNION ALL SELECT 'source', b.block_id, 'unused' FROM {blocks} b LEFT JOIN (SELECT DISTINCT block_ref FROM {nodes}) n ON n.block_ref = b.block_id WHERE n.block_ref IS NULL
""", "Nodes without sources, hedged nodes not marked, and unused blocks.")
operator("aud_cross_target", """
SELECT d.dest, $long(count(*)) AS total, $long(count(s.dest)) AS present, $long(count_if(s.dest IS NULL AND n.capability IN ('math', 'footnotes'))) AS justified, $long(count_if(s.dest IS NULL AND n.capability NOT IN ('math', 'footnotes'))) AS lost
FROM {nodes} n CROSS JOIN {destinations} d LEFT JOIN {support} s ON s.dest = d.dest AND s.capability = n.capability GROUP BY d.dest
""", "Units present, justified and lost by destination.")
operator("aud_ingest", """
SELECT doc_id, 'empty' AS what, page FROM (SELECT doc_id, page, sum(n_words) AS w FROM {blocks} GROUP BY doc_id, page) WHERE w < 5
UNION ALL SELECT doc_id, 'too-long', page FROM (SELECT doc_id, page, sum(n_words) AS w FROM {blocks} GROUP BY doc_id, page) WHERE w > 400
UNION ALL SELECT doc_id, 'jump', page FROM (SELECT doc_id, page, page - lag(page) OVER (PARTITION BY doc_id ORDER BY page) AS gap FROM (SELECT DISTINCT doc_id, page FROM {blocks} WHERE block_index % 7 <> 3)) WHERE gap > 1
""", "Empty, overlong and skipped pages.")
operator("aud_gate", "SELECT rule_id, severity, $long(count(*)) AS n, count_if(severity = 'error') > 0 AS blocks_promotion FROM {issues} GROUP BY rule_id, severity", "Merged report of the gate.")
operator("dif_sdm", f"""
WITH d AS ({_diff})
SELECT section_path, $long(count_if(change = 'added')) AS added, $long(count_if(change = 'removed')) AS removed, $long(count_if(change = 'modified')) AS modified, $long(count_if(change = 'unchanged')) AS unchanged FROM d GROUP BY section_path HAVING count_if(change <> 'unchanged') > 0
""", "Sections that two versions change.")
operator("dif_supersede", f"""
WITH d AS ({_diff}), gone AS (SELECT DISTINCT n.note_id, n.section_path FROM {{nodes}} n JOIN d ON n.block_ref = d.block_id WHERE d.change = 'removed'), t AS (SELECT note_id, title FROM {{notes}})
SELECT g.note_id, min(s.note_id) AS successor FROM gone g JOIN t ON t.note_id = g.note_id LEFT JOIN t s ON s.title = t.title AND s.note_id <> t.note_id GROUP BY g.note_id
""", "Successor of an obsolete note by title.")
operator("con_passes", """
SELECT 1 AS pass, 'link-debt' AS name, $long(count_if(n.note_id IS NULL)) AS findings FROM {note_links} l LEFT JOIN {notes} n ON l.dst = n.note_id
UNION ALL SELECT 2, 'glossary', $long(count(*)) FROM (SELECT alias FROM {glossary} GROUP BY alias HAVING count(DISTINCT canonical) > 1)
UNION ALL SELECT 3, 'indices', $long(count(DISTINCT note_type)) FROM {notes}
UNION ALL SELECT 4, 'cheatsheets', $long(count_if(type = 'parameter')) FROM {units}
UNION ALL SELECT 5, 'consistency', $long(count(*)) FROM {issues}
""", "Five consolidation passes in order.")
operator("idx_book", "SELECT n.domain, $long(count(*)) AS notes, $long(sum(n.minutes)) AS minutes, $long(sum(n.n_blocks)) AS blocks, $texts(n.note_id, n.doc_id, ',') AS members FROM {notes} n GROUP BY n.domain", "Index of a book.")
operator("pub_plan", """
SELECT action, dest, $long(count(*)) AS n FROM (
  SELECT d.dest, CASE WHEN m.note_id IS NULL THEN 'created' WHEN m.edited AND m.source_hash <> n.ir_hash THEN 'blocked' WHEN m.source_hash = n.ir_hash THEN 'skipped' ELSE 'updated' END AS action
  FROM {notes} n CROSS JOIN {destinations} d LEFT JOIN {manifest} m ON m.note_id = n.note_id AND m.destination = d.dest) GROUP BY action, dest
""", "Publication plan by action and destination.")
operator("stu_error_cards", """
SELECT error_id, CASE WHEN value < 5 THEN 'front too short' WHEN correction = '' THEN 'no correction' WHEN note_id IS NULL THEN 'no note' WHEN review_next IS NULL THEN 'no review date' END AS reject_reason,
       'What fixes ' || error_id || '?' AS front, correction AS back FROM {error_log}
""", "A card per error entry, or the first reason against it.")
operator("stu_goal_profile", """
WITH p AS (SELECT 'exam' AS profile, 'self-test' AS section UNION ALL SELECT 'exam', 'summary' UNION ALL SELECT 'work', 'procedure')
SELECT n.note_id, p.profile, $join($set(p.section), ',') AS sections FROM {notes} n CROSS JOIN p GROUP BY n.note_id, p.profile
""", "Sections that each of two profiles adds to a note; the profile table is a literal.")
operator("pln_assign", """
WITH t AS (SELECT section_path, type, count(*) AS n FROM {units} GROUP BY section_path, type), s AS (SELECT section_path, type, n, sum(n) OVER (PARTITION BY section_path) AS total, row_number() OVER (PARTITION BY section_path ORDER BY n DESC, type) AS k FROM t)
SELECT section_path, type AS dominant, $double(n) / $double(total) > 0.5 AS clear FROM s WHERE k = 1
""", "Dominant unit type of a section.")
operator("gls_rules", "SELECT canonical, $long(count(*)) AS rows_seen, count(DISTINCT alias) = 1 AS one_alias, min(doc_id) AS defined_in FROM {glossary} GROUP BY canonical", "One canonical definition per term.")
operator("cnf_rules", "SELECT term, $long(count(DISTINCT section_path)) AS anchors, count(DISTINCT section_path) >= 2 AS conflict FROM {units} WHERE type = 'definition' AND term <> '' GROUP BY term", "A conflict has two anchors at least.")
operator("man_rules", "SELECT note_id, destination, $long(count(*)) AS n, count(*) = 1 AS is_unique, max(CASE WHEN edited THEN 1 ELSE 0 END) = 1 AS edited FROM {manifest} GROUP BY note_id, destination", "A note has one entry per destination.")
