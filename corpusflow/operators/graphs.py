"""Graph operators over edge tables by joins; `graph_search` holds those that search."""

from __future__ import annotations

from corpusflow.plans.catalog import operator

operator("gr_build", """
SELECT r.domain, r.from_concept, r.to_concept, c.concept IS NULL AS dangling FROM (SELECT DISTINCT domain, from_concept, to_concept FROM {relations} WHERE relation = 'prerequisite' AND to_concept <> '') r
LEFT JOIN {concepts} c ON c.domain = r.domain AND c.concept = r.to_concept
""", "Prerequisite edges; dangling if the goal is no concept.")
operator("gr_two_cycles", "SELECT a.a, a.b FROM {trade} a JOIN {trade} b ON a.a = b.b AND a.b = b.a WHERE a.a < a.b", "Mutual pairs.")
operator("gr_chapter_edges", """
WITH t AS (SELECT $min_by(term, doc_id) AS term, min(doc_id) AS chapter FROM {units} WHERE type = 'definition' AND length(term) >= 6 GROUP BY term),
w AS (SELECT DISTINCT doc_id, lower(w) AS w FROM (SELECT doc_id, $explode($all_matches(content, r'[A-Za-z]+')) AS w FROM {blocks}))
SELECT t.chapter, w.doc_id AS mentions_in, $long(count(*)) AS n, w.doc_id > t.chapter AS forward FROM t JOIN w ON w.w = t.term AND w.doc_id <> t.chapter GROUP BY t.chapter, w.doc_id
""", "Mentions of a chapter's terms in other chapters.")
operator("gr_review_route", "SELECT error_id, domain, coalesce(review_next, $date('9999-12-31')) AS review_next, $long(row_number() OVER (PARTITION BY domain ORDER BY coalesce(review_next, $date('9999-12-31')), error_id)) AS place FROM {error_log}", "Error entries by review date; entries without one are last.")
