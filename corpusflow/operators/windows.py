"""Window and sequence operators: islands, sessions, chunks, order checks and first-wins."""

from __future__ import annotations

from corpusflow.operators import density
from corpusflow.operators.density import PROSE_WORDS
from corpusflow.plans.catalog import operator
from corpusflow.plans.dialect import duck_sql

operator("win_block_index", "SELECT doc_id, pos, $long(row_number() OVER (PARTITION BY doc_id ORDER BY pos)) - 1 AS block_index FROM {lines} WHERE $matches(line, r'[^\\x20\\x09-\\x0D]')", "Index of a block in its section in reading order.")
_class = "CASE WHEN nonprint > 0.05 THEN 'degraded' WHEN chars >= 1000 AND fonts >= 1 AND image_rate < 0.5 THEN 'readable' WHEN image_rate >= 0.9 OR chars < 100 THEN 'scanned' ELSE 'mixed' END"
operator("win_page_ranges", f"""
WITH c AS (SELECT doc_id, page, {_class} AS cls FROM {{triage}}),
f AS (SELECT doc_id, page, cls, CASE WHEN cls = lag(cls) OVER (PARTITION BY doc_id ORDER BY page) THEN 0 ELSE 1 END AS cut FROM c),
g AS (SELECT doc_id, page, cls, sum(cut) OVER (PARTITION BY doc_id ORDER BY page) AS island FROM f)
SELECT doc_id, cls, CASE WHEN min(page) = max(page) THEN $text(min(page)) ELSE $text(min(page)) || '-' || $text(max(page)) END AS pages, $long(count(*)) AS n FROM g GROUP BY doc_id, cls, island
""", "Gaps and islands: runs of consecutive pages of one class.")
operator("win_y_gap_groups", """
WITH s AS (SELECT page, x, y, h, word_id, CASE WHEN y - lag(y) OVER (PARTITION BY page, $div(x, 260) ORDER BY y, word_id) > 1.8 * h THEN 1 ELSE 0 END AS cut FROM {boxes}),
g AS (SELECT page, $div(x, 260) AS col, word_id, sum(cut) OVER (PARTITION BY page, $div(x, 260) ORDER BY y, word_id) AS grp FROM s)
SELECT page, col, $long(grp) AS grp, $long(count(*)) AS n FROM g GROUP BY page, col, grp
""", "Groups of a column split where the vertical gap exceeds 1.8 line heights.")
operator("win_sidebar_clusters", """
WITH o AS (SELECT page, y, h, word_id FROM {boxes} WHERE x > 600 OR x < 60),
s AS (SELECT page, y, word_id, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, word_id) > 3 * h THEN 1 ELSE 0 END AS cut FROM o),
g AS (SELECT page, y, sum(cut) OVER (PARTITION BY page ORDER BY y, word_id) AS grp FROM s)
SELECT page, $long(grp) AS grp, min(y) AS y0, max(y) AS y1, $long(count(*)) AS n FROM g GROUP BY page, grp HAVING count(*) >= 3
""", "Clusters of at least three words outside the columns.")
operator("win_mono_clusters", """
WITH s AS (SELECT page, x, y, w, h, word_id, CASE WHEN y - lag(y + h) OVER (PARTITION BY page ORDER BY y, word_id) > 12 THEN 1 ELSE 0 END AS cut FROM {boxes} WHERE mono),
g AS (SELECT page, x, y, w, h, sum(cut) OVER (PARTITION BY page ORDER BY y, word_id) AS grp FROM s)
SELECT page, $long(grp) AS grp, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, $long(count(*)) AS n FROM g GROUP BY page, grp HAVING count(*) >= 2
""", "Code regions: clusters of two or more monospaced words.")
_order = "SELECT page, region_id, col, y, w, $long(sum(CASE WHEN w > 210 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, region_id)) AS band FROM {regions}"
operator("win_reading_order", f"WITH b AS ({_order}) SELECT page, region_id, band, $long(row_number() OVER (PARTITION BY page ORDER BY band, col, y, region_id)) AS reading FROM b", "Reading order by band, column and height; full-width regions open bands.")
operator("win_continuity", """
SELECT page, region_id, round(score, 6) AS score, score < 0.3 AS jump FROM (
  SELECT page, region_id, CASE WHEN $matches(text, r'[a-z0-9]$') THEN 0.3E0 ELSE 0.0E0 END + CASE WHEN $matches(text, r'-$') THEN 0.3E0 ELSE 0.0E0 END
         + CASE WHEN (lead(y) OVER w) - y BETWEEN 0 AND 200 THEN 0.2E0 ELSE 0.0E0 END + CASE WHEN (lead(col) OVER w) = col THEN 0.2E0 ELSE 0.0E0 END AS score
  FROM {regions} WINDOW w AS (PARTITION BY page ORDER BY col, y, region_id))
""", "Continuity of a region with the next; below 0.3 is a jump.")
operator("win_order_check", f"SELECT page, region_id, band, col FROM (SELECT page, region_id, band, col, lag(col) OVER (PARTITION BY page, band ORDER BY region_id) AS before FROM ({_order})) WHERE before > col", "Regions that step back a column inside a band.")
operator("win_columnar_probe", """
SELECT page, bool_or(n = 6 AND spread <= 42 AND x_spread >= 3) AS columnar FROM (
  SELECT page, count(*) OVER w AS n, max(y) OVER w - min(y) OVER w AS spread, $size($distinct(array_agg(x) OVER w)) AS x_spread
  FROM {boxes} WINDOW w AS (PARTITION BY page ORDER BY word_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) GROUP BY page
""", "Whether six consecutive words stand in one band at three or more places.")
operator("win_numbering_jumps", """
SELECT chapter, section, before, gap, CASE WHEN gap > 100 THEN 'critical' WHEN gap > 1 THEN 'warning' ELSE 'ok' END AS severity
FROM (SELECT chapter, section, lag(section) OVER (PARTITION BY chapter ORDER BY section) AS before, section - lag(section) OVER (PARTITION BY chapter ORDER BY section) AS gap FROM {numbering} WHERE page % 4 <> 0) WHERE gap > 1
""", "Jumps between consecutive section numbers.")
# The fillers, and a pause of two seconds.
operator("win_pause_filler", """
SELECT conv_id, turn, pause, CASE WHEN pause >= 2 THEN $replace_all(text, r'(?i)^(?:(?:um|uh|er|ah|eh|mm|hmm|mm-hmm|uh-huh)[.,;:!?]? +)+', '') ELSE text END AS cleaned
FROM (SELECT conv_id, turn, coalesce(text, '') AS text, start_s - lag(end_s) OVER (PARTITION BY conv_id ORDER BY turn) AS pause FROM {segments})
""", "Leading fillers go only after a pause of two seconds.")
operator("win_heading_path", """
WITH h AS (SELECT doc_id, block_index, $replace_all($replace_all(lower(content), r'[^a-z0-9]+', '-'), r'^-+|-+$', '') AS slug, (block_index + doc_id) % 3 + 1 AS level FROM {blocks} WHERE type = 'heading'),
p AS (SELECT doc_id, block_index, level, slug, max(CASE WHEN level = 1 THEN block_index END) OVER w AS a1, max(CASE WHEN level = 2 THEN block_index END) OVER w AS a2,
             $max_by(slug, CASE WHEN level = 1 THEN block_index END) OVER w AS s1, $max_by(slug, CASE WHEN level = 2 THEN block_index END) OVER w AS s2
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, block_index, level, '/' || CASE WHEN level > 1 AND a1 IS NOT NULL THEN s1 || '/' ELSE '' END || CASE WHEN level > 2 AND a2 > coalesce(a1, -1) THEN s2 || '/' ELSE '' END || slug AS section_path FROM p
""", "Heading stack to nested section paths; a level is reset by a shallower heading.")
operator("win_slug_suffix", """
SELECT doc_id, block_index, CASE WHEN k = 1 THEN slug ELSE slug || '-' || $text(k) END AS slug
FROM (SELECT doc_id, block_index, slug, row_number() OVER (PARTITION BY doc_id, slug ORDER BY block_index) AS k FROM (SELECT doc_id, block_index, $replace_all($replace_all(lower(content), r'[^a-z0-9]+', '-'), r'^-+|-+$', '') AS slug FROM {blocks} WHERE type = 'heading'))
""", "Suffix -2, -3 for repeated slugs.")
operator("win_first_wins", "SELECT source_hash, term, unit_id, doc_id FROM (SELECT source_hash, term, unit_id, doc_id, row_number() OVER (PARTITION BY source_hash, term ORDER BY doc_id, block_index) AS k FROM {units} WHERE type = 'definition') WHERE k = 1", "First definition of a term in a domain.")


def _runs(kind: str, most: int) -> str:
    return f"""
WITH s AS (SELECT note_id, ord, node, CASE WHEN node = lag(node) OVER (PARTITION BY note_id ORDER BY ord) THEN 0 ELSE 1 END AS cut FROM {{nodes}}),
g AS (SELECT note_id, ord, node, sum(cut) OVER (PARTITION BY note_id ORDER BY ord) AS island FROM s)
SELECT note_id, min(ord) AS first_ord, $long(count(*)) AS n FROM g WHERE node = '{kind}' GROUP BY note_id, island HAVING count(*) > {most}
"""


operator("win_callout_run", _runs("callout", 3), "Runs of callouts longer than allowed.")
operator("win_bullet_run", _runs("bullet", 5), "Runs of bullets longer than allowed.")
operator("win_chunks_by_size", "SELECT section_path, $div(block_index, 30) AS chunk, $min_by(block_id, block_index) AS first_block, $max_by(block_id, block_index) AS last_block, $long(count(*)) AS n FROM {blocks} GROUP BY section_path, $div(block_index, 30)", "Chunks of thirty blocks with their ends.")
operator("win_chunks_by_chapter", """
WITH c AS (SELECT doc_id, block_index, block_id, greatest(sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_index) - 1, 0) AS chapter FROM {blocks})
SELECT doc_id, $div($long(chapter), 3) AS chunk, min(block_index) AS first_block, max(block_index) AS last_block, $long(count(*)) AS n FROM c GROUP BY doc_id, $div($long(chapter), 3)
""", "Chunks of three chapters; a heading opens a chapter.")
operator("win_chunks_by_section", "SELECT source, section_path, $long(dense_rank() OVER (PARTITION BY source ORDER BY first_doc)) AS chunk, n FROM (SELECT source, section_path, min(doc_id) AS first_doc, $long(count(*)) AS n FROM {blocks} GROUP BY source, section_path)", "Chunks by section in the order first seen.")
operator("win_next_work", "SELECT book, $long(min(ordinal)) AS next_item, $div($long(min(ordinal)) + 4, 5) * 5 AS next_consolidation FROM {work_items} WHERE status = 'pending' OR (status = 'failed' AND attempts < 3) GROUP BY book", "Next pending or recoverable item and the next consolidation.")
operator("win_header_rows", "SELECT page, $long(sum(CASE WHEN lead_flag = 1 AND k <= 3 THEN 1 ELSE 0 END)) AS header_rows FROM (SELECT page, k, min(flag) OVER (PARTITION BY page ORDER BY k) AS lead_flag FROM (SELECT page, row_number() OVER (PARTITION BY page ORDER BY y, word_id) AS k, CASE WHEN font_size >= 10 THEN 1 ELSE 0 END AS flag FROM {boxes})) GROUP BY page", "Leading large rows, three at most.")
_ANCHORS = """aggregate({items}, cast(array() AS array<bigint>), (acc, e) -> concat(acc, array(CASE WHEN size(acc) = 0 OR e{y} - element_at(acc, -1) > {tol} THEN e{y} ELSE element_at(acc, -1) END)))"""
operator(
    "win_axis_cluster",
    f"""
SELECT page, anchor, $long(count(*)) AS n FROM (SELECT page, explode({_ANCHORS.format(items="ys", y="", tol=40)}) AS anchor FROM (SELECT page, sort_array(collect_list(y)) AS ys FROM {{boxes}} GROUP BY page)) GROUP BY page, anchor
""",
    "Clusters by distance to the cluster's first value: a fold over the sorted values of a page.",
    oracle="""
WITH RECURSIVE s AS (SELECT page, y, row_number() OVER (PARTITION BY page ORDER BY y, word_id) AS k FROM boxes),
c AS (SELECT page, k, y, y AS anchor FROM s WHERE k = 1 UNION ALL SELECT s.page, s.k, s.y, CASE WHEN s.y - c.anchor > 40 THEN s.y ELSE c.anchor END FROM c JOIN s ON s.page = c.page AND s.k = c.k + 1)
SELECT page, anchor, count(*) AS n FROM c GROUP BY page, anchor
""",
)
operator(
    "win_line_order",
    f"""
SELECT page, $long(b.word_id) AS word_id, $long(row_number() OVER (PARTITION BY page ORDER BY anchor, b.x, b.word_id)) AS reading
FROM (SELECT page, explode(zip_with(bs, {_ANCHORS.format(items="bs", y=".y", tol=12)}, (b, a) -> struct(b AS bs, a AS anchors))) AS z FROM (SELECT page, sort_array(collect_list(struct(y, x, word_id))) AS bs FROM {{boxes}} GROUP BY page)) LATERAL VIEW inline(array(struct(z.bs AS b, z.anchors AS anchor))) v AS b, anchor
""",
    "Words by line, a line lasting while near its first word, then by place.",
    oracle="""
WITH RECURSIVE s AS (SELECT page, word_id, x, y, row_number() OVER (PARTITION BY page ORDER BY y, x, word_id) AS k FROM boxes),
c AS (SELECT page, k, word_id, x, y, y AS anchor FROM s WHERE k = 1 UNION ALL SELECT s.page, s.k, s.word_id, s.x, s.y, CASE WHEN s.y - c.anchor > 12 THEN s.y ELSE c.anchor END FROM c JOIN s ON s.page = c.page AND s.k = c.k + 1)
SELECT page, word_id, row_number() OVER (PARTITION BY page ORDER BY anchor, x, word_id) AS reading FROM c
""",
)
# Runs of prose begin anew where something else stands and after each report, so they are the folds of the density rules.
_prose = "SELECT note_id, $long(0) AS section, note_id AS heading, ord, CASE WHEN node = 'paragraph' THEN $long(n_words) END AS adds, node <> 'paragraph' AS ends FROM {nodes}"
operator(
    "win_prose_run",
    "SELECT note_id, ord FROM (" + density.runs(_prose, PROSE_WORDS, True) + ")",
    "First blocks of the runs of prose that pass the limit.",
    oracle=duck_sql("WITH RECURSIVE " + density.walk("P", _prose, PROSE_WORDS, True) + " SELECT note_id, ord FROM P"),
)
operator("win_cross_page_tables", """
WITH t AS (SELECT page, region_id, text, col FROM {regions} WHERE cls = 'table'), n AS (SELECT a.page AS a, b.page AS b, a.region_id AS ra, b.region_id AS rb, a.text AS ta, b.text AS tb FROM t a JOIN t b ON b.page = a.page + 1 AND a.col = b.col)
SELECT a, b, ra, rb, $double(greatest(length(ta), length(tb)) - levenshtein(ta, tb)) / greatest(length(ta), length(tb)) >= 0.8 AS merged FROM n
""", "Tables of adjacent pages and columns whose headers are alike.")
