"""Layout and table reconstruction over word boxes."""

from __future__ import annotations

from corpusflow.plans.catalog import operator

operator("lay_columns", """
WITH h AS (SELECT $div(page, 50) AS sheet, $div(x, 8) AS bucket, count(*) AS n FROM {boxes} GROUP BY $div(page, 50), $div(x, 8)),
m AS (SELECT sheet, max(n) AS top FROM h GROUP BY sheet), d AS (SELECT h.sheet, h.bucket FROM h JOIN m ON h.sheet = m.sheet WHERE h.n >= 0.05 * m.top),
g AS (SELECT sheet, bucket, CASE WHEN (bucket - lag(bucket) OVER (PARTITION BY sheet ORDER BY bucket)) * 8 > 30 THEN 1 ELSE 0 END AS cut FROM d),
i AS (SELECT sheet, bucket, sum(cut) OVER (PARTITION BY sheet ORDER BY bucket) AS col FROM g)
SELECT sheet, $long(col) AS col, min(bucket) * 8 AS x0, max(bucket) * 8 + 8 AS x1 FROM i GROUP BY sheet, col
""", "Columns: runs of dense buckets of the x-histogram, parted by 30 px.")
operator("lay_full_width", """
WITH r AS (SELECT page, word_id, x, w, row_number() OVER (PARTITION BY page ORDER BY w, word_id) AS k, count(*) OVER (PARTITION BY page) AS n FROM {boxes}),
m AS (SELECT page, min(w) AS median FROM r WHERE k > $div(n, 2) GROUP BY page)
SELECT b.page, b.word_id FROM {boxes} b JOIN m ON b.page = m.page WHERE b.w > 1.6 * m.median AND b.x < 260
""", "Boxes wider than 1.6 times the upper median width, left of the second column.")
operator("lay_regions", """
WITH s AS (SELECT page, $div(x, 260) AS col, x, y, w, h, word_id, CASE WHEN y - lag(y) OVER (PARTITION BY page, $div(x, 260) ORDER BY y, word_id) > 200 THEN 1 ELSE 0 END AS cut FROM {boxes}),
g AS (SELECT page, col, x, y, w, h, sum(cut) OVER (PARTITION BY page, col ORDER BY y, word_id) AS grp FROM s)
SELECT page, col, $long(grp) AS grp, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, $long(count(*)) AS n FROM g GROUP BY page, col, grp
""", "Regions: boxes around the groups of a column.")
operator("lay_margin_notes", "SELECT page, word_id FROM {boxes} WHERE (x < 50 OR x + w > 700) AND font_size <= 11", "Small words at the margins.")
operator("lay_captions", "SELECT page, region_id, gap FROM (SELECT page, region_id, cls, text, y - lag(y + h) OVER (PARTITION BY page ORDER BY y, region_id) AS gap FROM {regions}) WHERE gap BETWEEN 21 AND 112", "Regions that follow another at a caption's distance.")
operator("tab_autodetect", "SELECT page, $long(count(DISTINCT $div(x, 40))) AS xs, $long(count(DISTINCT $div(y, 40))) AS ys, count(DISTINCT $div(x, 40)) >= 3 AND count(DISTINCT $div(y, 40)) >= 3 AND max(x) - min(x) >= 100 AND max(y) - min(y) >= 50 AS is_table FROM {boxes} GROUP BY page", "Whether the words of a page form a grid.")
operator("frm_extract", "SELECT page, region_id, $extract(label, r'\\(([0-9]+(?:\\.[0-9]+)?)\\)$', 1) AS number, h <= 70 AND w < 220 AS inline FROM (SELECT page, region_id, h, w, text || ' (' || $text(region_id) || CASE WHEN page % 2 = 0 THEN '.1' ELSE '' END || ')' AS label FROM {regions} WHERE cls = 'formula')", "Number at the end of a formula, and whether it is inline.")
operator("ocr_retry", "SELECT page, attempt, conf FROM (SELECT page, attempt, conf, row_number() OVER (PARTITION BY page ORDER BY conf DESC, attempt) AS k FROM (SELECT page, word_id % 4 AS attempt, round(avg(conf), 6) AS conf FROM {boxes} GROUP BY page, word_id % 4)) WHERE k = 1", "The attempt with the best mean confidence, the first on a tie.")
