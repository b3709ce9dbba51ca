"""Scalar functions over text: identifiers, normalisers, extractors and checks."""

from __future__ import annotations

from corpusflow.plans.catalog import operator, table

operator("fn_block_id", "SELECT doc_id, substr($sha1($sha256(source) || '/doc-' || $text(doc_id) || '0'), 1, 12) AS block_id FROM {documents}", "First twelve hex digits of sha1(source hash, section path, index).")
operator("fn_fragment_id", "SELECT page, word_id, $sha1($text(page) || '::' || $text(x) || '.00,' || $text(y) || '.00,' || $text(x + w) || '.00,' || $text(y + h) || '.00::' || substr(text, 1, 64)) AS fragment_id FROM {boxes}", "sha1 of page, box with two decimals and the first 64 characters.")
operator("fn_sha256_file", "SELECT doc_id, $sha256(text) AS digest FROM {documents}", "Content hash.")
operator("fn_sha256_dir", "SELECT source, $sha256($texts($text(doc_id) || ':' || $sha256(text), doc_id, '|')) AS digest FROM {documents} GROUP BY source", "Hash over the sorted members of a folder.")
operator("fn_ir_hash", "SELECT note_id, $sha256($texts(path || '=' || node || ':' || text, ord, '|')) AS digest FROM {nodes} GROUP BY note_id", "Hash of a note's canonical form.")
operator("fn_cache_key", "SELECT event_id, substr($sha256($text(user_id) || '|' || event_type || '|engine|1|' || props), 1, 16) AS key FROM {events}", "Key of a memoised step.")
operator("fn_link_id", "SELECT src, dst, kind, 'lt-' || substr($sha256(dst || src || $text(kind)), 1, 12) AS link_id FROM {note_links}", "Stable link id.")
operator("fn_slugify", "SELECT block_id, CASE WHEN s = '' THEN 'section' ELSE substr(s, 1, 64) END AS slug FROM (SELECT block_id, $replace_all($replace_all(lower(content), r'[^a-z0-9]+', '-'), r'^-+|-+$', '') AS s FROM {blocks})", "Lower case, hyphens for other characters, 64 at most, with a default word.")
operator("fn_normalize_ws", "SELECT block_id, trim($replace_all(lower(content), r'[\\x20\\x09-\\x0D]+', ' ')) AS norm FROM {blocks}", "Lower case with single spaces.")
operator("fn_normalize_markup", "SELECT page_id, trim($replace_all($replace_all($replace_all(html, r'<[^>]*>', ' '), r'[*_`~#>|%&$]+', ''), r'[\\x20\\x09-\\x0D]+', ' ')) AS norm FROM {pages}", "Text without tags and markup signs.")
operator("fn_fold_accents", "SELECT doc_id, translate(text, 'áéíóúñüàèìòùâêîôûäëïöç', 'aeiounuaeiouaeiouaeioc') AS folded FROM {documents}", "Accents folded.")
# Unicode ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
_plain = "text"
for _sign, _letters in LIGATURES.items():
    _plain = f"replace({_plain}, '{_sign}', '{_letters}')"
table("joined_letters", "SELECT doc_id, replace(replace(replace(text, 'ff', 'ﬀ'), 'st', CASE WHEN doc_id % 2 = 0 THEN 'ﬅ' ELSE 'ﬆ' END), 'fi', 'ﬁ') AS text FROM {documents}")
operator("fn_ligatures", f"SELECT doc_id, {_plain} AS plain FROM {{joined_letters}}", "Seven Unicode ligatures as letters.")
operator("fn_class_gate", "SELECT page, region_id, CASE WHEN cls IN ('code', 'table') THEN 'skip' WHEN cls = 'formula' THEN 'dictionary' ELSE 'full' END AS gate FROM {regions}", "Which corrections a class gets.")
operator("fn_nonprintable_ratio", "SELECT doc_id, $double($count_matches(text, r'[\\p{Cc}\\p{Cf}]') - $count_matches(text, r'[\\n\\r\\t]')) / greatest(length(text), 1) AS ratio FROM {documents}", "Share of control characters other than line ends and tabs.")
operator("fn_parse_ranges", "SELECT DISTINCT doc_id, $explode($range(lo, hi)) AS page FROM (SELECT doc_id, $long($extract(r, r'^([0-9]+)-', 1)) AS lo, $long($extract(r, r'-([0-9]+)$', 1)) AS hi FROM (SELECT doc_id, $text(min(page)) || '-' || $text(max(page)) AS r FROM {blocks} GROUP BY doc_id))", "Ranges to pages.")
operator("fn_parse_section_number", "SELECT chapter, section, $long($at(parts, 1)) AS major, $long($at(parts, 2)) AS minor, $size(parts) AS depth FROM (SELECT chapter, section, $split($text(chapter) || '.' || $text(section), r'\\.') AS parts FROM {numbering})", "Dotted number to integers.")
operator("fn_timestamp_seconds", "SELECT event_id, $long($extract(t, r'^([0-9]+):', 1)) * 3600 + $long($extract(t, r':([0-9]+):', 1)) * 60 + $long($extract(t, r':([0-9]+),', 1)) + $double($long($extract(t, r',([0-9]+)$', 1))) / 1000 AS seconds FROM (SELECT event_id, $text(event_id % 24) || ':' || $text(event_id % 60) || ':' || $text(user_id % 60) || ',' || $text(event_id % 1000) AS t FROM {events})", "h:m:s,ms to seconds.")
operator("fn_detect_version", "SELECT page_id, coalesce(nullif($extract(url, r'[?&]v(?:ersion)?=([0-9.]+)', 1), ''), nullif($extract(url, r'/v?([0-9]+)(?:[/?#]|$)', 1), ''), 'unknown') AS version FROM {pages}", "Version by query or path.")
operator("fn_normalize_url", "SELECT page_id, pos, CASE WHEN $matches(href, r'^https?://') THEN href WHEN $starts(href, '/') THEN $extract(url, r'^(https?://[^/?#]*)', 1) || href WHEN $starts(href, '#') THEN $replace_all(url, r'#.*$', '') || href ELSE $replace_all(url, r'[^/]*$', '') || href END AS absolute FROM {links}", "Absolute, root, fragment and relative links resolved.")
operator("fn_arxiv_id", "SELECT event_id, $extract(t, r'([0-9]{4}\\.[0-9]{4,5})(v[0-9]+)?', 1) AS id, $extract(t, r'([0-9]{4}\\.[0-9]{4,5})(v[0-9]+)?', 2) AS version FROM (SELECT event_id, 'arXiv:' || $text(2000 + event_id % 400) || '.' || $text(10000 + event_id) || CASE WHEN event_id % 2 = 0 THEN 'v2' ELSE '' END AS t FROM {events})", "Paper id and version.")
operator("fn_arxiv_stamp", "SELECT event_id, $extract(t, r'^arXiv:[^ ]+ +\\[([a-z.A-Z-]+)\\]', 1) AS category FROM (SELECT event_id, 'arXiv:2101.00001v1 [' || CASE WHEN event_id % 2 = 0 THEN 'cs.CL' ELSE 'math.AG' END || '] 1 Jan 2021' AS t FROM {events})", "Category of a paper stamp.")
operator("fn_word_count", "SELECT doc_id, $count_matches(text, r'[^\\x20\\x09-\\x0D]+') AS by_space, $count_matches(text, r'[\\p{L}\\p{N}_]+') AS by_letters FROM {documents}", "Words by white space and by letters.")
operator("fn_clause_count", "SELECT block_id, $size($keep($split(content, r'[,;.]'), trim(x) <> '')) AS clauses FROM {blocks}", "Clauses between commas, semicolons and stops.")
operator("fn_rich_text_split", "SELECT doc_id, piece, substr(text, cast(piece * 2000 + 1 AS INT), 2000) AS part, $div(piece, 100) AS request FROM (SELECT doc_id, text, $explode($range($long(0), $div($long(greatest(length(text) - 1, 0)), 2000))) AS piece FROM {documents})", "Pieces of 2,000 characters, a hundred to a request.")
operator("fn_days_overdue", "SELECT error_id, greatest($days($date('2024-01-31'), review_next), 0) AS days FROM {error_log}", "Days since a review was due.")
operator("fn_json_content", "SELECT event_id, event_type, $json(props, '$.k') AS k, $long(length(props)) AS chars FROM {events}", "Field of tagged content.")
operator("sim_jaccard", """
WITH b AS (SELECT doc_id, page, $distinct($all_matches(lower($texts(content, block_index, ' ')), r'[a-z]+')) AS t FROM {blocks} GROUP BY doc_id, page),
p AS (SELECT x.doc_id, x.page, x.t AS a, y.t AS c FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.page = x.page + 1)
SELECT doc_id, page, CASE WHEN $size($union(a, c)) = 0 THEN 1.0E0 ELSE $double($size($intersect(a, c))) / $size($union(a, c)) END AS jaccard FROM p
""", "Jaccard index of token sets; two empty sets are equal.")
operator("sim_word_containment", """
WITH n AS (SELECT note_id, $distinct($all_matches(lower(text), r'[a-z]+')) AS a, note_id AS id FROM {nodes}), d AS (SELECT 'note-' || $text(doc_id) AS id, $distinct($all_matches(lower(text), r'[a-z]+')) AS t FROM {documents})
SELECT note_id, $long(count(*)) AS nodes, $long(count_if($size(a) > 0 AND $size($intersect(a, t)) >= 0.8 * $size(a))) AS present FROM n JOIN d ON n.id = d.id GROUP BY note_id
""", "Nodes of which four fifths of the words are in the artefact.")
# The limits of the cascade.
operator("sim_pair_decision", """
SELECT a, b, CASE WHEN named AND sim >= 0.3 AND sim < 0.5 THEN 'conflict' WHEN named OR sim >= 0.85 THEN 'merge' WHEN sim >= 0.6 THEN 'specialize' ELSE 'review' END AS decision,
       CASE WHEN named AND sim >= 0.3 AND sim < 0.5 THEN 0.7E0 WHEN named THEN 0.95E0 ELSE $even(sim, 3) END AS confidence
FROM (SELECT a, b, sim, canonical OR alias AS named FROM {pairs}) WHERE named OR sim >= 0.4
""", "Decision on a pair by canonical name, alias and similarity of the texts.", pairs="note_pairs")
operator("dup_subtree", "SELECT note_id, path FROM (SELECT note_id, path, row_number() OVER (PARTITION BY note_id, $sha256(node || text) ORDER BY ord) AS k FROM {nodes}) WHERE k = 1", "Blocks without those whose subtree stood before.")
operator("dup_split", "SELECT note_id, $long(part) AS part, min(ord) AS first_ord, $long(count(*)) AS n FROM (SELECT note_id, ord, sum(CASE WHEN node = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY note_id ORDER BY ord) AS part FROM {nodes}) GROUP BY note_id, part", "A note split at its headings.")
