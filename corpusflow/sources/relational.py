"""Sources whose parsing is relational: transcripts, JSON, crawl, robots, headers, and the relational sinks."""

from __future__ import annotations

from corpusflow.plans.catalog import operator

operator("src_detect_format", "SELECT page_id, CASE WHEN $starts(html, '%PDF') THEN 'pdf' WHEN $starts(html, 'PK') THEN 'zip' WHEN $matches(substr(html, 1, 200), r'(?i)<!doctype html|<html') THEN 'html' WHEN $matches(url, r'\\.md$') THEN 'markdown' ELSE 'text' END AS format FROM {pages}", "Format by magic characters, head and extension.")
operator("src_json_transcript", "SELECT event_id, event_type, $json(props, '$.k') AS k FROM {events}", "Fields of JSON records.")
operator("src_ingest_json", "SELECT step, engine, $long(count(*)) AS n, $long(sum(bytes)) AS bytes FROM {cache_entries} GROUP BY step, engine", "Typed records of an ingest step.")
operator("src_notes_frontmatter", "SELECT note_id, title, note_type FROM (SELECT note_id, title, note_type, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS k FROM {notes} WHERE note_type IN ('concept', 'procedure', 'reference')) WHERE k = 1", "Notes by header; the first of a name wins.")
operator("src_figure_spec", "SELECT event_type AS series, $long(count(*)) AS points, min(value) AS low, max(value) AS high FROM {events} GROUP BY event_type", "Series of a chart with their range.")
operator("src_html_headings", "SELECT page_id, $extract(html, r'<title>([^<]*)</title>', 1) AS title, $extract(html, r'<h1>([^<]*)</h1>', 1) AS h1, $size($groups(html, r'href=\"([^\"]*)\"', 1)) AS n_links FROM {pages}", "Title, first heading and link count of a page.")
operator("snk_graph_mermaid", "SELECT domain, 'graph TD' || $chr(10) || $texts('  ' || from_concept || ' --> ' || to_concept, from_concept || to_concept, $chr(10)) AS diagram FROM (SELECT DISTINCT domain, from_concept, to_concept FROM {relations} WHERE to_concept <> '') GROUP BY domain", "Graph of a domain as a text diagram.")
operator("snk_anki_csv", "SELECT note_id, $texts('\"' || replace(text, '\"', '\"\"') || '\",' || node, ord, $chr(10)) AS csv FROM {nodes} WHERE node = 'bullet' GROUP BY note_id", "Cards as CSV lines.")
operator("snk_publish_manifest", "SELECT note_id, destination, source_hash FROM (SELECT note_id, destination, source_hash, row_number() OVER (PARTITION BY note_id, destination ORDER BY seq DESC, source_hash) AS k FROM (SELECT note_id, destination, source_hash, seq FROM {manifest} UNION ALL SELECT note_id, 'notion', ir_hash, 99 FROM {notes})) WHERE k = 1", "Manifest after an upsert by note and destination.")
