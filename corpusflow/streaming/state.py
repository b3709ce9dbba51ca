"""Resumable state as tables: status machines, caches and incremental runs."""

from __future__ import annotations

from corpusflow.operators.joins import _diff
from corpusflow.plans.catalog import operator

operator("st_chunk_loop", "SELECT book, $long(count(*)) AS items, $long(count_if(status = 'done')) AS done, $long(count_if(back)) AS clock_errors, min(CASE WHEN status IN ('pending', 'in-progress') THEN ordinal END) AS resume_at FROM (SELECT book, $long(ordinal) AS ordinal, status, ts < lag(ts) OVER (PARTITION BY book ORDER BY ordinal) AS back FROM {work_items}) GROUP BY book", "Status machine of chunks: progress, clock check and where to resume.")
operator("st_book", "SELECT book, $long(max(ordinal)) AS chapters, $div($long(max(CASE WHEN status = 'done' THEN ordinal ELSE 0 END)), 5) AS consolidations, count_if(status = 'failed' AND attempts >= 3) > 0 AS stuck FROM {work_items} GROUP BY book", "Chapter machine with a consolidation every five.")
operator("st_manifest", "SELECT step, event_order, before, event_order < before AS out_of_order FROM (SELECT book AS step, $long(ordinal) AS event_order, $long(lag(ordinal) OVER (PARTITION BY book ORDER BY ts, ordinal)) AS before FROM {work_items}) WHERE before IS NOT NULL", "Stage order of a manifest.")
operator("st_cache", "SELECT w.key, w.step, c.key IS NOT NULL AS hit FROM {cache_entries} w LEFT JOIN (SELECT DISTINCT key FROM {cache_entries} WHERE engine_version = 1) c ON w.key = c.key", "Cache hits of a new engine version, and misses to compute.")
operator("st_incremental", f"""
WITH d AS ({_diff}), t AS (SELECT n.note_id, count_if(d.change <> 'unchanged') AS changed, count_if(d.change = 'removed') = count(*) AS obsolete FROM {{nodes}} n JOIN d ON n.block_ref = d.block_id GROUP BY n.note_id)
SELECT t.note_id, CASE WHEN t.obsolete THEN 'archive' WHEN t.changed > 0 THEN 'republish' ELSE 'keep' END AS action, $long(count(m.destination)) AS destinations FROM t LEFT JOIN {{manifest}} m ON m.note_id = t.note_id GROUP BY t.note_id, t.obsolete, t.changed
""", "What an update does to each note.")
