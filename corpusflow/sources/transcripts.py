"""Subtitle files to cues: blocks between blank lines, times to the millisecond, and fillers left out after a pause.

A cue is a block with a time line first or second; other blocks are no cues. Leading fillers go only where the cue before ended PAUSE seconds ago or
earlier, and the words then stand one space apart. A null or empty file has no cues.
"""

from __future__ import annotations

from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import operator, table

# The fillers, the pause, and the forms of a time.
FILLERS = "um|uh|er|ah|eh|mm-hmm|mm|hmm|uh-huh"
PAUSE = 2
SRT_TIME, VTT_TIME = r"([0-9]{2}):([0-9]{2}):([0-9]{2}),([0-9]{3})", r"([0-9]{2}):([0-9]{2}):([0-9]{2})\.([0-9]{3})"


def cues(files: str, time: str) -> str:
    """SQL of conv_id, cue from 1, start_s, end_s and text of {files}: conv_id, content."""
    line = rf"^{time}\s*-->\s*{time}$"
    part = lambda k: f"$long($extract(time_line, r'{line}', {k}))"
    seconds = lambda k: f"{part(k)} * 3600 + {part(k + 1)} * 60 + {part(k + 2)} + $double({part(k + 3)}) / 1000"
    return rf"""
WITH b AS (SELECT conv_id, pos, $split($at(blocks, pos), r'\n') AS ls FROM (SELECT conv_id, blocks, $explode($range($long(1), $size(blocks))) AS pos FROM (SELECT conv_id, $split($replace_all(content, r'^\s+|\s+$', ''), r'\n\s*\n') AS blocks FROM {{{files}}} WHERE content IS NOT NULL))),
t AS (SELECT conv_id, pos, CASE WHEN $matches(trim($at(ls, 2)), r'{line}') THEN trim($at(ls, 2)) WHEN $matches(trim($at(ls, 1)), r'{line}') THEN trim($at(ls, 1)) END AS time_line,
             CASE WHEN $matches(trim($at(ls, 2)), r'{line}') THEN trim($join($slice(ls, 3, greatest(cast($size(ls) AS INT) - 2, 0)), ' ')) ELSE trim($join($slice(ls, 2, greatest(cast($size(ls) AS INT) - 1, 0)), ' ')) END AS said FROM b),
c AS (SELECT conv_id, pos, said, {seconds(1)} AS start_s, {seconds(5)} AS end_s FROM t WHERE time_line IS NOT NULL),
p AS (SELECT conv_id, $long(row_number() OVER (PARTITION BY conv_id ORDER BY pos)) AS cue, start_s, end_s, said, start_s - coalesce(lag(end_s) OVER (PARTITION BY conv_id ORDER BY pos), 0) AS pause FROM c)
SELECT conv_id, cue, start_s, end_s, CASE WHEN pause >= {PAUSE} THEN $replace_all(trim($replace_all(said, r'\s+', ' ')), r'(?i)^(?:(?:{FILLERS})[.,;:!?]?(?: |$))+', '') ELSE said END AS text FROM p
"""


def _clock(ms: str, sign: str) -> str:
    two = lambda v: f"lpad($text({v}), 2, '0')"
    return f"{two(f'$div({ms}, 3600000)')} || ':' || {two(f'$div({ms}, 60000) % 60')} || ':' || {two(f'$div({ms}, 1000) % 60')} || '{sign}' || lpad($text({ms} % 1000), 3, '0')"


_times = lambda sign, arrow: f"{_clock('$floor(start_s * 1000)', sign)} || '{arrow}' || {_clock('$floor(end_s * 1000)', sign)}"
_said = "CASE turn % 3 WHEN 0 THEN 'Um, uh-huh  ' WHEN 1 THEN 'Hmm. so ' ELSE '' END || coalesce(text, '')"
# Conversations as files: some cues with a broken time, some with blank lines inside, some without a number.
table("srt_files", f"SELECT conv_id, $texts($text(turn) || $chr(10) || CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN 'soon' ELSE {_times(',', ' --> ')} END || $chr(10) || {_said}, turn, $chr(10) || $chr(10)) AS content FROM {{segments}} GROUP BY conv_id")
table("vtt_files", f"SELECT conv_id, 'WEBVTT' || $chr(10) || $chr(10) || 'NOTE made here' || $chr(10) || $chr(10) || $texts(CASE WHEN conv_id % 2 = 0 THEN role || $chr(10) ELSE '' END || {_times('.', '-->')} || $chr(10) || {_said}, turn, $chr(10) || ' ' || $chr(10)) AS content FROM {{segments}} GROUP BY conv_id")
operator("src_srt", cues("srt_files", SRT_TIME), "Subtitle files to cues.")
operator("src_vtt", cues("vtt_files", VTT_TIME), "WebVTT files to cues.")
