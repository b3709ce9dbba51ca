"""Density of notes: prose, anchors, lists and sources by section, over parsed blocks.

{note_blocks}: note_id, note_type, section (number), heading, section_lines, ord, kind, n_words, n_lines, items (of a list), checklist,
anchor (a visual anchor), factual, has_src. A run that passes its limit is reported and begins anew, so runs are folds
over the blocks of one section; everything else is windows and groups by note.
"""

from __future__ import annotations

from corpusflow.plans.catalog import operator
from corpusflow.plans.dialect import duck_sql

# Limits, note types that a rule leaves out, kinds that break a run of bullets, and sections without sources.
SUMMARY_WORDS, SUMMARY_LINES, PARAGRAPH_WORDS, PROSE_WORDS, CALLOUTS, BULLETS, SECTION_LINES, SOURCES, LEAST_FACTS = 60, 8, 200, 200, 3, 5, 100, 0.8, 5
EXEMPT = {"R3": "('glossary-term', 'cheatsheet', 'index-moc')", "R5": "('cheatsheet', 'index-moc')", "R6": "('glossary-term', 'cheatsheet', 'index-moc')", "R7": "('architecture')"}
STRUCTURE = "('paragraph', 'table', 'callout', 'figure', 'diagram', 'equation', 'code')"
UNSOURCED = r"^## .*(?:Autoevaluaci|Errores registrados|Resumen de errores)"

#: rule -> (what a block adds, null if nothing; whether it ends the run; limit; whether the report names the run's first block)
RUNS = {
    "R3": ("CASE WHEN kind IN ('paragraph', 'list') AND NOT anchor THEN $long(n_words) END", "anchor", PROSE_WORDS, True),
    "R5": ("CASE WHEN kind = 'list' AND NOT checklist THEN greatest($long(items), 1) END", f"kind IN {STRUCTURE}", BULLETS, False),
}
_STEPS = "SELECT note_id, section, heading, ord, {adds} AS adds, {ends} AS ends FROM {{note_blocks}} WHERE note_type NOT IN {exempt}"


def _fold(rule: str) -> str:
    adds, ends, most, first = RUNS[rule]
    return runs(_STEPS.format(adds=adds, ends=ends, exempt=EXEMPT[rule]), most, first)


def runs(steps: str, most: int, first: bool) -> str:
    """Where the runs of steps(note_id, section, heading, ord, adds, ends) pass the limit: their first or last block."""
    state = "named_struct('run', {0}, 'start', {1}, 'at', {2})"
    start = "CASE WHEN a.start IS NULL THEN b.ord ELSE a.start END"
    none = "cast(NULL AS BIGINT)"
    step = f"CASE WHEN b.adds IS NOT NULL AND a.run + b.adds > {most} THEN {state.format('cast(0 AS BIGINT)', none, f"concat(a.at, array({start if first else 'b.ord'}))")}"
    step += f" WHEN b.adds IS NOT NULL THEN {state.format('a.run + b.adds', start, 'a.at')} WHEN b.ends THEN {state.format('cast(0 AS BIGINT)', none, 'a.at')} ELSE a END"
    zero = state.format("cast(0 AS BIGINT)", none, "cast(array() AS ARRAY<BIGINT>)")
    return f"SELECT note_id, heading, explode(aggregate(bs, {zero}, (a, b) -> {step}).at) AS ord FROM (SELECT note_id, section, heading, array_sort(collect_list(struct(ord, adds, ends))) AS bs FROM ({steps}) GROUP BY note_id, section, heading)"


def _walk(rule: str) -> str:
    adds, ends, most, first = RUNS[rule]
    return walk(rule, _STEPS.format(adds=adds, ends=ends, exempt=EXEMPT[rule]), most, first)


def walk(rule: str, steps: str, most: int, first: bool) -> str:
    """The same runs for the oracle, block after block by recursion."""
    return f"""{rule}s AS (SELECT *, row_number() OVER (PARTITION BY note_id, section ORDER BY ord) AS k FROM ({steps})),
{rule}w AS (
  SELECT note_id, section, heading, $long(0) AS k, $long(0) AS run, $long(NULL) AS began, $long(NULL) AS fired FROM {rule}s WHERE k = 1
  UNION ALL SELECT s.note_id, s.section, s.heading, s.k, CASE WHEN s.adds IS NULL THEN CASE WHEN s.ends THEN 0 ELSE w.run END WHEN w.run + s.adds > {most} THEN 0 ELSE w.run + s.adds END,
    CASE WHEN s.adds IS NULL THEN CASE WHEN s.ends THEN NULL ELSE w.began END WHEN w.run + s.adds > {most} THEN NULL ELSE coalesce(w.began, s.ord) END,
    CASE WHEN s.adds IS NOT NULL AND w.run + s.adds > {most} THEN {"coalesce(w.began, s.ord)" if first else "s.ord"} END
  FROM {rule}w w JOIN {rule}s s ON s.note_id = w.note_id AND s.section = w.section AND s.k = w.k + 1),
{rule} AS (SELECT note_id, heading, fired AS ord FROM {rule}w WHERE fired IS NOT NULL)"""


_GROUPS = f"""
f AS (SELECT note_id, min(section) AS section FROM {{note_blocks}} WHERE $starts(heading, '## TL;DR') GROUP BY note_id),
r4 AS (SELECT note_id, heading, ord, row_number() OVER (PARTITION BY note_id, section, island ORDER BY ord) AS k
       FROM (SELECT note_id, section, heading, ord, kind, sum(CASE WHEN kind = 'callout' THEN 0 ELSE 1 END) OVER (PARTITION BY note_id, section ORDER BY ord) AS island FROM {{note_blocks}}) WHERE kind = 'callout'),
s AS (SELECT note_id, note_type, section, heading, max(section_lines) AS section_lines, count_if(kind IN {STRUCTURE}) AS structure, count_if(kind = 'collapsible') AS folds, count_if(factual) AS facts, count_if(factual AND has_src) AS sourced FROM {{note_blocks}} GROUP BY note_id, note_type, section, heading),
t AS (SELECT note_id, facts, sourced, max(CASE WHEN $starts(heading, '## ') THEN section END) OVER w AS top, max(CASE WHEN $matches(heading, r'{UNSOURCED}') THEN section END) OVER w AS off FROM s WINDOW w AS (PARTITION BY note_id ORDER BY section)),
d AS (SELECT note_id, sum(facts) AS facts, sum(sourced) AS sourced FROM t WHERE off IS NULL OR off <> top GROUP BY note_id)
SELECT 'R1' AS rule_id, 'warning' AS severity, b.note_id, b.heading || ':paragraph:' || $text(b.ord) AS node FROM {{note_blocks}} b JOIN f ON f.note_id = b.note_id AND f.section = b.section WHERE b.kind = 'paragraph' AND (b.n_words > {SUMMARY_WORDS} OR b.n_lines > {SUMMARY_LINES})
UNION ALL SELECT 'R2', 'error', note_id, heading || ':paragraph:' || $text(ord) FROM {{note_blocks}} WHERE kind = 'paragraph' AND n_words > {PARAGRAPH_WORDS} AND NOT $starts(heading, '## TL;DR')
UNION ALL SELECT 'R3', 'warning', note_id, heading || ':paragraph:' || $text(ord) FROM R3
UNION ALL SELECT 'R4', 'error', note_id, heading || ':callout:' || $text(ord) FROM r4 WHERE k % {CALLOUTS + 1} = 0
UNION ALL SELECT 'R5', 'error', note_id, heading || ':list:' || $text(ord) FROM R5
UNION ALL SELECT 'R6', 'error', note_id, heading FROM s WHERE structure = 0 AND note_type NOT IN {EXEMPT["R6"]}
UNION ALL SELECT 'R7', 'warning', note_id, heading FROM s WHERE section_lines > {SECTION_LINES} AND folds = 0 AND note_type NOT IN {EXEMPT["R7"]}
UNION ALL SELECT 'R8', 'warning', note_id, '/' FROM d WHERE facts >= {LEAST_FACTS} AND $double(sourced) / facts < {SOURCES}
"""
operator(
    "val_density",
    "WITH " + ", ".join(f"{r} AS ({_fold(r)})" for r in RUNS) + "," + _GROUPS,
    "Long paragraphs, prose without anchors, runs of callouts and bullets, bare lists, unfolded sections and missing sources, R1 to R8.",
    oracle=duck_sql("WITH RECURSIVE " + ",\n".join(_walk(r) for r in RUNS) + "," + _GROUPS),
)
