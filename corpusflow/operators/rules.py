"""Rule catalogue: each rule is one projection to (rule_id, severity, node); all are united by `val_run_all`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import note_rules
from corpusflow.plans.catalog import _holes, operator, program, run_sql
from corpusflow.plans.dialect import duck_sql
from corpusflow.plans.durable import written

#: name -> rules (id, severity, node expression, input, condition)
RULES = {
    "val_monospace": [("V-MD-01", "warning", "section_path || $text(block_index)", "blocks", "length(content) > 800"), ("V-MD-03", "info", "section_path || $text(block_index)", "blocks", "$matches(content, r'[-+|]{3,}')")],
    "val_error_log": [("V-ERR-01", "error", "error_id", "error_log", "correction = ''"), ("V-ERR-02", "error", "error_id", "error_log", "note_id IS NULL"), ("V-ERR-03", "warning", "error_id", "error_log", "review_next IS NULL")],
    "val_goal_profile": [("V-GP-01", "error", "note_id", "notes", "note_type = 'procedure' AND n_blocks < 2"), ("V-GP-02", "warning", "note_id", "notes", "note_type = 'concept' AND n_words < 30")],
    "val_provenance": [("C1", "error", "$text(doc_id)", "documents", "lang IS NULL"), ("C2", "warning", "$text(doc_id)", "documents", "n_chars <> length(text)"), ("C3", "error", "$text(doc_id)", "documents", "source IS NULL OR source = ''")],
    "val_self_eval": [("V2", "warning", "note_id || path", "nodes", "node = 'bullet' AND n_words < 3"), ("V4", "info", "note_id || path", "nodes", "node = 'bullet' AND NOT $matches(text, r'[?.]$')")],
}


def _one(rule: tuple) -> str:
    rule_id, severity, node, source, condition = rule
    return f"SELECT '{rule_id}' AS rule_id, '{severity}' AS severity, {node} AS node FROM {{{source}}} WHERE {condition}"


for _name, _rules in RULES.items():
    operator(_name, "\nUNION ALL ".join(_one(r) for r in _rules), "Rules " + ", ".join(r[0] for r in _rules) + ".")

_all = [_one(r) for rules in RULES.values() for r in rules] + [f"SELECT rule_id, severity, node FROM ({text})" for text in note_rules.TEXTS.values()]
_union = "\nUNION ALL ".join(_all)
#: Tables that several rules read or that are made from others at a price.
_WRITTEN = {"blocks": "dealt_blocks", "note_fields": "note_fields", "note_lines": "note_lines"}


@program("val_run_all", duck_sql(f"SELECT rule_id, severity, $long(count(*)) AS n FROM ({_union}) GROUP BY rule_id, severity"), first=_WRITTEN, **{h: h for h in _holes(_union)})
def val_run_all(**tables: DataFrame) -> DataFrame:
    """All rules of the registry, counted: each part is a plan of its own over written tables, and its counts are written."""
    spark = next(iter(tables.values())).sparkSession
    parts = ["\nUNION ALL ".join(_one(r) for r in rules) for rules in RULES.values()] + list(note_rules.TEXTS.values())
    counts = [written(run_sql(spark, f"SELECT rule_id, severity, count(*) AS n FROM ({text}) GROUP BY rule_id, severity", {h: tables[h] for h in _holes(text)}), "counts") for text in parts]
    return reduce(DataFrame.union, counts).groupBy("rule_id", "severity").agg(F.sum("n").alias("n"))


operator("val_study_paths", """
WITH c AS (SELECT domain, count(DISTINCT concept) AS n FROM {concepts} GROUP BY domain)
SELECT 'V1' AS rule_id, domain AS node FROM c WHERE n < 2
UNION ALL SELECT 'V4', c.domain || c.concept FROM {concepts} c LEFT JOIN {notes} n ON n.doc_id = c.doc_id WHERE n.note_id IS NULL
UNION ALL SELECT 'V2', r.domain || r.from_concept FROM (SELECT DISTINCT domain, from_concept, to_concept FROM {relations}) r JOIN {concepts} a ON a.domain = r.domain AND a.concept = r.from_concept JOIN {concepts} b ON b.domain = r.domain AND b.concept = r.to_concept WHERE b.doc_id > a.doc_id
""", "Too few routes, notes not planned, and steps before what they need.")
operator("val_profile", "SELECT c_mktsegment AS profile, $long(count(*)) AS n, c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE') AS known FROM {customer} GROUP BY c_mktsegment", "Profile values against their enumeration.")
