"""Sort, limit, sampling and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import operator, program
from corpusflow.plans.durable import with_places

operator("srt_candidates", "SELECT a, b, confidence FROM (SELECT x.note_id AS a, y.note_id AS b, $double(100 - abs(x.n_blocks - y.n_blocks)) / 100 AS confidence FROM {notes} x JOIN {notes} y ON x.title = y.title AND x.note_id < y.note_id) ORDER BY confidence DESC, a, b", "Candidates by confidence, then pair.")
operator("srt_graph", "SELECT domain, concept, doc_id FROM {concepts} ORDER BY domain, concept", "Graph nodes in order.")
operator("top_k_sections", "SELECT source, section_path, n, k FROM (SELECT source, section_path, n, $long(row_number() OVER (PARTITION BY source ORDER BY n DESC, section_path)) AS k FROM (SELECT source, section_path, $long(count(*)) AS n FROM (SELECT b.source, u.section_path, u.state FROM {units} u JOIN {blocks} b ON u.section_path = b.section_path AND u.block_index = b.block_index) WHERE state = 'pending' GROUP BY source, section_path)) WHERE k <= 5", "The five largest sections of each source.")
operator("lim_max_pages", "SELECT page_id, url FROM {pages} ORDER BY page_id LIMIT 500", "A crawl stops at its page limit, which is the operator's feature.")
operator("lim_caps", "SELECT doc_id, pos, k FROM (SELECT doc_id, pos, $long(row_number() OVER (PARTITION BY doc_id ORDER BY pos)) AS k FROM {lines} WHERE $matches(line, r'  +|\\x09')) WHERE k <= 50", "Fifty corrections a region at most, which is the operator's feature.")
# The oracle's form; Spark numbers the units by ranges, as two strata would be two tasks.
_rank = "SELECT unit_id, criticality, row_number() OVER (PARTITION BY criticality ORDER BY sha1('7' || unit_id), unit_id) AS k, count(*) OVER (PARTITION BY criticality) AS n FROM {units}"


def _ranked(units):
    """unit_id and criticality with k, the place in its stratum by a hash, and n, the size of the stratum."""
    placed = with_places(units.select("unit_id", "criticality"), F.col("criticality"), F.sha1(F.concat(F.lit("7"), "unit_id")), F.col("unit_id"))
    strata = placed.groupBy("criticality").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return placed.join(strata, "criticality").withColumn("k", F.col("place") - F.col("first") + 1)


@program("smp_stratified", f"SELECT unit_id, criticality FROM ({_rank}) WHERE criticality = 'must-keep' OR k <= greatest(1, round_even(n * 0.1, 0)::BIGINT)", units="units")
def smp_stratified(units):
    """All must-keep units and a tenth of the others, in the order of a hash."""
    return _ranked(units).where((F.col("criticality") == "must-keep") | (F.col("k") <= F.greatest(F.lit(1), F.bround(F.col("n") * 0.1, 0).cast("long")))).select("unit_id", "criticality")


@program("smp_stratified_audit", f"SELECT unit_id, criticality FROM ({_rank}) WHERE criticality = 'must-keep' OR n < 10 OR k <= floor(n * 0.1)", units="units")
def smp_stratified_audit(units):
    """The same with the size rounded down, and all of a small stratum."""
    return _ranked(units).where((F.col("criticality") == "must-keep") | (F.col("n") < 10) | (F.col("k") <= F.floor(F.col("n") * 0.1))).select("unit_id", "criticality")


operator("set_union_findings", "SELECT rule_id, node FROM {issues} WHERE rule_id = 'V-LED-02' UNION ALL SELECT rule_id, node FROM {issues} WHERE rule_id = 'V-LED-06' UNION ALL SELECT rule_id, node FROM {issues} WHERE rule_id = 'V-SDM-06'", "Findings of three passes.")
operator("set_union_refs", "SELECT family, $long(count(DISTINCT doc_id)) AS merged, $long(count(doc_id)) AS parts FROM {notes} GROUP BY family", "References of a merged note are those of its parts.")
operator("set_except_missing", "SELECT doc_id, page + 1 AS page FROM {blocks} EXCEPT SELECT doc_id, page FROM {blocks}", "Declared pages that are not there.")
operator("set_intersect_sections", "SELECT section_path FROM {old_blocks} INTERSECT SELECT section_path FROM {new_blocks}", "Sections of both versions.")
operator("set_dedup_pairs", "SELECT DISTINCT src, dst FROM {note_links}", "Distinct edges.")
operator("set_recall", "WITH e AS (SELECT DISTINCT src, dst FROM {note_links} WHERE kind = 1), a AS (SELECT DISTINCT src, dst FROM {note_links} WHERE src < dst) SELECT $long(count(*)) AS expected, $long(count(a.src)) AS found, $double(count(a.src)) / count(*) >= 0.8 AS passes FROM e LEFT JOIN a ON e.src = a.src AND e.dst = a.dst", "Recall of expected pairs.")
