"""Text corrections as an edit log, and their undoing.

Rules run in a fixed order, each over the whole text that the one before it left. The log has one row for each
correction: its rule's place, its own place among that rule's corrections, where it began before the rule and after it
(prefix sums of the lengths between matches and of the changes so far), and both spellings. The log alone gives everything back: rules are undone from the
last to the first, each by its own positions, and a single correction is found in the final text by carrying its position through
the changes of the later rules.

A null text stays null and has no corrections; an empty one has none. Text of a class that takes no corrections is returned as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import program, table
from corpusflow.plans.durable import written

# Rules as (id, pattern, correction of a match m), ligatures R005 to R008 outside addresses, and the dictionary.
_NOT_ADDRESS = r"(?!(?s:.{0,26}://|.{0,25}\.com|.{0,25}\.org))"
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
RULES = [
    ("R002", r"\n{3,}", "'\\n\\n'"),
    ("R003", r"(?md)^( +)\1+ +", "repeat(' ', cast((length(m) - 1) div 2 AS INT) + 1)"),
    ("R003", r"(?<!\A) {2,}(?!\n?\z)", "' '"),
    ("R004", r"(?md)^( +)\t", "concat(substr(m, 1, length(m) - 1), '    ')"),
    *((f"R00{5 + i}", lig + _NOT_ADDRESS, f"'{letters}'") for i, (lig, letters) in enumerate(LIGATURES.items())),
    ("R009", r"(?U)(\d{1,3})\.\s+([A-Z][a-z]+)", r"concat(substring_index(m, '.', 1), '.\n\n', regexp_extract(m, '[A-Z][a-z]+$', 0))"),
    ("R010", r"(?mdU)^(\([0-9]+\)|\[[0-9]+\])\s+", r"concat(regexp_extract(m, '^[^)\\]]+.', 0), '\n')"),
]
DICTIONARY = [("D001", "PostgresQL", "PostgreSQL", True), ("D002", "Javascript", "JavaScript", False), ("D003", "mySQL", "MySQL", True), ("D004", "Typescript", "TypeScript", True), ("D005", "pyhton", "python", False)]
SKIPPED = ("code", "console", "table", "syntax_diagram")
FORMULA = "formula"
PASSES = [*RULES, *((i, ("" if exact else "(?iu)") + old, f"'{new}'") for i, old, new, exact in DICTIONARY)]
_EDIT = "STRUCT<pass:INT,k:INT,gap:INT,original:STRING,corrected:STRING>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def corrected(texts: DataFrame) -> DataFrame:
    """texts(id, cls, text) with fixed, the corrected text, and _edits, the corrections of all rules in order."""
    df = texts.select("id", "cls", "text", F.col("text").alias("fixed"), F.lit(None).cast(f"ARRAY<{_EDIT}>").alias("_edits")).withColumn("_edits", F.expr(f"cast(array() AS ARRAY<{_EDIT}>)"))
    for i, (rule, pattern, change) in enumerate(PASSES):
        skipped = [*SKIPPED, *([FORMULA] if rule.startswith("R") else [])]
        takes = f"text IS NOT NULL AND coalesce(cls, '') NOT IN ({', '.join(repr(c) for c in skipped)})"
        df = df.withColumn("_found", F.expr(f"if({takes}, regexp_extract_all(fixed, {_quoted(pattern)}, 0), cast(array() AS ARRAY<STRING>))"))
        df = df.withColumn("_new", F.expr(f"transform(_found, m -> {change})")).withColumn("_gaps", F.expr(f"if(size(_found) = 0, cast(array() AS ARRAY<STRING>), split(fixed, {_quoted(pattern)}, -1))"))
        df = df.withColumn("fixed", F.expr("if(size(_found) = 0, fixed, array_join(zip_with(_gaps, _new, (g, n) -> concat(g, coalesce(n, ''))), ''))"))
        edits = f"transform(_found, (m, k) -> named_struct('pass', {i}, 'k', k, 'gap', length(_gaps[k]), 'original', m, 'corrected', _new[k]))"
        df = df.withColumn("_edits", F.expr(f"concat(_edits, {edits})")).drop("_found", "_new", "_gaps")
    return written(df, "corrected")  # a filter on the result would otherwise be spelled out through every rule


def edit_log(fixed: DataFrame) -> DataFrame:
    """id, pass, k, rule, before and after, where a correction begins, counted from 0 in the text before and after its rule, original and corrected."""
    # an outer explode, as the optimiser copies what an inner one reads, all rules, into a filter
    rows = fixed.select("id", F.explode_outer("_edits").alias("e")).where("e IS NOT NULL").select("id", "e.*")
    w = Window.partitionBy("id", "pass").orderBy("k")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    size, new = F.length("original"), F.length("corrected")
    rows = rows.withColumn("before", (F.sum("gap").over(w) + F.coalesce(F.sum(size).over(past), F.lit(0))).cast("long")).withColumn("after", (F.col("before") + F.coalesce(F.sum(new - size).over(past), F.lit(0))).cast("long"))
    return rows.where("original <> corrected").select("id", "pass", "k", F.element_at(F.array(*(F.lit(p[0]) for p in PASSES)), F.col("pass") + 1).alias("rule"), "before", "after", "original", "corrected")


_UNDO = "array_join(transform(e, (x, i) -> concat(substring(t, cast(if(i = 0, 0, e[i - 1].after + length(e[i - 1].corrected)) AS INT) + 1, cast(x.after - if(i = 0, 0, e[i - 1].after + length(e[i - 1].corrected)) AS INT)), x.original)), '') || substring(t, cast(e[size(e) - 1].after + length(e[size(e) - 1].corrected) AS INT) + 1)"


def reverted(fixed: DataFrame, log: DataFrame) -> DataFrame:
    """fixed(id, fixed) with text, all corrections of the log undone, rule by rule from the last."""
    whole = log.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pass", "after", "original", "corrected"))).alias("_all"))
    df = fixed.select("id", "fixed").join(whole, "id", "left").withColumn("t", F.col("fixed"))
    for i in range(len(PASSES) - 1, -1, -1):
        df = df.withColumn("e", F.expr(f"filter(_all, x -> x.pass = {i})")).withColumn("t", F.expr(f"if(coalesce(size(e), 0) <= 0, t, {_UNDO})"))
    return df.select("id", F.col("t").alias("text"))


def placed(log: DataFrame) -> DataFrame:
    """log with final, where the correction begins in the text that all rules left; null where a later correction reaches into it, so that it can't be undone alone."""
    log = written(log, "log")
    at = log.select("id", "pass", "k", F.col("after").alias("pos"), F.length("corrected").alias("len"), F.lit(True).alias("whole"))
    spans = log.select("id", F.col("pass").alias("later"), F.col("before").alias("begin"), (F.col("before") + F.length("original")).alias("end"), (F.length("corrected") - F.length("original")).alias("change"))
    for i in sorted(r[0] for r in log.select("pass").distinct().collect()):  # at most one for each rule
        now = spans.where(F.col("later") == i)
        # ends and beginnings of this rule's corrections, and both ends of what is followed, on one line: a correction that ends at a place lies before it
        marks = now.select("id", F.col("end").alias("x"), F.lit(0).alias("o"), F.col("change").alias("move"), F.lit(0).alias("opened"), F.lit(1).alias("closed"), *(F.lit(None).cast("int").alias(c) for c in ("pass", "k")), F.lit(None).cast("string").alias("side"))
        marks = marks.unionByName(now.select("id", F.col("begin").alias("x"), F.lit(2).alias("o"), F.lit(0).alias("move"), F.lit(1).alias("opened"), F.lit(0).alias("closed"), *(F.lit(None).cast("int").alias(c) for c in ("pass", "k")), F.lit(None).cast("string").alias("side")))
        old = at.where(F.col("pass") < i)
        ends = old.select("id", F.explode(F.array(F.struct(F.col("pos").alias("x"), F.lit("from").alias("side")), F.struct((F.col("pos") + F.col("len")).alias("x"), F.lit("to").alias("side")))).alias("p"), "pass", "k").select("id", "p.x", F.lit(1).alias("o"), F.lit(0).alias("move"), F.lit(0).alias("opened"), F.lit(0).alias("closed"), "pass", "k", "p.side")
        w = Window.partitionBy("id").orderBy("x", "o").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        run = marks.unionByName(ends).select("side", "id", "pass", "k", F.sum("move").over(w).alias("move"), F.sum("opened").over(w).alias("opened"), F.sum("closed").over(w).alias("closed")).where("side IS NOT NULL")
        told = run.groupBy("id", "pass", "k").agg(F.max(F.when(F.col("side") == "from", F.col("move"))).alias("move"), F.max(F.when(F.col("side") == "from", F.col("closed"))).alias("closed"), F.max(F.when(F.col("side") == "to", F.col("opened"))).alias("opened"))
        at = written(at.join(told, ["id", "pass", "k"], "left").select("id", "pass", "k", (F.col("pos") + F.coalesce("move", F.lit(0))).alias("pos"), "len", (F.col("whole") & (F.coalesce("opened", F.lit(0)) == F.coalesce("closed", F.lit(0)))).alias("whole")), "at")
    return log.join(at, ["id", "pass", "k"]).select("id", "pass", "k", "rule", "before", "after", F.when(F.col("whole"), F.col("pos")).alias("final"), "original", "corrected")


def revert_one(fixed: DataFrame, spans: DataFrame) -> DataFrame:
    """id, pass, k and text: the corrected text of each row of spans, from `placed`, with that one correction undone at its place."""
    t = F.expr("concat(substring(fixed, 1, cast(final AS INT)), original, substring(fixed, cast(final AS INT) + length(corrected) + 1))")
    return spans.where("final IS NOT NULL").join(fixed.select("id", "fixed"), "id").select("id", "pass", "k", t.alias("text"))


# Documents with the faults that recognition leaves, by their place.
table(
    "scans",
    """
SELECT doc_id AS id, CASE doc_id % 9 WHEN 0 THEN 'code' WHEN 1 THEN 'formula' ELSE 'text' END AS cls,
       CASE doc_id % 4 WHEN 0 THEN '   ' || replace(replace(replace(replace(text, 'fi', 'ﬁ'), 'and ', 'and  '), '. ', '.' || $chr(10) || $chr(10) || $chr(10) || $chr(10) || '       '), 'the ', 'mySQL ')
            WHEN 1 THEN '(12)  ' || replace(replace(text, 'on ', 'a.com pyhton '), 'ti', 'ﬂ') || '   '
            WHEN 2 THEN replace(replace(replace(text, ', ', ' 42.  '), 'or ', '7. JAVAScript' || $chr(10) || '  ' || $chr(9)), 'ed', 'ﬃ') ELSE text END AS text
FROM {documents}
""",
)


def _oracle_fixed() -> str:
    """The same rules in the oracle's functions, whose patterns look neither back nor ahead."""
    t = "CASE WHEN prose THEN regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g') ELSE text END"
    steps = [t]
    runs = "list_transform(string_split(t, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^ {3}') THEN repeat(' ', ((length(regexp_extract(l, '^ +')) - 1) // 2 + 1)) || ltrim(l, ' ') ELSE l END)"
    steps.append(f"array_to_string({runs}, chr(10))")
    steps.append("CASE WHEN regexp_matches(t, '^  ') THEN ' ' ELSE '' END || regexp_replace(regexp_replace(t, ' {2,}', ' ', 'g'), ' (\\n?)$', CASE WHEN regexp_matches(t, '  \\n?$') THEN '  \\1' ELSE ' \\1' END)")
    steps.append("regexp_replace(t, '(^|\\n)( +)\\t', '\\1\\2    ', 'g')")
    for lig, letters in LIGATURES.items():
        window = "substr(t, i::BIGINT, 30)"
        steps.append(f"CASE WHEN contains(t, chr({ord(lig)})) THEN array_to_string(list_transform(string_split(t, ''), lambda c, i: CASE WHEN c = chr({ord(lig)}) AND NOT contains({window}, '://') AND NOT contains({window}, '.com') AND NOT contains({window}, '.org') THEN '{letters}' ELSE c END), '') ELSE t END")
    steps.append("regexp_replace(t, '(\\d{1,3})\\.\\s+([A-Z][a-z]+)', '\\1.' || chr(10) || chr(10) || '\\2', 'g')")
    steps.append("regexp_replace(t, '(^|\\n)(\\([0-9]+\\)|\\[[0-9]+\\])\\s+', '\\1\\2' || chr(10), 'g')")
    ctes = [f"s0 AS (SELECT id, text, dict, prose, {steps[0]} AS t FROM (SELECT id, text, coalesce(cls, '') NOT IN ('code', 'console', 'table', 'syntax_diagram') AS dict, coalesce(cls, '') NOT IN ('code', 'console', 'table', 'syntax_diagram', 'formula') AS prose FROM {{scans}}))"]
    for i, s in enumerate(steps[1:], 1):
        ctes.append(f"s{i} AS (SELECT id, text, dict, prose, CASE WHEN prose THEN {s} ELSE t END AS t FROM s{i - 1})")
    t = "t"
    for _, old, new, exact in DICTIONARY:
        t = f"regexp_replace({t}, '{old}', '{new}', '{'g' if exact else 'gi'}')"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT id, CASE WHEN dict THEN {t} ELSE t END AS fixed FROM s{len(steps) - 1}"


@program("fn_ocr_rules", _oracle_fixed(), scans="scans")
def fn_ocr_rules(scans):
    """Texts after all rules and the dictionary, by class."""
    return corrected(scans).select("id", "fixed")


@program("fn_revert", "SELECT id, text FROM {scans}", scans="scans")
def fn_revert(scans):
    """Texts with all corrections undone by the log alone, which are the texts before them."""
    fixed = corrected(scans)
    return reverted(fixed, edit_log(fixed))


@program("fn_dictionary", "SELECT s.id, d.rule, ((length(s.text) - length(replace(s.text, d.old, ''))) // length(d.old))::BIGINT AS n FROM {scans} s, (VALUES ('D003', 'mySQL'), ('D005', 'pyhton')) d(rule, old) WHERE s.cls <> 'code' AND contains(s.text, d.old)", scans="scans")
def fn_dictionary(scans):
    """Corrections by the dictionary in each text."""
    return edit_log(corrected(scans)).where("rule LIKE 'D%'").groupBy("id", "rule").agg(F.count("*").alias("n")).where("rule IN ('D003', 'D005')")
