"""Inline marks of note lines with their spans, how deep they nest, and marks that never close.

All patterns run over a line at once; where a match begins follows from the lengths between matches, summed in a window, and how many marks are open
there from the beginnings and ends on one line of positions. An opening sign that no mark takes is reported as `unclosed`.
A null line has no marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import program, table

# Kinds of marks and their forms, in order.
MARKS = {
    "source-ref": r"\{src:(blk_[0-9a-f]{12})\}",
    "term-ref": r"\[\[term:([a-z][a-z0-9-]*)\]\]",
    "link-note": r"\[\[note:([a-zA-Z0-9_-]+)\]\]",
    "placeholder": r"\{\{([a-zA-Z][a-zA-Z0-9_-]*)\}\}",
    "derived": r"\{derived\}",
    "external": r"\{external\}",
    "footnote-ref": r"\[\[fn:([a-zA-Z0-9_-]+)\]\]",
    "keyboard": r"\[\[kbd:([^\]]+)\]\]",
    "deleted": r"~~([^~]+)~~",
    "layer-mark": r"\{layer:(l1|l2|l3)\}",
    "math-inline": r"\$([^$]+)\$",
}
#: Signs that open a mark; one that stands outside every mark is unclosed.
OPENERS = r"\{\{|\[\[|~~|\$|\{src:|\{layer:"
UNCLOSED = "unclosed"
_ANY = "|".join(f"(?:{p})" for p in MARKS.values()) + f"|({OPENERS})"


def marks(lines: DataFrame) -> DataFrame:
    """id, kind, match, value (what the mark holds), start and stop from 0, and depth, the number of marks around it, of lines(id, line)."""
    df = lines.where("line IS NOT NULL").select("id", "line")
    each = []
    for kind, pattern in [*MARKS.items(), (UNCLOSED, _ANY)]:
        found = f"regexp_extract_all(line, r'{pattern}', 0)"
        group = sum(p.count("(") - p.count(r"\(") - p.count("(?:") for p in MARKS.values()) + 1 if kind == UNCLOSED else int("(" in pattern)
        # the whole match of an opening sign is its value; in marks of the joint pattern that group is empty
        each.append(F.struct(F.lit(kind).alias("kind"), F.expr(found).alias("found"), F.expr(f"regexp_extract_all(line, r'{pattern}', {group})").alias("value"), F.expr(f"transform(split(line, r'{pattern}', -1), x -> length(x))").alias("gaps")))
    rows = df.select("id", F.explode(F.array(*each)).alias("m")).where("size(m.found) > 0")
    rows = rows.select("id", "m.kind", F.posexplode(F.arrays_zip("m.found", "m.value", F.slice("m.gaps", F.lit(1), F.size("m.found")).alias("gaps")))).select("id", "kind", "pos", "col.*")
    w = Window.partitionBy("id", "kind").orderBy("pos")
    stop = F.sum(F.col("gaps") + F.length("found")).over(w)
    rows = rows.select("id", "kind", F.col("found").alias("match"), F.when(~F.col("kind").isin("derived", "external"), F.col("value")).alias("value"), (stop - F.length("found")).cast("long").alias("start"), stop.cast("long").alias("stop"))
    rows = rows.where(f"kind <> '{UNCLOSED}' OR value <> ''")
    ends = rows.select("*", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("open")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("open")))).alias("e")).where(f"e.open = 1 OR kind <> '{UNCLOSED}'")
    # at one place marks close before others open, and the longer opens first
    line = Window.partitionBy("id").orderBy("e.at", "e.open", F.desc("stop"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.when(F.col("kind") == UNCLOSED, 0).otherwise(F.col("e.open"))
    return ends.withColumn("depth", F.coalesce(F.sum(weight).over(line), F.lit(0)).cast("long")).where("e.open = 1").select("id", "kind", "match", "value", "start", "stop", "depth")


table(
    "marked_lines",
    """
SELECT $text(doc_id) || '-' || $text(block_index) AS id, CASE block_index % 13
  WHEN 0 THEN content || ' {src:blk_' || block_id || '}' WHEN 1 THEN '~~' || $extract(content, r'^[^ ]+', 0) || ' [[term:a-b]] ' || '{' || 'derived}~~ and [[term:open' WHEN 2 THEN content || ' [[note:note_' || $text(doc_id) || ']][[fn:1]]'
  WHEN 3 THEN '{{' || 'name}} of ' || content || ' {{9}}' WHEN 4 THEN '[[kbd:Ctrl+' || source || ']] {' || 'external}' WHEN 5 THEN '$x + {{' || 'y}}$ is $' WHEN 6 THEN content || ' {layer:l2} {layer:l4}'
  WHEN 7 THEN '~~a~~b~~c' WHEN 8 THEN '$a$' || content || '$b$' ELSE content END AS line
FROM {blocks}
""",
)


def _oracle() -> str:
    """Positions by looking for each match behind the one before it."""
    parts = []
    for kind, pattern in [*MARKS.items(), (UNCLOSED, _ANY)]:
        parts.append(f"SELECT id, '{kind}' AS kind, line, regexp_extract_all(line, '{pattern}') AS found, string_split_regex(line, '{pattern}') AS gaps FROM {{lines}} WHERE regexp_matches(line, '{pattern}')")
    value = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_extract(match, '{p}', 1)" for k, p in MARKS.items() if "(" in p) + f" WHEN '{UNCLOSED}' THEN match END"
    return (
        "WITH m AS ("
        + "\nUNION ALL ".join(parts)
        + f"""),
x AS (SELECT id, kind, i, found[i] AS match, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0))::BIGINT AS start FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)),
s AS (SELECT id, kind, match, {value} AS value, start, start + length(match) AS stop FROM x WHERE kind <> '{UNCLOSED}' OR regexp_full_match(match, '{OPENERS}'))
SELECT s.id, s.kind, s.match, s.value, s.start, s.stop, (SELECT count(*) FROM s o WHERE o.id = s.id AND o.kind <> '{UNCLOSED}' AND o.start <= s.start AND o.stop > s.start AND (o.start, -o.stop) < (s.start, -s.stop)) AS depth FROM s
"""
    )


@program("fn_inline_marks", _oracle(), lines="marked_lines")
def fn_inline_marks(lines):
    """Inline marks with spans and depth, and unclosed ones."""
    return marks(lines)
