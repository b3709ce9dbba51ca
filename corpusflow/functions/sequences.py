"""Functions that SQL does not express: sequence similarity, LaTeX and bracket checks, in Arrow batches; and de-hyphenation, in SQL."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.ratios import Known, ratio
from corpusflow.plans import adapters  # noqa: F401  the tables that operators name
from corpusflow.plans.catalog import apply, engine_table, operator, rows_only
from corpusflow.plans.dialect import duck_sql
from corpusflow.plans.durable import written

#: Characters that the similarity compares, as the operator is defined.
COMPARED = 4000
#: Notes of one block that a task compares with as many others; how the work is dealt, not what is compared.
DEALT = 256
PAIRS = {"(": ")", "[": "]", "{": "}"}
# What a formula may hold, and which words keep their hyphen.
NESTED = 5
KNOWN_ENVIRONMENTS = frozenset("equation equation* align align* aligned matrix pmatrix bmatrix vmatrix Vmatrix smallmatrix cases gathered alignat split eqnarray eqnarray* multline".split())
KNOWN_COMMANDS = frozenset(
    """
    frac sum int sqrt prod coprod
    alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi varpi rho varrho sigma varsigma tau
    upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega
    infty partial nabla forall exists nexists cdot times div pm mp ast star cup cap setminus
    subset supset subseteq supseteq in ni notin leq le geq ge neq ne approx equiv sim simeq cong propto
    to rightarrow leftarrow Rightarrow Leftarrow leftrightarrow Leftrightarrow mapsto hookrightarrow uparrow downarrow
    lim liminf limsup sup inf max min arg gcd det Pr bmod pmod bar hat tilde vec dot ddot widehat widetilde
    overline underline overbrace underbrace text mathrm mathbf mathit mathcal mathbb mathfrak
    begin end left right big Big bigg Bigg label ref tag quad qquad binom tbinom substack xleftarrow xrightarrow
    overset underset stackrel boxed
    """.split()
)
COMPOUND_PREFIXES = frozenset("non pre post anti semi multi self cross well ill high low long short state real end least mean inter intra sub co re half full single double high-dimensional".split())
COMPOUND_TAILS = frozenset("based free like wise world time scale order level specific aware dependent independent driven informed valued agnostic oriented bound tuned art off line".split())


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    known = Known()
    return pd.Series([ratio(known(x[:COMPARED]), known(y[:COMPARED])) if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


def sequence_ratio(a, b):
    """Column of 2 M / T of the first COMPARED characters; 0 if one is empty."""
    return F.pandas_udf(_ratios, "double")(a, b)


def latex_errors(text: str) -> list[str]:
    """Braces, nesting, environments and orphan scripts."""
    if not text.strip():
        return ["nothing in the formula"]
    out = []
    for opener, closer, name in (("{", "}", "braces"), ("[", "]", "brackets")):
        depth = deepest = 0
        for c in text:
            depth += (c == opener) - (c == closer)
            deepest = max(deepest, depth)
            if depth < 0:
                break
        if depth:
            out.append(f"{name} do not pair")
        if opener == "{" and deepest > NESTED:
            out.append("braces nest too deep")
    stack = []
    for what, name in re.findall(r"\\(begin|end)\{([^}]*)\}", text):
        if what == "begin":
            if name not in KNOWN_ENVIRONMENTS:
                out.append(f"environment {name} is not known")
            stack.append(name)
        elif not stack or stack.pop() != name:
            out.append(f"environment {name} ends unbegun")
    out += [f"environment {n} does not end" for n in stack]
    out += [f"command {c} is not known" for c in re.findall(r"\\([a-zA-Z]+)", text) if c not in KNOWN_COMMANDS]
    if re.search(r"(?:^|[=+\-*/,;(\[{\s])[_^]", text):
        out.append("script without a base")
    return out


def _latex(text: pd.Series) -> pd.Series:
    return text.map(lambda t: "; ".join(latex_errors(t or "")))


def latex_check(text):
    """Column of the errors of a formula, joined; empty if there are none."""
    return F.pandas_udf(_latex, "string")(text)


def fix_brackets(text: str, language: str) -> str:
    """Missing closers added, only where that makes the text parse; else the text as it is."""
    stack = []
    for c in text:
        if c in PAIRS:
            stack.append(PAIRS[c])
        elif c in PAIRS.values() and (not stack or stack.pop() != c):
            return text
    candidate = text + "".join(reversed(stack))
    parse = {"python": ast.parse, "json": json.loads}.get(language)
    if parse is None or candidate == text:
        return candidate
    try:
        parse(candidate)
    except (SyntaxError, ValueError):
        return text
    return candidate


def _brackets(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([fix_brackets(t or "", k) for t, k in zip(text, language)])


def bracket_fix(text, language):
    """Column of texts with missing closers added where that makes them parse."""
    return F.pandas_udf(_brackets, "string")(text, language)


def _listed(words: frozenset) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


_HEAD = r"^([a-z](?:[a-z-]*[a-z])?)([.,;:)\]]*)[ \t]+[^ \t]"
_DEHYPHENATED = f"""
WITH pairs AS (
  SELECT doc_id, block_index, text, type = 'paragraph' AND lead(type) OVER w = 'paragraph' AND abs(font_size - lead(font_size) OVER w) <= 0.5 AS joinable,
         lower($extract(text, r'([A-Za-z]+)-[ \t]*$', 1)) AS prefix, $extract(lead(text) OVER w, r'{_HEAD}', 1) AS word, $extract(lead(text) OVER w, r'{_HEAD}', 2) AS punct
  FROM {{fragments}} WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)
), cuts AS (SELECT doc_id, block_index, prefix, word, punct FROM pairs WHERE joinable AND length(prefix) >= 2 AND length(word) >= 1),
vocabulary AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, $explode($all_matches(lower(text), r'[a-z]+(?:-[a-z]+)*')) AS w FROM {{fragments}})),
moves AS (
  SELECT c.doc_id, c.block_index, c.word || c.punct AS moved,
         CASE WHEN parted.w IS NOT NULL THEN TRUE WHEN whole.w IS NOT NULL THEN FALSE ELSE c.prefix IN ({_listed(COMPOUND_PREFIXES)}) OR c.word IN ({_listed(COMPOUND_TAILS)}) OR $matches(c.word, r'-') END AS kept
  FROM cuts c LEFT JOIN vocabulary parted ON parted.doc_id = c.doc_id AND parted.w = c.prefix || '-' || c.word
       LEFT JOIN vocabulary whole ON whole.doc_id = c.doc_id AND whole.w = c.prefix || c.word
), marked AS (
  SELECT p.doc_id, p.block_index, p.text, m.moved, m.kept, lag(m.moved) OVER (PARTITION BY p.doc_id ORDER BY p.block_index) AS taken
  FROM pairs p LEFT JOIN moves m ON m.doc_id = p.doc_id AND m.block_index = p.block_index
), bodies AS (SELECT doc_id, block_index, moved, kept, taken, CASE WHEN taken IS NULL THEN text ELSE $replace_all(substr(text, length(taken) + 1), r'^[ \t]+', '') END AS body FROM marked)
SELECT doc_id, block_index, CASE WHEN moved IS NULL THEN body WHEN kept THEN $replace_all(body, r'[ \t]+$', '') || moved ELSE $replace_all(body, r'-[ \t]*$', '') || moved END AS text, moved, kept
FROM bodies
"""
# Spark's form of the same: fragments are dealt once, by document, and no word is. The words that the cuts of a document ask for come to its fragments, and those that a
# fragment has come back. A row without a document or a place is joined with nothing.
_WORDS = r"[a-z]+(?:-[a-z]+)*"
operator(
    "fn_dehyphenate",
    f"""
WITH pairs AS (
  SELECT doc_id, block_index, text, doc_id IS NOT NULL AND block_index IS NOT NULL AND type = 'paragraph' AND lead(type) OVER w = 'paragraph' AND abs(font_size - lead(font_size) OVER w) <= 0.5 AS joinable,
         lower($extract(text, r'([A-Za-z]+)-[ \t]*$', 1)) AS prefix, $extract(lead(text) OVER w, r'{_HEAD}', 1) AS word, $extract(lead(text) OVER w, r'{_HEAD}', 2) AS punct
  FROM {{fragments}} WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)
), cuts AS (SELECT doc_id, block_index, text, prefix, word, punct, coalesce(joinable AND length(prefix) >= 2 AND length(word) >= 1, false) AS cut FROM pairs),
asked AS (SELECT doc_id, block_index, text, prefix, word, punct, cut, flatten(collect_set(CASE WHEN cut THEN array(prefix || '-' || word, prefix || word) END) OVER (PARTITION BY doc_id)) AS asked FROM cuts),
had AS (SELECT doc_id, block_index, text, prefix, word, punct, cut, CASE WHEN size(asked) = 0 THEN array() ELSE array_intersect($all_matches(lower(text), r'{_WORDS}'), asked) END AS had FROM asked),
known AS (SELECT doc_id, block_index, text, prefix, word, punct, cut, flatten(collect_set(CASE WHEN size(had) > 0 THEN had END) OVER (PARTITION BY doc_id)) AS known FROM had),
moves AS (
  SELECT doc_id, block_index, text, CASE WHEN cut THEN word || punct END AS moved,
         CASE WHEN NOT cut THEN NULL WHEN array_contains(known, prefix || '-' || word) THEN TRUE WHEN array_contains(known, prefix || word) THEN FALSE ELSE prefix IN ({_listed(COMPOUND_PREFIXES)}) OR word IN ({_listed(COMPOUND_TAILS)}) OR $matches(word, r'-') END AS kept
  FROM known
), marked AS (SELECT doc_id, block_index, text, moved, kept, lag(moved) OVER (PARTITION BY doc_id ORDER BY block_index) AS taken FROM moves),
bodies AS (SELECT doc_id, block_index, moved, kept, taken, CASE WHEN taken IS NULL THEN text ELSE $replace_all(substr(text, length(taken) + 1), r'^[ \t]+', '') END AS body FROM marked)
SELECT doc_id, block_index, CASE WHEN moved IS NULL THEN body WHEN kept THEN $replace_all(body, r'[ \t]+$', '') || moved ELSE $replace_all(body, r'-[ \t]*$', '') || moved END AS text, moved, kept
FROM bodies
""",
    "Words cut at the end of a fragment joined with the first word of the next one of the same size, which keeps a word; the hyphen stays where the document's other words or fixed lists say so.",
    oracle=duck_sql(_DEHYPHENATED),
)


@rows_only("fn_dehyphenate")
def fn_dehyphenate(spark, sf_dir):
    made: dict[str, DataFrame] = {}
    made["blocks"] = engine_table(spark, sf_dir, "dealt_blocks", made)
    return apply("fn_dehyphenate", fragments=engine_table(spark, sf_dir, "fragments", made))


def candidate_pairs(notes: DataFrame) -> DataFrame:
    """Pairs of notes of one type blocked by the start of their title; lengths must allow a ratio of 0.4.

    A block is dealt into parts of some DEALT notes, and each pair of its parts is a key, so that no task has all pairs of a large block."""
    kept = written(notes.select("note_id", "note_type", F.substring(F.lower("title"), 1, 12).alias("block"), "body"), "notes")
    block = ["note_type", "block"]
    large = kept.groupBy(*block).agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts")).where("parts > 1")
    dealt = kept.join(large, block, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("note_id"), F.col("parts").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    a = dealt.select(F.col("note_id").alias("a"), *block, F.col("part").alias("p"), F.col("other").alias("q"), F.col("body").alias("body_a"))
    b = dealt.select(F.col("note_id").alias("b"), *block, F.col("other").alias("p"), F.col("part").alias("q"), F.col("body").alias("body_b"))
    la, lb = F.length("body_a"), F.length("body_b")
    return a.join(b, [*block, "p", "q"]).where("a < b").where(2 * F.least(la, lb) >= 0.4 * (la + lb)).drop("p", "q")


def _notes(spark, sf_dir):
    body = engine_table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, COMPARED).alias("body"))
    return engine_table(spark, sf_dir, "notes").join(body, "doc_id")


def decided_pairs(notes: DataFrame) -> DataFrame:
    """Decisions on the candidate pairs of notes(note_id, note_type, title, aliases, body) by the similarity of their texts."""
    named = notes.select("note_id", F.lower("title").alias("title"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    pairs = candidate_pairs(notes).select("a", "b", sequence_ratio("body_a", "body_b").alias("sim"))
    both = pairs.join(named.toDF("a", "ta", "la"), "a").join(named.toDF("b", "tb", "lb"), "b")
    return apply("sim_pair_decision", pairs=both.select("a", "b", (F.col("ta") == F.col("tb")).alias("canonical"), F.arrays_overlap("la", "lb").alias("alias"), "sim"))


@rows_only("sim_sequence_ratio")
def sim_sequence_ratio(spark, sf_dir):
    return candidate_pairs(_notes(spark, sf_dir)).select("a", "b", F.round(sequence_ratio("body_a", "body_b"), 6).alias("ratio"))


@rows_only("dup_redefinition")
def dup_redefinition(spark, sf_dir):
    """Concepts defined again outside their first chapter with a ratio above one half."""
    units = engine_table(spark, sf_dir, "units").where("type = 'definition' AND length(term) >= 4").select("source_hash", "term", "doc_id", "content")
    first = units.groupBy("source_hash", "term").agg(F.min_by("content", "doc_id").alias("canonical"), F.min("doc_id").alias("home"))
    again = units.join(first, ["source_hash", "term"]).where("doc_id <> home")
    return again.select("source_hash", "term", "home", "doc_id", F.round(sequence_ratio("canonical", "content"), 6).alias("ratio")).where("ratio > 0.5")


@rows_only("fn_latex_validate")
def fn_latex_validate(spark, sf_dir):
    formula = F.concat(F.lit("\\begin{cases} x_{"), F.col("region_id").cast("string"), F.when(F.col("page") % 3 == 0, "}").otherwise("} \\end{cases}"))
    return engine_table(spark, sf_dir, "regions").where("cls = 'formula'").select("page", "region_id", latex_check(formula).alias("errors"))


@rows_only("fn_bracket_fix")
def fn_bracket_fix(spark, sf_dir):
    text = F.concat(F.lit("f(["), F.col("page").cast("string"), F.when(F.col("page") % 2 == 0, "])").otherwise(", 2"))
    return engine_table(spark, sf_dir, "regions").where("cls = 'code'").select("page", "region_id", bracket_fix(text, F.lit("python")).alias("fixed"))
