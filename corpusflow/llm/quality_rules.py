"""Operator 4: a rule bitmask ledger, in DataFrame functions only.

Each rule is evaluated once per document; the ledger keeps its measurements and one bit per failed rule.
A policy is a version number with the bits that reject, so a new policy, or what a document set would be
without one rule, is a bitwise aggregate over the ledger and never a second pass over the texts.

Windows of eight words are compared by 64-bit hashes inside one document. Their positions are sorted only
in documents where some window repeats. Defined cases: null or blank text has zero measurements and fails
`too_short`; very long texts are measured whole; equal rows give equal rows; ties do not arise; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import _common as C

#: Insults known from the start; matched as whole words in lower case.
TOXIC_WORDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
#: The words of other languages are learned from the labels: those in TOXIC_SUPPORT or more toxic documents, and in
#: TOXIC_ODDS times as many of them as of the others. At most LABELLED_ROWS labelled documents are used, which bounds the words too.
LABELLED_ROWS = 20_000
TOXIC_SUPPORT = 6
TOXIC_ODDS = 50
_PLAIN_WORDS = r"filter(split(lower(_text), '[^\\p{L}\\p{N}]+', -1), w -> w <> '')"
#: name -> SQL condition on the measurements, in the order of the bits.
RULES = {
    "too_short": "n_words < 20",
    "repeats_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words AND n_symbols >= 5",
    "shouting": "5 * n_bangs > n_words AND n_bangs >= 5",
    "repeats_lines": "n_lines >= 10 AND 2 * n_dup_lines > n_lines",
    "toxic": "n_toxic >= 1",
}
BASE_RULES = ("too_short", "repeats_words")
#: Policies by version: the rules that reject a document.
POLICIES = {1: BASE_RULES, 2: ("too_short", "repeats_words", "symbols", "shouting", "repeats_lines", "toxic")}
POLICY = 2
WINDOW = 8


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def toxic_words(docs: DataFrame, labels: DataFrame) -> list[str]:
    """Words that mark a toxic text: TOXIC_WORDS and those learned from labels(doc_id, toxic)."""
    sample = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "toxic").limit(LABELLED_ROWS)
    words = docs.select("doc_id", F.col("text").alias("_text")).where("_text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("toxic", F.explode(F.array_distinct(F.expr(_PLAIN_WORDS))).alias("word"))
    counts = words.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") != 1).alias("good"))
    found = counts.where((F.col("bad") >= TOXIC_SUPPORT) & (F.col("bad") >= TOXIC_ODDS * F.col("good")))
    return sorted({*TOXIC_WORDS, *(r.word for r in found.select("word").collect())})


def ledger(docs: DataFrame, keep: tuple[str, ...] = (), lexicon: list[str] | None = None) -> DataFrame:
    """doc_id, the columns `keep`, measurements (long) and fail_bits (long) of docs(doc_id, text)."""
    marks = F.array(*(F.xxhash64(F.lit(w)) for w in lexicon or TOXIC_WORDS))
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", *keep, text.alias("_text"))
    df = df.withColumns(
        {
            "_words": F.expr(r"filter(split(_text, '[\\x20\\x09-\\x0D]+', -1), w -> w <> '')"),
            "_lines": F.expr(r"filter(split(_text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
            "n_symbols": F.size(F.split("_text", r"[#*$%&|<>]", -1)).cast("long") - 1,
            "n_bangs": F.size(F.split("_text", "!!", -1)).cast("long") - 1,
            "n_toxic": F.size(F.array_intersect(F.expr(f"transform({_PLAIN_WORDS}, w -> xxhash64(w))"), marks)).cast("long"),
        }
    ).drop("_text")
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.expr("transform(_words, w -> xxhash64(w))"),
        }
    ).drop("_words", "_lines")
    for step in (1, 2, 4):
        df = df.withColumn("_h", F.expr(f"zip_with(_h, slice(_h, {step + 1}, size(_h)), (a, b) -> xxhash64(a, b))"))
    df = df.withColumn("_h", F.expr(f"slice(_h, 1, cast(greatest(n_words - {WINDOW - 1}, 0) as int))"))
    df = df.withColumn("_h", F.expr("if(size(array_distinct(_h)) < size(_h), _h, null)"))
    df = df.withColumn("_h", F.expr("if(_h is null, null, sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i))))"))
    df = df.withColumn("_h", F.expr("if(_h is null, null, sort_array(transform(filter(_h, (x, j) -> x.h = get(_h, j - 1).h OR x.h = get(_h, j + 1).h), x -> x.i)))"))
    covered = f"aggregate(zip_with(_h, slice(_h, 2, size(_h)), (a, b) -> least(b - a, {WINDOW})), 0L, (n, x) -> n + x)"
    df = df.withColumn("n_repeat_words", F.expr(f"if(_h is null, 0L, {covered})")).drop("_h")
    bits = None
    for i, rule in enumerate(RULES.values()):
        bit: Column = F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return df.withColumn("fail_bits", bits)


def verdict(book: DataFrame, policy: int = POLICY) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    return book.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask(BASE_RULES))) != 0).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask({*POLICIES[policy], *BASE_RULES}))) == 0)


def passing(book: DataFrame) -> DataFrame:
    """Rows of a verdict that are kept. A row number, which no filter passes, keeps the optimiser from copying the rules' expressions into the filter, where each use of one would be spelled out again."""
    return book.withColumn("_row", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_row") >= 0)).drop("_row")


def ablations(book: DataFrame, policy: int = POLICY) -> DataFrame:
    """One row per rule: documents it fails, documents only it rejects under the policy, and those kept without it."""
    used = mask(POLICIES[policy])
    hit = F.col("fail_bits").bitwiseAND(F.lit(used))
    sums = []
    for name in RULES:
        bit = mask([name])
        sums += [F.count_if(F.col("fail_bits").bitwiseAND(F.lit(bit)) != 0).alias(f"{name}_failed"), F.count_if((hit == bit) & F.lit(bool(used & bit))).alias(f"{name}_only"), F.count_if(F.col("fail_bits").bitwiseAND(F.lit(used & ~bit)) == 0).alias(f"{name}_kept")]
    one = book.agg(*sums)
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"{n}_failed").alias("failed"), F.col(f"{n}_only").alias("rejected_alone"), F.col(f"{n}_kept").alias("kept_without")) for n in RULES))).alias("r")).select("r.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    book = verdict(ledger(docs, lexicon=toxic_words(docs, C.table(spark, sf_dir, "labels"))))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t WHERE len(words) >= 8)
), rep AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1
), cov AS (SELECT doc_id, sum(least(coalesce(nxt - i, 8), 8))::BIGINT AS n FROM rep GROUP BY doc_id),
plain AS (
  SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda w: w <> ''))) AS word FROM t
), lexicon AS (
  SELECT unnest(['clown', 'disgusting', 'idiot', 'loser', 'moron', 'pathetic', 'scum', 'stupid', 'trash', 'worthless']) AS word
  UNION
  SELECT word FROM (
    SELECT word, count(*) FILTER (WHERE toxic = 1) AS bad, count(*) FILTER (WHERE toxic <> 1) AS good
    FROM plain JOIN (SELECT doc_id, toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL ORDER BY md5(doc_id::VARCHAR), doc_id, toxic LIMIT 20000) USING (doc_id)
    GROUP BY word HAVING bad >= 6 AND bad >= 50 * good)
), tox AS (SELECT doc_id, count(*) AS n FROM plain WHERE word IN (SELECT word FROM lexicon) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         ((length(text) - length(replace(text, '!!', ''))) // 2)::BIGINT AS n_bangs,
         coalesce(tox.n, 0)::BIGINT AS n_toxic,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id LEFT JOIN tox ON t.doc_id = tox.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR (10 * n_symbols > n_words AND n_symbols >= 5)
            OR (5 * n_bangs > n_words AND n_bangs >= 5) OR (n_lines >= 10 AND 2 * n_dup_lines > n_lines) OR n_toxic >= 1) AS kept,
       ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words AND n_symbols >= 5)::BIGINT
        + 8 * (5 * n_bangs > n_words AND n_bangs >= 5)::BIGINT + 16 * (n_lines >= 10 AND 2 * n_dup_lines > n_lines)::BIGINT + 32 * (n_toxic >= 1)::BIGINT)::BIGINT AS fail_bits
FROM m
"""
