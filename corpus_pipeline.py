"""A corpus pipeline of five operators: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as
the next one's docs. All but the last keep the columns of documents; other columns do not pass, whatever their names.

Defined cases, for every stage: null and blank texts are too short for the first stage and pass the others as empty
texts would; a null doc_id is a document of its own; equal rows are judged alike, and near-dedup keeps one of them;
ties between near-duplicates go to the smallest doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import _common as C
from corpusflow.llm import decontamination, line_dedup, packing, quality_rules, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ledger's policy keeps."""
    lexicon = quality_rules.toxic_words(docs, C.table(spark, sf_dir, "labels"))
    book = quality_rules.verdict(quality_rules.ledger(docs.withColumn("_text_kept", F.col("text")), ("_text_kept", "lang", "source", "n_chars"), lexicon))
    return quality_rules.passing(book).withColumnRenamed("_text_kept", "text").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them hold; n_chars follows the text."""
    return line_dedup.drop_frequent(docs).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, its smallest doc_id; of equal rows one.

    Sets of five-word shingles of similarity 0.8 or more are linked: wide SimHash fingerprints propose links, an index finds the rest, all are checked."""
    docs = docs.select(*COLUMNS)
    return simhash.one_of_each(docs, simhash.wide_groups(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaks(docs.select(*COLUMNS), C.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate), ("packing", pack)]

#: SQL has no byte-level BPE; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
