"""Operator 8: line deduplication over levelled sorted runs of line hashes.

A store keeps, for each 128-bit line key, the number of documents that hold it, in runs sorted by key.
A batch is counted, its new run goes to level 0, and whenever a level has `fanout` runs they are merged
into one of the next level, so a key is rewritten once a level. A new batch can be anti-joined with the runs
(`unseen`), and keys that reach a document count can be read from them (`frequent`).

A key is the line stripped of ASCII white space with A-Z lower-cased. Defined cases: null or empty text is one
empty line; keys shorter than `min_chars` never count; equal lines in one document count once; equal rows
are equal documents with one id, counted once; null doc_id is a document of its own; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import _common as C

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 2
RUN = "k1 long, k2 long, n_docs long"
#: How many rows and places of lines to drop may be sent to every executor, some 16 bytes each.
BROADCAST_ENTRIES = 1_000_000


class LineRuns:
    """Levels of runs in the shared folder; the manifest is a list of (level, path), kept by the driver."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, path: str | None = None):
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{C.scratch_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.runs: list[tuple[int, str]] = []

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(path)

    def _write(self, counts: DataFrame, level: int) -> None:
        path = f"{self.path}/level={level}/{uuid.uuid4().hex}"
        counts.sortWithinPartitions("k1", "k2").write.parquet(path)
        self.runs.append((level, path))

    def merged(self, level: int | None = None) -> DataFrame:
        """The runs of a level, or all, with one row per key."""
        own = [self._read(p) for at, p in self.runs if level is None or at == level]
        if not own:
            return self.spark.createDataFrame([], RUN)
        if len(own) == 1:
            return own[0]
        return reduce(DataFrame.unionAll, own).groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of keys(k1, k2, ...) that no run holds."""
        return keys.join(self.merged().select("k1", "k2"), ["k1", "k2"], "left_anti")

    def add(self, keys: DataFrame) -> None:
        """Count keys(k1, k2), one row per document and key, as a new run, then compact."""
        self._write(keys.groupBy("k1", "k2").agg(F.count("*").alias("n_docs")), 0)
        level = 0
        while len(own := [x for x in self.runs if x[0] == level]) >= self.fanout:
            merged = self.merged(level)
            self._write(merged, level + 1)
            self.runs = [x for x in self.runs if x not in own]
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        return self.merged().where(F.col("n_docs") >= min_docs).select("k1", "k2")


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (_d, _t, at, k1, k2, first): each line whose key is long enough, its place, and whether it is its document's first of that key."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        d, t, at, keys, first = [], [], [], [], []
        for one_d, one_t, text in zip(batch.column("_d").to_pylist(), batch.column("_t").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            seen = set()
            for i, line in enumerate((text or b"").split(b"\n")):
                key = line.strip(C.SPACE_BYTES).lower()
                if len(key) < min_chars or min_chars > 1 and len(key.decode()) < min_chars:
                    continue
                k = xxhash.xxh3_128_digest(key)
                d.append(one_d)
                t.append(one_t)
                at.append(i)
                keys.append(k)
                first.append(k not in seen)
                seen.add(k)
        k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(at, pa.int32()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(first, pa.bool_())], names=["_d", "_t", "at", "k1", "k2", "first"])

    return C.map_chunks(docs.select(*C.row_key(), "text"), "text", "_d long, _t long, at int, k1 long, k2 long, first boolean", work)


def _flags(drop: str, n) -> Column:
    """Whether each of n places is in the sorted array `drop`: runs of false between its members, in one pass over it."""
    last = F.when(F.size(drop) > 0, F.element_at(drop, -1)).otherwise(-1)
    before = F.concat(F.array(F.lit(-1)), F.slice(drop, 1, F.size(drop) - 1))
    runs = F.zip_with(drop, before, lambda x, y: F.concat(F.array_repeat(F.lit(False), x - y - 1), F.array(F.lit(True))))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(False), n - last - 1))


def drop_frequent(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with text rid of lines whose key is in min_docs documents, and n_lines, n_dropped (long).

    Other columns stay; those named _d, _t, _lines, _drop, _flags, n_lines or n_dropped are replaced or dropped.
    """
    spark = docs.sparkSession
    keys = C.materialize(line_keys(docs, min_chars), "line-keys")
    store = LineRuns(spark, fanout)
    # a document is known by its id; rows of one id and different texts count a shared key once
    once = keys.where("first").dropDuplicates(["_d", "k1", "k2"]) if min_docs > 1 else keys
    for b in range(batches):
        store.add(once.where(F.pmod(F.xxhash64("_d"), F.lit(batches)) == b) if batches > 1 else once)
    dropped = keys.join(store.frequent(min_docs), ["k1", "k2"], "left_semi").groupBy("_d", "_t").agg(F.sort_array(F.collect_set("at")).alias("_drop"))
    dropped = C.materialize(dropped, "line-drops")
    if dropped.agg(F.coalesce(F.sum(F.size("_drop") + 2), F.lit(0))).first()[0] <= BROADCAST_ENTRIES:
        dropped = F.broadcast(dropped)
    keyed = docs.withColumns(dict(zip(("_d", "_t"), C.row_key())))
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    return (
        keyed.join(dropped, ["_d", "_t"], "left")
        .withColumn("_lines", lines)
        .withColumn("_flags", F.when(F.col("_drop").isNotNull(), _flags("_drop", F.size("_lines"))))
        .withColumn("text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(F.expr("transform(filter(arrays_zip(_lines, _flags), p -> NOT p._flags), p -> p._lines)"), "\n")))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dropped", F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop")).cast("long"))
        .drop("_d", "_t", "_lines", "_drop", "_flags")
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, list_extract(ls, i) AS line,
         translate(regexp_replace(list_extract(ls, i), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), hot AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM hot)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM hot)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
"""
