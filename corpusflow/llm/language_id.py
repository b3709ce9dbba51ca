"""Operator 7: language identification by nearest centroid.

A text is lower-cased, runs of other characters than letters become one space, and its character n-grams of one to
three are hashed to DIMENSIONS counts. Vectors are log(1 + tf) * idf, of length one. The training documents of a
language are clustered by spherical k-means; a text gets the language of the centroid with the largest cosine.
A cosine below what nearly all training documents of that cluster reach marks the prediction as rejected.

The model is fitted on at most TRAINING_ROWS labelled documents, those with the smallest hash of their id.
Defined cases: null text, or one without a letter, is `und` with score 0; with nothing to learn from all are `und`;
equal rows are predicted alike; ties go to the language first in order; an empty table gives no rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import _common as C

TRAINING_ROWS = 4_000
DIMENSIONS = 4_096
CLUSTERS = 4
ROUNDS = 12
REJECT_SHARE = 0.002
UNKNOWN = "und"
_MIX = np.uint32(0x9E3779B1)
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTER


def counts(texts: list[str], dims: int = DIMENSIONS) -> np.ndarray:
    """Hashed n-gram counts, one row per text; a text without letters has a row of zeros."""
    out = np.zeros((len(texts), dims), np.float32)
    code = np.frombuffer(("\n" + "\n".join(t.replace("\n", " ") for t in texts).lower() + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    doc = np.cumsum(code == 10) - 1
    letter = _letters()[code]
    code[~letter] = 32
    keep = letter | np.r_[True, letter[:-1]]  # the first of a run of other characters
    code, doc, letter = code[keep], doc[keep], letter[keep]
    doc = np.minimum(doc, len(texts) - 1)
    h = code * _MIX
    grams = [(h, letter)]
    h2 = (h[:-1] * np.uint32(31) + h[1:]) * _MIX
    grams.append((h2, (doc[:-1] == doc[1:]) & (letter[:-1] | letter[1:])))
    h3 = (h2[:-1] * np.uint32(31) + h[2:]) * _MIX
    grams.append((h3, (doc[:-2] == doc[2:]) & letter[1:-1]))
    shift = np.uint32(32 - (dims.bit_length() - 1))
    for h, ok in grams:
        at = np.flatnonzero(ok)
        out += np.bincount(doc[at] * dims + (h[at] >> shift).astype(np.int64), minlength=len(texts) * dims)[: len(texts) * dims].reshape(len(texts), dims)
    return out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(v: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from rows spread by farthest-first choice."""
    k = min(k, len(v))
    c = [v.mean(axis=0)]
    best = v @ c[0]
    for _ in range(k - 1):
        c.append(v[int(np.argmin(best))])
        best = np.maximum(best, v @ c[-1])
    c = np.stack(c)
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _features(df: DataFrame, dims: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tf = counts(batch.column("text").to_pylist(), dims)
        return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.astype(np.float32).tobytes() for r in tf], pa.binary())], names=["lang", "tf"])

    return C.map_chunks(df.select("lang", "text"), "text", "lang string, tf binary", work, 1 << 20)


def fit(docs: DataFrame, rows: int = TRAINING_ROWS, dims: int = DIMENSIONS, clusters: int = CLUSTERS) -> dict | None:
    """Model from at most `rows` of docs(doc_id, text, lang)."""
    usable = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "lang", "text")
    ids = usable.select(F.col("doc_id").alias("_id"), F.xxhash64(F.col("doc_id").cast("string")).alias("_r")).orderBy("_r", "_id").limit(rows)
    sample = usable.join(F.broadcast(ids.select("_id").distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    got = _features(sample, dims).toPandas()
    if not len(got):
        return None
    tf = np.stack([np.frombuffer(x, np.float32) for x in got["tf"]])
    langs = got["lang"].to_numpy()
    some = tf.any(axis=1)
    tf, langs = tf[some], langs[some]
    if not len(tf):
        return None
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    v = vectors(tf, idf)
    order = np.lexsort((v[:, 0], langs))
    v, langs = v[order], langs[order]
    centroids, names, least = [], [], []
    for lang in sorted(set(langs)):
        own = v[langs == lang]
        c = cluster(own, clusters)
        cos = own @ c.T
        near = np.argmax(cos, axis=1)
        for i in range(len(c)):
            if (near == i).any():
                centroids.append(c[i])
                names.append(lang)
                least.append(float(np.quantile(cos[near == i, i], REJECT_SHARE)))
    return {"idf": idf, "centroids": np.stack(centroids).astype(np.float32), "langs": names, "least": np.array(least, np.float32), "dims": dims}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of docs(doc_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        n = len(texts)
        lang, score, rejected = [UNKNOWN] * n, [0.0] * n, [True] * n
        if model:
            for a in range(0, n, 256):
                tf = counts(texts[a : a + 256], model["dims"])
                cos = vectors(tf, model["idf"]) @ model["centroids"].T
                best = np.argmax(cos, axis=1)
                for i in np.flatnonzero(tf.any(axis=1)).tolist():
                    j = int(best[i])
                    lang[a + i], score[a + i], rejected[a + i] = model["langs"][j], float(min(1.0, max(0.0, cos[i, j]))), bool(cos[i, j] < model["least"][j])
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return C.map_chunks(docs.select("doc_id", "text"), "text", "doc_id long, lang_pred string, score double, rejected boolean", work, 1 << 20)


def fold(doc_id: str, parts: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
