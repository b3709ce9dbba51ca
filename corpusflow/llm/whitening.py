"""Operator 13: embedding whitening by digit-slice products.

The moments of the distinct integer vectors are exact: every task splits its vectors into limbs of LIMB bits, so
that a float64 product over TILE rows stays below 2^53, recombines the limb products as big integers and sends them as 32-bit digits.
Spark adds the digits, digit by digit, and only the d x d sums reach the driver, where they become the covariance without any cancellation
and are eigendecomposed. A last pass over all rows projects them; the check of the covariance of what
was projected is an aggregate over the distinct vectors.

Defined cases: rows with a null vector or a null, NaN or infinite entry are dropped; a null vec_id is kept; repeated vectors count once in
the fit, and each of their rows is returned; shorter vectors count as if filled up with zeros; equal eigenvalues are in the
order that the decomposition gives them, the same for all rows; a component without variance has a null `whitened` and counts in no
error; a deviation beyond a long is null; fewer than four dimensions give as many components; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import _common as C
from corpusflow.llm import _vectors as V

COMPONENTS = 4
#: Rows of one product, and bits of a limb: TILE * 2^(2 * LIMB) < 2^53.
TILE = 4096
LIMB = 20
_DIGIT = 32
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """float64 matrices whose sum, each times 2^(LIMB * its place), is x; all but the last lie in 0 .. 2^LIMB - 1."""
    out = []
    while V.largest(x) >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def gram(x: np.ndarray) -> np.ndarray:
    """x' x of at most TILE rows of int64, as Python integers."""
    parts = limbs(x)
    total = np.zeros((x.shape[1],) * 2, object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total = total + ((a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j)))
    return total


def moment_digits(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(i, j, k, digit): the entries of the moments of [x, 1] over a split are the sums of digit * 2^(_DIGIT k)."""
    total = np.zeros((width + 1,) * 2, object)
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            x = V.matrix(batch.column("x").slice(at, TILE), width)
            total = total + gram(np.hstack([x, np.ones((len(x), 1), np.int64)]))
    i, j = np.triu_indices(width + 1)
    rest, k = total[i, j], 0
    while (rest != 0).any():
        last = max(abs(v) for v in rest) < 1 << 62
        digit = rest if last else rest & ((1 << _DIGIT) - 1)
        rest = rest * 0 if last else rest >> _DIGIT
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), k), pa.int32()), pa.array(digit.astype(np.int64))], ["i", "j", "k", "digit"])
        k += 1


@dataclass
class Whitening:
    n: int
    #: Sums of each dimension, exact.
    sums: list[int]
    #: Component c is the row c of vectors, with the variance values[c].
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """x - mean along the components, over their standard deviation; NaN where there is no variance."""
        mean = np.array([s / self.n for s in self.sums])
        scale = np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (x - mean) @ self.vectors.T / scale

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n x - S)^2 of each row, as Python integers where int64 could overflow."""
        bound = self.n * V.largest(x) + max(map(abs, self.sums), default=0)
        kind = np.int64 if bound * bound * max(len(self.sums), 1) < 1 << 62 else object
        off = x.astype(kind) * self.n - np.array(self.sums, kind)
        return (off * off).sum(axis=1)


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of distinct(x); None of no vectors."""
    # the digits are below 2^62 and as decimals their sum has room for 2^60 tasks
    parts = distinct.select("x").mapInArrow(lambda batches: moment_digits(batches, width), "i int, j int, k int, digit long")
    total = np.zeros((width + 1,) * 2, object)
    for r in parts.groupBy("i", "j", "k").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("s")).collect():
        total[r.i, r.j] += int(r.s) << (_DIGIT * r.k)
    total = np.where(np.tri(width + 1, k=-1, dtype=bool), total.T, total)
    n, sums = int(total[width, width]), total[:width, width]
    if not n:
        return None
    exact = n * total[:width, :width] - np.outer(sums, sums)  # n^2 times the covariance
    trace = sum(int(exact[i, i]) for i in range(width))
    cov = np.array([[int(v) / (n * n) for v in row] for row in exact], np.float64).reshape(width, width)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values = np.where(values[order] > max(width, 1) * np.finfo(float).eps * (trace / (n * n)), values[order], 0.0)
    return Whitening(n, [int(s) for s in sums], vectors.T[order], values, values / (trace / (n * n)) if trace else np.zeros(len(order)))


def identity_error(distinct: DataFrame, how: Whitening) -> float:
    """Largest absolute entry of the covariance of distinct(x), projected, minus the identity."""
    kept, width = [c for c in range(len(how.values)) if how.values[c] > 0], len(how.sums)
    if not kept:
        return 0.0

    def task(batches):
        for b in batches:
            w = how.project(V.matrix(b.column("x"), width))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, c]) for c in kept], [f"w{c}" for c in kept])

    pairs = [(a, b) for a in kept for b in kept if a <= b]
    row = distinct.select("x").mapInArrow(task, ", ".join(f"w{c} double" for c in kept)).agg(*(F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs)).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(row, pairs))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each of rows(vec_id, x) and component, numbered from 1 by falling variance."""
    spark = rows.sparkSession
    distinct = C.materialize(rows.select("x").distinct(), "distinct-vectors")
    width = distinct.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    how = fit(distinct, width, components)
    if how is None or not len(how.values):
        return spark.createDataFrame([], SCHEMA)
    error, count = identity_error(distinct, how), len(how.values)

    def task(batches):
        for b in batches:
            x = V.matrix(b.column("x"), width)
            w = how.project(x).ravel()
            far = pa.array([v if v < 1 << 63 else None for v in how.deviation(x).tolist()], pa.int64())
            each = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()), pa.array(np.full(len(each), how.n)), far.take(pa.array(each)), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(how.explained, len(x))), pa.array(np.full(len(each), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(task, SCHEMA)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(V.integer_vectors(C.table(spark, sf_dir, "embeddings"), F.col("vec_id").cast("long").alias("vec_id")))
