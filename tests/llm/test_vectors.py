"""Mining and whitening against brute force on small tables with every awkward case."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import _vectors, hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "a", 1, "b") for i, v, k in rows], SCHEMA)


def some_rows(n=420, d=6, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.12) for _ in range(d)], rng.randrange(3)) for i in range(n)]
    hot = rows[11][1]
    rows = [(i, hot if i % 3 == 1 else v, k) for i, v, k in rows]  # one vector holds a third
    return rows + [(100, rows[100][1], rows[100][2])] * 2 + [
        (200, [0.5] * d, 1), (None, [0.3] * d, 1), (None, [0.3] * d, 2), (-100, [0.4] * d, 0), (900, None, 1), (901, [0.1] * d, None),
        (902, [0.1, None] + [0.1] * (d - 2), 1), (903, [math.nan] + [0.1] * (d - 1), 1), (904, [math.inf] + [0.1] * (d - 1), 1), (1000, [], 1), (1100, [0.25, 0.5], 2),
    ]


def floors(v, d=6):
    v = [np.float32(c) for c in v]
    return [math.floor(256 * float(c)) for c in v] + [0] * (d - len(v))


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def mined_brute(rows):
    rows = [(i, floors(v), (k + 1) % 10 if i is not None and i % 7 == 0 else k) for i, v, k in rows if k is not None and good(v)]
    out = []
    for r, (i, x, k) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = sorted(((sum(p * q for p, q in zip(x, y)), j, m) for s, (j, y, m) in enumerate(rows) if s != r), key=lambda t: (-t[0], t[1] is None, t[1] or 0))
        for p, j, _ in [t for t in scored if t[2] == k][:5]:
            found = [t for t in scored if t[2] != k and 80 * p <= 100 * t[0] <= 100 * p][:5]
            out += [(i, j, n, t[1], p, t[0]) for n, t in enumerate(found, 1)]
    return sorted(out, key=repr)


def mined(df, **how):
    rows = hard_negatives.labelled_vectors(df)
    return sorted(map(tuple, hard_negatives.mine(rows, rows.where("id % 100 = 0"), **how).collect()), key=repr)


@pytest.mark.parametrize("parts,limit", [(1, 16 << 20), (7, 300)])
def test_mining_equals_brute_force(spark, parts, limit):
    rows = some_rows()
    want = mined_brute(rows)
    assert len(want) > 40
    assert mined(table(spark, rows).repartition(parts), limit=limit) == want


def test_mining_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE", (2, 3))
    rows = hard_negatives.labelled_vectors(table(spark, some_rows(120)))
    batches = [b for b in rows.toArrow().to_batches(max_chunksize=50)]
    anchors = [r for r in rows.where("id = 0").collect()][0]
    block = hard_negatives.Anchors(pa.table({"id": [anchors.id], "label": [anchors.label], "n": [1], "x": pa.array([anchors.x])}))
    (got,) = hard_negatives.positives_of(block, batches, 5)
    others = sorted(((-sum(a * b for a, b in zip(anchors.x, r.x)), r.id is None, r.id) for r in rows.collect() if r.label == anchors.label and r.id != anchors.id), key=lambda t: t[:2] + (t[2] or 0,))
    assert list(zip(got.column("score").to_pylist(), got.column("id").to_pylist())) == [(-s, i) for s, _, i in others[:5]]


def test_mining_far_beyond_float(spark):
    rows = [(100, [3e6, 1.0], 1), (1, [3e6, 2.0], 1), (2, [2.9e6, 3.0], 2), (3, [2.9e6, 3.00390625], 2)]
    assert [r[3] for r in mined(table(spark, rows))] == [3, 2]


def test_mining_of_nothing(spark):
    assert mined(table(spark, [])) == [] == mined(table(spark, [(1, [0.5], 1), (2, [0.5], 1)]))


def test_merging_does_not_depend_on_order():
    rng = np.random.default_rng(1)
    group, score, id = rng.integers(0, 4, 300), rng.integers(0, 6, 300), rng.permutation(300)
    none = id % 50 == 0
    tops = []
    for cut in (300, 17, 1):
        top = hard_negatives.Top(np.zeros(4, np.int64), 5)
        for at in range(0, 300, cut):
            s = slice(at, at + cut)
            top.add(group[s], score[s], none[s], id[s])
        tops.append(top.batch().to_pylist())
    assert tops[0] == tops[1] == tops[2]
    want = sorted(((g, -s, n, i) for g, s, n, i in zip(group.tolist(), score.tolist(), none.tolist(), id.tolist())))
    assert [(r["g"], -r["score"]) for r in tops[0]] == [t[:2] for g in range(4) for t in [w for w in want if w[0] == g][:5]]


def whitened(df, **how):
    from pyspark.sql import functions as F

    return whitening.whiten(_vectors.integer_vectors(df, F.col("vec_id").cast("long").alias("vec_id")), **how)


@pytest.mark.parametrize("parts", [1, 5])
def test_whitening_equals_exact_moments(spark, parts):
    rows = some_rows()
    kept = [(i, floors(v)) for i, v, _ in rows if good(v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    got = whitened(table(spark, rows).repartition(parts)).collect()
    assert len(got) == 4 * len(kept)
    assert sorted([(r.vec_id, r.deviation) for r in got if r.component == 1], key=repr) == sorted([(i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept], key=repr)
    cov = np.array([[float(Fraction(sum(x[a] * x[b] for x in fit), n) - Fraction(sums[a] * sums[b], n * n)) for b in range(6)] for a in range(6)])
    values, vectors = np.linalg.eigh(cov)
    for c in range(4):
        mine = sorted([(r.vec_id, r.whitened) for r in got if r.component == c + 1], key=repr)
        v = vectors[:, 5 - c] / math.sqrt(values[5 - c])
        want = sorted([(i, float((np.array(x) - np.array(sums) / n) @ v)) for i, x in kept], key=repr)
        a, b = np.array([w for _, w in sorted(mine, key=lambda t: (str(t[0]), t[1]))]), np.array([w for _, w in sorted(want, key=lambda t: (str(t[0]), t[1]))])
        flipped = np.array([w for _, w in sorted([(i, -w) for i, w in want], key=lambda t: (str(t[0]), t[1]))])
        assert np.allclose(a, b, atol=1e-9) or np.allclose(a, flipped, atol=1e-9)
        assert {r.explained for r in got if r.component == c + 1}.pop() == pytest.approx(values[5 - c] / np.trace(cov), rel=1e-12)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-12 and len({r.identity_error for r in got}) == 1


def test_products_of_huge_integers_are_exact():
    rng = random.Random(2)
    x = np.array([[rng.randrange(-(1 << 62), 1 << 62) for _ in range(4)] for _ in range(50)])
    want = [[sum(int(r[a]) * int(r[b]) for r in x) for b in range(4)] for a in range(4)]
    assert whitening.gram(x).tolist() == want
    batch = pa.record_batch({"x": pa.array(x.tolist(), pa.list_(pa.int64()))})
    total = {}
    for part in whitening.moment_digits(iter([batch, batch]), 4):
        for r in part.to_pylist():
            total[r["i"], r["j"]] = total.get((r["i"], r["j"]), 0) + (r["digit"] << (32 * r["k"]))
    assert all(total.get((a, b), 0) == 2 * want[a][b] for a in range(4) for b in range(a, 4)) and total[4, 4] == 100


def test_whitening_without_variance_or_rows(spark):
    assert whitened(table(spark, [])).count() == 0
    got = whitened(table(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1), (3, [0.25, 0.25], None)])).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component, r.n) for r in got] == [(i, c, 2) for i in (1, 2, 3) for c in (1, 2)]
    assert [r.whitened is None for r in got] == [False, True] * 3 and abs(got[0].whitened) == pytest.approx(1)
    assert [r.explained for r in got[:2]] == [1.0, 0.0] and got[0].identity_error < 1e-12
    assert {r.deviation for r in got} == {64 * 64}
