"""The pipeline against a plain one on a small folder of tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from corpusflow.llm import packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    item = line(20)
    rows = [[i, line(60) + "\n" + line(40)] for i in range(60)]
    for r in rows[:15]:
        r[1] = "Shared head\n" + r[1]
    rows[20][1] = "too short"
    rows[21][1] += " idiot moron"
    rows[22][1] = rows[23][1]
    rows[24][1] = rows[25][1] + " extra"
    rows[26][1] += " " + item
    rows[27][1] = None
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows


def test_pipeline(spark, folder):
    path, rows = folder
    want = {i: t.replace("Shared head\n", "") for i, t in rows if i not in (20, 21, 23, 25, 26, 27)}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    assert {r.doc_id: r.text for r in docs.collect()} == want
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = corpus_pipeline.run(spark, path).collect()
    ids = {i: len(packing.encoder().encode_ordinary(t)) + 1 for i, t in want.items()}
    got: dict = {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == ids


def test_stages_take_awkward_tables(spark, folder):
    from pyspark.sql import functions as F

    path, _ = folder
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, " \n ", "en", "s", 3), (3, "w " * 9000, "en", "s", 18000), (3, "w " * 9000, "en", "s", 18000)]
    odd = spark.createDataFrame(rows, COLUMNS)
    for name in ("_d", "_t", "_text", "_words", "_lines", "fp", "kept", "component_id", "at", "row", "_n", "_row"):
        odd = odd.withColumn(name, F.lit(1))
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, path)
            got = out.count()
            if name != "packing":
                assert out.columns == list(corpus_pipeline.COLUMNS)
                assert got == {"quality rules": 0, "line dedup": n, "simhash near-dedup": min(n, 2), "benchmark decontamination": n}[name]
            else:
                assert out.select("doc_id").distinct().count() == (4 if n else 0)
