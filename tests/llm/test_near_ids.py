"""The near-dedup stage where doc_id is null or repeated."""

from __future__ import annotations

import corpus_pipeline


def test_unlike_texts_stay_whatever_their_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (None, text("d")), (8, text("e")), (None, text("c"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text[0]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(None, "a"), (None, "b"), (None, "c"), (7, "d"), (7, "e")], key=str)
