"""Scores of texts without spaces."""

from __future__ import annotations

from corpusflow.llm import lm_scoring


def test_no_floor_under_a_word(spark):
    word = "".join(chr(0x4E00 + 37 * i % 20000) for i in range(900))
    rows = [(1, word[:300], True), (2, word[:600], True), (3, word, True), *((i, "some plain words to learn", False) for i in range(10, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r.score for r in lm_scoring.score(docs, lm_scoring.fit(docs.where("NOT held_out"))).collect()}
    assert got[1] < -400 and got[2] < 1.5 * got[1] and got[3] < 1.3 * got[2]
