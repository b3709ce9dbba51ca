"""Merges, name distances and edit logs against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import edit_log as E
from corpusflow.operators import merging as M
from corpusflow.plans import registry

registry.load()


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(60)], [(random.Random(2).randrange(200), i) for i in range(150)], [(0, i) for i in range(1, 90)], [(5, 5), (7, 500), (None, 3)], []])
def test_components(spark, pairs):
    nodes = list(range(200))
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in M.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label


def test_merge_of_a_chain_of_four(spark):
    notes = spark.createDataFrame([("a", 1, "T1", ["x"], ["t"], ["r"]), ("b", 2, "T2", None, ["u"], []), ("c", 3, "", ["x", "y"], None, ["q"]), ("d", 4, "T4", [], [], []), ("e", 5, "E", ["k"], [], [])], "note_id string, place long, title string, aliases array<string>, tags array<string>, related array<string>")
    blocks = spark.createDataFrame([("a", 0, "s1", "a0", "r1"), ("a", 1, None, "a1", "r2"), ("b", 0, "s1", "b0", "r3"), ("c", 0, "s2", "c0", "r4"), ("d", 0, "s1", "d0", None), ("d", 1, "s2", "d1", "r1"), ("e", 0, "s1", "e0", "r9")], "note_id string, ord long, section string, text string, block_ref string")
    links = spark.createDataFrame([("e", "d", 1), ("e", "b", 1), ("a", "c", 1), ("b", "e", 2), ("e", "e", 1), ("e", "gone", 1)], "src string, dst string, kind long")
    done = M.merge(notes, blocks, links, spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("zz", "e")], "a string, b string"))
    head = {r.merged: r for r in done.notes.collect()}
    assert set(head) == {"a", "e"} and head["a"].title == "T4" and head["a"].n_parts == 4
    assert head["a"].aliases == ["a", "b", "c", "d", "x", "y"] and head["a"].tags == ["t", "u"] and head["a"].related == ["q", "r"] and head["e"].aliases == ["k"]
    assert [r.text for r in done.blocks.where("merged = 'a'").orderBy("ord").collect()] == ["a0", "b0", "d0", "a1", "c0", "d1"]
    assert {(r.src, r.dst, r.kind, r.rewritten) for r in done.links.collect()} == {("e", "a", 1, True), ("a", "e", 2, True), ("e", "e", 1, False), ("e", "gone", 1, False)}
    assert {(r.from_note, r.target) for r in done.debt.collect()} == {(n, "a") for n in "abcd"}
    assert done.lost.count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


@pytest.mark.parametrize("limit", [1, 2])
def test_names_within_a_distance(spark, limit):
    rng = random.Random(limit)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(140)}
    one, two = sorted(names)[::2], sorted(names)[1::3]
    got = {(r.name, r.other, r.distance) for r in M.within(spark.createDataFrame([(n,) for n in [*one, None]], "name string"), spark.createDataFrame([(n,) for n in two], "other string"), limit).collect()}
    assert got == {(a, b, distance(a, b)) for a in one for b in two if distance(a, b) <= limit}


def corrected_brute(text, cls):
    """Rules by Python's own patterns, in order."""
    if cls in E.SKIPPED or text is None:
        return text
    if cls != E.FORMULA:
        text = re.sub(r"\n{3,}", "\n\n", text)
        text = re.sub(r"(?m)^( +)\1+ +", r"\1 ", text)
        text = re.sub(r"(?<!^) {2,}(?!$)", " ", text)
        text = re.sub(r"(?m)^( +)\t", lambda m: m[1] + "    ", text)
        for sign, letters in E.LIGATURES.items():
            text = "".join(letters if c == sign and not any(x in text[i : i + 30] for x in ("://", ".com", ".org")) else c for i, c in enumerate(text))
        text = re.sub(r"(\d{1,3})\.\s+([A-Z][a-z]+)", lambda m: m[1] + ".\n\n" + m[2], text)
        text = re.sub(r"(?m)^(\([0-9]+\)|\[[0-9]+\])\s+", lambda m: m[1] + "\n", text)
    for _, old, new, exact in E.DICTIONARY:
        text = re.sub(re.escape(old), new, text, flags=0 if exact else re.I)
    return text


TEXTS = [
    "a\n\n\n\nb  c   d", "   lead\n      six\n  two", "  \tx\n \ty", "eﬃcient ﬂow http://ﬁ.com far ﬁne " + "x" * 40 + " ﬁ", "see 3.  Then 12. Now 4.x", "(1)  one\n[22]\ttwo\n (3) no", "end   ", "end  \n",
    "PostgresQL javascript JAVASCRIPT PYHTON mySQL", "", None, "plain", "mySQLmySQL  ﬁﬁ\n\n\n(1) 1. PyhtonX", "a ﬂ" + " " * 5 + "b.org",
]


@pytest.fixture(scope="module")
def fixed(spark):
    rng = random.Random(9)
    bits = ["  ", " ", "\n\n\n", "\n", "ﬁ", "ﬂ", "ﬄ", "1. ", "Aa", "(2) ", "mySQL", "pyhton", "word", "\t", ".com", "://"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i * 10 + k, cls, t) for i, t in enumerate(texts) for k, cls in enumerate(("text", "code", "formula", None))]
    return rows, E.corrected(spark.createDataFrame(rows, "id long, cls string, text string")).cache()


def test_corrections_equal_brute_force(fixed):
    rows, df = fixed
    got = {r.id: r.fixed for r in df.collect()}
    for i, cls, t in rows:
        assert got[i] == corrected_brute(t, cls), repr(t)


def test_undoing_the_log_gives_the_texts_back(fixed):
    rows, df = fixed
    got = {r.id: r.text for r in E.reverted(df.select("id", "fixed"), E.edit_log(df)).collect()}
    assert got == {i: t for i, _, t in rows}


def test_positions_of_the_log(fixed):
    rows, df = fixed
    texts = {i: t for i, _, t in rows}
    first = [r for r in E.edit_log(df).collect() if r["pass"] == 0]
    assert first and all(texts[r.id][r.before : r.before + len(r.original)] == r.original for r in first)


def test_single_corrections_are_undone_at_their_place(fixed):
    _, df = fixed
    spans = E.placed(E.edit_log(df)).cache()
    final = {r.id: r.fixed for r in df.collect()}
    told = [r for r in spans.collect() if r.final is not None]
    assert len(told) > 100 and all(final[r.id][r.final : r.final + len(r.corrected)] == r.corrected for r in told)
    one = {(r.id, r["pass"], r.k): r.text for r in E.revert_one(df, spans).collect()}
    for r in told:
        assert one[r.id, r["pass"], r.k] == final[r.id][: r.final] + r.original + final[r.id][r.final + len(r.corrected) :]


def test_a_correction_that_another_reaches_into_is_not_undone_alone(spark):
    df = E.corrected(spark.createDataFrame([(1, "text", "x 1.   Aa")], "id long, cls string, text string"))
    got = {r.rule: r.final for r in E.placed(E.edit_log(df)).collect()}
    assert got == {"R003": None, "R009": 2} and df.first().fixed == "x 1.\n\nAa"
    assert df.where(F.col("text") == F.col("fixed")).count() == 0


def test_no_task_holds_the_texts_of_a_merged_note(spark):
    """Chains join a share of all notes, so texts stream into a digest."""
    plan = registry.QUERIES["dup_merge"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(ord" not in plan


def test_digest_over_batches():
    rows = [{"merged": m, "text": t} for m, t in (("a", "x"), ("a", None), ("a", "yé"), ("b", None), ("c", ""), ("c", "z"))]
    for size in (1, 2, 6):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], pa.schema([("merged", pa.string()), ("text", pa.string())])) for i in range(0, 6, size)]
        got = [tuple(r.values()) for b in M._digested(iter(batches)) for r in b.to_pylist()]
        assert got == [("a", 3, hashlib.sha256("x|yé".encode()).hexdigest()), ("b", 1, None), ("c", 2, hashlib.sha256(b"|z").hexdigest())]
