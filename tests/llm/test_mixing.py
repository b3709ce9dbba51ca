"""Mixing: targets against a loop, rates against bisection, and what is taken against both."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target int, row string, h string, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "r", "h", 3) for i, t, s in rows], SCHEMA)


def some_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "Z", "é", "c c", "", None])
        rows.append((i, " ".join(["w"] * int(rng.paretovariate(1.1) * 8)), source))
    tiny = [(2000 + i, "one two", "tiny") for i in range(3)]
    return rows + tiny + [(3000, "word\n" * 30_000, "a"), (3001, None, "a"), (3002, " \t\n", None), (None, "no id here", "b"), (None, "no id here", "b"), (5, rows[5][1], rows[5][2]), (3003, "", "void"), (3004, None, "void")]


def count(text):
    return sum(1 for w in (text or "").encode().split())


def targets_brute(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = total - sum(3 * sizes[s] for s in stopped)
        share = sum(w for s, w in weight.items() if s not in stopped)
        got = {s: 3.0 * sizes[s] if s in stopped else free * weight[s] / share for s in names}
        above = {s for s in names if s not in stopped and got[s] > 3 * sizes[s]}
        if not above:
            return got
        stopped |= above


@pytest.mark.parametrize("parts", [1, 6])
def test_mix(spark, parts):
    rows = some_rows()
    out = mixing.mix(table(spark, rows).repartition(parts)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in out) == sorted((i is None, i or 0, count(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = targets_brute(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    assert want["tiny"] == 18 and want["void"] == 0
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert sum(r.rate * r.size for r in mine) == pytest.approx(want[s], rel=1e-8)
        longest = max(r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(0.002 * want[s], 1)
        if want[s] and want[s] < 3 * sizes[s]:  # one tilt for all of the source: log rate over size is the same below the cap
            tilts = [math.log(r.rate) / r.size for r in mine if r.size and r.rate < 3 - 1e-9]
            assert max(tilts) - min(tilts) <= 1e-6 * max(map(abs, tilts)) + 1e-12
            lam = tilts[0]
            low = sum(r.size * min(3, math.exp((lam - abs(lam) * 1e-3 - 1e-9) * r.size)) for r in mine)
            assert low <= want[s] and longest


def test_reruns_agree_on_any_partitions(spark):
    rows = some_rows(8)
    one, two = (sorted(((r.doc_id is None, r.doc_id or 0, r.size, r.copies) for r in mixing.mix(table(spark, rows).repartition(k)).collect())) for k in (2, 9))
    assert one == two


def test_no_documents(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    out = mixing.mix(table(spark, [(1, None, None), (2, "", "a")])).collect()
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in out} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}


def test_places_follow_code_points(spark):
    names = ["b", None, "a", "Z", "é", "", "aa"]
    got = mixing.ranked(spark.createDataFrame([(n,) for n in names], "source string").repartition(5))
    assert [r.source for r in got.orderBy("place").collect()] == ["", "Z", "a", "aa", "b", "é", None]
    assert sorted(r.place for r in got.collect()) == list(range(7))


def test_sizes_count_words_of_whole_texts(spark):
    got = {r.doc_id: r.size for r in mixing.sizes(table(spark, [(1, "a\x0bb\x0cc\xa0d e", "s"), (2, "x " * 50_000, "s"), (3, None, "s")])).collect()}
    assert got == {1: 4, 2: 50_000, 3: 0}
    assert mixing.sizes(table(spark, [(1, "a", "s")])).where((F.col("h") >= 0) & (F.col("h") < 1)).count() == 1
