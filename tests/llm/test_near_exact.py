"""The near-dedup stage links all pairs of similarity 0.8 or more and no others."""

from __future__ import annotations

import random

import pytest

from corpusflow.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def texts(seed):
    rng = random.Random(seed)
    line = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    common, out = line(40), []
    for k in range(120):
        words = line(rng.randint(30, 200)) + (common if k % 4 == 0 else [])
        out.append(" ".join(words))
        copy = list(words)
        for i in rng.sample(range(len(copy)), max(1, len(copy) * (k % 6) // 200)):  # similarity about 0.7 to 1
            copy[i] = f"x{rng.randrange(3000)}"
        out.append(" ".join(copy))
    return out


def components(rows):
    sets, label = [shingles(t) for t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 9 * both >= 4 * (len(a) + len(sets[j])):
                x, y = label[i], label[j]
                label = [min(x, y) if z in (x, y) else z for z in label]
    return label


@pytest.mark.parametrize("block", [simhash.ENTRY_BLOCK, 3])
def test_every_pair_and_no_other(spark, monkeypatch, block):
    rows = texts(11)
    want = components(rows)
    monkeypatch.setattr(simhash.index_pairs, "__defaults__", (block,), raising=False)
    got = {r.doc_id: r.component for r in simhash.wide_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    least = {}
    for i in range(len(rows)):
        least.setdefault(got[i], i)
    assert [least[got[i]] for i in range(len(rows))] == want
