"""The pipeline's near-dedup stage against exact Jaccard similarity."""

from __future__ import annotations

import random

import corpus_pipeline
from corpusflow.llm import simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def test_near_copies_are_found_and_others_stay(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    rows, near = [], {}
    for k in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        rows.append((10 * k, " ".join(words)))
        for j in (1, 2):
            copy = list(words)
            for _ in range(max(1, len(words) // 100)):  # up to five shingles of a hundred each
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((10 * k + j, " ".join(copy)))
        half = words[: len(words) // 2] + [rng.choice(vocab) for _ in range(len(words) // 2)]
        rows.append((10 * k + 5, " ".join(half)))  # similarity about a third
    rows += [(9000, None), (9001, " \n"), (9002, "one two"), (9003, "one two"), (9004, "one three")]
    got = simhash.wide_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    name = {r.doc_id: r.component for r in got}
    found = sum(name[10 * k] == name[10 * k + j] for k in range(60) for j in (1, 2))
    assert found >= 0.95 * 120
    assert all(name[10 * k] != name[10 * k + 5] for k in range(60))
    assert len({name[10 * k] for k in range(60)}) == 60
    assert name[9000] == name[9001] != name[9002] == name[9003] != name[9004]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()}
    want = {}
    for i, c in name.items():
        want[c] = min(i, want.get(c, i))
    assert kept == set(want.values())


def test_shuffled_side_gives_the_same(spark, monkeypatch):
    rows = [(i, f"alpha beta gamma delta {i % 5} epsilon zeta eta theta iota") for i in range(40)] + [(3, "alpha beta gamma delta 3 epsilon zeta eta theta iota")]
    want = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect())
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", 0)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()) == want == [0, 1, 2, 3, 4]
