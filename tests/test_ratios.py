from __future__ import annotations

import difflib
import random
import time
from itertools import combinations

from corpusflow.functions import sequences
from corpusflow.functions.ratios import Indexed, Known, ratio


def plain(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_ratio_is_that_of_difflib():
    draw = random.Random(5)
    letters = ["ab", "abcdef", "etaoin shrdlu.,\nABCXYZq", "".join(chr(0x4E00 + i) for i in range(300))]
    for n in range(6000):
        chars, most = draw.choice(letters), 14 if n % 40 else 700
        a, b = ("".join(draw.choices(chars, weights=[1 / (k + 1) for k in range(len(chars))], k=draw.randint(0, most))) for _ in "ab")
        if n % 3 == 0:
            k = draw.randint(0, len(b))
            a = a[: len(a) // 2] + b[k // 2 : k] + a[len(a) // 2 :]
        assert ratio(Indexed(a), Indexed(b)) == plain(a, b), (a, b)
    for a, b in (("a" * 400, "a" * 300), ("", ""), ("", "x"), ("ab" * 300, "ba" * 300), ("xab", "x" * 250)):
        assert ratio(Indexed(a), Indexed(b)) == plain(a, b)


def test_many_comparisons_of_long_texts_take_a_fraction_of_difflibs_time():
    draw = random.Random(6)
    words = ["".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 8))) for _ in range(200)]
    texts = [". ".join(" ".join(draw.choices(words, k=12)).capitalize() for _ in range(40)) for _ in range(12)]
    began = time.process_time()
    want = [plain(a, b) for a, b in combinations(texts, 2)]
    between = time.process_time()
    known = Known()
    assert [ratio(known(a), known(b)) for a, b in combinations(texts, 2)] == want
    assert time.process_time() - between < (between - began) / 3


def test_known_forgets():
    known = Known(most=10)
    for text in ("abcdef", "ghijkl", "mnopqr"):
        assert known(text).text == text
    assert len(known.texts) == 1


def test_pairs_of_a_large_block_are_dealt_and_whole(spark, monkeypatch):
    monkeypatch.setattr(sequences, "DEALT", 3)
    rows = [(f"n{i:02}", "concept", "The same title of all", "x" * (20 + i)) for i in range(20)] + [("z1", "concept", "Another", "xx"), ("z2", "concept", "ANOTHER", "xx"), ("z3", None, "Another", "xx")]
    pairs = sequences.candidate_pairs(spark.createDataFrame(rows, "note_id string, note_type string, title string, body string"))
    got = sorted((r.a, r.b) for r in pairs.collect())
    assert got == sorted([*combinations([f"n{i:02}" for i in range(20)], 2), ("z1", "z2")])
