"""The corpus operators against brute force, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from corpusflow.llm import decontamination, html_extraction, language_id, license_scan, line_dedup, lm_scoring, packing, quality_rules, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at int, key string, _n int"
EMPTY = [(None, None), (900, None), (901, ""), (902, " \t\n "), (903, "a"), (904, "word " * 30), (905, "x" * 5000), (906, "ünï cödé spaces\nA\rB\x0bC")]


def words(text):
    return (text or "").encode().split()


def table(spark, rows):
    full = [(i, t, "en", "src", None, 1, "k", 2) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["an", "er", "th", "on", "re", "ti"]) for _ in range(rng.randint(1, 3))) for _ in range(80)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k)).capitalize() + "."
    shared = [line(30) for _ in range(4)]
    docs = []
    for i in range(n):
        text = "\n".join([line(rng.randint(3, 40)) for _ in range(rng.randint(1, 8))])
        if i % 3 == 0:
            text += " " + rng.choice(shared)
        if i % 5 == 0:
            text = "Common head line\n" + text
        if i % 11 == 0 and docs:
            text = docs[-1][1].replace("an", "AN", 1)
        if i % 13 == 0 and docs:
            text = docs[rng.randrange(len(docs))][1]
        docs.append((i * 3, text))
    return docs + EMPTY + [docs[5]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).cache()


def test_substrings_equal_brute_force(docs, rows):
    n = 13
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, 10**9), -1 if i is None else i)
    want = Counter()
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (-1 if i is None else i):
                gone.update(range(k, k + n))
        want[(i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.drop_repeats(docs).collect())
    assert got == want
    assert sum(x[2] for x in want) > 100


def test_suffix_automaton_matches():
    rng = random.Random(1)
    for _ in range(30):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(4)]
        sam = substring_dedup.SuffixAutomaton()
        for t in texts[:3]:
            sam.add(t)
        have = {tuple(t[k : k + 4]) for t in texts[:3] for k in range(len(t) - 3)}
        assert sam.matches(texts[3], 4) == [k + 4 for k in range(len(texts[3]) - 3) if tuple(texts[3][k : k + 4]) in have]


def test_quality_equals_brute_force(docs, rows):
    want = Counter()
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))] += 1
    book = quality_rules.verdict(quality_rules.ledger(docs))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in book.collect())
    assert got == want


def test_policies_and_ablations(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    book = quality_rules.ledger(table(spark, [(1, clean), (2, clean + " idiot moron"), (3, "short"), (4, clean.replace(" ", "&&& ")), (5, None)]))
    kept = {r.doc_id: r.kept for r in quality_rules.verdict(book).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {r.doc_id: r.kept for r in quality_rules.verdict(book, 1).collect()}[2]
    rules = {r.rule: r for r in quality_rules.ablations(book).collect()}
    assert rules["toxic"].rejected_alone == 1 and rules["toxic"].kept_without == 2 and rules["too_short"].failed == 2


def test_toxic_words_are_learned(spark):
    good = [(i, f"plain text number{i} here") for i in range(100)]
    bad = [(i, f"plain text vilword number{i}") for i in range(100, 110)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(110)] + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    assert "vilword" in quality_rules.toxic_words(table(spark, good + bad), labels)


def brute_components(rows, distance=4):
    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= distance and label[b] < label[a]:
                    label[a], changed = label[b], True
    out = Counter()
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        out[(i, f"{fps[k]:016x}", min(ids) if ids else None)] += 1
    return out


def test_simhash_equals_brute_force(docs, rows):
    groups = simhash.near_groups(docs)
    got = Counter((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in groups.select("doc_id", "fp", "component_id").collect())
    assert got == brute_components(rows)


def test_large_keys_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) for b in base]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "f0 long").repartition(5)
    parent = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.near_links(df, 4, block=8).collect():
        assert (r.a ^ r.b).bit_count() <= 64 and bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4
        parent[find(r.a)] = find(r.b)
    a, b = simhash.forest(fps[:, None], 4)
    whole = len(fps) - len(a)
    assert len({find(x) for x in parent}) == whole


def test_lines_equal_brute_force(docs, rows):
    def key(x):
        return x.strip(b" \t\n\x0b\x0c\r").lower()

    seen = Counter()
    for i, lines in {(i, ln) for i, t in rows for ln in {key(x) for x in (t or "").encode().split(b"\n")}}:
        seen[lines] += 1
    want = Counter()
    for i, t in rows:
        ls = (t or "").encode().split(b"\n")
        keep = [x for x in ls if not (key(x) and seen[key(x)] >= 10)]
        want[(i, len(ls), len(ls) - len(keep), b"\n".join(keep).decode())] += 1
    out = line_dedup.drop_frequent(docs)
    assert set(docs.columns) <= set(out.columns)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect())
    assert got == want and sum(x[2] for x in want) > 10


def test_line_runs_levels(spark):
    store = line_dedup.LineRuns(spark, fanout=2)
    batches = [[(1, 1), (2, 2)], [(1, 1)], [(3, 3), (1, 1)], [(2, 2)], [(9, 9)]]
    for b in batches:
        keys = spark.createDataFrame(b, "k1 long, k2 long")
        store.add(keys)
    assert [level for level, _ in store.runs] == [2, 0]
    assert {(r.k1, r.n_docs) for r in store.merged().collect()} == {(1, 3), (2, 2), (3, 1), (9, 1)}
    fresh = store.unseen(spark.createDataFrame([(1, 1), (7, 7)], "k1 long, k2 long"))
    assert [r.k1 for r in fresh.collect()] == [7]


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    special = [(700, "a <|endoftext|> b"), (701, "<|endoftext|>"), (702, "<|endoftext|><|endoftext|> x" * 30)]
    assert packing.token_ids(["<|endoftext|>", None]) == [[50256], []]
    rows, docs = rows + special, docs.unionByName(table(docs.sparkSession, special))
    want = Counter()
    by_key = {}
    for i, t in rows:
        ids = [*(tok.encode(t or "", add_special_tokens=False).ids), 0]
        by_key.setdefault((i, len(ids)), []).append(ids)
        want[(i, len(ids))] += 1
    pieces = packing.pack(docs, size=64).collect()
    assert sum(r.length for r in pieces) == sum(len(x) for v in by_key.values() for x in v)
    starts = Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)
    assert starts == want
    for r in pieces:
        crcs = [zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in by_key[(r.doc_id, r.doc_tokens)]]
        assert r.ids_crc32 in crcs
    fills: dict = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 64
    assert all(f == 64 or f & (f - 1) == 0 for f in fills.values())


def test_sum_of_squares_choice():
    rng = random.Random(9)
    packer = packing.LevelPacker(32)
    counts = Counter()
    for k in range(400):
        n = rng.randint(1, 31)
        best = None
        for level in [0, *counts]:
            if level + n > 32 or level and not counts[level]:
                continue
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + n < 32:
                after[level + n] += 1
            cost = sum(v * v for v in after.values())
            best = min(best, (cost, -level)) if best else (cost, -level)
        packer.place((k, 0, n, None, n), n)
        level = -best[1]
        if level:
            counts[level] -= 1
        if level + n < 32:
            counts[level + n] += 1
        counts += Counter()
        assert {i: int(c) for i, c in enumerate(packer.counts) if c} == dict(counts)


def test_leaks(spark):
    item = "So yesterday Tom Baker bought 12 apples for 3.50 dollars and gave Mary 5 of them before lunch."
    other = item.replace("Tom Baker", "Ann Smith").replace("12", "99").replace("3.50", "1.25").replace("Mary", "Lucy")
    mixed = "So yesterday Ann Ann bought 99 apples for 99 dollars and gave Ann 99 of them before lunch."
    filler = "other words stand here and there without any meaning at all "
    rows = [(1, filler + item), (2, filler * 3 + other + filler), (3, filler * 2), (4, (filler + item).upper().replace(" ", "!! ")), (5, None), (6, ""), (7, mixed), (1, filler + item), (None, item)]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "four words only here"), (11, "five words make one window")], "item_id long, text string")
    found = decontamination.find_leaks(table(spark, rows), bench).collect()
    assert Counter((r.doc_id, r.item_id, r.reparameterised) for r in found) == Counter([(1, 7, False), (1, 7, False), (2, 7, True), (4, 7, False), (None, 7, False)])
    left = decontamination.drop_leaks(table(spark, rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 6, 7] and left.columns == table(spark, rows).columns
    assert decontamination.find_leaks(table(spark, rows), bench.limit(0)).count() == 0


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(df.where(language_id.fold("doc_id", 4) != 2))
    held = df.where(language_id.fold("doc_id", 4) == 2)
    got = language_id.predict(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = language_id.predict(table(spark, [(1, None), (2, ""), (3, "123 !!"), (None, "der die das und")]), model).collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and odd[3].lang_pred in {"de", "en", "fr", "es"}
    assert language_id.fit(df.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(table(spark, EMPTY), None).collect()} == {"und"}


def held(df):
    from pyspark.sql import functions as F

    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)))


def test_lm_base_and_model(spark, docs, rows):
    marked = held(docs)
    model = lm_scoring.fit(marked.where("NOT held_out"))
    got = lm_scoring.score(marked, model).collect()
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    # how many words tasks hold changes nothing
    few = lm_scoring.score(marked, lm_scoring.fit(marked.where("NOT held_out"), local_words=3)).collect()
    plain = lambda rows: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)
    assert plain(few) == plain(got)
    cut = {**model, "tasks": {**model["tasks"], "key": model["tasks"]["key"][:5], "c": model["tasks"]["c"][:5]}}
    exact = lambda rows: sorted((str(r.doc_id), r.n_tokens, round(r.score, 4)) for r in rows)
    assert exact(lm_scoring.score(marked, cut).collect()) == exact(got)
    none = lm_scoring.score(marked.limit(3), lm_scoring.fit(marked.limit(0))).collect()
    assert len(none) == 3 and all(r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    assert lm_scoring.score(marked.limit(0), model).count() == 0


def test_lm_score_equals_brute_force(spark, docs, rows):
    """Every word of some texts, id by id, from the model's parameters and plain counts."""
    L = lm_scoring
    marked = held(docs)
    model = L.fit(marked.where("NOT held_out"))
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words_of = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if not out(i) for w in words_of(t))
    m, enc = model["attention"].tables(), packing.encoder()
    features, centres, within = model["tasks"]["features"], model["tasks"]["centres"], model["tasks"]["tables"]["within"]
    spell = {w: [L.END] if w is None else enc.encode_ordinary(" " + w.decode()) for i, t in rows for w in words_of(t)}
    kind = {w: L.WORD_CLASSES - 1 if w is None else int(np.argmax(centres @ (features[ids].sum(0) + np.float32(L.FIRST) * features[ids[0]]))) for w, ids in spell.items()}
    mass = np.zeros(L.WORD_CLASSES)
    for w, n in c.items():
        mass[kind[w]] += n - L.DISCOUNT
    s = 1 - mass.sum() / sum(c.values())
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    r = model["attention"].p["r"]
    got = {x.doc_id: x.score for x in L.score(marked, model).collect()}
    picked = [(i, t) for i, t in rows if i in (3, 15, 900, 901, 904, 906)]
    for i, t in picked:
        stream = [L.END, *(x for w in words_of(t) for x in spell[w])]
        total, at = 0.0, 0
        for w in words_of(t):
            spelled, named = 1.0, None
            for x in spell[w]:
                block = at // L.STRIDE * L.STRIDE
                inputs = stream[max(0, block - L.CONTEXT) if block else 0 : at + 1]
                weight = np.array([math.exp(m["q"][inputs[-1]] @ m["kv"][y, : L.WIDTH]) * math.exp(r[len(inputs) - 1 - j]) for j, y in enumerate(inputs)])
                mean = weight @ m["kv"][inputs, L.WIDTH : -1] / weight.sum()
                before = m["class"][inputs[-1]]
                if named is None:
                    named = softmax(mean @ m["wo"] + m["wt"][before])[kind[w]]
                spelled *= softmax(mean @ m["o"] + m["t"][before])[m["class"][x]] * math.exp(within[before, x])
                at += 1
            by_name = named * (c[w] - L.DISCOUNT) / mass[kind[w]] if c[w] else 0
            total += math.log10((1 - s) * by_name + s * spelled)
        assert abs(got[i] - total) < 1e-3 * max(1, abs(total)), i
    shares = np.exp(within.astype(np.float64))
    for k in (0, 7):
        assert np.allclose(np.bincount(m["class"], weights=shares[k], minlength=L.CLASSES), 1, atol=1e-3)


def test_lm_windows_score_each_id_once(spark):
    rng = np.random.default_rng(1)
    classes = rng.integers(0, lm_scoring.CLASSES, lm_scoring.IDS)
    features = rng.standard_normal((lm_scoring.IDS, lm_scoring.FEATURES)).astype(np.float32)
    att = lm_scoring.Attention(classes, features)
    stream = np.r_[rng.integers(0, 1000, 170), lm_scoring.END, rng.integers(0, 1000, 3), lm_scoring.END].astype(np.int32)
    ends = np.array([171, 175])
    m = att.tables() | {"within": rng.standard_normal((lm_scoring.CLASSES, lm_scoring.IDS)).astype(np.float32)}
    word = np.where(rng.random(175) < 0.4, rng.integers(0, lm_scoring.WORD_CLASSES, 175), -1).astype(np.int32)
    got, named = lm_scoring.log_probabilities(stream, ends, m, word)
    for i in range(175):
        begin = 0 if i < 171 else 171
        block = begin + (i - begin) // lm_scoring.STRIDE * lm_scoring.STRIDE
        lo = begin if block == begin else block - lm_scoring.CONTEXT
        inputs = [lm_scoring.END if k == begin else stream[k - 1] for k in range(lo, i + 1)]
        q = m["q"][inputs[-1]]
        w = np.array([math.exp(q @ m["kv"][x, : lm_scoring.WIDTH]) * math.exp(att.p["r"][i - k]) for k, x in zip(range(lo, i + 1), inputs)])
        c = w @ m["kv"][inputs, lm_scoring.WIDTH : -1] / w.sum()
        last = classes[inputs[-1]]
        for z, k, have, more in ((c @ m["o"] + m["t"][last], classes[stream[i]], got[i], m["within"][last, stream[i]]), (c @ m["wo"] + m["wt"][last], word[i], named[i], 0)):
            if k >= 0:
                assert abs(have - ((z - np.log(np.exp(z).sum()))[k] + more) / math.log(10)) < 1e-4


def test_lm_gradients():
    rng = np.random.default_rng(0)
    features = np.zeros((lm_scoring.IDS, lm_scoring.FEATURES), np.float32)
    features[:50] = rng.standard_normal((50, lm_scoring.FEATURES))
    classes = np.arange(lm_scoring.IDS) % lm_scoring.CLASSES
    windows = rng.integers(0, 50, (300, lm_scoring.CONTEXT + lm_scoring.STRIDE + 1))
    windows[:, 1:] = (windows[:, :1] + 3 * np.arange(1, windows.shape[1])) % 50  # each id follows from the last
    targets = windows[:, lm_scoring.CONTEXT + 1 :] % 7
    att, state = lm_scoring.Attention(classes, features), {}
    for _ in range(200):
        pick = rng.integers(0, 300, 64)
        att.step(windows[pick], targets[pick], 0.03, state)
    assert att.loss(windows) < 0.5
    yw = att._forward(windows)[-1]
    assert np.take_along_axis(yw, targets[..., None], 2).mean() > 0.6


def test_lm_windows_hold_whole_texts():
    import pyarrow as pa

    texts = pa.array(["one two three " * 40, None, "", "x"])
    stream, begin, per_text = lm_scoring.Subwords(texts).stream()
    ends = np.flatnonzero(stream == lm_scoring.END) + 1
    raw = [stream[a:b].astype("<u2").tobytes() for a, b in zip([0, *ends], ends)]
    ids = lm_scoring.Ids(pa.array(raw, pa.binary()))
    assert (ids.stream == stream).all() and (ids.ends == ends).all() and (ids.begin == begin).all() and (ids.per_text == per_text).all() and len(ids.unique) == 4
    w, n = lm_scoring.text_windows(pa.array(raw, pa.binary()))
    assert n == len(w) and (lm_scoring.text_windows(pa.array(raw, pa.binary()), 3, 1)[0] == w[1::3]).all()
    scored = w[:, lm_scoring.CONTEXT + 1 :]
    first = scored[: -(-(int(np.argmax(stream == lm_scoring.END)) + 1) // lm_scoring.STRIDE)].ravel()
    n = int(np.argmax(stream == lm_scoring.END))
    assert (first[:n] == stream[:n]).all() and (first[n:] == lm_scoring.END).all()


def test_lm_beats_base_on_held_out(spark):
    marked = held(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    got = lm_scoring.score(marked, lm_scoring.fit(marked.where("NOT held_out"))).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_licences(spark):
    digests = license_scan.known()
    assert len({d for d, *_ in digests}) == len(digests)
    assert all(re.search(license_scan.MARKS, t) for t in license_scan.TEXTS.values())
    notices = [f"{v}{f}" for forms in license_scan.NAMES.values() for f in forms for v in license_scan.VERBS]
    assert all(re.search(license_scan.MARKS, x) for x in notices)
    mit = "MIT License\n\nCopyright (c) 2020, S. Some; A. One. All rights reserved.\n\n" + license_scan.TEXTS["MIT"].replace("Permission", "PERMISSION ,")
    rows = [(1, mit), (2, "Text.\nReleased under the MIT Licence\nmore"), (3, "Licensed under the Apache License, version 2.0!\nReleased under the MIT License.\nReleased under the MIT License."), (4, None), (5, ""), (6, "my license is none"), (2, "Text.\nReleased under the MIT Licence\nmore"), (None, "SPDX-License-Identifier: GPL-3.0"), (7, mit + "\n" * 30000), (8, "Copyright (c) 2020 J. X. Y. Released under the MIT License."), (9, "Released under CC BY 4.0.")]
    got = Counter((r.doc_id, r.licenses, r.whole_text, r.n_notices) for r in license_scan.scan(table(spark, rows)).collect())
    assert got == Counter([(1, "MIT", True, 0), (2, "MIT", False, 1), (2, "MIT", False, 1), (3, "Apache-2.0,MIT", False, 3), (4, "", False, 0), (5, "", False, 0), (6, "", False, 0), (None, "GPL-3.0", True, 1), (7, "MIT", True, 0), (8, "MIT", True, 1), (9, "CC-BY-4.0", True, 1)])


def test_html_held_out():
    field = html_extraction.train()
    right = total = 0
    for html, truth in html_extraction.labelled_pages(150, seed=99):
        blocks = html_extraction.leaf_blocks(html)
        assert [b.text for b in blocks] == [" ".join(t.split()) for t, _ in truth]
        labels = field.decode(html_extraction.features(blocks))
        right += sum(a == b for a, (_, b) in zip(labels, truth))
        total += len(truth)
    assert right / total > 0.98


def test_viterbi_is_best_path():
    field = html_extraction.ChainField({f"f{i}": i for i in range(4)}, np.array([1.0, -2.0, 0.5, 0.1]), np.array([0.3, -0.1]), np.array([[0.2, -0.4], [0.1, 0.6]]))
    rng = random.Random(3)
    for _ in range(20):
        feats = [[f"f{rng.randrange(5)}"] for _ in range(6)]

        def score(path):
            e = sum(field.weights[field.index[f]] for fs, y in zip(feats, path) for f in fs if y and f in field.index)
            return field.start[path[0]] + e + sum(field.move[a, b] for a, b in zip(path, path[1:]))

        best = max(([k >> i & 1 for i in range(6)] for k in range(64)), key=score)
        assert abs(score(field.decode(feats)) - score(best)) < 1e-9


def test_html_cases(spark):
    html = '<html><body><nav><a href="/x">Menu</a></nav><article><h1>A &amp; B</h1><p>One<br>two   three.<p>Four &lt;five&gt;.</article><footer>&copy; me</footer></body></html>'
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (None, "u", "<p"), (1, "u", html)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = Counter((r.page_id, r.text, r.n_chars) for r in got)
    text = "A & B\n\nOne two three.\n\nFour <five>."
    assert by[(1, text, len(text))] == 2 and by[(2, "", 0)] == 1 and by[(3, "", 0)] == 1


def test_empty_tables(spark):
    empty = table(spark, [(1, "x")]).limit(0)
    assert substring_dedup.drop_repeats(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert line_dedup.drop_frequent(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert license_scan.scan(empty).count() == 0
    assert quality_rules.ledger(empty).count() == 0


def test_contract_columns_on_tables(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    got = substring_dedup.op3_substring_dedup(spark, d)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and got.count() == n
    row = line_dedup.op8_line_dedup(spark, d).where("n_dropped = 0").first()
    text = spark.read.parquet(f"{d}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    assert row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
