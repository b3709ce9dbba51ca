"""The layer's step is the plain one at less cost; every word that begins in a window is learned, also where the window cuts it."""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa

from corpusflow.llm import lm_scoring as L


def plain_step(p, classes, features, w, word, rate, state):
    """Adam on the mean losses, each logit, weight and gradient written out."""
    n, width = len(w), L.WIDTH
    flat = lambda m: m.reshape(-1, m.shape[-1])
    distance = np.arange(L.CONTEXT, L.CONTEXT + L.STRIDE)[:, None] - np.arange(L.CONTEXT + L.STRIDE)[None, :]
    x = features[w[:, :-1]]
    own, keys = flat(x[:, L.CONTEXT :]), flat(x)
    q, k, v = (own @ p["q"]).reshape(n, L.STRIDE, width), (keys @ p["k"]).reshape(n, -1, width), (keys @ p["v"]).reshape(n, -1, width)
    a = np.clip(q @ k.transpose(0, 2, 1) / np.float32(math.sqrt(width)), -60, 60)
    a = np.exp(a) * np.where(distance >= 0, np.exp(p["r"][np.abs(distance)]), np.float32(0))
    a = a / a.sum(axis=2, keepdims=True)
    c = flat(a @ v)
    before, target = classes[w[:, L.CONTEXT : -1]].ravel(), classes[w[:, L.CONTEXT + 1 :]].ravel()

    def error(c, before, o, t, target):
        z = np.clip(c @ o + (t - t.max(axis=1, keepdims=True))[before], -60, 60)
        z = np.exp(z)
        z = z / (z.sum(axis=1, keepdims=True) * np.float32(len(z)))
        z[np.arange(len(z)), target] -= np.float32(1 / len(z))
        return z

    dz = error(c, before, p["o"], p["t"] + p["b"], target)
    at = np.flatnonzero(word.ravel() >= 0)
    dw = error(c[at], before[at], p["wo"], p["wt"] + p["wb"], word.ravel()[at])
    hot = np.eye(L.CLASSES, dtype=np.float32)[before]
    g = {"o": c.T @ dz, "t": hot.T @ dz, "b": dz.sum(0), "wo": c[at].T @ dw, "wt": hot[at].T @ dw, "wb": dw.sum(0)}
    dc = dz @ p["o"].T
    dc[at] += dw @ p["wo"].T
    held, dc = (dc * c).sum(axis=1).reshape(n, L.STRIDE, 1), dc.reshape(n, L.STRIDE, width)
    ds = a * (dc @ v.transpose(0, 2, 1) - held)
    g["r"] = np.bincount(np.abs(distance).ravel(), weights=np.where(distance >= 0, ds.sum(0), 0).ravel()).astype(np.float32)
    ds = ds * np.float32(1 / math.sqrt(width))
    g["q"], g["k"], g["v"] = own.T @ flat(ds @ k), keys.T @ flat(ds.transpose(0, 2, 1) @ q), keys.T @ flat(a.transpose(0, 2, 1) @ dc)
    state["n"] = state.get("n", 0) + 1
    for name, value in p.items():
        m1, m2 = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m1 += 0.1 * (g[name] - m1)
        m2 += 0.01 * (g[name] ** 2 - m2)
        value -= rate * min(1.0, state["n"] / 20) * (m1 / (1 - 0.9 ** state["n"])) / (np.sqrt(m2 / (1 - 0.99 ** state["n"])) + 1e-8)


def drawn(windows):
    rng = np.random.default_rng(2)
    features = rng.standard_normal((L.IDS, L.FEATURES)).astype(np.float32)
    features /= np.linalg.norm(features, axis=1, keepdims=True)
    classes = rng.integers(0, L.CLASSES, L.IDS)
    w = rng.integers(0, 3000, (windows, L.CONTEXT + L.STRIDE + 1))
    word = np.where(rng.random((windows, L.STRIDE)) < 0.4, rng.integers(0, L.WORD_CLASSES, (windows, L.STRIDE)), -1)
    return classes, features, w, word


def test_step_is_the_plain_one():
    classes, features, w, word = drawn(96 * 6 + 50)
    for scale in (1, 40):  # at 40 logits are cut
        att, state, plain = L.Attention(classes, features), {}, {}
        att.p |= {k: att.p[k] * np.float32(scale) for k in ("q", "k", "v")}
        p = {k: v.copy() for k, v in att.p.items()}
        for i in range(0, len(w), 96):
            att.step(w[i : i + 96], word[i : i + 96], 0.03, state)
            plain_step(p, classes, features, w[i : i + 96], word[i : i + 96], 0.03, plain)
        for k in p:
            assert np.abs(p[k] - att.p[k]).max() < 2e-3 * max(1, np.abs(p[k]).max()), (scale, k)


def test_step_costs_less_than_the_plain_one():
    classes, features, w, word = drawn(96)
    att, p = L.Attention(classes, features), L.Attention(classes, features).p
    state, plain, times = {}, {}, ([], [])
    for _ in range(12):
        for i, run in enumerate((lambda: att.step(w, word, 0.03, state), lambda: plain_step(p, classes, features, w, word, 0.03, plain))):
            t = time.thread_time()
            for _ in range(4):
                run()
            times[i].append(time.thread_time() - t)
    assert min(times[0]) < 0.8 * min(times[1])


def test_words_that_windows_cut_are_learned():
    classes, features, _, _ = drawn(1)
    centres, begins = features[: L.WORD_CLASSES - 1], L._space_ids(L.encoder())
    texts = pa.array(["some words interrogation " * 40, None, "x", "antidisestablishmentarianism" * 9])
    stream, begin, per_text = L.Subwords(texts).stream()
    ends = np.flatnonzero(stream == L.END) + 1
    ids = pa.array([stream[a:b].astype("<u2").tobytes() for a, b in zip([0, *ends], ends)], pa.binary())
    alone = L.word_classes(np.arange(L.IDS), np.arange(L.IDS), features, centres)
    windows, goals = L.training_windows(ids, features, centres, begins, alone)
    want = L.word_classes(stream, begin, features, centres)
    want[stream[begin] == L.END] = L.WORD_CLASSES - 1
    assert (windows == L.text_windows(ids)[0]).all()
    assert (goals[goals >= 0] == want).all()


def test_known_words_have_the_same_ids(monkeypatch):
    texts = pa.array([f"one two {'three' * (i % 4)} n{i % 7}  odd{i % 3}  word" for i in range(60)] + [None, ""])
    whole = L.Subwords(texts).stream()
    for most in (1_000_000, 3):
        monkeypatch.setattr(L, "KNOWN", most)
        known, parts = {}, []
        for i in range(0, len(texts), 5):
            parts.append(L.Subwords(texts.slice(i, 5), known).stream())
        assert (np.concatenate([x[0] for x in parts]) == whole[0]).all() and (np.concatenate([x[2] for x in parts]) == whole[2]).all()
