"""Every window of the training texts moves the layer."""

from __future__ import annotations

import numpy as np

from corpusflow.llm import lm_scoring as L


def test_layer_learns_from_every_window(spark):
    rng = np.random.default_rng(4)
    classes, features = rng.integers(0, L.CLASSES, L.IDS), rng.standard_normal((L.IDS, L.FEATURES)).astype(np.float32)
    centres = features[: L.WORD_CLASSES - 1]
    base = rng.integers(0, 2000, L.STRIDE * 30).astype("<u2")

    def layer(stream):
        rows = [(bytearray(np.append(stream, L.END).astype("<u2").tobytes()),)]
        return L.descend(spark.createDataFrame(rows, "ids binary").coalesce(1), L.Attention(classes, features), centres)

    want = layer(base)
    again = layer(base)
    assert all((want[k] == again[k]).all() for k in want)
    for window in (0, 1, 7, 19, 20, 29):
        other = base.copy()
        other[window * L.STRIDE + 3 : window * L.STRIDE + 9] = 3000 + window  # inside this window, outside the next one's context
        assert any((layer(other)[k] != want[k]).any() for k in want), window
