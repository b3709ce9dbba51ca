"""Operator 9: language-model scores of whole texts.

Words are the white-space words in lower case (A-Z), each followed by nothing and preceded by a space when it is cut
into subword ids of a public byte-level BPE; a closing id ends a text. All that is learned comes from every document of
the training fold, in Spark tables that are aggregated before anything reaches the driver:

* counts of words, subword ids and pairs of neighbouring ids, from one pass;
* a vector for each id, from what stands before and after it, and classes of ids and of words by these vectors;
* P(id | its class, class of the id before), counted and smoothed;
* a causal self-attention layer in numpy, with relative positions, that predicts the class of the next id and of the next word.
  Every partition descends on all windows of its texts, BATCH and later LATER of them a step, and the layers are averaged by windows.

P(id | before) = P(class | before by attention) * P(id | class, class before). Windows of CONTEXT + STRIDE inputs overlap by
CONTEXT, so each id is scored once; windows run in masked batches. Words are spelled by their ids, or named. With s the share of
DISCOUNT taken off every training word, k the word's class by its ids,
P(word | before) = (1 - s) * P(k | before by attention) * (c(word) - DISCOUNT) / C(k) + s * P(its ids | before),
where C(k) sums what stands above it over the words of the class. The score is the sum of log10 over words and end.

Counts are of all words whatever their number. Tasks hold the most frequent ones (at most LOCAL_WORDS, a matter of speed
alone); each other token carries its two parts to a join with the count table, so results do not depend on that bound.
What the driver and the tasks hold beside it is bounded by the vocabulary of ids. Words are told apart by 64-bit hashes.

Defined cases: null or empty text is the end alone; very long texts and words are scored whole; a null doc_id is never held
out; equal rows score alike; ties in clustering go to the first class; with no training documents N = V = 0 and the model is uniform; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import _common as C
from corpusflow.llm.packing import encoder

IDS = 50_257
END = 50_256
CONTEXT, STRIDE = 8, 24
CLASSES = 48
WORD_CLASSES = 36
WIDTH = 16
FEATURES = 24
#: Directions onto which neighbours of an id are projected, on each side.
SKETCH = 48
LOCAL_WORDS = 1_000_000
#: Taken off the count of each named word, for words that training has not seen.
DISCOUNT = 0.75
SMOOTH = 0.05
#: What the first id of a word weighs beyond the others in the word's class.
FIRST = 0.618
#: Weight, in occurrences, of what an id has in its class against what it has after a class.
BACKOFF = 20.0
#: Windows in a step, and in each step after the first STEADY of a partition.
BATCH, LATER = 96, 192
STEADY = 200
#: Rows of a tall matrix that are multiplied at once; products of this size are made without packing, in less time.
PIECE = 96
#: Batches whose counts start a partition's weights of word classes after id classes.
WARM = 20
RATE = 0.03
#: Bytes of texts or ids that are cut or counted at once; the larger, the fewer words and pairs are met again.
CHUNK = 6 << 20
#: Words whose ids a task of tokenising keeps for its next texts, a matter of speed alone.
KNOWN = 1_000_000
#: Bytes of ids, two each, that training holds at once.
TRAIN_CHUNK = 2 << 20
#: Bytes of ids, two each, that scoring holds at once.
IDS_CHUNK = 1 << 20
HELD_PARTS, HELD_OUT = 7, 2


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes in their order, where each one stands, and which of them each hash is."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(order) else np.zeros(0, bool)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


class Subwords:
    """Subword ids of the words of a column of texts; those of words that `known` holds are taken from there, and new ones left there."""

    def __init__(self, texts: pa.Array, known: dict | None = None):
        words = C.Words(texts, lower=True)
        self.words = words
        hashes = words.hashes()
        self.unique, at, self.inverse = distinct(hashes)
        had, have, first, ids = (known or {}).get("words", (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)))
        place = np.searchsorted(had, self.unique)
        fresh = np.ones(len(self.unique), bool)
        fresh[place < len(had)] = had[place[place < len(had)]] != self.unique[place < len(had)]
        old = np.flatnonzero(~fresh)
        new, begin = self._spell(at[fresh])
        #: Ids of words one after another; where those of each different word begin, and how many they are.
        self.ids = np.concatenate([ids, new])
        self.first, self.sizes = np.empty(len(fresh), np.int64), np.empty(len(fresh), np.int64)
        self.first[old], self.sizes[old] = have[place[old]], first[place[old]]
        self.first[fresh], self.sizes[fresh] = begin[:-1] + len(ids), np.diff(begin)
        if known is not None:
            where = place[fresh]
            all_ = np.insert(had, where, self.unique[fresh]), np.insert(have, where, self.first[fresh]), np.insert(first, where, self.sizes[fresh]), self.ids
            known["words"] = all_ if len(all_[0]) <= KNOWN else (self.unique, self.first, self.sizes, self.ids)
            if len(known["words"][3]) > 8 * KNOWN:
                known.clear()

    def _spell(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places one after another, and where those of each begin, with their end."""
        words, enc = self.words, encoder()
        raw = words.data.tobytes()
        forms = [raw[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]
        if not forms:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        ids = np.array(enc.encode_ordinary((b" " + b" ".join(forms)).decode("utf-8", "replace")), np.int32)
        first = np.flatnonzero(_space_ids(enc)[ids])
        if len(first) != len(forms):  # a word holds a space of its own making
            each = [enc.encode_ordinary(" " + f.decode("utf-8", "replace")) for f in forms]
            ids = np.array([i for x in each for i in x], np.int32)
            first = np.cumsum([0, *(len(x) for x in each[:-1])])
        return ids, np.r_[first, len(ids)]

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids with an end after each text; the first id of each word or end; how many words and ends each text has."""
        words = self.words
        n_texts = len(words.first) - 1
        per_text = np.diff(words.first) + 1
        is_end = np.zeros(len(words) + n_texts, bool)
        is_end[np.cumsum(per_text) - 1] = True
        sizes = np.ones(len(is_end), np.int64)
        sizes[~is_end] = self.sizes[self.inverse]
        begin = np.cumsum(sizes) - sizes
        source = np.full(len(is_end), len(self.ids), np.int64)
        source[~is_end] = self.first[self.inverse]
        at = np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(source - begin, sizes)
        return np.append(self.ids, np.int32(END))[at], begin, per_text


_SPACE_IDS: dict[int, np.ndarray] = {}


def _space_ids(enc) -> np.ndarray:
    if id(enc) not in _SPACE_IDS:
        _SPACE_IDS[id(enc)] = np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(enc.n_vocab)] + [False] * (IDS - enc.n_vocab))
    return _SPACE_IDS[id(enc)]


class Ids:
    """Texts as ids, two bytes each, every text closed by the end: all ids one after another, where texts end, and their words."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = column.buffers()[2]
        self.bytes = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.stream = self.bytes.view("<u2").astype(np.int32)
        self.ends = (offsets[1:] - offsets[0]) // 2
        #: Where each word or end begins: an id with a leading space begins a word, and no other id of a word has one.
        self.begin = np.flatnonzero(_space_ids(encoder())[self.stream] | (self.stream == END))
        self.is_end = self.stream[self.begin] == END
        self.per_text = np.diff(np.searchsorted(self.begin, np.r_[0, self.ends]))
        starts, stops = self.begin[~self.is_end], np.r_[self.begin[1:], len(self.stream)][~self.is_end]
        #: Hashes of the different words; which of them each word is; the ids of these one after another, and where each begins.
        self.unique, at, self.inverse = distinct(C.span_hashes(self.bytes, 2 * starts, 2 * stops))
        sizes = (stops - starts)[at]
        self.first = np.cumsum(sizes) - sizes
        self.spelling = self.stream[np.arange(int(sizes.sum())) + np.repeat(starts[at] - self.first, sizes)]
        self.sizes = sizes


def tokenize(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, row and ids of docs(doc_id, text, held_out), written once, as every later pass reads them; without held_out, false."""

    def work(batch: pa.RecordBatch, known: dict) -> pa.RecordBatch:
        stream, begin, per_text = Subwords(batch.column("text"), known).stream()
        cuts = 2 * np.r_[begin, len(stream)][np.r_[0, np.cumsum(per_text)]]
        raw = stream.astype("<u2").tobytes()
        ids = pa.array([raw[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), batch.column("row"), ids], names=["doc_id", "held_out", "row", "ids"])

    def run(batches):
        known: dict = {}
        for batch in batches:
            for part in C.chunks(batch, "text", CHUNK):
                yield work(part, known)

    held = F.col("held_out") if "held_out" in docs.columns else F.lit(False).alias("held_out")
    rows = docs.select("doc_id", held, F.monotonically_increasing_id().alias("row"), "text")
    return C.materialize(rows.mapInArrow(run, "doc_id long, held_out boolean, row long, ids binary"), "lm-ids")


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, a, b, spelling, c): counts of words (kind 0: key is the hash, spelling the ids, two bytes each), ids (1: a), documents (2) and pairs of neighbouring ids (3: a, b) of docs(ids)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Ids(batch.column("ids"))
        stream = s.stream
        ids = np.bincount(stream, minlength=IDS)
        some = np.flatnonzero(ids)
        pair, n_pair = np.unique(np.append(np.uint32(END), stream[:-1].astype(np.uint32)) * np.uint32(IDS) + stream.astype(np.uint32), return_counts=True)  # below 2^32
        n_word, n = len(s.unique), len(s.unique) + len(some) + 1 + len(pair)
        kind = np.repeat(np.arange(4, dtype=np.int8), [n_word, len(some), 1, len(pair)])
        key, a, b = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        key[:n_word] = s.unique.view(np.int64)
        cuts = np.full(n + 1, 2 * len(s.spelling), np.int32)
        cuts[:n_word] = 2 * s.first
        spelling = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts), pa.py_buffer(s.spelling.astype("<u2"))])
        a[n_word : n_word + len(some)] = some
        a[n_word + len(some) + 1 :], b[n_word + len(some) + 1 :] = pair // IDS, pair % IDS
        c = np.r_[np.bincount(s.inverse, minlength=n_word), ids[some], batch.num_rows, n_pair].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(a), pa.array(b), spelling, pa.array(c)], names=["kind", "key", "a", "b", "spelling", "c"])

    return C.map_chunks(docs.select("ids"), "ids", "kind byte, key long, a int, b int, spelling binary, c long", work, CHUNK).groupBy("kind", "key", "a", "b", "spelling").agg(F.sum("c").alias("c"))


def neighbour_vectors(pairs: DataFrame, ids: np.ndarray, seed: int = 5) -> np.ndarray:
    """A vector for each id: the lift of its neighbours on either side, summed in Spark over random directions, then reduced to FEATURES."""
    total = max(1, int(ids.sum()))
    directions = np.random.default_rng(seed).standard_normal((2, IDS, SKETCH)).astype(np.float32) / math.sqrt(SKETCH)
    share = pairs.sparkSession.sparkContext.broadcast((ids, directions))

    def work(batches):
        ids, directions = share.value
        for batch in batches:
            one, other, side, c = (batch.column(x).to_numpy() for x in ("one", "other", "side", "c"))
            if not len(one):
                continue
            lift = np.log1p(c * float(total) / (ids[one] * ids[other].astype(np.float64)))
            begin = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (side[1:] != side[:-1])])
            sums = np.add.reduceat(lift[:, None].astype(np.float32) * directions[side, other], begin, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(one[begin]), pa.array(side[begin]), pa.array([x.tobytes() for x in sums], pa.binary())], names=["one", "side", "v"])

    both = pairs.select(F.col("a").alias("one"), F.col("b").alias("other"), F.lit(0).alias("side"), "c").unionAll(pairs.select(F.col("b").alias("one"), F.col("a").alias("other"), F.lit(1).alias("side"), "c"))
    got = both.repartition(C.shuffle_width(pairs.sparkSession), "one", "side").sortWithinPartitions("one", "side").mapInArrow(work, "one int, side int, v binary").toArrow()
    wide = np.zeros((IDS, 2, SKETCH), np.float32)
    if got.num_rows:
        v = np.frombuffer(b"".join(got.column("v").to_pylist()), np.float32).reshape(-1, SKETCH)
        np.add.at(wide, (got.column("one").to_numpy(), got.column("side").to_numpy()), v)
    share.destroy()
    wide = wide.reshape(IDS, 2 * SKETCH)
    wide /= np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-9)
    weight = np.log1p(ids)[:, None]
    mean = (wide * weight).sum(axis=0) / max(weight.sum(), 1e-9)
    wide = np.where(ids[:, None] > 0, wide - mean, 0)
    _, axes = np.linalg.eigh((wide * weight).T @ wide)
    out = wide @ axes[:, ::-1][:, :FEATURES]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def centres_of(features: np.ndarray, ids: np.ndarray, n: int, rounds: int = 15) -> np.ndarray:
    """Different directions of at most n clusters of the ids that occur, by spherical k-means from the most frequent ones."""
    some = np.argsort(-ids, kind="stable")[: np.count_nonzero(ids)]
    if not len(some):
        return np.zeros((1, FEATURES), np.float32)
    v, weight = features[some], np.log1p(ids[some])[:, None].astype(np.float32)
    c = v[:n].copy()
    for _ in range(rounds):
        c = c[np.sort(np.unique(c.round(4), axis=0, return_index=True)[1])]
        own = np.argmax(v @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, v * weight)
        there = np.bincount(own, minlength=len(c)) > 0
        c[there] = sums[there]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c[np.sort(np.unique(c.round(4), axis=0, return_index=True)[1])]


def word_classes(ids: np.ndarray, first: np.ndarray, features: np.ndarray, centres: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Class of each word by all its ids, given where each begins among ids, and how many it has, else all up to the next; the last class is
    the end's own. The first id counts a little more, so that ids that are centres themselves don't tie."""
    size = np.diff(np.r_[first, len(ids)]) if size is None else size
    out, to = np.empty(len(first), np.int32), np.ascontiguousarray(centres.T)
    short = np.minimum(size, _SHORT + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    cuts = np.searchsorted(short[order], np.arange(1, _SHORT + 2))
    for n, lo, hi in zip(range(1, _SHORT + 1), cuts, cuts[1:]):
        for at in range(lo, hi, _WORDS_AT_ONCE):
            some = order[at : min(hi, at + _WORDS_AT_ONCE)]
            begin = first[some]
            one = features.take(ids[begin], axis=0)
            v = one.copy()
            for j in range(1, n):
                v += features.take(ids[begin + j], axis=0)
            v += np.float32(FIRST) * one
            out[some] = np.argmax(_apply(v, to), axis=1)
    long = order[cuts[-1] :]
    if len(long):
        at = np.cumsum(size[long]) - size[long]
        own = ids[np.arange(int(size[long].sum())) + np.repeat(first[long] - at, size[long])]
        out[long] = np.argmax((np.add.reduceat(features[own], at, axis=0) + np.float32(FIRST) * features[own[at]]) @ to, axis=1)
    return out


#: Words of up to so many ids are added up place by place, so many words at once.
_SHORT, _WORDS_AT_ONCE = 8, 4096


def _windows(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts of a stream, and the place of each id among their scored places, one window after another."""
    ends = np.flatnonzero(stream == END) + 1
    begins = np.r_[0, ends[:-1]]
    blocks = -(-(ends - begins) // STRIDE)
    fresh, total = np.cumsum(blocks) - blocks, int(blocks.sum())
    place = np.arange(len(stream)) + np.repeat(fresh * STRIDE - begins, ends - begins)
    row = np.full(CONTEXT + 1 + total * STRIDE, END, np.int64)
    row[CONTEXT + 1 + place] = stream
    out = np.lib.stride_tricks.as_strided(row, (total, CONTEXT + STRIDE + 1), (STRIDE * row.itemsize, row.itemsize)).copy()
    out[fresh, : CONTEXT + 1] = END
    return out, place


def text_windows(ids: pa.Array, every: int = 1, skip: int = 0) -> tuple[np.ndarray, int]:
    """Rows of CONTEXT + STRIDE + 1 ids, one in `every` of those that follow each other through the texts after the first `skip`,
    filled with the end before a text's start and after its end; and how many follow each other."""
    windows, _ = _windows(np.frombuffer(b"".join(ids.to_pylist()), "<u2").astype(np.int32))
    return windows[skip::every], len(windows)


def classes_at(stream: np.ndarray, features: np.ndarray, centres: np.ndarray, begins: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """For each place of a stream of texts the class of the word or end that begins there; -1 elsewhere. `alone` is the class of each id as a word of its own."""
    first = np.flatnonzero(begins[stream] | (stream == END))
    size = np.diff(np.r_[first, len(stream)])
    k = alone[stream[first]]
    more = np.flatnonzero(size > 1)
    k[more] = word_classes(stream, first[more], features, centres, size[more])
    k[stream[first] == END] = WORD_CLASSES - 1
    out = np.full(len(stream), -1)
    out[first] = k
    return out


def training_windows(ids: pa.Array, features: np.ndarray, centres: np.ndarray, begins: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of `text_windows`, and for their scored places the class of the word or end that begins there; -1 elsewhere."""
    stream = np.frombuffer(b"".join(ids.to_pylist()), "<u2").astype(np.int32)
    windows, place = _windows(stream)
    goals = np.full(len(windows) * STRIDE, -1)
    goals[place] = classes_at(stream, features, centres, begins, alone)
    return windows, goals.reshape(-1, STRIDE)


def _apply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for an a of many rows."""
    out, whole = np.empty((len(a), b.shape[1]), np.float32), len(a) // PIECE * PIECE
    np.matmul(a[:whole].reshape(-1, PIECE, a.shape[1]), b, out=out[:whole].reshape(-1, PIECE, b.shape[1]))
    np.matmul(a[whole:], b, out=out[whole:])
    return out


def _sum_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for an a and b of many rows."""
    whole = len(a) // PIECE * PIECE
    parts = a[:whole].reshape(-1, PIECE, a.shape[1]).transpose(0, 2, 1) @ b[:whole].reshape(-1, PIECE, b.shape[1])
    return parts.sum(axis=0) + a[whole:].T @ b[whole:]


_INPUTS = CONTEXT + STRIDE
_DISTANCE = np.arange(CONTEXT, _INPUTS)[:, None] - np.arange(_INPUTS)[None, :]
_CAUSAL = _DISTANCE >= 0
#: Distance of each place from each input, the last index where it comes before; what adds up each distance; ones; a row for each class.
_POSITION = np.where(_CAUSAL, _DISTANCE, _INPUTS)
_BY_DISTANCE = np.eye(_INPUTS + 1, dtype=np.float32)[_POSITION.ravel(), :_INPUTS]
_ONES = np.ones(max(_INPUTS, CLASSES, WORD_CLASSES), np.float32)
_HOT = np.eye(CLASSES, dtype=np.float32)
#: Rows whose logits are held at once.
_ROWS = 24 * PIECE
#: Logits are cut here on both sides before exp in training, far beyond what matters.
_MOST = np.float32(60)


def _softmax(z: np.ndarray) -> np.ndarray:
    y = np.exp(z - z.max(axis=2, keepdims=True))
    return y / y.sum(axis=2, keepdims=True)


class Attention:
    """One causal self-attention layer from id features to the class of the next id."""

    def __init__(self, classes: np.ndarray, features: np.ndarray, seed: int = 3, p: dict | None = None):
        rng = np.random.default_rng(seed)
        self.classes, self.features, self.p = classes, features, p
        if p is not None:
            return
        g = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {"q": g(FEATURES, WIDTH), "k": g(FEATURES, WIDTH), "v": g(FEATURES, WIDTH), "o": g(WIDTH, CLASSES), "t": np.zeros((CLASSES, CLASSES), np.float32), "b": np.zeros(CLASSES, np.float32), "r": np.zeros(_INPUTS, np.float32), "wo": g(WIDTH, WORD_CLASSES), "wt": np.zeros((CLASSES, WORD_CLASSES), np.float32), "wb": np.zeros(WORD_CLASSES, np.float32)}

    def _forward(self, windows: np.ndarray):
        p = self.p
        x = self.features[windows[:, :-1]]
        q, k, v = x[:, CONTEXT:] @ p["q"], x @ p["k"], x @ p["v"]
        s = q @ k.transpose(0, 2, 1) / math.sqrt(WIDTH) + np.where(_CAUSAL, p["r"][np.abs(_DISTANCE)], -1e9)
        a = np.exp(s - s.max(axis=2, keepdims=True))
        a /= a.sum(axis=2, keepdims=True)
        c = a @ v
        before = self.classes[windows[:, CONTEXT:-1]]
        return x, q, k, v, a, c, before, _softmax(c @ p["o"] + p["t"][before] + p["b"]), _softmax(c @ p["wo"] + p["wt"][before] + p["wb"])

    def step(self, w: np.ndarray, word: np.ndarray, rate: float, state: dict) -> None:
        """One step of Adam on a batch of windows; state holds the moments, and the parameters one after another."""
        if "all" not in state:
            state["all"] = np.concatenate([x.ravel() for x in self.p.values()])
            state["m1"], state["m2"], state["n"] = np.zeros_like(state["all"]), np.zeros_like(state["all"]), 0
            cuts = np.cumsum([x.size for x in self.p.values()])
            self.p = {k: x.reshape(v.shape) for (k, v), x in zip(self.p.items(), np.split(state["all"], cuts[:-1]))}
            state["norm"] = max(1e-9, float(np.linalg.norm(self.features, axis=1).max()))
        p, n, scale = self.p, len(w), np.float32(1 / math.sqrt(WIDTH))
        flat = lambda m: m.reshape(-1, m.shape[-1])
        x = self.features.take(w[:, :-1], axis=0).reshape(-1, FEATURES)
        y = _apply(x, np.hstack([p["q"] * scale, p["k"], p["v"]])).reshape(n, _INPUTS, 3 * WIDTH)
        q, k, v = y[:, CONTEXT:, :WIDTH], y[..., WIDTH : 2 * WIDTH], y[..., 2 * WIDTH :]
        across = np.empty((n, 2 * WIDTH + 1, _INPUTS), np.float32)  # keys, values and a one, place by place
        across[:, :-1] = y[..., WIDTH:].transpose(0, 2, 1)
        across[:, -1] = 1
        a = q @ across[:, :WIDTH]
        if np.vdot(p["q"], p["q"]) * np.vdot(p["k"], p["k"]) * (scale * state["norm"] ** 2) ** 2 > _MOST**2:  # else no logit gets there
            np.clip(a, -_MOST, _MOST, out=a)
        np.exp(a, out=a)
        a *= np.append(np.exp(p["r"]), np.float32(0))[_POSITION]
        weight = 1 / (flat(a) @ _ONES[:_INPUTS])[:, None]
        c = flat(a @ v)
        c *= weight
        of_class = self.classes.take(w[:, CONTEXT:])
        before, target = of_class[:, :-1].ravel(), of_class[:, 1:].ravel()
        most = max(c.max(initial=0), -c.min(initial=0))

        def learn(c, before, o, t, target):
            """What the mean loss of each row gives c, o and t."""
            m, wide, back = len(c), o.shape[1], np.ascontiguousarray(o.T)
            t = t - t.max(axis=1, keepdims=True)
            cut = most * np.abs(o).sum(axis=0).max() - t.min() > _MOST
            dc, to_o, to_t = np.empty_like(c), np.zeros_like(o), np.zeros_like(t)
            for i in range(0, m, _ROWS):
                some = slice(i, i + _ROWS)
                near, last = c[some], before[some]
                z = _apply(near, o)
                z += t.take(last, axis=0)
                if cut:
                    np.clip(z, -_MOST, _MOST, out=z)
                np.exp(z, out=z)
                z *= (1 / ((z @ _ONES[:wide]) * np.float32(m)))[:, None]
                z.ravel()[np.arange(0, z.size, wide) + target[some]] -= np.float32(1 / m)
                dc[some] = _apply(z, back)
                to_o += _sum_of(near, z)
                to_t += _sum_of(_HOT.take(last, axis=0), z)
            return dc, to_o, to_t

        g = {}
        dc, g["o"], g["t"] = learn(c, before, p["o"], p["t"] + p["b"], target)
        at = np.flatnonzero(word.ravel() >= 0)
        more, g["wo"], g["wt"] = learn(c.take(at, axis=0), before.take(at), p["wo"], p["wt"] + p["wb"], word.ravel().take(at))
        dc[at] += more
        g["b"], g["wb"] = g["t"].sum(0), g["wt"].sum(0)
        held = np.empty((n * STRIDE, WIDTH + 1), np.float32)
        np.multiply(dc, weight, out=held[:, :-1])
        np.multiply(np.einsum("ij,ij->i", dc, c), -weight[:, 0], out=held[:, -1])
        held = held.reshape(n, STRIDE, WIDTH + 1)
        ds = held @ across[:, WIDTH:]
        ds *= a
        g["r"] = (_ONES[:1].repeat(n) @ ds.reshape(n, -1)) @ _BY_DISTANCE
        back = np.empty((n, _INPUTS, 3 * WIDTH), np.float32)
        back[:, :CONTEXT, :WIDTH] = 0
        np.matmul(ds, k, out=back[:, CONTEXT:, :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q, out=back[..., WIDTH : 2 * WIDTH])
        np.matmul(a.transpose(0, 2, 1), held[..., :-1], out=back[..., 2 * WIDTH :])
        both = _sum_of(x, flat(back))
        g["q"], g["k"], g["v"] = both[:, :WIDTH] * scale, both[:, WIDTH : 2 * WIDTH], both[:, 2 * WIDTH :]
        state["n"] += 1
        slope = np.concatenate([g[name].ravel() for name in p])
        m1, m2 = state["m1"], state["m2"]
        m1 += np.float32(0.1) * (slope - m1)
        m2 += np.float32(0.01) * (slope * slope - m2)
        pace = np.float32(rate * min(1.0, state["n"] / 20) / (1 - 0.9 ** state["n"]))
        state["all"] -= pace * m1 / (np.sqrt(m2 * np.float32(1 / (1 - 0.99 ** state["n"]))) + np.float32(1e-8))

    def loss(self, windows: np.ndarray) -> float:
        y = self._forward(windows)[-2]
        return float(-np.log(np.take_along_axis(y, self.classes[windows[:, CONTEXT + 1 :]][..., None], 2)).mean())

    def tables(self) -> dict:
        """What scoring needs: per-id queries, keys and values, and the weights of positions; logits stay small enough for exp."""
        p = self.p
        q, k = self.features @ p["q"] / math.sqrt(WIDTH), self.features @ p["k"]
        top = float(np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max())
        if top > 60:
            q = q * (60 / top)
        t, wt = p["t"] + p["b"], p["wt"] + p["wb"]
        return {"q": q.astype(np.float32), "kv": np.hstack([k, self.features @ p["v"], np.ones((IDS, 1))]).astype(np.float32), "o": p["o"], "t": (t - t.max(axis=1, keepdims=True)).astype(np.float32), "wo": p["wo"], "wt": (wt - wt.max(axis=1, keepdims=True)).astype(np.float32), "m": np.where(_CAUSAL, np.exp(p["r"][np.abs(_DISTANCE)]), 0).astype(np.float32), "class": self.classes.astype(np.int32)}


def log_probabilities(stream: np.ndarray, ends: np.ndarray, m: dict, word: np.ndarray, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """log10 P of each id of a stream of texts, each closed at `ends` (exclusive) by END, and of the class of the word that
    begins there, where `word` gives one; it is -1 elsewhere. Every text begins a block of STRIDE places of its own; a window is
    a block with the CONTEXT places before it."""
    begins = np.r_[0, ends[:-1]]
    blocks = -(-(ends - begins) // STRIDE)
    fresh = np.cumsum(blocks) - blocks
    place = np.arange(len(stream)) + np.repeat(fresh * STRIDE - begins, ends - begins)
    size = int(blocks.sum()) * STRIDE
    target, goal = np.full(size, END, np.int32), np.full(size, -1, np.int32)
    target[place], goal[place] = stream, word
    inputs = np.full(CONTEXT + size, END, np.int32)
    inputs[CONTEXT + 1 :] = target[:-1]
    inputs[CONTEXT + fresh * STRIDE] = END
    first = np.zeros(size // STRIDE, bool)
    first[fresh] = True
    out, named = np.empty(size, np.float32), np.zeros(size, np.float32)
    kinds, within = m["class"].astype(np.int64), m["within"].ravel()
    for i in range(0, len(first), batch):
        n = min(batch, len(first) - i)
        lo, hi = i * STRIDE, (i + n) * STRIDE
        ids = inputs[lo : hi + CONTEXT]
        own, to = ids[CONTEXT:], target[lo:hi]
        kv = m["kv"].take(ids, axis=0)
        across = np.ascontiguousarray(kv[:, :WIDTH].T)
        windows = lambda x, *shape, by: np.lib.stride_tricks.as_strided(x, (n, *shape), (STRIDE * by, *x.strides))  # noqa: B023, E731
        w = m["q"].take(own, axis=0).reshape(n, STRIDE, WIDTH) @ windows(across, WIDTH, _INPUTS, by=across.strides[1])
        np.exp(w, out=w)
        w *= m["m"]
        w[np.flatnonzero(first[i : i + n]), :, :CONTEXT] = 0
        c = (w @ windows(kv[:, WIDTH:], _INPUTS, WIDTH + 1, by=kv.strides[0])).reshape(-1, WIDTH + 1)  # the last column sums the weights
        c = c[:, :WIDTH] / c[:, WIDTH:]
        before = kinds.take(own)

        def gained(c, o, t, before, k):
            """Log share of class k of each row."""
            z = _apply(c, o)
            z += t.take(before, axis=0)
            got = z.ravel().take(np.arange(0, z.size, z.shape[1]) + k)
            np.exp(z, out=z)
            return got - np.log(z @ _ONES[: z.shape[1]])

        out[lo:hi] = gained(c, m["o"], m["t"], before, kinds.take(to)) + within.take(before * IDS + to)
        at = np.flatnonzero(goal[lo:hi] >= 0)
        named[lo + at] = gained(c.take(at, axis=0), m["wo"], m["wt"], before.take(at), goal[lo:hi].take(at))
    tenth = np.float32(1 / math.log(10))
    return out[place] * tenth, named[place] * tenth


def class_pairs(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Occurrences of each id after each class, CLASSES by IDS; summed in Spark."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(classes[batch.column("a").to_numpy()].astype(np.int32)), batch.column("b"), batch.column("c")], names=["k", "b", "c"])

    got = pairs.select("a", "b", "c").mapInArrow(work, "k int, b int, c long").groupBy("k", "b").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros((CLASSES, IDS), np.float32)
    out[got.column("k").to_numpy(), got.column("b").to_numpy()] = got.column("c").to_numpy()
    return out


def _given(c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log share of each column in each row of counts, against log shares b."""
    return (np.log((c + 5 * np.exp(b)) / (c.sum(1, keepdims=True) + 5)) - b).astype(np.float32)


def descend(docs: DataFrame, model: Attention, centres: np.ndarray) -> dict:
    """The mean of the layers that the partitions of docs(ids) reach from the model on their own windows, summed in Spark, entry by entry."""
    shapes = {k: v.shape for k, v in model.p.items()} | {"_n": (1,)}
    share = docs.sparkSession.sparkContext.broadcast((model, centres))

    def work(batches):
        own, centres = share.value
        own = Attention(own.classes, own.features, p={k: v.copy() for k, v in own.p.items()})
        begins, state = _space_ids(encoder()), {}
        alone = word_classes(np.arange(IDS), np.arange(IDS), own.features, centres)
        hold, goals, done = np.zeros((0, _INPUTS + 1), np.int64), np.zeros((0, STRIDE), np.int64), 0

        def train(w, targets):
            if not state:
                there = targets >= 0
                seen = np.bincount(own.classes[w[:, CONTEXT:-1]][there] * WORD_CLASSES + targets[there], minlength=CLASSES * WORD_CLASSES)
                own.p["wt"] = _given(seen.reshape(CLASSES, WORD_CLASSES), own.p["wb"])
            size = LATER if state.get("n", 0) >= STEADY else BATCH
            for i in range(0, len(w), size):
                own.step(w[i : i + size], targets[i : i + size], RATE, state)

        for batch in batches:
            for part in C.chunks(batch, "ids", TRAIN_CHUNK):
                windows, targets = training_windows(part.column("ids"), own.features, centres, begins, alone)
                hold, goals = np.concatenate([hold, windows]), np.concatenate([goals, targets])
                done += len(windows)
                whole = len(hold) // (WARM * BATCH) * (WARM * BATCH)
                for i in range(0, whole, WARM * BATCH):
                    train(hold[i : i + WARM * BATCH], goals[i : i + WARM * BATCH])
                hold, goals = hold[whole:], goals[whole:]
        if len(hold):
            train(hold, goals)
        if done:
            flat = np.concatenate([*(own.p[k].ravel() * float(done) for k in own.p), [float(done)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64))], names=["i", "x"])

    got = docs.select("ids").mapInArrow(work, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(sum(math.prod(s) for s in shapes.values()))
    flat[got.column("i").to_numpy()] = got.column("x").to_numpy()
    share.destroy()
    out, at = {}, 0
    for name, shape in shapes.items():
        out[name] = flat[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    n = out.pop("_n")[0]
    return {k: (v / n).astype(np.float32) for k, v in out.items()} if n else model.p


def local_bound(words: DataFrame, most: int = LOCAL_WORDS) -> int:
    """The least count that at most `most` words reach, to ten significant bits."""
    low = F.greatest(F.floor(F.log2("c")) - 9, F.lit(0)).cast("int")
    total, least = 0, 1 << 62
    for r in words.select(F.expr("c").alias("c")).withColumn("low", low).select(F.expr("shiftleft(shiftright(c, low), low)").alias("c")).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        total += r.n
        if total > most:
            break
        least = r.c
    return least


def fit(docs: DataFrame, local_words: int = LOCAL_WORDS) -> dict:
    """The model that docs(doc_id, text), or what `tokenize` made of them, teach."""
    docs = docs if "ids" in docs.columns else tokenize(docs)
    counts = C.materialize(corpus_counts(docs), "lm-counts")
    words, pairs = counts.where("kind = 0"), counts.where("kind = 3")
    n_words, n_forms, n_docs = counts.agg(F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("c"))), F.lit(0)), F.count_if(F.col("kind") == 0), F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("c"))), F.lit(0))).first()
    ids = np.zeros(IDS, np.int64)
    for r in counts.where("kind = 1").select("a", "c").collect():
        ids[r.a] = r.c
    features = neighbour_vectors(pairs, ids)
    classes = np.where(ids > 0, np.argmax(features @ centres_of(features, ids, CLASSES).T, axis=1), np.arange(IDS) % CLASSES)
    centres = centres_of(features, ids, WORD_CLASSES - 1)
    after = class_pairs(pairs, classes)
    # ids in their class, then after a class
    smooth = ids + SMOOTH
    alone = smooth / np.bincount(classes, weights=smooth, minlength=CLASSES)[classes]
    moves = np.stack([np.bincount(classes, weights=row, minlength=CLASSES) for row in after])
    within = np.empty((CLASSES, IDS), np.float32)
    for k in range(CLASSES):
        within[k] = np.log((after[k] + BACKOFF * alone) / (moves[k] + BACKOFF)[classes])

    def named(batches):
        for batch in batches:
            spelling = batch.column("spelling")
            sizes = pc.binary_length(spelling).to_numpy() // 2
            k = word_classes(np.frombuffer(b"".join(spelling.to_pylist()), "<u2"), np.cumsum(sizes) - sizes, features, centres)
            yield pa.RecordBatch.from_arrays([pa.array(k), batch.column("c")], names=["k", "c"])

    of_class = np.zeros(WORD_CLASSES)
    for r in words.select("spelling", "c").mapInArrow(named, "k int, c long").groupBy("k").agg(F.sum(F.col("c") - F.lit(DISCOUNT)).alias("c")).collect():
        of_class[r.k] = r.c
    of_class[WORD_CLASSES - 1] = max(0, n_docs - DISCOUNT)
    model = Attention(classes, features)
    log_share = lambda c: np.log(c / c.sum(axis=-1, keepdims=True))
    model.p["b"] = log_share(moves.sum(0) + 1.0).astype(np.float32)
    model.p["t"] = _given(moves, model.p["b"])
    model.p["wb"] = log_share(of_class + 1.0).astype(np.float32)
    model.p = descend(docs, model, centres)
    least = local_bound(words, local_words)
    got = words.where(F.col("c") >= least).select("key", "c").toArrow()
    key, c = got.column("key").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(key)
    spelled = min(1.0, max(1e-6, 1 - of_class.sum() / max(1, n_words + n_docs)))
    with np.errstate(divide="ignore"):
        name = np.log(1 - spelled) - np.log(np.maximum(of_class, 1e-9))
    return {
        "words": words.select("key", "c"),
        "n": n_words + n_docs,
        "v": n_forms + (n_docs > 0),
        "n_docs": n_docs,
        "attention": model,
        "tasks": {"tables": model.tables() | {"within": within}, "features": features, "centres": centres, "key": key[order], "c": c[order], "name": name, "spell": math.log(spelled), "n_docs": n_docs},
    }


PART = "doc_id long, row long, held_out boolean, n_tokens long, n_known long, base double, score double, key array<long>, name array<double>, spell array<double>"


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text, held_out), or what `tokenize` made of them, by a model of `fit`."""
    share = docs.sparkSession.sparkContext.broadcast(model["tasks"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = share.value
        s = Ids(batch.column("ids"))
        stream, begin, is_end, per_text = s.stream, s.begin, s.is_end, s.per_text
        text_at = np.cumsum(per_text) - per_text
        group = np.full(len(begin), WORD_CLASSES - 1, np.int32)
        group[~is_end] = word_classes(s.spelling, s.first, m["features"], m["centres"])[s.inverse]
        word = np.full(len(stream), -1, np.int32)
        word[begin] = group
        lp, named = log_probabilities(stream, s.ends, m["tables"], word)
        ten = math.log(10)
        spell = np.add.reduceat(lp, begin, dtype=np.float64) * ten + m["spell"]
        name = named[begin] * ten + m["name"][group]
        known = np.zeros(len(s.unique), bool)
        c = np.zeros(len(s.unique), np.int64)
        if len(m["key"]):
            at = np.minimum(np.searchsorted(m["key"], s.unique), len(m["key"]) - 1)
            known = m["key"][at] == s.unique
            c[known] = m["c"][at[known]]
        count, here = np.full(len(begin), m["n_docs"]), np.ones(len(begin), bool)
        count[~is_end], here[~is_end] = c[s.inverse], known[s.inverse]
        # both parts in natural logs, the named one -inf without a count; tokens that are not here are added after the join
        with np.errstate(divide="ignore"):
            both = np.where(here, np.logaddexp(name + np.log(np.maximum(count - DISCOUNT, 0)), spell), 0) / ten
        sums = lambda x: np.add.reduceat(x, text_at)
        away = np.flatnonzero(~here[~is_end])
        cuts = pa.array(np.searchsorted(np.repeat(np.arange(batch.num_rows), per_text - 1)[away], np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (s.unique[s.inverse[away]].view(np.int64), name[~is_end][away], spell[~is_end][away])]
        flat = [per_text.astype(np.int64), sums((here & (count > 0)).astype(np.int64)), sums(np.where(here, np.log10(count + 1.0), 0)), sums(both)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("row"), batch.column("held_out"), *map(pa.array, flat), *lists], names=[x.split()[0] for x in PART.split(", ")])

    rows = (docs if "ids" in docs.columns else tokenize(docs)).select("doc_id", "row", "held_out", "ids")
    part = C.materialize(C.map_chunks(rows, "ids", PART, work, IDS_CHUNK), "lm-scores")
    away = part.select("row", F.explode(F.arrays_zip("key", "name", "spell")).alias("w")).select("row", "w.*").join(model["words"], "key", "left")
    named = F.when(F.col("c").isNotNull(), F.col("name") + F.ln(F.col("c") - F.lit(DISCOUNT)))
    top, low = F.greatest(named, "spell"), F.least(named, "spell")
    both = F.coalesce(top + F.log1p(F.exp(low - top)), "spell") / math.log(10)
    more = away.groupBy("row").agg(F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("b"), F.sum(F.when(named.isNull(), F.col("spell") / math.log(10)).otherwise(both)).alias("s"))
    per_token = math.log10(model["n"] + model["v"] + 1)
    return part.drop("key", "name", "spell").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_PARTS == HELD_OUT, F.lit(False))
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    ids = tokenize(docs)
    return score(ids, fit(ids.where(~F.col("held_out"))))
