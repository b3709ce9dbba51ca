"""Operator 6: benchmark decontamination by template windows.

A text becomes the sequence of its white-space words, lower-cased, without outer punctuation; words of nothing
else go. In the template form numbers, capitalised words inside a sentence and units after a number are typed
placeholders. Windows of WINDOW words are looked up, as they are and as templates, in a hash table of the benchmark's
windows. A template window counts only with MIN_PLAIN words that are no placeholders, equal word by word, and
only while its slots agree: along one alignment, equal benchmark values stand for equal document values and
different ones for different. An item is leaked if SHARE of its words are covered, or LONG words.

The benchmark is the stated query set. Its table goes to every task in blocks of at most BLOCK_WORDS words, one
pass over the documents each, so what is sent is bounded whatever its size. Documents are never shuffled.

Defined cases: null or blank text or item matches nothing; items shorter than a window are one window of their own
length, from SHORTEST words on; equal rows are reported each; ties do not arise; an empty benchmark leaks nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import _common as C

WINDOW = 8
SHORTEST = 3
MIN_PLAIN = 4
SHARE = 0.6
LONG = 25
BLOCK_WORDS = 500_000
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb ml l gal s sec ms min h hr hrs hours minutes seconds days weeks months years usd eur gbp dollars euros cents percent hz khz mhz ghz w kw v a c f k b kb mb gb tb mph kmh km/h m/s meters metres kilometers kilometres grams kilograms liters litres inches feet miles pounds ounces degrees".split())
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*")
_PLAIN, _NUM, _UNIT = 0, 1, 2
_SLOT_HASH = C.mix(np.arange(1, 5, dtype=np.uint64))
_NAME_HASH = _SLOT_HASH[3]


class Tokens:
    """Kept words of a column of texts with plain and template hashes."""

    def __init__(self, texts: pa.Array):
        words = C.Words(texts)
        hashes = words.hashes()
        owner = words.owner()
        raw = words.data.tobytes()
        uniq, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        n = len(uniq)
        self.forms: list[str] = []
        kind, title, ends, keep = np.zeros(n, np.int8), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        for i, (a, b) in enumerate(zip(words.starts[at].tolist(), words.ends[at].tolist())):
            whole = raw[a:b].decode("utf-8", "replace")
            core = _OUTER.sub("", whole)
            self.forms.append(core.lower())
            if not core:
                continue
            keep[i] = True
            first = core[0]
            if first.isdigit() and _NUMBER.match(core):
                kind[i] = _NUM
            elif self.forms[-1] in UNITS:
                kind[i] = _UNIT
            title[i] = first.isupper() and core[1:].islower()
            ends[i] = any(c in ".!?:" for c in whole[whole.rfind(core[-1]) :])
        plain = np.zeros(n, np.uint64)
        if n:
            plain[keep] = _hash_forms([f for f, k in zip(self.forms, keep.tolist()) if k])
        kept = np.flatnonzero(keep[inverse])
        self.form = inverse[kept]
        self.owner = owner[kept]
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.plain = plain[self.form]
        newline = np.r_[0, np.cumsum(words.data == 10)]
        begin = np.ones(len(kept), bool)  # at the start of a sentence, line or text
        if len(kept) > 1:
            a, b = kept[:-1], kept[1:]
            begin[1:] = (self.owner[1:] != self.owner[:-1]) | ends[self.form[:-1]] | (newline[words.starts[b]] != newline[words.ends[a]])
        k = kind[self.form]
        name = title[self.form] & ~begin & (k == _PLAIN)
        unit = (k == _UNIT) & np.r_[False, k[:-1] == _NUM] if len(k) else np.zeros(0, bool)
        number = k == _NUM
        self.slot = name | unit | number
        self.template = self.plain.copy()
        self.template[name], self.template[unit], self.template[number] = _NAME_HASH, _SLOT_HASH[_UNIT], _SLOT_HASH[_NUM]

    def word(self, i: int) -> str:
        return self.forms[self.form[i]]


def _hash_forms(forms: list[str]) -> np.ndarray:
    """Hash of each form as one word, inner white space such as a no-break space included."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(f.encode()) for f in forms), np.uint64, len(forms))


class Bench:
    """Windows of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str], window: int = WINDOW):
        t = Tokens(pa.array(texts, pa.string()))
        self.ids, self.window = ids, window
        self.words = [[t.word(j) for j in range(t.first[i], t.first[i + 1])] for i in range(len(ids))]
        self.slots = [t.slot[t.first[i] : t.first[i + 1]].tolist() for i in range(len(ids))]
        self.where: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for i in range(len(ids)):
            a, b = int(t.first[i]), int(t.first[i + 1])
            size = min(window, b - a)
            if size < SHORTEST:
                continue
            for h in (t.plain[a:b], t.template[a:b]):
                for j, x in enumerate(C.window_hashes(h, size).tolist()):
                    if (i, j) not in self.where[size][x]:
                        self.where[size][x].append((i, j))
        self.where = {k: dict(v) for k, v in self.where.items()}
        self.filters = {}
        for size, table in self.where.items():
            f = np.zeros(1 << 22, bool)
            f[(np.fromiter(table, np.uint64, len(table)) >> np.uint64(42)).astype(np.int64)] = True
            self.filters[size] = f

    def leaks(self, t: Tokens) -> list[tuple[int, int, int, float, bool]]:
        """(text, item, covered words, share, by template only) of a column of texts."""
        found: dict[tuple[int, int], dict] = {}
        for size, table in self.where.items():
            m = len(t.plain) - size + 1
            if m <= 0:
                continue
            inside = t.owner[:m] == t.owner[size - 1 :]
            slots = np.r_[0, np.cumsum(t.slot)]
            plain_enough = size - (slots[size:] - slots[:-size])[:m] >= min(MIN_PLAIN, size)
            for exact, h, ok in ((True, C.window_hashes(t.plain, size), inside), (False, C.window_hashes(t.template, size), inside & plain_enough)):
                maybe = np.flatnonzero(ok & self.filters[size][(h >> np.uint64(42)).astype(np.int64)])
                for p, x in zip(maybe.tolist(), h[maybe].tolist()):
                    for item, j in table.get(x, ()):
                        key = (int(t.owner[p]), item)
                        state = found.setdefault(key, {"covered": set(), "exact": set(), "maps": {}})
                        self._take(t, state, item, p, j, size, exact)
        out = []
        for (text, item), state in found.items():
            n = len(state["covered"])
            if n >= LONG or n >= SHARE * len(self.words[item]):
                out.append((text, item, n, n / len(self.words[item]), len(state["exact"]) < n))
        return out

    def _take(self, t: Tokens, state: dict, item: int, p: int, j: int, size: int, exact: bool) -> None:
        mine, slots = self.words[item], self.slots[item]
        ours = [t.word(i) for i in range(p, p + size)]
        if exact:
            if ours == mine[j : j + size]:
                state["covered"].update(range(j, j + size))
                state["exact"].update(range(j, j + size))
            return
        there, back = state["maps"].setdefault(p - j, ({}, {}))
        new = []
        for i, w in enumerate(ours):
            b = mine[j + i]
            if t.slot[p + i] and slots[j + i]:
                if there.get(b, w) != w or back.get(w, b) != b:
                    return
                new.append((b, w))
            elif w != b:
                return
        if len({*dict(new)}) != len({w for _, w in new}):
            return
        there.update(new)
        back.update((w, b) for b, w in new)
        state["covered"].update(range(j, j + size))


def bench_blocks(benchmark: DataFrame, words: int = BLOCK_WORDS):
    """Blocks of benchmark(item_id, text) as Bench objects; rows come to the driver one partition at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if not row.text:
            continue
        n = len(row.text.split())
        if ids and size + n > words:
            yield Bench(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += n
    if ids:
        yield Bench(ids, texts)


LEAK = "doc_id long, item_id long, n_words long, share double, reparameterised boolean"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document of docs(doc_id, text) and item of benchmark(item_id, text) leaked into it."""
    out = None
    for bench in bench_blocks(benchmark):

        def work(batch: pa.RecordBatch, bench=bench):
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[d], bench.ids[i], n, share, template) for d, i, n, share, template in bench.leaks(Tokens(batch.column("text")))]
            if rows:
                return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], names=["doc_id", "item_id", "n_words", "share", "reparameterised"])

        part = C.map_chunks(docs.select("doc_id", "text"), "text", LEAK, work)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], LEAK) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns stay."""
    for bench in bench_blocks(benchmark):

        def work(batch: pa.RecordBatch, bench=bench) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            for d, *_ in bench.leaks(Tokens(batch.column("text"))):
                keep[d] = False
            return batch.filter(pa.array(keep))

        docs = C.map_chunks(docs, "text", docs.schema, work)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
