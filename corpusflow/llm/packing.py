"""Operator 10: sum-of-squares online packing.

Every task packs the documents of its own input split, so nothing is shuffled: a document is tokenised,
cut at the window length, and the rest is placed in the fill level that keeps the squared counts of
partially filled windows smallest. A level array holds those counts. Windows still open when the split
ends are drained into each other by cutting, and the last one is cut at powers of two, which need no padding.

Defined cases: null or empty text packs as the closing id alone; equal rows are packed one by one;
ties between fill levels go to the fullest window; very long texts are cut at the window length; an empty table gives no rows;
other columns are ignored, whatever their names. Strings of special tokens are encoded as the vocabulary's own library
does, as their single id.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import _common as C

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
WINDOW = 1024
#: Vocabulary by which op10 is defined, and the same ranks in the file that the faster library reads.
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
_ENCODERS: dict = {}


def encoder(ranks: str | None = None):
    """The byte-level BPE; tests hold its ids against those of VOCABULARY."""
    import public_tokenizers
    import tiktoken

    path = ranks or public_tokenizers.path(RANKS)
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[path]


def token_ids(texts: list[str | None], ranks: str | None = None) -> list[list[int]]:
    """Ids of each text by VOCABULARY. Texts without a special token's string get the same ids, five times as fast, from the ranks."""
    enc = encoder(ranks)
    if ranks:
        return [enc.encode_ordinary(t or "") for t in texts]
    if VOCABULARY not in _ENCODERS:
        import public_tokenizers
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
        _ENCODERS[VOCABULARY] = own, tuple(x.content for x in own.get_added_tokens_decoder().values())
    own, special = _ENCODERS[VOCABULARY]
    return [own.encode(t, add_special_tokens=False).ids if t and any(x in t for x in special) else enc.encode_ordinary(t or "") for t in texts]


class LevelPacker:
    """Sum-of-squares packing of items of 1 to `size` tokens into windows of `size`."""

    def __init__(self, size: int, first_id: int = 0):
        self.size, self.next_id = size, first_id
        #: Windows at each fill; full ones are closed and not counted.
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.held: dict[int, list[tuple]] = {}

    def fresh(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, piece: tuple, n: int) -> list[tuple]:
        """Put a piece of n tokens in a window; returns the pieces of a window that this closes."""
        if n == self.size:
            return [(*piece, self.fresh(), 0)]
        # N(h) falls and N(h + n) rises by one: the change of the sum of squares is 2 (N(h + n) - N(h) + 1); a full window leaves the sum
        c = self.counts
        last = self.size - n
        rise = c[n : self.size + 1] - c[: last + 1]
        rise[0] = c[n]
        cost = 2 * rise + 2
        cost[0] -= 1
        cost[last] = 1 - 2 * c[last]
        cost[1:][c[1 : last + 1] == 0] = np.iinfo(np.int64).max
        level = int(len(cost) - 1 - np.argmin(cost[::-1]))  # ties: the fullest window
        if level and not c[level]:
            level = 0
        if level:
            c[level] -= 1
            window = self.open[level].pop()
        else:
            window = self.fresh()
            self.held[window] = []
        self.held[window].append((*piece, window, level))
        fill = level + n
        if fill == self.size:
            return self.held.pop(window)
        c[fill] += 1
        self.open[fill].append(window)
        return []

    def drain(self, length_at: int, cut) -> Iterator[tuple]:
        """Close what is open: the emptiest windows are cut up to fill the fullest; the last is cut at powers of two."""
        order = [(level, w) for level in range(self.size, 0, -1) for w in self.open[level]]
        low, high = len(order) - 1, 0
        spare: list[tuple] = []
        while high <= low:
            fill, window = order[high]
            high += 1
            while fill < self.size and (spare or high <= low):
                if not spare:
                    spare = [x[:-2] for x in self.held.pop(order[low][1])]
                    low -= 1
                    continue
                piece = spare.pop()
                take = min(self.size - fill, piece[length_at])
                head, tail = cut(piece, take)
                if tail:
                    spare.append(tail)
                self.held[window].append((*head, window, fill))
                fill += take
            if fill == self.size or fill & (fill - 1) == 0:
                yield from self.held.pop(window)
            else:
                yield from self.by_powers([x[:-2] for x in self.held.pop(window)], fill, length_at, cut)
        if spare:
            yield from self.by_powers(spare, sum(x[length_at] for x in spare), length_at, cut)
        self.held.clear()

    def by_powers(self, pieces: list[tuple], total: int, length_at: int, cut) -> Iterator[tuple]:
        pieces = pieces[::-1]
        while total:
            room = min(self.size, 1 << (total.bit_length() - 1))
            window, fill = self.fresh(), 0
            while fill < room:
                piece = pieces.pop()
                take = min(room - fill, piece[length_at])
                head, tail = cut(piece, take)
                if tail:
                    pieces.append(tail)
                yield (*head, window, fill)
                fill += take
            total -= room


def pack(docs: DataFrame, size: int = WINDOW, end_id: int = 0, ranks: str | None = None) -> DataFrame:
    """One row per piece of each document of docs(doc_id, text); columns of SCHEMA."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        packer = LevelPacker(size, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        # a piece: doc_id, start, length, ids, tokens of the document
        cut = lambda p, k: ((p[0], p[1], k, p[3][:k], p[4]), (p[0], p[1] + k, p[2] - k, p[3][k:], p[4]) if k < p[2] else None)

        def batch_of(rows):
            full = [(r[0], r[1], r[2], zlib.crc32(r[3].tobytes()), r[4], r[5], r[6]) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*full)], names=names)

        for batch in batches:
            for part in C.chunks(batch, "text", 8 << 20):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    ids = np.array([*token_ids([text.as_py()], ranks)[0], end_id], "<u4")
                    n = len(ids)
                    for at in range(0, n, size):
                        own = ids[at : at + size].copy()
                        rows += packer.place((doc_id, at, len(own), own, n), len(own))
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
        rows += packer.drain(2, cut)
        if rows:
            yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
