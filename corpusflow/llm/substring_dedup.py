"""Operator 3: exact substring deduplication with suffix automata of reference shards.

1. Every window of `n` words names its minimiser, the word 5-gram of smallest hash in it. Windows that are equal
   have equal minimisers, so a minimiser found in one document only rules its windows out. One shuffle of
   (minimiser, document, place) finds the first document of each that more documents hold.
2. A reference shard is a stretch of `SHARD_WORDS` words of such a first document. Documents send each passage whose
   windows have these minimisers to that shard; all copies of a window meet in one shard. A long document is spread
   over many shards, and each passage goes to one shard only, where a broadcast of all automata to all tasks
   would grow with the corpus.
3. Equal passages of a shard are one from here on, aggregated before the shuffle, so that a crowd of copies does not meet in
   one task: documents after its first lose it whole, for all its windows start in that first one.
4. In a shard, passages stream in the order of documents through a suffix automaton of words: matching statistics
   of `n` or more against earlier documents mark words, then what was new extends the automaton. Words are
   compared as they are; elsewhere hashes route work, save that equal passages are told by a digest of 128 bits.

Defined cases: null or blank text has no words and the hash of the empty text; documents with fewer than n words
stay whole; windows that repeat in their own document only stay; rows with one doc_id are one document for
matching; a null doc_id counts as the smallest; an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm import _common as C

WORDS = 13
GRAM = 5
SHARD_WORDS = 512
#: How many removable ranges and their documents may be sent to every executor, some 16 bytes each; more are joined by a shuffle.
BROADCAST_ENTRIES = 1_000_000


class SuffixAutomaton:
    """Suffix automaton over words; strings are added one by one and never match across each other."""

    __slots__ = ("next", "link", "length")

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            have = nxt[last].get(w)
            if have is not None:
                if length[have] == length[last] + 1:
                    last = have
                    continue
                last = self._split(last, w, have)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = cur

    def _split(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def matches(self, words: list, n: int) -> list[int]:
        """Places just after a match of n or more words."""
        nxt, link, length = self.next, self.link, self.length
        state = run = 0
        out = []
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nxt[state].get(w)
            if to is not None:
                state = to
                run += 1
                if run >= n:
                    out.append(i + 1)
        return out


def spans(ends: list[int], n: int) -> list[tuple[int, int]]:
    """Union of [end - n, end) for rising ends."""
    out: list[list[int]] = []
    for e in ends:
        if out and e - n <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([e - n, e])
    return [tuple(x) for x in out]


def rest(marked: list[tuple[int, int]], size: int, n: int) -> list[tuple[int, int]]:
    """Stretches that hold every window of n words not inside a marked span."""
    out, at = [], 0
    for a, b in marked:
        if min(a + n - 1, size) - at >= n:
            out.append((at, min(a + n - 1, size)))
        at = max(0, b - n + 1)
    if size - at >= n:
        out.append((at, size))
    return out


def _minimisers(words: C.Words, n: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser of each window, and whether the window lies in one text."""
    g = C.window_hashes(words.hashes(), gram)
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    need, have = n - gram + 1, 1
    while have < need:
        step = min(have, need - have)
        g = np.minimum(g[:-step], g[step:])
        have += step
    return g[:m], C.valid_windows(words, n)


def occurrences(docs: DataFrame, n: int, gram: int) -> DataFrame:
    """(m, d, at): each minimiser of each document with its first window."""

    def work(batch: pa.RecordBatch):
        words = C.Words(batch.column("text"))
        m, ok = _minimisers(words, n, gram)
        if not ok.any():
            return None
        at = np.flatnonzero(ok)
        doc = words.owner()[at]
        m = m[at].view(np.int64)
        lead = np.r_[True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]
        at, doc, m = at[lead], doc[lead], m[lead]
        order = np.lexsort((at, m, doc))
        at, doc, m = at[order], doc[order], m[order]
        lead = np.r_[True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]
        at, doc, m = at[lead], doc[lead], m[lead]
        ids = batch.column("_d").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(m), pa.array(ids[doc]), pa.array((at - words.first[doc]).astype(np.int32))], names=["m", "d", "at"])

    return C.map_chunks(docs.select("_d", "text"), "text", "m long, d long, at int", work)


def shared_minimisers(docs: DataFrame, n: int, gram: int) -> DataFrame:
    """(d, m, o, b) for minimisers of two documents or more: the first of these, and the shard of its place there."""
    w = Window.partitionBy("m")
    seen = occurrences(docs, n, gram).withColumn("first", F.min(F.struct("d", "at")).over(w)).withColumn("last", F.max("d").over(w))
    return seen.where(F.col("last") > F.col("first.d")).select("d", "m", F.col("first.d").alias("o"), F.floor(F.col("first.at") / SHARD_WORDS).cast("int").alias("b"))


def removable(docs: DataFrame, n: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(_d, _t, ranges): word ranges of docs(_d, _t, text) whose windows start in a document before _d."""
    spark = docs.sparkSession
    by_doc = shared_minimisers(docs, n, gram).groupBy("d").agg(F.collect_set(F.struct("m", "o", "b")).alias("s"))
    found = docs.select("_d", "_t", "text").join(by_doc, F.col("_d") == F.col("d"))

    def passages(batch: pa.RecordBatch):
        words = C.Words(batch.column("text"))
        m, ok = _minimisers(words, n, gram)
        raw = words.data.tobytes()
        sets = batch.column("s")
        flat = sets.flatten()
        cuts = np.r_[0, np.cumsum(sets.value_lengths().to_numpy())]
        fm, fo, fb = (flat.field(i).to_numpy() for i in range(3))
        out = [[] for _ in range(8)]
        d, t = batch.column("_d").to_pylist(), batch.column("_t").to_pylist()
        m = m.view(np.int64)
        for i in range(batch.num_rows):
            lo, hi = int(words.first[i]), int(words.first[i + 1]) - n + 1
            a, b = cuts[i], cuts[i + 1]
            if hi <= lo or a == b:
                continue
            order = np.argsort(fm[a:b])
            keys, own = fm[a:b][order], m[lo:hi]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            if not hit.any():
                continue
            o, blk = fo[a:b][order][at], fb[a:b][order][at]
            change = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1]) | (o[1:] != o[:-1]) | (blk[1:] != blk[:-1])])
            for x, y in zip(change.tolist(), [*change[1:].tolist(), len(own)]):
                if hit[x]:
                    out[0].append(int(o[x]))
                    out[1].append(int(blk[x]))
                    out[2].append(d[i])
                    out[3].append(t[i])
                    out[4].append(x)
                    out[5].append(y - x + n - 1)
                    out[6].append(b" ".join(raw[words.starts[lo + x] : words.ends[lo + y - 1 + n - 1]].split()))
                    out[7].append(xxhash.xxh3_128_digest(out[6][-1]))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        h = np.frombuffer(b"".join(out[7]), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(out, types)), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["o", "b", "_d", "_t", "at", "n", "words", "h1", "h2"])

    sent = C.materialize(C.map_chunks(found, "text", "o long, b int, _d long, _t long, at int, n int, words binary, h1 long, h2 long", passages), "passages")
    key = ["o", "b", "h1", "h2"]
    distinct = sent.groupBy(*key).agg(F.min("_d").alias("d"), F.first("words").alias("words"))

    def match(batches):
        shard = doc = None
        sam, fresh = SuffixAutomaton(), []
        for batch in batches:
            rows = [[] for _ in range(6)]
            for o, blk, h1, h2, d, words in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (o, blk) != shard:
                    shard, doc, sam, fresh = (o, blk), None, SuffixAutomaton(), []
                if d != doc:
                    for run in fresh:
                        sam.add(run)
                    doc, fresh = d, []
                words = words.split()
                marked = spans(sam.matches(words, n), n) if len(sam.next) > 1 else []
                fresh += [words[x:y] for x, y in rest(marked, len(words), n)]
                for row, value in zip(rows, (o, blk, h1, h2, d, [{"x": x, "y": y} for x, y in marked])):
                    row.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, types)], names=["o", "b", "h1", "h2", "d", "marked"])

    width = C.shuffle_width(spark) * 2
    streamed = distinct.select(*key, "d", "words").repartition(width, "o", "b").sortWithinPartitions("o", "b", "d", "h1", "h2").mapInArrow(match, "o long, b int, h1 long, h2 long, d long, marked array<struct<x:int,y:int>>")
    whole = F.array(F.struct(F.lit(0).alias("x"), F.col("n").alias("y")))
    marked = sent.drop("words").join(streamed, key).withColumn("marked", F.when(F.col("_d") > F.col("d"), whole).otherwise(F.col("marked")))
    each = marked.select("_d", "_t", "at", F.explode("marked").alias("r")).select("_d", "_t", F.struct((F.col("at") + F.col("r.x")).alias("x"), (F.col("at") + F.col("r.y")).alias("y")).alias("r"))
    return each.groupBy("_d", "_t").agg(F.sort_array(F.collect_set("r")).alias("ranges"))


def drop_repeats(docs: DataFrame, n: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text's other words, joined by one space."""
    keyed = docs.select("doc_id", *C.row_key(), "text")
    ranges = C.materialize(removable(keyed, n, gram), "removable")
    if ranges.agg(F.coalesce(F.sum(F.size("ranges") + 2), F.lit(0))).first()[0] <= BROADCAST_ENTRIES:
        ranges = F.broadcast(ranges)
    joined = keyed.join(ranges, ["_d", "_t"], "left")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, gone, kept = [], [], []
        for text, ranges in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("ranges").to_pylist()):
            words = (text or b"").split()
            total.append(len(words))
            if ranges:
                keep = np.ones(len(words), bool)
                for r in ranges:
                    keep[r["x"] : r["y"]] = False
                gone.append(len(words) - int(keep.sum()))
                words = [w for w, k in zip(words, keep.tolist()) if k]
            else:
                gone.append(0)
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return C.map_chunks(joined.select("doc_id", "text", "ranges"), "text", "doc_id long, n_words long, n_removed long, kept string", work)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(C.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
lead AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
hit AS (SELECT DISTINCT win.doc_id, win.i + k AS p FROM win JOIN lead ON win.g = lead.g CROSS JOIN (SELECT unnest(range(0, 13)) AS k) WHERE lead.d < win.doc_id),
every AS (SELECT doc_id, p, list_extract(w, p) AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t WHERE len(w) > 0)),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS s, count(*) AS n FROM every e LEFT JOIN hit h ON e.doc_id = h.doc_id AND e.p = h.p WHERE h.p IS NULL GROUP BY e.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
