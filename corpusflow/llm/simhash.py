"""Operator 5: SimHash near-duplicates through deletion-variant signatures.

Equal fingerprints are one node from the start. A fingerprint is cut into segments; with `distance // 2 + 1` of them, two
fingerprints within `distance` bits have one that differs by one bit at most. Each segment is indexed
once per bit with that bit left out; equal variants meet in one key, are verified on the whole fingerprint,
and links become components by star contraction. Inside a key only links that join something new are kept.
A key with more than BLOCK fingerprints is dealt out again in pairs of blocks, so no task holds an unbounded key
and none of its pairs is left out.

`near_groups` takes the fingerprint of 64 bits that the contract of op5 fixes. `wide_groups` links the sets of shingles of WIDE_SHINGLE
words whose Jaccard similarity is NUMERATOR / DENOMINATOR or more, all of them and no others. Fingerprints of 64 * LANES bits propose
links first, through FIRST_SEGMENTS segments, and each is checked on the sets; this joins most copies, but not all. The rest is found by an
index that loses no pair: two such sets share one of the first n - ceil(similarity * n) + 1 shingles of each in any order that
all sets have in common, and an entry that they share first leaves enough to both. Pairs of an entry in different components
are checked on the sets. The order, by counts of all shingles in SLOTS slots, keeps entries short and decides about speed alone.

Defined cases: null or blank text has fingerprint zero and is linked like any other; with fewer words than a
shingle the whole sequence is the shingle; equal rows share a component; an empty table gives no rows; a null
doc_id takes part and is never the name of a component that has another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm import _common as C
from corpusflow.llm._graph import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCK = 1024
NEAR = 6
LINKS = "a long, b long, key long, block int, f array<long>"
LANES, WIDE_SHINGLE, WIDE_SEGMENTS, WIDE_DISTANCE = 3, 5, 9, 31
NUMERATOR, DENOMINATOR = 4, 5
#: Segments that propose links; the index of shingles finds the others.
FIRST_SEGMENTS = 3
SLOTS = 1 << 16
#: Members of an entry whose pairs are formed in one task; of more, blocks meet in pairs.
ENTRY_BLOCK = 1024
#: How many keys of rows may be sent to every executor.
BROADCAST_KEYS = 1_000_000


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half the hashes of the shingles, repeats included."""
    if not words:
        return 0
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    at = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], SEED) for a, b in zip(at, ends[shingle - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 255):  # counts of 255 rows fit a byte
        ones += np.add.reduce(np.unpackbits(h[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs' doc_id, _d, _t and fp, the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(text.lower().split(), shingle) if text else 0 for text in batch.column("text").cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("_d"), batch.column("_t"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "_d", "_t", "fp"])

    return C.map_chunks(docs.select("doc_id", *C.row_key(), "text"), "text", "doc_id long, _d long, _t long, fp long", work)


def wide_fingerprints(docs: DataFrame, shingle: int = WIDE_SHINGLE, lanes: int = LANES) -> DataFrame:
    """docs' doc_id, _d, _t and f0, f1 and so on, the lanes of the fingerprint as signed longs."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = C.Words(batch.column("text"), lower=True)
        h = words.hashes()
        grams = C.window_hashes(h, shingle)
        out = np.zeros((batch.num_rows, lanes), np.uint64)
        salts = C.mix(np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        for i in range(batch.num_rows):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if a == b:
                continue
            own = grams[a : b - shingle + 1] if b - a >= shingle else C.window_hashes(h[a:b], b - a)
            ones = np.zeros(64 * lanes, np.int64)
            for k in range(0, len(own), 255):  # counts of 255 rows fit a byte
                x = C.mix(own[k : k + 255, None] ^ salts)
                ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
            out[i] = np.packbits(2 * ones > len(own), bitorder="little").view("<u8")
        ids = [batch.column("doc_id").cast(pa.int64()), batch.column("_d"), batch.column("_t")]
        return pa.RecordBatch.from_arrays([*ids, *(pa.array(np.ascontiguousarray(out[:, j]).view(np.int64)) for j in range(lanes))], names=["doc_id", "_d", "_t", *(f"f{j}" for j in range(lanes))])

    return C.map_chunks(docs.select("doc_id", *C.row_key(), "text"), "text", "doc_id long, _d long, _t long, " + ", ".join(f"f{j} long" for j in range(lanes)), work)


def node_ids(f: np.ndarray) -> np.ndarray:
    """One 64-bit name for each row of lanes; a single lane is its own."""
    out = f[:, 0].copy()
    for j in range(1, f.shape[1]):
        out = C.mix(out ^ f[:, j]) + np.uint64(j)
    return out


def variants(f: np.ndarray, segments: int, some: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all one-wildcard variants of the segments, or some of them, of rows of lanes, and the row of each."""
    n, lanes = f.shape
    bounds = [64 * lanes * i // segments for i in range(segments + 1)]
    keys = []
    for i in some or range(segments):
        a, b = bounds[i], bounds[i + 1]
        lane, low = divmod(a, 64)
        segment = f[:, lane] >> np.uint64(low)
        if low + b - a > 64:
            segment = segment | f[:, lane + 1] << np.uint64(64 - low)
        segment = segment & np.uint64((1 << (b - a)) - 1)
        for bit in range(b - a):
            # below 2^32 the segment without the bit, above it which bit of all it is
            keys.append((segment & ~np.uint64(1 << bit)) | np.uint64((a + bit) << 40))
    return np.concatenate(keys), np.tile(np.arange(n), len(keys))


def _apart(f: np.ndarray, g: np.ndarray, lanes: int) -> np.ndarray:
    return np.bitwise_count(f[..., :lanes] ^ g[..., :lanes]).sum(axis=-1)


def _named(f: np.ndarray, lanes: int) -> np.ndarray:
    """The component in the column after the lanes, where there is one, else the row's own name."""
    return (f[:, lanes] if f.shape[1] > lanes else node_ids(f)).view(np.int64)


def forest(f: np.ndarray, distance: int, lanes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of lanes to the first of its component among f, as places in f; a column after the lanes names components that are known."""
    lanes = lanes or f.shape[1]
    near = _apart(f[:, None], f[None, :], lanes) <= distance
    if f.shape[1] > lanes:
        near |= f[:, None, lanes] == f[None, :, lanes]
    label = np.arange(len(f))
    while True:
        new = np.where(near, label[None, :], len(f)).min(axis=1)
        new = np.minimum(new, label[new])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(f)))
    return moved, label[moved]


def nearest(f: np.ndarray, distance: int, lanes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A link of each row of lanes to the nearest one before it, where that is within distance."""
    apart = _apart(f[:, None], f[None, :], lanes or f.shape[1])
    apart[np.triu_indices(len(f))] = 1 << 30
    best = apart.argmin(axis=1)
    moved = np.flatnonzero(apart[np.arange(len(f)), best] <= distance)
    return moved, best[moved]


def _runs(batches: Iterator[pa.RecordBatch], distance: int, block: int, lanes: int, names: list[str], choose=forest) -> Iterator[pa.RecordBatch]:
    """Links inside keys of rows sorted by key; members of keys beyond `block` are passed on with their block."""
    width = len(names)
    hold_k, hold_f, passed, hold_key = np.zeros(0, np.int64), np.zeros((0, width), np.uint64), 0, None

    def out(n, a=None, b=None, key=None, at=None, f=None):
        put = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
        lists = pa.nulls(n, pa.list_(pa.int64())) if f is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(f.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays([put(a, pa.int64()), put(b, pa.int64()), put(key, pa.int64()), put(at, pa.int32()), lists], names=["a", "b", "key", "block", "f"])

    def links(k, f):
        a, b = [], []
        begin, size = _sizes(k)
        for s in range(1, NEAR):  # all pairs of small keys
            same = np.flatnonzero(k[s:] == k[:-s])
            hit = same[_apart(f[same + s], f[same], lanes) <= distance]
            a.append(hit + s)
            b.append(hit)
        for i, n in zip(begin[size > NEAR].tolist(), size[size > NEAR].tolist()):
            x, y = choose(f[i : i + n], distance, lanes)
            a.append(i + x)
            b.append(i + y)
        ids = _named(f, lanes)
        pair = np.unique(np.stack([ids[np.concatenate(a)], ids[np.concatenate(b)]]), axis=1)
        pair = pair[:, pair[0] != pair[1]]
        return out(pair.shape[1], pair[0], pair[1])

    for batch in batches:
        k = np.r_[hold_k, batch.column("key").to_numpy()]
        f = np.concatenate([hold_f, np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], axis=1)])
        if not len(k):
            continue
        if passed and k[0] != hold_key:
            passed = 0
        last = int(np.searchsorted(k, k[-1]))
        if passed and last:  # the end of a large key
            cut = int(np.searchsorted(k, hold_key, "right"))
            yield out(cut, key=k[:cut], at=(passed + np.arange(cut)) // block, f=f[:cut])
            k, f, last, passed = k[cut:], f[cut:], last - cut, 0
        done_k, done_f = k[:last], f[:last]
        hold_k, hold_f = k[last:], f[last:]
        if passed or len(hold_k) > block:  # pass on what is there, so that no more than a batch is held
            hold_key = int(hold_k[0])
            yield out(len(hold_k), key=hold_k, at=(passed + np.arange(len(hold_k))) // block, f=hold_f)
            passed += len(hold_k)
            hold_k, hold_f = hold_k[:0], hold_f[:0]
        if len(done_k):
            mask = np.ones(len(done_k), bool)
            for i, n in zip(*(x.tolist() for x in _sizes(done_k))):
                if n > block:
                    mask[i : i + n] = False
                    yield out(n, key=done_k[i : i + n], at=np.arange(n) // block, f=done_f[i : i + n])
            if mask.any():
                yield links(done_k[mask], done_f[mask])
    if len(hold_k):
        yield links(hold_k, hold_f)


def _sizes(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return begin, np.diff(np.r_[begin, len(k)])


def near_links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK, segments: int | None = None, some: range | None = None, choose=forest) -> DataFrame:
    """Links (a, b) between node ids that connect all fingerprints of distinct fps(f0, f1, ...) that share a variant and lie
    within distance, not every pair of them. With a column `component` links are between those that differ."""
    names = [c for c in fps.columns if c != "component"]
    lanes = len(names)
    names += ["component"] * ("component" in fps.columns)
    count = segments or distance // 2 + 1

    def index(batches):
        for batch in batches:
            f = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], axis=1)
            for i in range(0, len(f), 2048):
                k, row = variants(f[i : i + 2048, :lanes], count, some)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *(pa.array(np.ascontiguousarray(f[i + row, j]).view(np.int64)) for j in range(len(names)))], names=["key", *names])

    def inside(batches):
        yield from _runs(batches, distance, block, lanes, names, choose)

    def across(batches):
        for batch in batches:
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                f = np.unique(np.array([*left, *right], np.int64), axis=0).view(np.uint64)
                a, b = choose(f, distance, lanes)
                ids = _named(f, lanes)
                pair = np.unique(np.stack([ids[a], ids[b]]), axis=1)
                pair = pair[:, pair[0] != pair[1]]
                if pair.size:
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    keys = fps.select(*names).mapInArrow(index, "key long, " + ", ".join(f"{c} long" for c in names))
    found = C.materialize(keys.repartition(C.shuffle_width(fps.sparkSession) * 2, "key").sortWithinPartitions("key", *names).mapInArrow(inside, LINKS), "links")
    links = found.where("key IS NULL").select("a", "b")
    large = found.where("key IS NOT NULL")
    if large.limit(1).count():
        blocks = large.groupBy("key", "block").agg(F.collect_list("f").alias("f"))  # at most `block` members each
        top = large.groupBy("key").agg(F.max("block").alias("top"))
        paired = blocks.join(top, "key").select("key", "block", "f", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("other"))
        lo, hi = F.least("block", "other"), F.greatest("block", "other")
        met = paired.groupBy("key", lo.alias("lo"), hi.alias("hi")).agg(F.max_by("f", -F.col("block")).alias("left"), F.max_by("f", "block").alias("right"))
        links = links.union(met.select("left", "right").mapInArrow(across, "a long, b long"))
    return links.distinct()


def shingle_sets(texts: pa.Array, shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, one text after another and sorted inside, and where each text begins."""
    words = C.Words(texts, lower=True)
    h = words.hashes()
    begin, count = words.first[:-1], np.diff(words.first)
    at = np.flatnonzero(C.valid_windows(words, shingle))
    value, owner = [C.window_hashes(h, shingle)[at]], [words.owner()[at]]
    for n in range(1, shingle):  # fewer words than a shingle
        some = np.flatnonzero(count == n)
        if len(some):
            value.append(C.window_hashes(h, n)[begin[some]] ^ np.uint64(n))
            owner.append(some)
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def _set_names(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set of shingles."""
    sums = np.r_[np.uint64(0), np.cumsum(C.mix(value ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)]
    return C.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _lists(value: np.ndarray, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))


def slot_counts(docs: DataFrame, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """How many sets hold a shingle of each of SLOTS slots, over all docs; summed in Spark."""

    def work(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in C.chunks(batch, "text"):
                counts += np.bincount((shingle_sets(part.column("text"), shingle)[0] >> np.uint64(32)).astype(np.int64) % SLOTS, minlength=SLOTS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["slot", "n"])

    got = docs.select("text").mapInArrow(work, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def indexed_sets(docs: DataFrame, counts: np.ndarray, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """docs' _d, _t, the node that names the set of shingles, its size, and the entries of the index, rarest slots first."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, first = shingle_sets(batch.column("text"), shingle)
        size = np.diff(first)
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((value, counts[(value >> np.uint64(32)).astype(np.int64) % SLOTS], owner))
        entries = size - -(-NUMERATOR * size // DENOMINATOR) + (size > 0)
        taken = np.arange(len(value)) - first[owner] < entries[owner]
        return pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_t"), pa.array(_set_names(value, first)), pa.array(size.astype(np.int32)), _lists(value[order][taken], np.r_[0, np.cumsum(entries)])], names=["_d", "_t", "node", "size", "entries"])

    return C.map_chunks(docs.select(*C.row_key(), "text"), "text", "_d long, _t long, node long, size int, entries array<long>", work)


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """Those of distinct pairs(a, b) of nodes(node, _d, _t) whose sets are similar enough; sets are made again, from one text for each node of pairs."""
    pairs = C.materialize(pairs, "near-pairs")
    needed = C.materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "_d", "_t"), "node"), "near-needed")
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_KEYS else needed

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("node"), _lists(*shingle_sets(batch.column("text"), shingle))], names=["node", "shingles"])

    texts = docs.select("text", *C.row_key()).join(needed, ["_d", "_t"]).select("node", "text")
    sets = C.materialize(C.map_chunks(texts, "text", "node long, shingles array<long>", work).dropDuplicates(["node"]), "near-sets")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    enough = F.size(F.array_intersect("x", "y")) * (NUMERATOR + DENOMINATOR) >= (F.size("x") + F.size("y")) * NUMERATOR
    return C.materialize(met.where(enough).select("a", "b"), "near-alike")


def _meet(rows: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    """Pairs of nodes of an entry's rows (node, component, size, place), of them or of them and others, in different components, whose sizes and
    places leave enough shingles to both."""
    x, y = rows[:, None], (rows if others is None else others)[None]
    small, large = np.minimum(x[..., 2], y[..., 2]), np.maximum(x[..., 2], y[..., 2])
    left = np.minimum(x[..., 2] - x[..., 3], y[..., 2] - y[..., 3])
    ok = (x[..., 1] != y[..., 1]) & (DENOMINATOR * small >= NUMERATOR * large) & ((NUMERATOR + DENOMINATOR) * left >= NUMERATOR * (small + large))
    i, j = np.nonzero(np.triu(ok, 1) if others is None else ok)
    a, b = rows[i, 0], (rows if others is None else others)[j, 0]
    return np.stack([np.maximum(a, b), np.minimum(a, b)])


def index_pairs(nodes: DataFrame, block: int = ENTRY_BLOCK) -> DataFrame:
    """Distinct pairs (a, b) of nodes(node, component, size, entries) of different components that share an entry and may be similar enough."""
    row = F.struct("node", "component", F.col("size").cast("long").alias("size"), F.col("place").cast("long").alias("place"))
    entries = nodes.select("node", "component", "size", F.posexplode("entries").alias("place", "key")).select("key", row.alias("r")).select("key", "r.*")

    def out(pairs=None, key=None, at=None, rows=None):
        n = len(rows) if pairs is None else pairs.shape[1]
        lists = pa.nulls(n, pa.list_(pa.int64())) if rows is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 4), pa.array(rows.reshape(-1)))
        put = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
        return pa.RecordBatch.from_arrays([*(put(None if pairs is None else x, pa.int64()) for x in (pairs if pairs is not None else (None, None))), put(key, pa.int64()), put(at, pa.int32()), lists], names=["a", "b", "key", "block", "f"])

    def inside(batches):
        hold_k, hold, passed = np.zeros(0, np.int64), np.zeros((0, 4), np.int64), 0

        def done(k, r, passed):
            """Pairs of whole keys; members of large ones are passed on, with the block that each belongs to."""
            begin, size = _sizes(k)
            found = []
            for i, n in zip(begin.tolist(), size.tolist()):
                before = passed if i == 0 else 0
                if before or n > block:
                    yield out(key=k[i : i + n], at=(before + np.arange(n)) // block, rows=r[i : i + n])
                elif n > 1:
                    found.append(_meet(r[i : i + n]))
            if found:
                yield out(np.unique(np.concatenate(found, axis=1), axis=1))

        for batch in batches:
            k = np.r_[hold_k, batch.column("key").to_numpy()]
            r = np.concatenate([hold, np.stack([batch.column(c).to_numpy() for c in ("node", "component", "size", "place")], axis=1)])
            if not len(k):
                continue
            if passed and k[0] != passed_key:
                passed = 0
            last = int(np.searchsorted(k, k[-1]))
            if last:
                yield from done(k[:last], r[:last], passed)
                passed = 0
            hold_k, hold = k[last:], r[last:]
            if passed or len(hold_k) > block:  # pass on what is there, so that no more than a batch is held
                passed_key = int(hold_k[0])
                yield out(key=hold_k, at=(passed + np.arange(len(hold_k))) // block, rows=hold)
                passed += len(hold_k)
                hold_k, hold = hold_k[:0], hold[:0]
        if len(hold_k):
            yield from done(hold_k, hold, 0)

    def across(batches):
        for batch in batches:
            for lo, hi, left, right in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "left", "right"))):
                pair = _meet(np.array(left, np.int64)) if lo == hi else _meet(np.array(left, np.int64), np.array(right, np.int64))
                if pair.size:
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    keyed = entries.repartition(C.shuffle_width(nodes.sparkSession) * 2, "key").sortWithinPartitions("key")
    found = C.materialize(keyed.mapInArrow(inside, LINKS), "entry-links")
    pairs = found.where("key IS NULL").select("a", "b")
    large = found.where("key IS NOT NULL")
    if large.limit(1).count():
        blocks = large.groupBy("key", "block").agg(F.collect_list("f").alias("f"))  # at most `block` members each
        top = large.groupBy("key").agg(F.max("block").alias("top"))
        paired = blocks.join(top, "key").select("key", "block", "f", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("other"))
        lo, hi = F.least("block", "other"), F.greatest("block", "other")
        met = paired.groupBy("key", lo.alias("lo"), hi.alias("hi")).agg(F.max_by("f", -F.col("block")).alias("left"), F.max_by("f", "block").alias("right"))
        pairs = pairs.union(met.select("lo", "hi", "left", "right").mapInArrow(across, "a long, b long"))
    return pairs.where("a <> b").distinct()


def wide_groups(docs: DataFrame, shingle: int = WIDE_SHINGLE, distance: int = WIDE_DISTANCE, lanes: int = LANES, segments: int = WIDE_SEGMENTS) -> DataFrame:
    """(doc_id, _d, _t, node, component): texts whose sets of shingles are linked; the component is its smallest node."""
    names = [f"f{j}" for j in range(lanes)]

    def name(batches):
        for batch in batches:
            ids = node_ids(np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], axis=1)) if batch.num_rows else np.zeros(0, np.uint64)
            yield batch.append_column("fp", pa.array(ids.view(np.int64)))

    marked = C.materialize(indexed_sets(docs, slot_counts(docs, shingle), shingle), "near-indexed")
    nodes = C.materialize(marked.dropDuplicates(["node"]), "near-nodes")
    columns = "doc_id long, _d long, _t long, " + ", ".join(f"{c} long" for c in names)
    prints = C.materialize(wide_fingerprints(docs, shingle, lanes).mapInArrow(name, columns + ", fp long"), "wide-fingerprints")
    # links of fingerprints as pairs of sets: one set stands for each fingerprint, and the others of it are proposed with it
    held = C.materialize(nodes.select("node", "_d", "_t").join(prints.select("_d", "_t", "fp", *names).dropDuplicates(["_d", "_t"]), ["_d", "_t"]).drop("_d", "_t"), "near-prints")
    first = C.materialize(held.groupBy("fp").agg(F.min("node").alias("first")), "near-first")
    links = near_links(held.select(*names).distinct(), distance, segments=segments, some=range(min(FIRST_SEGMENTS, segments)), choose=nearest)
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}"))
    proposed = links.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    proposed = proposed.union(held.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))).where("a <> b")
    likely = alike(proposed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), nodes, docs, shingle)
    own = F.coalesce("component", "node").alias("component")
    labelled = nodes.join(components(likely), "node", "left").select("node", own, "size", "entries")
    links = likely.union(alike(index_pairs(labelled), nodes, docs, shingle))
    named = nodes.select("node").join(components(links), "node", "left").select("node", own)
    return prints.select("doc_id", "_d", "_t").join(marked.select("_d", "_t", "node").dropDuplicates(["_d", "_t"]), ["_d", "_t"]).join(named, "node").select("doc_id", "_d", "_t", "node", "component")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without the documents whose component in groups(doc_id, _d, _t, component) has a smaller doc_id; of equal rows one stays, a null doc_id comes last.

    Texts are not shuffled while the keys to drop are few enough to be broadcast."""
    columns = docs.columns
    keys = C.materialize(groups.groupBy("component", "_d", "_t").agg(F.min(F.col("doc_id").isNull()).alias("null"), F.count("*").alias("n")), "near-keys")
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_KEYS else df
    # components of several keys; those of one have nothing to drop
    first = C.materialize(keys.groupBy("component").agg(F.min(F.struct("null", "_d", "_t")).alias("least"), F.count("*").alias("size")).where("size > 1").drop("size"), "near-firsts")
    least = F.coalesce(F.struct("null", "_d", "_t") == F.col("least"), F.lit(True))
    judged = C.materialize(keys.join(few(first, first.count()), "component", "left").select("_d", "_t", "n", least.alias("first")), "near-verdicts")
    drop, twice = judged.where("NOT first").select("_d", "_t"), judged.where("first AND n > 1").select("_d", "_t")
    n_drop, n_twice = judged.agg(F.count_if(~F.col("first")), F.count_if(F.col("first") & (F.col("n") > 1))).first()
    keyed = docs.withColumns(dict(zip(("_d", "_t"), C.row_key())))
    kept = keyed.join(few(drop, n_drop), ["_d", "_t"], "left_anti")
    if n_twice:
        one = Window.partitionBy("_d", "_t").orderBy(*(c for c in columns if c not in ("doc_id", "text")))
        again = kept.join(few(twice, n_twice), ["_d", "_t"], "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
        kept = kept.join(few(twice, n_twice), ["_d", "_t"], "left_anti").unionAll(again)
    return kept.select(*columns)


def near_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, _d, _t, fp, component_id): the component's smallest doc_id."""
    marked = C.materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = C.materialize(nodes, "nodes")
    parts = components(near_links(nodes.select(F.col("fp").alias("f0")), distance))
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp")


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
