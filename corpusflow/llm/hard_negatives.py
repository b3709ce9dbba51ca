"""Operator 12: hard-negative mining by blocked dense products.

Anchors are cut by hash into blocks of bounded bytes. A block is broadcast and every task multiplies it with the
candidates of its own split, tile by tile, in float64, which is exact while no sum can reach 2^53 (beyond, in int64). A task keeps
the first few of each anchor in a mergeable state, so it sends a bounded number of rows, and a window merges those of all
tasks. The first pass finds the positives; the second streams the candidates again and keeps, for every anchor
and positive, the first negatives whose score lies in the positive's window. Nothing is sampled and no pair is
written; the rows of a block's positives, at most POSITIVES for each of its anchors, pass through the driver.

Defined cases: rows with a null label, a null vector, or a null, NaN or infinite entry take no part; a null vec_id
is never an anchor, follows all others in ties and is returned as null; equal scores are ordered by vec_id; a repeated anchor row is
an anchor each time, and its copies are positives of each other; shorter vectors count as if filled up with zeros, so an
empty one scores zero; longer vectors only need more bytes; an anchor without positives or negatives gives no rows; an empty table
gives no rows; other columns are ignored, whatever their names. A score beyond a long raises an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm import _common as C
from corpusflow.llm import _vectors as V

POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this share of the positive's.
SHARE = (4, 5)
#: Bytes of anchors that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Anchors and candidates of one product: 16 MB of scores.
TILE = (512, 4096)
_NONE = np.iinfo(np.int64).min
_ANY = pa.schema([("g", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])


class Top:
    """The first k rows of each group, by falling score, then rising id, nulls last. Rows may come in any order and in any blocks."""

    def __init__(self, low: np.ndarray, k: int):
        #: What a group admits: scores from low on, at low itself only ids before the k-th once the group is full.
        self.k, self.low = k, low.copy()
        self.full = np.zeros(len(low), bool)
        self.last_none = np.ones(len(low), bool)
        self.last_id = np.zeros(len(low), np.int64)
        self.group = self.score = self.id = np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def add(self, group: np.ndarray, score: np.ndarray, none: np.ndarray, id: np.ndarray) -> None:
        low, tied = self.low[group], self.full[group]
        before = (none < self.last_none[group]) | ((none == self.last_none[group]) & (id < self.last_id[group]))
        new = (score > low) | ((score == low) & (~tied | before))
        if not new.any():
            return
        group, score = np.concatenate([self.group, group[new]]), np.concatenate([self.score, score[new]])
        none, id = np.concatenate([self.none, none[new]]), np.concatenate([self.id, id[new]])
        order = np.lexsort((id, none, -score, group))
        g = group[order]
        begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.r_[begin, len(g)]))
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.group, self.score, self.none, self.id = group[order], score[order], none[order], id[order]
        at = rank == self.k - 1
        g = self.group[at]
        self.low[g], self.full[g], self.last_none[g], self.last_id[g] = self.score[at], True, self.none[at], self.id[at]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.group), pa.array(self.score), pa.array(self.id, mask=self.none)], schema=_ANY)


class Anchors:
    """A block of anchors, each once, with the number of its equal rows."""

    def __init__(self, found: pa.Table):
        self.id, self.label, self.n = (found[c].to_numpy() for c in ("id", "label", "n"))
        self.x = V.matrix(found["x"])
        self.largest = V.largest(self.x)
        self.of_id: dict[int, list[int]] = {}
        for i, a in enumerate(self.id.tolist()):
            self.of_id.setdefault(a, []).append(i)

    def __len__(self) -> int:
        return len(self.id)


def products(anchors: Anchors, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and candidates in a common width and in a type whose products are exact."""
    bound = anchors.largest * V.largest(x) * max(x.shape[1], anchors.x.shape[1], 1)
    if bound >= 1 << 62:
        raise OverflowError("hard negatives: a score does not fit a long")
    kind = np.float64 if bound < V.EXACT else np.int64
    wide = max(x.shape[1], anchors.x.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, wide - m.shape[1]))).astype(kind) for m in (anchors.x, x))


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, whether null, label, x) of tiles of the rows of a split."""
    for batch in batches:
        for at in range(0, batch.num_rows, TILE[1]):
            part = batch.slice(at, TILE[1])
            ids = part.column("id")
            yield ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column("label").to_numpy(), V.matrix(part.column("x"))


def positives_of(anchors: Anchors, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The first k rows of each anchor's label in this split, the rows equal to the anchor left out."""
    top = Top(np.full(len(anchors), _NONE), k)
    for ids, none, label, x in candidates(batches):
        a_all, x_all = products(anchors, x)
        for kind in np.unique(label):
            mine, theirs = np.flatnonzero(anchors.label == kind), np.flatnonzero(label == kind)
            own = [(a, j) for j, c in enumerate(theirs.tolist()) if not none[c] for a in anchors.of_id.get(int(ids[c]), ()) if anchors.label[a] == kind and (a_all[a] == x_all[c]).all()]
            for at in range(0, len(mine), TILE[0]):
                rows = mine[at : at + TILE[0]]
                scores = a_all[rows] @ x_all[theirs].T
                if own:
                    place = {a: i for i, a in enumerate(rows.tolist())}
                    for a, j in own:
                        if a in place:
                            scores[place[a], j] = _NONE
                low = top.low[rows]
                if len(theirs) > k and not top.full[rows].all():
                    low = np.maximum(low, np.partition(scores, len(theirs) - k, axis=1)[:, len(theirs) - k])
                i, j = np.nonzero(scores >= low[:, None])
                s = scores[i, j].astype(np.int64)
                i, j, s = i[s != _NONE], j[s != _NONE], s[s != _NONE]
                top.add(rows[i], s, none[theirs[j]], ids[theirs[j]])
    yield top.batch()


class Windows:
    """Positives of the anchors of a block: group g is one anchor with one positive and admits scores from low[g] to high[g]."""

    def __init__(self, anchors: Anchors, found: dict[int, list[tuple[int, int | None]]], share: tuple[int, int]):
        self.first = np.zeros(len(anchors) + 1, np.int64)
        high, self.positive, self.anchor = [], [], []
        for a in range(len(anchors)):
            high += [s for s, _ in found.get(a, ())]
            self.positive += [i for _, i in found.get(a, ())]
            self.anchor += [a] * len(found.get(a, ()))
            self.first[a + 1] = len(high)
        self.high = np.array(high, np.int64)
        self.low = np.array([-(-share[0] * s // share[1]) for s in high], np.int64)


def negatives_of(anchors: Anchors, windows: Windows, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The first k rows of other labels in this split for each window."""
    top = Top(windows.low, k)
    count = np.diff(windows.first)
    used = np.flatnonzero(count)
    begin = windows.first[used]
    top_score = np.maximum.reduceat(windows.high, begin) if len(used) else begin
    for ids, none, label, x in candidates(batches):
        a_all, x_all = products(anchors, x)
        for at in range(0, len(used), TILE[0]):
            rows = used[at : at + TILE[0]]
            low = np.minimum.reduceat(top.low, begin)[at : at + TILE[0]]
            scores = a_all[rows] @ x_all.T
            i, j = np.nonzero((scores >= low[:, None]) & (scores <= top_score[at : at + TILE[0], None]))
            other = anchors.label[rows[i]] != label[j]
            i, j = i[other], j[other]
            s = scores[i, j].astype(np.int64)
            for p in range(int(count[rows].max(initial=0))):
                g = windows.first[rows[i]] + p
                ok = p < count[rows[i]]
                ok[ok] &= (s[ok] <= windows.high[g[ok]]) & (s[ok] >= top.low[g[ok]])
                top.add(g[ok], s[ok], none[j[ok]], ids[j[ok]])
    yield top.batch()


def anchor_blocks(anchors: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Distinct anchors with n, the number of their equal rows, and their block, which holds at most about limit bytes; number of blocks."""
    size = F.size("x") * 8 + 64
    found = C.materialize(anchors.groupBy("id", "label", "x").agg(F.count("*").alias("n")).withColumn("hash", F.xxhash64("id", "label", "x")), "anchors")
    rows, total, longest = found.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    blocks = -(-total // limit)
    while True:
        cut = found.withColumn("block", F.pmod("hash", F.lit(max(blocks, 1))))
        most = cut.groupBy("block").agg(F.sum(size).alias("b")).agg(F.max("b")).first()[0] or 0
        if most <= 2 * max(limit, longest) or blocks > 2 * rows:
            return cut, blocks
        blocks *= 2


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = SHARE, limit: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors have id long, label long and x array<long>, without nulls but in id of rows; anchors are rows too."""
    spark = rows.sparkSession
    found, blocks = anchor_blocks(anchors, limit)
    path = f"{C.scratch_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in range(blocks):
        part = Anchors(found.where(F.col("block") == block).select("id", "label", "n", "x").toArrow())
        if len(part):
            found_here, sent = _mine_block(rows, part, positives, negatives, share)
            found_here.write.mode("append").parquet(path)
            for b in sent:
                b.destroy()
    return spark.read.schema(schema).parquet(path)


def _mine_block(rows: DataFrame, part: Anchors, positives: int, negatives: int, share: tuple[int, int]) -> tuple[DataFrame, list]:
    """Rows of a block, and what was broadcast for them."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(part)
    best = Window.partitionBy("g").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    firsts = rows.mapInArrow(lambda batches: positives_of(sent.value, batches, positives), "g long, score long, id long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    of: dict[int, list[tuple[int, int | None]]] = {a: [(int(part.x[a].astype(object) @ part.x[a].astype(object)), int(part.id[a]))] * min(int(part.n[a]) - 1, positives) for a in range(len(part))}
    for r in firsts.select("g", "score", "id").toLocalIterator():
        of[r.g].append((r.score, r.id))
    of = {a: sorted(p, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:positives] for a, p in of.items()}
    windows = Windows(part, of, share)
    told = spark.sparkContext.broadcast(windows)
    merged = rows.mapInArrow(lambda batches: negatives_of(sent.value, told.value, batches, negatives), "g long, score long, id long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)

    def named(batches):
        part, windows = sent.value, told.value
        anchor, positive = np.array(windows.anchor, np.int64), pa.array(windows.positive, pa.int64())
        for b in batches:
            g = b.column("g").to_numpy()
            again = np.repeat(np.arange(len(g)), part.n[anchor[g]])  # a repeated anchor has its rows each time
            a, g = part.id[anchor[g[again]]], g[again]
            yield pa.RecordBatch.from_arrays([pa.array(a), positive.take(pa.array(g)), b.column("rank").take(pa.array(again)), b.column("id").take(pa.array(again)), pa.array(windows.high[g]), b.column("score").take(pa.array(again))], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return merged.select("g", "rank", "id", "score").mapInArrow(named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), [sent, told]


def labelled_vectors(embeddings: DataFrame) -> DataFrame:
    """id, label, x of the rows that take part; every seventh label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return V.integer_vectors(embeddings.where("label IS NOT NULL"), F.col("vec_id").cast("long").alias("id"), label.alias("label"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_vectors(C.table(spark, sf_dir, "embeddings"))
    return mine(rows, rows.where("id % 100 = 0"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r
), pos AS (
  SELECT r, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) AS p
  FROM s WHERE same QUALIFY p <= 5
)
SELECT pos.anchor_id, positive_id, (row_number() OVER (PARTITION BY pos.r, p ORDER BY score DESC, other_id))::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s ON pos.r = s.r AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
