"""Shared pieces: durable intermediates, Arrow chunking and vectorised word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes outside this set.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xC2B2AE3D27D4EB4F
#: Masks of the first n bytes of eight.
_LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], _U64)
_LONG_WORD = 256
#: Text handled at once by a Python task; a longer single text forms a chunk alone.
CHUNK_BYTES = 2 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="corpusflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `limit` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def map_chunks(df: DataFrame, column: str, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow over chunks of bounded text size."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, column, limit):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight at a time are mixed in, after the length; long spans go to XXH3."""
    if not len(starts):
        return np.zeros(0, _U64)
    lens = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # eight bytes from each place on
    out = mix(lens.astype(_U64) * _U64(_BASE))
    todo, at = np.flatnonzero(lens <= _LONG_WORD), 0
    while len(todo):
        left = lens[todo] - at
        lane = lanes[starts[todo] + at] & _LANE[np.minimum(left, 8)]
        out[todo] = mix((out[todo] ^ lane) * _U64(_BASE) + _U64(at))
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(lens > _LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


class Words:
    """Words of a column of texts, as positions in one byte buffer."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = _LOWER[data] if lower else data
        solid = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[self.offsets] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:-1]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | edge[1:-1]
        self.solid = solid
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        #: Text i has the words first[i] .. first[i + 1].
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.starts, self.ends)

    def list(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(64, 2 * n), _U64)
        out[0] = 1
        size = 1
        while size < len(out):
            step = _U64(pow(base, size, 1 << 64))
            more = min(size, len(out) - size)
            out[size : size + more] = out[:more] * step
            size += more
        _POWERS[base] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each bit over the 64."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values, len(h) - n + 1 of them, without regard to text ends."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U64)
    p = powers(_WINDOW_BASE, n)
    out = h[:m] * p[0]
    for j in range(1, n):
        out += h[j : j + m] * p[j]
    return mix(out)


def valid_windows(words: Words, n: int) -> np.ndarray:
    """Whether n words starting at each word lie in one text, for len(words) - n + 1 starts."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    text_end = np.repeat(words.first[1:], np.diff(words.first))
    return np.arange(m) + n <= text_end[:m]


def row_key(text: str = "text", doc_id: str = "doc_id") -> list:
    """Join columns that tell rows apart even where doc_id is null or repeated with another text."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_d"), F.xxhash64(F.col(text)).alias("_t")]
