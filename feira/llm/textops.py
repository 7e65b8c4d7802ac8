"""Helpers shared by the operators: Arrow batches as byte arrays, word hashes, stored stages.

Texts are handled as UTF-8 bytes of whole batches: one pass of numpy over a
few megabytes finds the words of hundreds of documents and hashes them.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is
``[^\\x20\\x09-\\x0D]+`` on code points, as UTF-8 uses those bytes for nothing else.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from feira.session import ensure_checkpoint_dir

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (splitmix64's finaliser) on uint64 arrays."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U64))[0])


BYTE_CODE = mix(np.arange(1, 257, dtype=U64))


class _Powers:
    """Powers of the base and of its inverse, grown on demand and never sent to workers."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def __reduce__(self):
        return _Powers, ()

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            up, down = np.full(size, _BASE, U64), np.full(size, _BASE_INVERSE, U64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


POWERS = _Powers()


class Prefix:
    """Polynomial hashes of any byte ranges of one buffer, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        POWERS.grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODE[data] * POWERS.up[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One mixed 64-bit hash per range; equal bytes give equal hashes wherever they lie."""
        raw = (self.sums[ends] - self.sums[starts]) * POWERS.down[starts]
        return mix(raw ^ mix((ends - starts).astype(U64)))


class Chunk:
    """Some consecutive texts of a batch as one byte buffer."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and for each text the index of its first word (n + 1 entries)."""
        size = len(self.data)
        if not size:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self) + 1, np.int64)
        word = ~SPACE[self.data]
        edge = np.zeros(size + 1, bool)  # edge[p]: a text begins (or all end) at byte p
        edge[self.offsets] = True
        before = np.zeros(size, bool)
        before[1:] = word[:-1]
        after = np.zeros(size, bool)
        after[:-1] = word[1:]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES, max_rows: int = 1 << 30) -> Iterator[Chunk]:
    """The column in chunks of at most ``max_bytes`` (a longer text is a chunk by itself)."""
    if not len(column):
        return
    data, off = text_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(n, lo + max_rows, max(hi, lo + 1))
        yield Chunk(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


LONG_RANGE = 256  # bytes from which a range is hashed by itself


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per byte range, made of its eight-byte words by scrambling after each of them.

    Unlike the sums of ``Prefix`` there is no pair of strings known to collide; ranges may overlap, but each costs its length.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(U64) + U64(mix_int(17)))
    left = np.flatnonzero((size > 0) & (size <= LONG_RANGE))
    at, rest = starts[left], size[left]
    while len(left):
        word = eights[at]
        short = rest < 8
        word[short] &= (U64(1) << (rest[short] * 8).astype(U64)) - U64(1)
        out[left] = mix(out[left] * U64(_BASE) ^ mix(word + U64(1)))
        on = rest > 8
        left, at, rest = left[on], at[on] + 8, rest[on] - 8
    for i in np.flatnonzero(size > LONG_RANGE):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def word_hashes(chunk: Chunk, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lowered if asked) and each text's first word index."""
    starts, ends, first = chunk.words()
    return range_hashes(LOWER[chunk.data] if lower else chunk.data, starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, and each text's first window index; a text of fewer words has one window."""
    counts = np.diff(first)
    per_text = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate([[0], np.cumsum(per_text)])
    # word index of each window's first word
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], per_text)
    have = np.repeat(np.minimum(counts, k), per_text)
    out = np.zeros(len(at), U64)
    for j in range(k):
        inside = have > j
        code = U64(mix_int(1000 + j) | 1)
        if inside.all():
            out += hashes[at + j] * code
        else:
            out[inside] += hashes[at[inside] + j] * code
    return mix(out ^ mix(have.astype(U64))), begin


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for sizes[0] entries, then the same of each further range."""
    total = int(sizes.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if total else np.zeros(0, np.int64)
    return np.arange(total) + shift


def arrow_limits(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get: 2,000 rows, 16 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    arrow_limits(df.sparkSession)
    return df.mapInArrow(fn, schema)


def stage_folder(spark: SparkSession) -> str:
    """A new folder of this run below the cluster's shared ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{configured.rstrip('/')}/feira-llm/{uuid.uuid4().hex}"


class Scratch:
    """The folders that ``stored`` makes while this is entered; ``clear`` deletes them.

    For callers that know when an operator's result has been written, such as the pipeline's next stage.
    """

    active: list[Scratch] = []

    def __init__(self):
        self.folders: list[str] = []

    def __enter__(self) -> Scratch:
        Scratch.active.append(self)
        return self

    def __exit__(self, *exc: object) -> None:
        Scratch.active.remove(self)

    def clear(self, spark: SparkSession) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while self.folders:
            path = jvm.org.apache.hadoop.fs.Path(self.folders.pop())
            path.getFileSystem(conf).delete(path, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there, so that its
    lineage is cut and a lost executor costs no more than the reading of its part. The
    shuffle files of the write are of no more use then and go at its end."""
    spark = df.sparkSession
    path, before = stage_folder(spark), spark.conf.get(CLEANUP, "false")
    if Scratch.active:
        Scratch.active[-1].folders.append(path)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def column_runs(
    batches: Iterator[pa.RecordBatch], key: str, flush_rows: int = 1 << 16
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by the long column ``key`` as tables that never break a run of equal keys,
    with the run starts (and the row count as last entry). Meant for runs of bounded length."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        k = table[key].to_numpy()
        return table, np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= flush_rows:
            table, starts = cut(pa.Table.from_batches(held).combine_chunks())
            last = int(starts[-2])
            if last:
                yield table.slice(0, last), starts[:-1]
            held = table.slice(last).to_batches()
            rows = table.num_rows - last
            if rows >= flush_rows:
                flush_rows = 2 * rows
    if rows:
        yield cut(pa.Table.from_batches(held).combine_chunks())
