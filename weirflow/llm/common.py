"""Pieces that the training-data operators share.

Text is handled as Arrow batches: the UTF-8 buffer of a string column is scanned with
numpy, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are scanned at once; it bounds the memory of a Python worker.
BLOCK_BYTES = 16 << 20


# ---------------------------------------------------------------- shared folder
def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session (as in tests) may leave it unset, and gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            return kept.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weirflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def kept_at(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which goes when the session's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _place(spark, path)
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again (cuts the lineage)."""
    spark = df.sparkSession
    path = kept_at(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for frames that no later plan reads."""
    for frame in frames:
        path = getattr(frame, "_kept_at", None)
        if path:
            fs, at = _place(frame.sparkSession, path)
            fs.delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    name = f"__{name}"
    while name in df.columns:
        name += "_"
    return name


def in_class(column: str, modulus: int, remainder: int):
    """crc32 of an id's decimal text, modulo: a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "utf-8")) % modulus == remainder


# ---------------------------------------------------------------- workers
def _trimmer():
    """The C library's call that gives free memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def frugal(run):
    """A function over Arrow batches that leaves a worker small: workers are used again for other
    stages, and would hold what this one has freed."""

    @wraps(run)
    def give_back(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trimmer()(0)

    return give_back


# ---------------------------------------------------------------- text buffers
def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``limit`` bytes of text (one row at least)."""
    _, offs = text_buffer(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_STEP = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix1(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


_POWERS = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 64)
        out = np.full(size, U64(0xD6E8FEB86659FD93), U64)
        out[0] = U64(1)
        _POWERS = np.multiply.accumulate(out)
    return _POWERS


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows of a text column."""

    data: np.ndarray
    doc_offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of each row's first word; n + 1 entries

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words' bytes."""
        data = self.data if data is None else data
        if not len(self.start):
            return np.zeros(0, U64)
        length = self.end - self.start
        total = int(length.sum())
        base = np.cumsum(length) - length
        at = np.arange(total, dtype=np.int64) - np.repeat(base, length)
        values = _TABLE[data[np.repeat(self.start, length) + at]]
        values *= _powers(int(length.max()))[at]
        return mix(np.add.reduceat(values, base) + length.astype(U64) * _STEP)


def scan_words(column: pa.Array | pa.ChunkedArray) -> Words:
    data, offs = text_buffer(column)
    n = len(offs) - 1
    inside = ~WHITE[data]
    size = len(data)
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    edge = offs[:-1][offs[:-1] < size]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offs, "left")
    return Words(data, offs, start, end, np.repeat(np.arange(n), np.diff(first)), first)


def windows(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of each window of ``width`` words within a row."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    total = np.zeros(n - width + 1, U64)
    for k in range(width):
        total = (total ^ hashes[k : n - width + 1 + k]) * U64(0xD6E8FEB86659FD93) + U64(k + 1)
        total ^= total >> U64(29)
    same = words.doc[: n - width + 1] == words.doc[width - 1 :]
    at = np.flatnonzero(same)
    return at, mix(total[at])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class HashTable:
    """Numbers to numbers, by open addressing; lookups are made for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, dtype: np.dtype = np.dtype(np.float32)):
        self.bits = max(4, int(max(1, len(keys)) * 3 - 1).bit_length())
        self.keys = np.full(1 << self.bits, U64(2**64 - 1), U64)
        self.values = np.zeros(1 << self.bits, dtype)
        left, slot = np.arange(len(keys)), self._slots(keys)
        wrap = np.int64((1 << self.bits) - 1)
        while len(left):
            free = self.keys[slot] == U64(2**64 - 1)
            self.keys[slot[free]] = keys[left[free]]
            won = free & (self.keys[slot] == keys[left])
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & wrap

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys aren't there."""
        slot = self._slots(keys)
        found = self.keys[slot]
        out, missing = self.values[slot], found != keys
        left = np.flatnonzero(missing & (found != U64(2**64 - 1)))
        slot = slot[left]
        wrap = np.int64((1 << self.bits) - 1)
        while len(left):
            slot = (slot + 1) & wrap
            found = self.keys[slot]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            missing[left[hit]] = False
            go = ~hit & (found != U64(2**64 - 1))
            left, slot = left[go], slot[go]
        return out, missing
