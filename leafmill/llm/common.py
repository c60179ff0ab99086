"""Byte-level helpers that the text operators share.

Texts reach Python as Arrow batches. They are cut into blocks of about a megabyte and worked on as one byte
array with offsets, so cost per document stays low and memory is bounded by the block (or the longest text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
#: The bytes of [\x20\x09-\x0D]; bytes.split() and bytes.translate() agree on them.
SPACES = b" \t\n\x0b\x0c\r"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters, digits and every byte of a longer UTF-8 sequence.
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts don't pile up in a Python worker, and a checkpoint folder if none is named."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        import tempfile

        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-checkpoint-"))


def release() -> None:
    """Gives memory that is free but kept by the allocators back to the system; workers and drivers live on between jobs and would pile it up."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable) -> Callable:
    """run, a function of mapInArrow, that gives its memory back when a task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about limit bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, wide, n + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """Words of a block: starts, ends (byte positions), and first[d]:first[d + 1], the words of text d."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, member: np.ndarray):
        inside = member[data]
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            before[offs[:-1][offs[:-1] < len(data)]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(data), bool)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
            cut = offs[1:-1]
            after[cut[(cut > 0)] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.data, self.sums = data, None

    def hashes(self, width: int | None = None, fold: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `width` bytes; ASCII letters in lower case if fold.

        The polynomial's base is odd, so it can be divided out again: one running sum serves every word.
        """
        n = len(self.data)
        if self.sums is None:
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[LOWER[self.data] if fold else self.data] * powers(_BASE, n), out=self.sums[1:])
        ends = self.ends if width is None else np.minimum(self.ends, self.starts + width)
        return mix((self.sums[ends] - self.sums[self.starts]) * powers(_INVERSE, n + 1)[self.starts] + (ends - self.starts).astype(np.uint64))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; of the whole if there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    if n < k:
        return mix((hashes * _SLOT[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out += hashes[j : n - k + 1 + j] * _SLOT[j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
