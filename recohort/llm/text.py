"""Numpy helpers over the bytes of many texts at once: chunks, words, hashes and rolling hashes.

All functions work on whole texts. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are worked on in chunks of about this many bytes, which bounds the memory of a task. A longer text is a chunk.
CHUNK_BYTES = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that anything but a blank ends.
NOT_SPACE = ~SPACES
#: Bytes of words made of digits, letters a-z and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True



def small_batches(spark) -> None:
    """Lets Spark hand texts to Python in batches of some megabytes, however long they are, instead of 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def giving_back(run: Callable) -> Callable:
    """run, after whose last row the worker gives memory back: Spark keeps workers, and what they hold, for later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def powers(inverse: bool, n: int) -> np.ndarray:
    """The first n powers, modulo 2**64, of the base of the hashes or of its inverse."""
    size = max(2 * CHUNK_BYTES, 1 << int(n - 1).bit_length())
    return _powers(_INVERSE if inverse else _BASE, size)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on every bit before."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Texts side by side: `data` holds their bytes, text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch | None = None):
        self.data, self.offsets, self.batch = data, offsets, batch
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def lowered(self) -> Chunk:
        return Chunk(_LOWER[self.data], self.offsets, self.batch)

    def sums(self) -> np.ndarray:
        """Prefix sums from which hash_spans() takes the hash of any piece."""
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_TABLE[self.data] * powers(False, len(self.data)), out=self._sums[1:])
        return self._sums

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[starts:ends]; equal bytes have equal hashes."""
        sums = self.sums()
        return mix((sums[ends] - sums[starts]) * powers(True, len(sums))[starts] + (ends - starts).astype(np.uint64))

    def hash_windows(self, size: int) -> np.ndarray:
        """Hashes of data[i:i + size] for every i, windows over the border of two texts included."""
        sums = self.sums()
        count = max(0, len(self.data) - size + 1)
        return mix((sums[size:size + count] - sums[:count]) * powers(True, max(count, 1))[:count] + np.uint64(size))

    def words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of bytes of the kind, and the number of words before each text."""
        inside = kind[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        stops = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        first[begins] = inside[begins]
        last[stops] = inside[stops]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of the batches in order, cut into chunks between texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        if texts.null_count and (offsets[1:] > offsets[:-1])[np.asarray(texts.is_null())].any():
            texts = texts.fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
            yield Chunk(data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin],
                        batch.slice(begin, end - begin))
            begin = end


def each_range(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one after another."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
