"""Texts of an Arrow batch as byte arrays, for vectorised work inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once (numbers of 8 bytes are made for each); a longer text is handled alone.
CHUNK_BYTES = 1 << 18

# ASCII white space (tab, line feed, vertical tab, form feed, return, space).
SPACE_BYTES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over the batches of a task, that gives what it freed back to the
    system at its end: Spark keeps workers for later tasks, and the allocators of Arrow and of
    the C library keep what they have."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def forget(known: dict) -> None:
    """Empties ``known``, what a worker keeps over its tasks, and gives the memory back at once."""
    if known:
        known.clear()
        _give_back()


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


@dataclass
class Chunk:
    """Rows lo..hi of a batch: their bytes end to end; row i is data[starts[i]:starts[i + 1]]."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Nulls count as empty texts."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]] along axis 0; empty segments give 0."""
    n = len(starts) - 1
    out = np.zeros((n, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=out.dtype)
    return out


# Multipliers of the splitmix64 finalizer and an odd base for polynomial hashes.
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64))])
    return _POWERS[:n]


def runs(keep: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of kept bytes that do not cross rows: their begins, ends and rows."""
    if not len(keep):
        z = np.zeros(0, np.int64)
        return z, z, z
    begin = keep.copy()
    begin[1:] &= ~keep[:-1]
    inner = starts[:-1][starts[:-1] < len(keep)]
    begin[inner] = keep[inner]
    end = keep.copy()
    end[:-1] &= ~keep[1:]
    last = starts[1:][starts[1:] > 0] - 1
    end[last] = keep[last]
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return b, e, np.searchsorted(starts, b, "right") - 1


def run_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    lengths = ends - begins
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    picked = data[at + np.repeat(begins, lengths)].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(picked * _powers(int(lengths.max()))[at], np.cumsum(lengths) - lengths)
        return mix64(sums + lengths.astype(np.uint64) * _M1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(chunk: Chunk, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: hashes, rows, begins, ends. ASCII capitals fold."""
    data = _LOWER[chunk.data] if lower else chunk.data
    b, e, rows = runs(~IS_SPACE[chunk.data], chunk.starts)
    return run_hashes(data, b, e), rows, b, e
