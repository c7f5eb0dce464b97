"""Vectorised text helpers for Arrow batches (numpy over the UTF-8 buffers).

Every helper works on a ``Chunk``: a few hundred kilobytes of whole documents
laid end to end, so that the numpy passes stay in cache and a worker's memory
does not grow with the batch.  A document larger than the target is a chunk of
its own; texts are never cut.  A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_RNG = np.random.default_rng(20_240_229)
#: value of each byte in the word hash (fixed by the seed, alike on all workers)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers = np.ones(1, np.uint64)


#: what a Python worker keeps from task to task, by the operator that keeps it
_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What tasks of one operator leave in their Python worker for the next ones."""
    return _KEPT.setdefault(name, {})


def forget_others(name: str | None) -> None:
    """Drop what tasks of other operators left; a worker serves one after the other."""
    for other in list(_KEPT):
        if other != name:
            del _KEPT[other]


def give_back() -> None:
    """Hand freed memory back to the system, as the worker lives on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def task(run: Callable, keep: str | None = None) -> Callable:
    """A function for ``mapInArrow`` that leaves nothing in its worker but what ``keep`` names."""
    def wrapped(batches):
        forget_others(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def powers(n: int) -> np.ndarray:
    """Powers of the hash base (modulo 2**64), grown on demand."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Chunk:
    """Whole documents: ``buf`` holds their bytes, ``off`` the n + 1 offsets."""

    lo: int  # first row of the batch
    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i]:self.off[i + 1]].tobytes()


def as_strings(col: pa.Array) -> pa.Array:
    """The column as a plain string array without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return col.fill_null("") if col.null_count else col


def chunks(col: pa.Array, target: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a text column into chunks of whole documents."""
    col = as_strings(col)
    n = len(col)
    if n == 0:
        return
    _, ob, db = col.buffers()
    off = np.frombuffer(ob, np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(db, np.uint8) if db is not None and db.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + target, "right")) - 1)
        yield Chunk(lo, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of words that white space separates
NOT_SPACE = ~_SPACE
#: bytes of words of letters and digits; all bytes of non-ASCII characters belong
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[buf]


@dataclass
class Words:
    """Word spans of a chunk in bytes; ``first[i]`` is document i's first word."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(chunk: Chunk, buf: np.ndarray, member: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of member bytes within each document."""
    if not len(buf):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(chunk.off), np.int64))
    inside = member[buf]
    head = chunk.off[:-1][chunk.off[:-1] < len(buf)]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[head] |= inside[head]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tail = head[head > 0] - 1
    closes[tail] |= inside[tail]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, chunk.off))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the disjoint, ordered, non-empty byte spans."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    within = np.arange(int(size.sum())) - np.repeat(at, size)
    if len(within) == int(end[-1] - start[0]):
        inside = buf[start[0]:end[-1]]
    else:
        inside = buf[within + np.repeat(start, size)]
    value = _BYTE[inside] * powers(int(size.max()))[within]
    return mix(np.add.reduceat(value, at) + size.astype(np.uint64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive word hashes at each start (len(h) - k + 1 values)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out += h[j:len(h) - k + 1 + j] * _MULT[j % 64] * np.uint64(2 * (j // 64) + 1)
    return mix(out + np.uint64(k))


def shingle_sets(chunk: Chunk, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document (A-Z lower-cased).

    With fewer than k words the whole sequence is the one shingle; without
    words the set is empty.
    """
    buf = lower(chunk.buf)
    w = words(chunk, buf)
    h = span_hashes(buf, w.start, w.end)
    win = window_hashes(h, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            s = np.sort(win[a:b - k + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
        elif b > a:
            out.append(window_hashes(h[a:b], b - a))
        else:
            out.append(h[:0])
    return out


def list_column(parts: list[np.ndarray], kind=pa.int64()) -> pa.Array:
    """A list column from one numpy array per row."""
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False)))


def signed(a: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return a.astype(np.uint64, copy=False).view(np.int64)
