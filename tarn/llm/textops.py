"""Vectorised text primitives over Arrow string columns: words, lines, span hashes.

Texts are viewed as one UTF-8 buffer with offsets; nothing here loops over characters in Python.
Nulls count as empty texts.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once; one longer text is worked on alone.
BLOCK_BYTES = 1 << 19
#: Powers of a base that a worker keeps; longer runs are put together from these.
KEPT_POWERS = 1 << 16

U = np.uint64
_B, _C = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)


def _inverse(x: np.uint64) -> np.uint64:
    return U(pow(int(x), -1, 1 << 64))


_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64. The first KEPT_POWERS are kept, whatever n is."""
    have = _POWERS.get(int(base))
    if have is None:
        have = np.full(KEPT_POWERS, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _POWERS[int(base)] = have
    if n <= KEPT_POWERS:
        return have[:n]
    steps = np.full(-(-n // KEPT_POWERS), have[-1:] * base, np.uint64)
    steps[0] = 1
    np.cumprod(steps, out=steps)
    return np.multiply.outer(steps, have).reshape(-1)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x], np.uint64))[0])


class SpanHash:
    """Hashes of any [start, end) of a sequence, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: np.uint64 = _B):
        n = len(values)
        self.inverse = powers(_inverse(base), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64) * U(0xA0761D6478BD642F))

    def windows(self, k: int) -> np.ndarray:
        """The hash of every window of k values, by its start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without a copy where there are no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    n = len(column)
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column, limit: int = BLOCK_BYTES):
    """Yield (first row, bytes, offsets) of runs of rows with about limit bytes."""
    data, offsets = utf8(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of a block: maximal runs of bytes outside `space`, never across texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE):
        self.data, self.offsets, n = data, offsets, len(data)
        inside = ~space[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.inside = inside
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: For each text, its first word; one more for the end.
        self.bounds = np.searchsorted(self.start, offsets)
        self.per_text = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_text)), self.per_text)

    def hashes(self, lower: bool = True) -> np.ndarray:
        return SpanHash(byte_values(LOWER[self.data] if lower else self.data))(self.start, self.end)


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of k words inside one text; shorter texts with words give one, of all of them."""
    text = words.text_of
    whole = SpanHash(hashes, _C)
    n = len(hashes) - k + 1
    if n > 0:
        ok = np.flatnonzero(text[:n] == text[k - 1 :])
        h, t = whole(ok, ok + k), text[ok]
    else:
        h, t = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((words.per_text > 0) & (words.per_text < k))
    if len(short):
        h = np.concatenate([h, whole(words.bounds[short], words.bounds[short + 1])])
        t = np.concatenate([t, short])
    return h, t


def release() -> None:
    """Give memory that is free back to the system: a worker that waits for its next task holds none of the last one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What tasks keep in a worker for later ones, by who keeps it.
KEPT: dict[str, dict] = {}


def forget(keeps: str = "") -> None:
    """Drop what tasks of other kinds have kept in this worker: a vocabulary doesn't stay through the stages that follow."""
    others = [k for k in KEPT if k != keeps]
    for k in others:
        del KEPT[k]
    if others:
        release()


def lean(run, keeps: str = ""):
    """run, a function of batches, with its memory released at the end; of what is kept in the worker only `keeps` outlasts its start."""

    def wrapped(batches):
        forget(keeps)
        yield from run(batches)
        release()

    return wrapped


def per_text_sum(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
