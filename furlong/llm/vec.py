"""Vectorised text helpers used inside tasks: whole Arrow batches become numpy arrays, with no loop over rows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd base of the rolling polynomial modulo 2**64, and one random value for each byte.
BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, 0 to n."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        both = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = both[0], both[1]
    return _powers


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Rolling:
    """Hashes of any slice of a sequence of 64-bit symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        p, self.inverse = powers(n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * p[:n], out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k symbols from each position (none if there are fewer)."""
        n = len(self.prefix) - k
        return (self.prefix[k:] - self.prefix[: max(n, 0)]) * self.inverse[: max(n, 0)] if n > 0 else np.zeros(0, np.uint64)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: an idle worker process would else keep what its largest took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def text_slices(col: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) in pieces of about ``most`` bytes; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    if len(col) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of non-space bytes) and each text's range in them."""
    inside = ~IS_SPACE[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = offs[:-1][offs[:-1] < offs[1:]]
    before[first] = False
    after[offs[1:][offs[:-1] < offs[1:]] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word and each text's range in them."""
    if lower:
        data = LOWER[data]
    start, end, at = word_bounds(data, offs)
    return mix(Rolling(BYTE_VALUES[data]).slices(start, end)), at


def owners(at: np.ndarray) -> np.ndarray:
    """Index of the text of each element."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def shingle_sets(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, ascending, and each text's range in them.

    A text of 1 to k-1 words has the whole sequence as its one shingle."""
    n_words = np.diff(at)
    doc = owners(at)
    roll = Rolling(words)
    h = mix(roll.grams(k), k)
    ok = doc[: len(h)] == doc[k - 1 : k - 1 + len(h)]
    d, h = doc[: len(h)][ok], h[ok]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        d = np.concatenate([d, short])
        h = np.concatenate([h, mix(roll.slices(at[short], at[short + 1]), 1000 + k)])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    d, h = d[new], h[new]
    return h, np.searchsorted(d, np.arange(len(at)))


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[i] .. start[i] + length[i] - 1."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary value for each range of ``values``."""
    raw = np.ascontiguousarray(values)
    row = raw.itemsize * int(np.prod(raw.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * row).astype(np.int32)), pa.py_buffer(raw)])
