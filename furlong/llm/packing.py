"""Sum-of-squares online packing of token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tokens import END_ID, crc32, encoded, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Windows of ``size`` tokens in ``levels`` equal steps of fill. ``count[l]`` is the number of open windows at level l;
    an item goes where the sum of count[l]**2 grows least (the fullest of equals). Items are (length, doc_id, start, ids,
    total).

    A window whose room is less than a step leaves the levels and is topped up by the front of the items that come next.
    An item may also be cut to fill a window that has less room than it needs, which counts as ``cut_cost`` more; so a
    level holds no more than about cut_cost / 2 windows, and memory is bounded by the level array whatever comes."""

    def __init__(self, size: int, levels: int = 50, cut_cost: int = 8):
        self.size, self.levels, self.cut_cost = size, levels, cut_cost
        self.count = np.zeros(levels, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(levels)]  # (fill, items) by level, the last is in turn
        self.fill = np.zeros(levels, np.int64)  # of the window in turn
        self.nearly: list | None = None
        self.room = 0

    def level(self, fill: np.ndarray | int) -> np.ndarray | int:
        return fill * self.levels // self.size

    def take(self, at: int) -> list:
        """The window in turn at a level; level 0 may have none, which is a new window."""
        if not self.open[at]:
            return []
        _, window = self.open[at].pop()
        self.count[at] -= 1
        self.fill[at] = self.open[at][-1][0] if self.open[at] else 0
        return window

    def put(self, window: list, fill: int) -> list[list]:
        """Put back a window; it is full, nearly full, or open at its level."""
        if fill == self.size:
            return [window]
        if self.nearly is None and self.level(fill) == self.levels - 1:
            self.nearly, self.room = window, self.size - fill
            return []
        at = self.level(fill)
        self.open[at].append((fill, window))
        self.count[at] += 1
        self.fill[at] = fill
        return []

    def place(self, item: tuple) -> list[list[tuple]]:
        """The windows that this item fills."""
        out = []
        while item[0]:
            if item[0] >= self.size:
                part, item = cut(item, self.size)
                out.append([part])
            elif self.nearly is not None:
                part, item = cut(item, min(item[0], self.room))
                self.nearly.append(part)
                self.room -= part[0]
                if not self.room:
                    out.append(self.nearly)
                    self.nearly = None
            else:
                at, n = self.choose(item[0])
                part, item = cut(item, n)
                fill = n + int(self.fill[at]) if at >= 0 else n
                window = self.take(at) if at >= 0 else []
                window.append(part)
                out += self.put(window, fill)
        return out

    def choose(self, n: int) -> tuple[int, int]:
        """The level (-1: a new window) where n tokens, or the first of them, go."""
        grown = lambda to: np.where(to >= self.levels - 1, 0, 2 * self.count[np.minimum(to, self.levels - 1)] + 1)
        held = self.count > 0
        to = self.level(self.fill + n)
        gone = 2 * self.count - 1
        cost = np.where(to == np.arange(self.levels), 0, grown(to) - gone)
        room = self.size - self.fill
        never = np.iinfo(np.int64).max
        whole = np.append(int(grown(self.level(np.int64(n)))), np.where(held & (room >= n), cost, never))
        part = np.where(held & (room < n), self.cut_cost - gone, never)
        k, j = len(whole) - 1 - int(np.argmin(whole[::-1])), int(np.argmin(part))
        return (j, int(room[j])) if part[j] < whole[k] else (k - 1, n)

    def drain(self) -> list[list[tuple]]:
        """All windows that are not full, fullest first; none stay open."""
        rest = sorted((x for level in self.open for x in level), key=lambda x: -x[0])
        out = [self.nearly] * (self.nearly is not None) + [w for _, w in rest]
        self.__init__(self.size, self.levels, self.cut_cost)
        return out


def cut(x: tuple, n: int) -> tuple[tuple, tuple]:
    """The first n tokens of an item, and the rest."""
    return (n, x[1], x[2], x[3][:n], x[4]), (x[0] - n, x[1], x[2] + n, x[3][n:], x[4])


def close_up(windows: list[list[tuple]], size: int) -> list[list[tuple]]:
    """Windows without padding from part-filled ones: the emptiest give what the fullest lack, cut where needed, and
    the last remainder becomes windows whose lengths are powers of two."""
    out, lo, hi = [], 0, len(windows) - 1
    while lo < hi:
        room = size - sum(x[0] for x in windows[lo])
        while room and lo < hi:
            x = windows[hi].pop()
            if x[0] > room:
                x, rest = cut(x, room)
                windows[hi].append(rest)
            windows[lo].append(x)
            room -= x[0]
            if not windows[hi]:
                hi -= 1
        if not room:
            out.append(windows[lo])
            lo += 1
    if lo == hi:
        left = windows[lo][::-1]
        while left:
            want = 1 << (sum(x[0] for x in left).bit_length() - 1)
            part = []
            while want:
                x = left.pop()
                if x[0] > want:
                    x, rest = cut(x, want)
                    left.append(rest)
                part.append(x)
                want -= x[0]
            out.append(part)
    return out


def pack_sequences(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end: int = END_ID,
    keeps_space: bool = False, with_ids: bool = False,
) -> DataFrame:
    """Pack every document into sequences of at most ``size`` tokens; each row is a piece of a document.

    Pieces are placed online by sum of squares within each input partition, so nothing is shuffled; see ``SumOfSquares``
    for when a document is cut. When a partition ends, its part-filled windows (a few dozen, however many rows it has)
    close up; the last is cut into lengths that are powers of two, so
    no sequence needs padding. Sequence ids are unique over partitions and a rerun task gives the same ones. A long text
    is encoded in parts.
    A null or empty text is the end id alone; rows that repeat an id are packed each; an empty table gives no rows."""
    schema = PIECES + ", ids array<long>" * with_ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(tokenizer, keeps_space), SumOfSquares(size)
        next_id = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def emit(window: list[tuple]) -> None:
            nonlocal next_id
            at = 0
            for length, doc, start, ids, total in window:
                rows.append((doc, start, length, crc32(ids), total, next_id, at) + ((ids.tolist(),) if with_ids else ()))
                at += length
            next_id += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (7 + with_ids)
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
            names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            keys = b.column(0).to_pylist()
            for lo, ids, at in encoded(coder, b.column(1), end):
                for j in range(len(at) - 1):
                    total = int(at[j + 1] - at[j])
                    for full in packer.place((total, keys[lo + j], 0, ids[at[j] : at[j + 1]].copy(), total)):
                        emit(full)
                if len(rows) > 2000:
                    yield batch()
        for w in close_up(packer.drain(), size):
            emit(w)
        yield batch()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(pack, schema)
