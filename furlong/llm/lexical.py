"""Ranked lexical search: best-first intervals of documents under range-maximum tables of the posting lists."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .aliases import LOWER as LOWER_CASE, UPPER as UPPER_CASE
from .vec import LOWER, expand, text_slices
from .work import discard, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of a text that are cut into terms at once, postings of a shard, pairs of an interval and a term looked up at once, documents of a leaf.
WINDOW, SHARD, LOOKUPS, LEAF = 2 << 20, 1 << 19, 1 << 20, 64
#: Bytes of item terms that one search holds; more items are searched in blocks.
BLOCK = 8 << 20
NO_ID = np.iinfo(np.int64).min


def windows(data: np.ndarray, offs: np.ndarray, most: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Cuts of about ``most`` bytes that no term crosses; a text may have many."""
    lo = 0
    while lo < len(data):
        hi = min(lo + most, len(data))
        if hi < len(data):
            end = int(offs[np.searchsorted(offs, hi)])  # a text's end is a cut as well
            gap = ~IS_TERM[data[hi:end]]
            hi = hi + int(np.argmax(gap)) if gap.any() else end
        yield lo, hi
        lo = hi


def known_terms(data: np.ndarray, offs: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and (text, term, occurrences) of those in ``vocabulary``, by text and term."""
    n, size = np.zeros(len(offs) - 1, np.int64), max(len(vocabulary), 1)
    keys, counts = [], []
    for lo, hi in windows(data, offs):
        part = LOWER[data[lo:hi]]
        edge = np.zeros(hi - lo + 1, bool)
        edge[offs[(offs >= lo) & (offs <= hi)] - lo] = True
        inside = IS_TERM[part]
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        if not len(start):
            continue
        doc = np.searchsorted(offs, start + lo, "right") - 1
        n += np.bincount(doc, minlength=len(n))
        bounds = np.stack([start, end], 1).ravel().astype(np.int32)  # terms and what lies between them, in turn
        both = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(part)])
        term = pc.fill_null(pc.index_in(both, value_set=vocabulary), -1).to_numpy()[::2]
        key, count = np.unique((doc * size + term)[term >= 0], return_counts=True)
        keys.append(key)
        counts.append(count)
    if not keys:
        none = np.zeros(0, np.int64)
        return n, none, none, none
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(place, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
    return n, key // size, key % size, count


def postings(docs: DataFrame, terms: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of each document: its number of terms, and its postings in the ``terms`` asked for."""
    vocabulary = [t.encode() for t in terms]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.binary())
        for b in batches:
            for lo, hi, data, offs in text_slices(b.column(1)):
                n, doc, term, tf = known_terms(data, offs, known)
                at = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (term, tf)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), *lists], ["id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(read, "id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """The posting lists of some documents, in order of id, with a range-maximum sparse table: at level j and place i
    stands where the largest impact of the 2**j postings from i is. Lists lie one behind the other; no range crosses two."""

    def __init__(self, ids: np.ndarray, impact: np.ndarray, doc: np.ndarray, term: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        self.ids, doc = ids[by_id], rank[doc]
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]
        self.keys = term[order] * len(ids) + self.doc
        longest = int(np.bincount(term).max(initial=0))
        table = [np.arange(len(doc), dtype=np.int32)]
        for j in range(1, longest.bit_length()):
            left, half = table[-1], 1 << (j - 1)
            right = np.append(left[half:], np.full(min(half, len(left)), left[-1], np.int32))
            table.append(np.where(self.impact[left] >= self.impact[right], left, right))
        self.table = np.array(table)

    def range(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of a term in documents lo to hi - 1."""
        size = len(self.ids)
        return np.searchsorted(self.keys, term * size + lo), np.searchsorted(self.keys, term * size + hi)

    def top(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the largest impact of the postings a to b - 1 is (a < b)."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        x, y = self.table[level, a], self.table[level, b - (1 << level)]
        return np.where(self.impact[x] >= self.impact[y], x, y)


class Search:
    """The best ``k`` documents of each item, over the shards given one after the other.

    ``terms`` has the distinct terms of all items, ``at`` each item's range in them, ``weight`` that of each term of the
    vocabulary. Sums of impacts stay below 2**53, so they are exact in doubles."""

    def __init__(self, terms: np.ndarray, at: np.ndarray, weight: np.ndarray, k: int):
        self.terms, self.at, self.weight, self.k = terms, at, weight, k
        items = len(at) - 1
        self.score, self.id = np.zeros((items, k), np.int64), np.full((items, k), NO_ID)

    def pairs(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row with each term of its item."""
        many = self.at[item + 1] - self.at[item]
        return np.repeat(np.arange(len(item)), many), self.terms[expand(self.at[item], many)]

    def in_parts(self, item: np.ndarray) -> Iterator[slice]:
        """Runs of rows whose pairs with terms are at most LOOKUPS (one row at least)."""
        total, lo = np.cumsum(self.at[item + 1] - self.at[item]), 0
        while lo < len(item):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + LOOKUPS, "right")))
            yield slice(lo, hi)
            lo = hi

    def bounds(self, shard: Shard, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What no document of an interval exceeds, the sum of its terms' largest impacts, and the document that has the largest of them."""
        row, term = self.pairs(item)
        a, b = shard.range(term, lo[row], hi[row])
        some = np.flatnonzero(a < b)
        row, at = row[some], shard.top(a[some], b[some])
        share = self.weight[term[some]] * shard.impact[at]
        bound = np.bincount(row, weights=share, minlength=len(item)).astype(np.int64)
        split = np.array(lo)
        first = np.lexsort((-share, row))
        rows, place = np.unique(row[first], return_index=True)
        split[rows] = shard.doc[at[first[place]]]
        return bound, split

    def scores(self, shard: Shard, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) of the documents of the intervals that score at all."""
        row, term = self.pairs(item)
        a, b = shard.range(term, lo[row], hi[row])
        at, each = expand(a, b - a), np.repeat(np.arange(len(row)), b - a)
        base = np.cumsum(hi - lo) - (hi - lo)
        place = base[row[each]] + shard.doc[at] - lo[row[each]]
        total = np.bincount(place, weights=self.weight[term[each]] * shard.impact[at], minlength=int((hi - lo).sum())).astype(np.int64)
        hit = np.flatnonzero(total)
        own = np.searchsorted(base, hit, "right") - 1
        return item[own], lo[own] + hit - base[own], total[hit]

    def keep(self, item: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Take scored documents into the best of their items; of equal scores the smaller id stands first."""
        good = (score > self.score[item, -1]) | ((score == self.score[item, -1]) & (ids < self.id[item, -1]))
        if not good.any():
            return
        who = np.unique(item[good])
        item = np.concatenate([np.repeat(who, self.k), item[good]])
        score, ids = np.concatenate([self.score[who].ravel(), score[good]]), np.concatenate([self.id[who].ravel(), ids[good]])
        order = np.lexsort((ids, -score, item))
        first = np.searchsorted(item[order], who)
        best = order[first[:, None] + np.arange(self.k)]
        self.score[who], self.id[who] = score[best], ids[best]

    def run(self, shard: Shard, items: np.ndarray) -> None:
        """Best-first: the intervals of the highest bounds are split at their documents of largest impact, which are scored;
        short intervals are scored whole. An interval ends when its bound cannot enter the item's best."""
        if not len(shard.doc):
            return
        item, lo, hi = items, np.zeros(len(items), np.int64), np.full(len(items), len(shard.ids))
        bound, split = self.bounds(shard, item, lo, hi)
        width = 2
        while True:
            worst = self.score[item, -1]
            live = np.flatnonzero((bound > worst) | ((bound == worst) & (bound > 0) & (shard.ids[lo] < self.id[item, -1])))
            if not len(live):
                return
            live = live[np.lexsort((lo[live], -bound[live], item[live]))]
            place = np.arange(len(live)) - np.searchsorted(item[live], item[live])
            now, rest = live[place < width], live[place >= width]
            width = min(2 * width, 64)
            leaf = hi[now] - lo[now] <= LEAF
            cut = now[~leaf]
            whole = [np.concatenate([x[now[leaf]], y]) for x, y in ((item, item[cut]), (lo, split[cut]), (hi, split[cut] + 1))]
            for part in self.in_parts(whole[0]):
                who, doc, score = self.scores(shard, *[x[part] for x in whole])
                self.keep(who, shard.ids[doc], score)
            child = [np.concatenate([item[cut]] * 2), np.concatenate([lo[cut], split[cut] + 1]), np.concatenate([split[cut], hi[cut]])]
            child = [x[child[1] < child[2]] for x in child]
            found = [self.bounds(shard, *[x[part] for x in child]) for part in self.in_parts(child[0])]
            item, lo, hi = (np.concatenate([x[rest], y]) for x, y in zip((item, lo, hi), child, strict=True))
            bound, split = (np.concatenate([x[rest], *[f[i] for f in found]]) for i, x in ((0, bound), (1, split)))


def shards(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[Shard]:
    """Shards of about SHARD postings of the documents that a task reads."""
    for b in batches:
        lists = b.column(2)
        at = lists.offsets.to_numpy().astype(np.int64)
        term, tf = (b.column(i).values.to_numpy().astype(np.int64) for i in (2, 3))
        ids, n = pc.fill_null(b.column(0), NO_ID).to_numpy(), b.column(1).to_numpy()
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SHARD, "right")) - 1)
            doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
            own = slice(at[lo], at[hi])
            m = 10 + (90 * n[lo:hi] * n_docs) // max(n_terms, 1)
            yield Shard(ids[lo:hi], (10**9 * tf[own]) // (1000 * tf[own] + 8 * m[doc]), doc, term[own])
            lo = hi


def search_block(docs: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, id, score): the best of each task for each of ``items`` (rows with no and terms)."""
    terms = sorted({t for r in items for t in r["terms"]})
    place = {t: i for i, t in enumerate(terms)}
    lists = materialize(postings(docs, terms, id_col, text_col))
    total = lists.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = {r["t"]: r["df"] for r in lists.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
    n_docs, n_terms = total["docs"], total["terms"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(terms))] or [0], np.int64)
    asked = [np.array([i for t in r["terms"] if (i := place[t]) in held and weight[i] > 0], np.int64) for r in items]
    at = np.concatenate([[0], np.cumsum([len(x) for x in asked])]).astype(np.int64)
    flat, numbers = np.concatenate([np.zeros(0, np.int64), *asked]), np.array([r["no"] for r in items], np.int64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(flat, at, weight, k)
        some = np.flatnonzero(np.diff(at))
        for shard in shards(batches, n_docs, n_terms):
            for lo in range(0, len(some), 64):
                search.run(shard, some[lo : lo + 64])
        item, rank = np.nonzero(search.score)
        ids = search.id[item, rank]
        yield pa.RecordBatch.from_arrays([pa.array(numbers[item]), pa.array(ids, mask=ids == NO_ID), pa.array(search.score[item, rank])], ["no", "id", "score"])

    found = materialize(lists.select("id", "n", "terms", "tfs").mapInArrow(best, "no long, id long, score long"))
    discard(lists)
    return found


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of highest score above 0 for each row of ``items``.

    Terms are the maximal runs of letters, digits and characters beyond ASCII of the whole text, A to Z lower-cased. A term
    weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms adds, for each distinct term of the item,
    weight * (10**9 tf div (1000 tf + 8 m)), m = 10 + 90 n N div L. Equal scores rank by id, a null id first.

    Null and empty texts have no terms: such documents are found by nothing and count in no statistic, such items have no
    rows. Repeated documents and items are rows of their own; an empty table gives no rows; other columns are ignored.

    Documents are read once: only postings in terms of the items are kept, and they stay in the task that made or reads
    them, so a word that all documents hold is no hot key. Each task searches its documents in shards of SHARD postings and
    hands on ``k`` rows for each item. A long text is cut between terms; a shard holds one document's postings at least, at
    most one for each term asked for. Items of more than ``block`` bytes of terms are searched block by block, one block
    on the driver at a time."""
    lower = F.translate(F.coalesce(F.col(item_text_col).cast("string"), F.lit("")), UPPER_CASE, LOWER_CASE)
    asked = items.select(F.monotonically_increasing_id().alias("no"), F.col(item_col).alias("item_id"), F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), 0)).alias("terms"))
    asked = materialize(asked)
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 8))).first()[0] or 0
    n_blocks = math.ceil(size / block)
    found = [search_block(docs, asked.filter(F.pmod(F.xxhash64("no"), F.lit(n_blocks)) == b).select("no", "terms").collect(), k, id_col, text_col) for b in range(n_blocks)]
    out = found[0] if found else docs.sparkSession.createDataFrame([], "no long, id long, score long")
    for f in found[1:]:
        out = out.union(f)
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_first("id")))
    ranked = out.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.join(asked.select("no", "item_id"), "no").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
