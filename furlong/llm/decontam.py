"""Benchmark decontamination: size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .vec import blobs, owners, shingle_sets, text_slices, word_hashes
from .work import materialize


def shingle_table(rows: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (distinct shingles) and the sorted shingle hashes as packed 64-bit integers."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in text_slices(b.column(1)):
                h, at = shingle_sets(*word_hashes(data, offs, lower=True), k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), blobs(h, at)], ["id", "n", "shingles"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(sets, "id long, n long, shingles binary")


class Items:
    """A block of test items, partitioned by set size: class c has the items of 2**c to 2**(c+1)-1 shingles.

    An item of n shingles has as sketch its s smallest hashes, s = n - ceil(t * n) + 1. If a document holds a share t of
    the item, at most n - ceil(t * n) of its shingles are missing, so one of the sketch is there: no item is lost. Each
    class has a threshold, its largest sketch value; of a document only the hashes below it are looked up."""

    def __init__(self, rows: list, threshold: float):
        self.ids = [r["id"] for r in rows]  # null where the item has none
        self.sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.need = np.ceil(threshold * self.n - 1e-9).astype(np.int64)
        self.classes = []
        size_class = np.array([int(n).bit_length() for n in self.n])
        for c in np.unique(size_class):
            own = np.flatnonzero(size_class == c)
            sketch = [self.sets[i][: self.n[i] - self.need[i] + 1] for i in own]
            value, who = np.concatenate(sketch), np.repeat(own, [len(s) for s in sketch])
            order = np.argsort(value, kind="stable")
            self.classes.append((value[order], who[order], value.max()))

    def search(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, shared shingles) of each pair that holds the needed share, exactly counted."""
        doc = owners(at)
        for value, who, top in self.classes:
            low = np.flatnonzero(h <= top)  # the class' sketch of the documents
            left, right = np.searchsorted(value, h[low]), np.searchsorted(value, h[low], "right")
            hit = np.flatnonzero(left < right)
            if not len(hit):
                continue
            many = right[hit] - left[hit]
            place = np.concatenate([np.arange(a, b) for a, b in zip(left[hit], right[hit], strict=True)])
            pairs = np.unique(np.stack([np.repeat(doc[low[hit]], many), who[place]]), axis=1)
            for d, i in pairs.T:
                mine = h[at[d] : at[d + 1]]
                want = self.sets[i]
                p = np.minimum(np.searchsorted(mine, want), len(mine) - 1)
                shared = int((mine[p] == want).sum())
                if shared >= self.need[i]:
                    yield int(d), int(i), shared


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", block_shingles: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each document that holds at least ``threshold`` of the distinct
    k-word shingles of a test item. Words are runs of non-space bytes with A-Z in lower case; an item or document of
    fewer than k words is one shingle. Null or empty texts hold nothing and are held by nothing; ids may be null; rows that
    repeat an id give a row each; empty tables give no rows; other columns are ignored. Items go to the tasks in blocks of
    at most ``block_shingles`` shingles; documents are not shuffled. With several blocks the documents' shingles are
    written once and each block searches them. A prefix of the sorted hashes serves as the signature of each size class
    (see ``Items``), which finds every pair; a text is held whole, with some 80 bytes for each of its bytes."""
    spark = docs.sparkSession
    items = shingle_table(benchmark, k, item_id_col, item_text_col).filter("n > 0").persist()
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_shingles))
    schema = "doc_id long, item_id long, n_shared long, n_item long"
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))

    def shingled(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for lo, _, data, offs in text_slices(batch.column(1)):
            yield lo, *shingle_sets(*word_hashes(data, offs, lower=True), k)

    def written(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for lo, _, data, offs in text_slices(batch.column(1), 16 << 20):
            yield lo, np.frombuffer(data.tobytes(), np.uint64), offs // 8

    kept = materialize(shingle_table(docs, k, id_col, text_col).select("id", "shingles")) if blocks > 1 else None
    found = None
    for b in range(blocks):
        # about block_shingles / k shingles of 8 bytes: a bounded part, whatever the table's size
        held = items.filter(F.pmod(F.xxhash64("id", "shingles"), F.lit(blocks)) == b).select("id", "shingles").collect()
        sent = spark.sparkContext.broadcast([{"id": r["id"], "shingles": bytes(r["shingles"])} for r in held])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Items(sent.value, threshold) if sent.value else None
            for batch in batches:
                keys = batch.column(0)
                for lo, h, at in (written(batch) if blocks > 1 else shingled(batch)) if block else ():
                    out = [(keys[lo + d].as_py(), block.ids[i], s, int(block.n[i])) for d, i, s in block.search(h, at)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "item_id", "n_shared", "n_item"])

        part = (rows if kept is None else kept).mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    items.unpersist()
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


