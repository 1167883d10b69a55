"""Exact repeats of long windows over a whole corpus: the search under substring and suffix-style removal.

The search is one chain of Spark jobs over any sequence of symbols (words or bytes) and window length W:

1. ``window_runs``: every window has as anchor the smallest hash of its k-grams. Consecutive windows with one anchor are a
   run, told by its anchor and the hash of all it covers. Equal windows have equal anchors wherever they stand.
2. Runs are counted by (anchor, content). A run whose content stands elsewhere is repeated as a whole, without looking at
   its windows. An anchor with a single content cannot lead to anything else. What is left is where an anchor stands in
   several contents: the edges of repeated passages.
3. For those, the holders of each content send what the run covers to its anchor's task. Under removal of what stands in
   an earlier document (``earlier_only``), these contents are the anchor's reference shard: in ascending order of their
   ids, documents first run through a suffix automaton of all earlier ones, whose matching statistics give the spans of
   at least W symbols, and are then added to it. A shard has at most PART_CONTENTS contents.
4. Where the first copy goes too, and for anchors with more contents, window hashes are sent instead, dealt by anchor and
   window hash, and equal (anchor, window) pairs are found by sorting. The holders of a window whose anchor has more than
   DEALT_CONTENTS contents are dealt over several tasks; what a task cannot settle alone, the smallest id of each window,
   is matched in a second step, so that no passage however common gathers its holders in one task.

A whole document never runs through a shard that cannot hold a window of it, which is what keeps automata affordable: the
shards grow with the corpus, and broadcasting all of them to all documents costs its square. Both hashes have 64 bits and
are independent. Nothing is sampled or capped, groups of copies collapse to one holder at
step 2, and what travels is proportional to the edges of repeats, not to pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .automata import SuffixAutomaton
from .vec import BYTE_VALUES, Rolling, blobs, expand, give_back, mix, owners, signed, text_slices, word_bounds, word_hashes
from .work import broadcast_if, discard, materialize

#: About as many window hashes go to one task of step 3, contents of an anchor to one part of it, and holders of one window
#: to one task before they are dealt over several.
TASK_WINDOWS, PART_CONTENTS, DEALT_CONTENTS = 2_000_000, 32, 1024

#: Bytes of text that are hashed at once: some 80 bytes are held for each symbol.
SLICES = {"word": 2 << 20, "byte": 1 << 19}


def shard_spans(ids: np.ndarray, parts: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of the spans of each part that stand in a part with a smaller id, for parts in ascending order of
    ids: matching statistics against the suffix automaton of all parts before."""
    shard = SuffixAutomaton()
    first = 0
    for last in np.append(np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)).tolist():
        own = [parts[k].tolist() for k in range(first, last)]
        if first:
            for k, symbols in zip(range(first, last), own, strict=True):
                start = end = -1
                for j, n in enumerate(shard.statistics(symbols), 1):
                    if n >= window:
                        if j - window > end:
                            if end > 0:
                                yield k, start, end
                            start = j - window
                        end = j
                if end > 0:
                    yield k, start, end
        if last < len(ids):
            for symbols in own:
                shard.add(symbols)
        first = last


#: What step 3 sends: symbols of whole runs with their numbers n, or (n null) hashes of single windows.
SENT = ["route", "symbols", "anchor", "ids", "th", "start", "n"]
SENT_SCHEMA = pa.schema([("route", pa.int64()), *((c, pa.binary()) for c in SENT[1:])])
SENT_DDL = "route long, symbols binary, anchor binary, ids binary, th binary, start binary, n binary"
#: What a task of step 4 gives: spans of a text, or (doc_id null) windows for the second step. A route below 0 is that of
#: windows dealt over several tasks.
FOUND_SCHEMA = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("spans", pa.binary()), *((f"to_{f.name}", f.type) for f in SENT_SCHEMA)])
FOUND_DDL = "doc_id long, th long, spans binary, " + ", ".join(f"to_{c}" for c in SENT_DDL.split(", "))


def by_route(route: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    """Single windows (h, anchor, ids, th, start), one row for each route."""
    order = np.argsort(route, kind="stable")
    s = route[order]
    cut = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    out = [pa.array(s[cut]), *(blobs(x[order], np.append(cut, len(s))) for x in cols), pa.nulls(len(cut), pa.binary())]
    return pa.RecordBatch.from_arrays(out, schema=SENT_SCHEMA)


def padded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of some columns of FOUND_SCHEMA with nulls in the others."""
    own = dict(zip(batch.schema.names, batch.columns, strict=True))
    return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(batch.num_rows, f.type)) for f in FOUND_SCHEMA], schema=FOUND_SCHEMA)


def symbols(data: np.ndarray, offs: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    return (BYTE_VALUES[data], offs) if unit == "byte" else word_hashes(data, offs, lower=False)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, by running minima from both sides of blocks of w."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    full = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = h
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def window_runs(sym: np.ndarray, at: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor, content, inner) of each run; places count from the text's start. inner: the
    anchor stands more than once in what the run covers, so that windows of one run can be equal."""
    roll = Rolling(sym)
    grams = mix(roll.grams(k), 7)
    low = sliding_min(grams, window - k + 1)
    doc = owners(at)
    place = np.flatnonzero(doc[: len(low)] == doc[window - 1 : window - 1 + len(low)])
    if not len(place):
        e = np.zeros(0, np.int64)
        return e, e, e, e.view(np.uint64), e.view(np.uint64), e.astype(bool)
    value = low[place]
    new = np.ones(len(place), bool)
    new[1:] = (value[1:] != value[:-1]) | (place[1:] != place[:-1] + 1) | (doc[place[1:]] != doc[place[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(place)))
    a = place[first]
    d = doc[a]
    anchor = value[first]
    # places of anchors: a bit table finds nearly all others out, then each run counts its own
    bit = np.zeros(1 << 22, bool)
    bit[anchor & np.uint64((1 << 22) - 1)] = True
    spot = np.flatnonzero(bit[grams & np.uint64((1 << 22) - 1)])
    left, right = np.searchsorted(spot, a), np.searchsorted(spot, a + n + window - k)
    same = grams[spot[expand(left, right - left)]] == np.repeat(anchor, right - left)
    inner = np.bincount(np.repeat(np.arange(len(a)), right - left)[same], minlength=len(a)) > 1
    return d, a - at[d], n, anchor, mix(roll.slices(a, a + n - 1 + window) + n.astype(np.uint64), 11), inner


def find_repeats(
    docs: DataFrame, *, unit: str, window: int, k: int, earlier_only: bool, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, th, spans): for each text with repeated windows, packed 32-bit (start, end) pairs of places covered by
    them. A window counts if it also starts in a document with a smaller id (``earlier_only``) or else anywhere else.

    A null id is smaller than all others. th is the hash of the text: rows that repeat an id with the same text share
    their spans (and count as different places unless ``earlier_only``)."""
    spark = docs.sparkSession
    smallest = -(2**63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(smallest)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("th", F.xxhash64("t"))

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, _, data, offs in text_slices(b.column(2), SLICES[unit]):
                d, a, n, anchor, content, inner = window_runs(*symbols(data, offs, unit), window, k)
                if len(d):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (ids[lo + d], th[lo + d], a.astype(np.int32), n.astype(np.int32), signed(anchor), signed(content), inner & (not earlier_only))],
                        ["doc_id", "th", "a", "n", "anchor", "content", "inner"],
                    )
        give_back()

    runs = materialize(rows.select("doc_id", "th", "t").mapInArrow(runs_of, "doc_id long, th long, a int, n int, anchor long, content long, inner boolean"))
    holder = F.struct("doc_id", "th", "a")
    contents = runs.groupBy("anchor", "content").agg(F.count("*").alias("c"), F.min(holder).alias("holder"), F.max("inner").alias("inner"))
    per_anchor = contents.groupBy("anchor").agg(F.count("*").alias("n_contents"), F.sum("c").alias("total"), F.max("inner").alias("any_inner")).filter("total > 1 OR any_inner").drop("total", "any_inner")
    known = materialize(contents.join(per_anchor, "anchor").select("anchor", "content", "c", "holder", "n_contents", F.col("inner").alias("any_inner")))
    n_known = known.count()
    status = runs.join(broadcast_if(known, 72 * n_known), ["anchor", "content"])
    same_doc = F.col("holder.doc_id") == F.col("doc_id")  # a document's repeats of a run all need their spans
    held = same_doc if earlier_only else same_doc & (F.col("holder.th") == F.col("th")) & (F.col("holder.a") == F.col("a"))
    whole = F.col("holder.doc_id") < F.col("doc_id") if earlier_only else F.col("c") > 1
    status = status.select("doc_id", "th", "a", "n", "anchor", "n_contents", whole.alias("whole"), (held & ((F.col("n_contents") > 1) | F.col("any_inner"))).alias("sends"))
    status = materialize(status.filter("whole or sends"))
    discard(runs)
    discard(known)

    by_shard = F.lit(earlier_only) & (F.col("n_contents") <= PART_CONTENTS)
    senders = status.filter("sends").groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "n", "anchor", "n_contents", by_shard.alias("by_shard"))).alias("runs"))
    size = status.filter("sends").agg(F.sum("n").cast("long").alias("windows"), F.count("*").alias("runs")).first()
    todo = rows.join(broadcast_if(senders, 40 * size["runs"]), ["doc_id", "th"]).select("doc_id", "th", "t", "runs")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            lists = b.column(3)
            ends, flat = np.asarray(lists.offsets), lists.values
            field = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "n", "anchor", "n_contents", "by_shard")}
            for lo, hi, data, offs in text_slices(b.column(2), SLICES[unit]):
                sym, at = symbols(data, offs, unit)
                roll = Rolling(sym)
                r = np.arange(ends[lo], ends[hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                whole = field["by_shard"][r]
                if whole.any():
                    own, owner = r[whole], doc[whole]
                    n, a = field["n"][own].astype(np.int64) + window - 1, field["a"][own].astype(np.int64) + at[owner]
                    route = (mix(field["anchor"][own].view(np.uint64), 17) >> np.uint64(40)).astype(np.int64)
                    order = np.argsort(route, kind="stable")
                    s = route[order]
                    cut = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                    edge = np.append(cut, len(s))
                    symbol_edge = np.concatenate([[0], np.cumsum(n[order])])[edge]
                    row, own = lo + owner[order], own[order]
                    cols = [pa.array(s[cut]), blobs(sym[expand(a[order], n[order])], symbol_edge)]
                    cols += [blobs(x, edge) for x in (field["anchor"][own], ids[row], th[row], field["a"][own].astype(np.int32), n[order].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, SENT)
                    r, doc = r[~whole], doc[~whole]
                n = field["n"][r].astype(np.int64)
                start = expand(field["a"][r].astype(np.int64), n)
                run = np.repeat(np.arange(len(r)), n)
                pos = start + at[doc][run]
                h = mix(roll.slices(pos, pos + window), 13)
                anchor = field["anchor"][r][run].view(np.uint64)
                row = lo + doc[run]
                parts = -(-field["n_contents"][r] // PART_CONTENTS)[run].astype(np.uint64)
                salts = -(-field["n_contents"][r] // DEALT_CONTENTS)[run].astype(np.uint64)
                salt = mix(th[row].view(np.uint64), 19) % salts
                key = mix(anchor + (h >> np.uint64(20)) % parts + (salt << np.uint64(32)), 17)
                # one row for each route of the batch, not for each run
                route = (key >> np.uint64(40)).astype(np.int64)
                if len(route):
                    yield by_route(np.where(salts > 1, -1 - route, route), h, anchor, ids[row], th[row], start.astype(np.int32))
        give_back()

    def packed(ids: np.ndarray, th: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
        """Spans, sorted by (id, text), as a row for each text."""
        cut = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])))
        return padded(pa.RecordBatch.from_arrays([pa.array(ids[cut]), pa.array(th[cut]), blobs(span.astype(np.int32), np.append(cut, len(ids)))], ["doc_id", "th", "spans"]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), SENT_SCHEMA)  # about TASK_WINDOWS hashes, or what as many windows cover
        shards = kept(held, pc.is_valid(held.column("n")))
        if shards.num_rows:
            yield from match_shards(shards)
        held = kept(held, pc.is_null(held.column("n")))
        for dealt in (True, False):
            own = kept(held, pc.less(held.column("route"), 0) if dealt else pc.greater_equal(held.column("route"), 0))
            if own.num_rows:
                yield from match_windows(own, dealt)
        del held, shards, own
        give_back()

    def kept(t: pa.Table, mask: pa.ChunkedArray) -> pa.Table:
        """The rows of a mask, without a copy where it takes all or none."""
        n = pc.sum(mask).as_py() or 0
        return t if n == t.num_rows else t.filter(mask) if n else t.slice(0, 0)

    def joined(t: pa.Table, name: str, kind: type) -> np.ndarray:
        """The values of all rows one behind the other, from the column's own memory."""
        parts = [np.zeros(0, kind)]
        for c in t.column(name).chunks:
            at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            if len(c) and at[-1] > at[0]:
                parts.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind))
        return np.concatenate(parts)

    def match_shards(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sym, anchor, ids, th, start, n = (joined(t, c, k) for c, k in zip(SENT[1:], (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32), strict=True))
        at = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        order = np.lexsort((start, th, ids, anchor))
        where, spans = [], []
        for own in np.split(order, np.flatnonzero(np.diff(anchor[order].view(np.int64))) + 1):
            for k, a, e in shard_spans(ids[own], [sym[at[j] : at[j + 1]] for j in own], window):
                where.append(own[k])
                spans.append((start[own[k]] + a, start[own[k]] + e))
        if where:
            where, spans = np.array(where), np.array(spans)
            order = np.lexsort((th[where], ids[where]))
            yield packed(ids[where][order], th[where][order], spans[order])

    def match_windows(t: pa.Table, dealt: bool) -> Iterator[pa.RecordBatch]:
        h, anchor, ids, th, start = (joined(t, c, k) for c, k in zip(SENT[1:-1], (np.uint64, np.uint64, np.int64, np.int64, np.int32), strict=True))
        order = np.lexsort((ids, anchor, h))
        h, anchor, ids, th, start = h[order], anchor[order], ids[order], th[order], start[order]
        new = np.append(True, (h[1:] != h[:-1]) | (anchor[1:] != anchor[:-1]))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(h)))
        hit = np.repeat(ids[first], n) < ids if earlier_only else np.repeat(n > 1, n)
        if dealt:  # other tasks may hold the same windows: the smallest id of each speaks for this one
            left = np.flatnonzero(~hit) if earlier_only else first
            route = (mix(anchor[left] + h[left], 17) % np.uint64(tasks)).astype(np.int64)  # the task: few, as each is a row
            b = by_route(route, h[left], anchor[left], ids[left], th[left], start[left])
            yield padded(b.rename_columns([f"to_{c}" for c in SENT]))
        ids, th, start = ids[hit], th[hit], start[hit]
        if not len(ids):
            return
        order = np.lexsort((start, th, ids))
        ids, th, start = ids[order], th[order], start[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (start[1:] > start[:-1] + 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ids)) - 1
        yield packed(ids[first], th[first], np.stack([start[first], start[last] + window], axis=1))

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["windows"] or 0) // TASK_WINDOWS))
    once = materialize(todo.mapInArrow(send, SENT_DDL).repartition(tasks, "route").mapInArrow(match, FOUND_DDL))
    again = once.filter("doc_id is null").select(*(F.col(f"to_{c}").alias(c) for c in SENT)).repartitionById(tasks, F.col("route").cast("int")).mapInArrow(match, FOUND_DDL)
    found = once.filter("doc_id is not null").unionByName(again).select("doc_id", "th", "spans")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, n = b.column(2).to_numpy(), b.column(3).to_numpy()
            span = np.stack([a, a + n - 1 + window], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), blobs(span, np.arange(len(a) + 1))], ["doc_id", "th", "spans"])

    sure = status.filter("whole").select("doc_id", "th", "a", "n").distinct().mapInArrow(pair, "doc_id long, th long, spans binary")
    # the spans of one text are bounded by its length
    out = materialize(found.unionByName(sure).groupBy("doc_id", "th").agg(F.collect_list("spans").alias("spans")))
    discard(status)
    discard(once)
    return out


def remove_repeats(
    docs: DataFrame, *, unit: str, window: int, k: int, earlier_only: bool, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_units, n_removed, n_spans (maximal removed runs), kept_sha256 of what is left, and
    with ``keep_text`` that itself as bytes. Words are runs of non-space bytes, unchanged, and what is kept is joined by
    one space. Null and empty texts have no windows; an empty table gives no rows; other columns are ignored."""
    spans = find_repeats(docs, unit=unit, window=window, k=k, earlier_only=earlier_only, id_col=id_col, text_col=text_col)
    size = spans.agg(F.sum(F.expr("aggregate(spans, 0L, (a, x) -> a + octet_length(x))") + 64)).first()[0] or 0
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    rows = rows.withColumn("doc_id", F.coalesce("id", F.lit(-(2**63)))).withColumn("th", F.xxhash64("t"))
    both = rows.join(broadcast_if(spans, size), ["doc_id", "th"], "left").select("id", "t", "spans")
    schema = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2).to_pylist()
            n, gone, runs, sha, kept = [], [], [], [], []
            for lo, hi, data, offs in text_slices(b.column(1)):
                start, end, at = word_bounds(data, offs) if unit == "word" else (None, None, offs)
                for j in range(hi - lo):
                    size = int(at[j + 1] - at[j])
                    keep = np.ones(size, bool)
                    if lists[lo + j]:
                        step = np.zeros(size + 1, np.int64)
                        span = np.frombuffer(b"".join(lists[lo + j]), np.int32).reshape(-1, 2)
                        np.add.at(step, span[:, 0], 1)
                        np.add.at(step, span[:, 1], -1)
                        keep = np.cumsum(step[:size]) == 0
                    if unit == "byte":
                        left = data[at[j] : at[j + 1]][keep].tobytes()
                    else:
                        raw, w = data.data if len(data) else b"", np.flatnonzero(keep) + at[j]
                        left = b" ".join([bytes(raw[s:e]) for s, e in zip(start[w].tolist(), end[w].tolist(), strict=True)])
                    n.append(size)
                    gone.append(int(size - keep.sum()))
                    runs.append(int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    kept.append(left)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_text, names[: len(cols) + keep_text])

    return both.mapInArrow(cut, schema)
