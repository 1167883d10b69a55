"""Near-duplicate groups by b-bit MinHash, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .vec import blobs, mix, shingle_sets, signed, text_slices, word_hashes
from .work import broadcast_if, materialize

#: Fixed shape: BANDS keys of ROWS minima each, so a pair of similarity 0.85 shares no key with probability
#: (1 - 0.85**4)**24 = 2e-8, of 0.8 with 4e-6; and BITS low bits of each of the BANDS * ROWS minima.
BANDS, ROWS, BITS = 24, 4, 2
N = BANDS * ROWS
#: A pair of similarity 0.75 shares no key with probability (1 - 0.75**4)**24 = 1e-4; lower thresholds are refused.
LEAST_THRESHOLD = 0.75
#: A pair's estimate has a standard error of at most 0.07 (0.043 at 0.85); pairs this far below the threshold go.
SLACK = 0.25

_random = np.random.default_rng(9)
FACTOR = _random.integers(1, 2**63, N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _random.integers(1, 2**63, N, dtype=np.uint64)


def identity(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets that are not empty, and two mixed sums of each set (zeros of an empty one): with its size, its identity."""
    full = np.flatnonzero(at[:-1] < at[1:])
    sums = np.zeros((2, len(at) - 1), np.uint64)
    if len(full):
        sums[:, full] = [np.add.reduceat(mix(h, s), at[:-1][full]) for s in (21, 22)]
    return full, sums


def sketch(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sets' identities, and of each that is not empty: band keys, and the packed low bits of its minima."""
    full, sums = identity(h, at)
    start = at[:-1][full]
    low = np.empty((len(full), N), np.uint64)
    for j in range(N):
        low[:, j] = np.minimum.reduceat(h * FACTOR[j] + SHIFT[j], start)
    key = np.zeros((len(full), BANDS), np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(31) + low[:, r::ROWS], 23)
    key = mix(key + np.arange(BANDS, dtype=np.uint64), 24)
    bit = (mix(low, 25) & np.uint64(3)).astype(np.uint8)
    packed = bit[:, 0::4] | bit[:, 1::4] << 2 | bit[:, 2::4] << 4 | bit[:, 3::4] << 6
    return sums, key, packed


#: Equal 2-bit values in a byte, by the exclusive or of two packed bytes.
EQUAL = np.array([sum((x >> s) & 3 == 0 for s in (0, 2, 4, 6)) for x in range(256)], np.uint8)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, corrected for the values that agree by chance (1 of 2**BITS)."""
    share = EQUAL[a ^ b].sum(axis=-1) / N
    return (share - 0.5**BITS) / (1 - 0.5**BITS)


def values(sig: np.ndarray) -> np.ndarray:
    """The N values of each packed signature."""
    return ((sig[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(len(sig), -1)


def votes(sig: np.ndarray) -> np.ndarray:
    """How many signatures have each value, for each position."""
    v = values(sig)
    return np.stack([(v == x).sum(axis=0) for x in range(4)])


def consensus(count: np.ndarray) -> np.ndarray:
    """The packed signature of each position's most frequent value: near copies have their common origin there."""
    v = count.argmax(axis=0).astype(np.uint8)
    return v[0::4] | v[1::4] << 2 | v[2::4] << 4 | v[3::4] << 6


def centre(sig: np.ndarray) -> int:
    """The signature that agrees most with all of a bucket."""
    count, v = votes(sig), values(sig)
    return int(count[v, np.arange(v.shape[1])].sum(axis=1).argmax())


#: Classes of one tile's side, of whole sets and of signatures. A bucket of more than BLOCK classes is dealt out.
TILE, BLOCK = 256, 2048


def linking(rest: np.ndarray, rest_ids: np.ndarray, every: np.ndarray, ids: np.ndarray, label: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``rest`` and ``every`` whose estimates reach ``floor``, enough of them to join all labels that any do;
    ``label`` (of ``every``) names what is joined already, and a member of ``rest`` has its id as label."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    label = np.concatenate([label, rest_ids])
    for r in range(len(rest)):
        hit = np.flatnonzero(estimate(every, rest[r]) >= floor)
        own = label[len(ids) + r]
        names, at = np.unique(label[hit], return_index=True)
        other = names != own
        a.append(np.full(other.sum(), rest_ids[r]))
        b.append(ids[hit[at[other]]])
        label[np.isin(label, names[other])] = own
    return np.concatenate(a), np.concatenate(b)


def spanning(own: np.ndarray, ids: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that span the graph of a bucket's members whose estimates reach ``floor``: the centre's star first, then
    each member that it leaves out is compared with all others."""
    c = centre(own)
    near = estimate(own, own[c]) >= floor
    near[c] = True
    a, b = linking(own[~near], ids[~near], own, ids, np.where(near, ids[c], ids), floor)
    star = ids[near & (np.arange(len(ids)) != c)]
    return np.concatenate([np.full(len(star), ids[c]), a]), np.concatenate([star, b])


def signatures(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), N * BITS // 8)


def dealt_pairs(rows: DataFrame, floor: float, block: int) -> DataFrame:
    """What ``spanning`` gives, (a, b), for buckets of any size: ``rows`` (key, rep, sig) are never gathered by key.

    Tasks count votes over what they hold, and the sums give each key's consensus; the member next to it is the centre,
    found in the same two steps. Each row is then compared with its key's centre alone. What no centre takes is compared
    with all rows of its key, in tiles of about ``block`` rows a side."""

    def by_key(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        key = b.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            yield int(key[own[0]]), own

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = signatures(b.column("sig"))
                out = [(key, votes(sig[own]).ravel().tolist()) for key, own in by_key(b)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["key", "votes"])

    def total(t: pa.Table) -> pa.Table:
        sums = sum(np.array(v, np.int64) for v in t.column("votes").to_pylist())
        return pa.table({"key": t.column("key").slice(0, 1), "middle": pa.array([consensus(sums.reshape(4, N)).tobytes()], pa.binary())})

    middles = materialize(rows.mapInArrow(count, "key long, votes array<long>").groupBy("key").applyInArrow(total, "key long, middle binary"))
    n = middles.count()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = EQUAL[signatures(b.column("sig")) ^ signatures(b.column("middle"))].sum(axis=1).astype(np.int64)
                best = pa.array([int(own[score[own].argmax()]) for _, own in by_key(b)])
                yield pa.RecordBatch.from_arrays([b.column("key").take(best), pa.array(score).take(best), b.column("rep").take(best), b.column("sig").take(best)], ["key", "score", "rep", "sig"])

    best = rows.join(broadcast_if(middles, 64 * n), "key").select("key", "rep", "sig", "middle").mapInArrow(nearest, "key long, score long, rep long, sig binary")
    hubs = materialize(best.groupBy("key").agg(F.max(F.struct("score", "rep", "sig")).alias("h")).select("key", F.col("h.rep").alias("hub"), F.col("h.sig").alias("hub_sig")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = estimate(signatures(b.column("sig")), signatures(b.column("hub_sig"))) >= floor
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "rep", "sig", "hub")), pa.array(ok)], ["key", "rep", "sig", "hub", "near"])

    told = rows.join(broadcast_if(hubs, 64 * n), "key").select("key", "rep", "sig", "hub", "hub_sig")
    told = materialize(told.mapInArrow(near, "key long, rep long, sig binary, hub long, near boolean"))
    star = told.filter("near and hub <> rep").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    sizes = materialize(told.groupBy("key").agg(F.count("*").alias("size"), F.count(F.when(~F.col("near"), 1)).alias("rest_n")).filter("rest_n > 0"))
    m = sizes.count()
    if not m:
        return star
    chunks = lambda c: F.ceil(F.col(c) / block).cast("long")
    data = told.join(broadcast_if(sizes, 48 * m), "key").withColumn("label", F.when(F.col("near"), F.col("hub")).otherwise(F.col("rep")))
    spread = lambda c: F.pmod(F.xxhash64("rep"), chunks(c))
    rest = data.filter("not near").withColumn("i", spread("rest_n")).withColumn("j", F.explode(F.sequence(F.lit(0), chunks("size") - 1)))
    every = data.withColumn("j", spread("size")).withColumn("i", F.explode(F.sequence(F.lit(0), chunks("rest_n") - 1)))
    cols = ["key", "i", "j", "rep", "label", "sig"]
    tiles = rest.select(*cols, F.lit(True).alias("is_rest")).unionByName(every.select(*cols, F.lit(False).alias("is_rest")))

    def compare(tile: pa.Table) -> pa.Table:
        side = np.array(tile.column("is_rest").to_pylist(), bool)
        sig, ids, label = signatures(tile.column("sig")), tile.column("rep").to_numpy(), tile.column("label").to_numpy()
        a, b = linking(sig[side], ids[side], sig[~side], ids[~side], label[~side], floor)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return star.unionByName(tiles.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"))


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Whole groups of rows with equal ``key`` (rows come sorted by it), many at a time, as numpy columns."""
    held: list[np.ndarray] | None = None

    def column(b: pa.RecordBatch, c: str) -> np.ndarray:
        x = b.column(c)
        if pa.types.is_binary(x.type):
            return signatures(x)
        return x.to_numpy(zero_copy_only=False)

    for b in batches:
        if not b.num_rows:
            continue
        cols = [column(b, c) for c in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        held = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols]
    if held is not None:
        yield held


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def tile_links(rest: list, every: list, threshold: float) -> tuple[list[int], list[int]]:
    """Links between two lists of (id, label, set) that join different labels, enough of them to join all that any do.

    Shingles that stand in one set only cannot be shared; the others span a matrix whose product counts all
    intersections at once."""
    rows = [*rest, *every]
    sizes = np.array([len(r[2]) for r in rows])
    flat = np.concatenate([r[2] for r in rows])
    names, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    column = (np.cumsum(count > 1) - 1)[place]
    owner = np.repeat(np.arange(len(rows)), sizes)
    width, step = int((count > 1).sum()), 4096
    inter = np.zeros((len(rest), len(every)), np.float32)
    for lo in range(0, width, step):
        part = shared & (column >= lo) & (column < lo + step)
        m = np.zeros((len(rows), min(step, width - lo)), np.float32)
        m[owner[part], column[part] - lo] = 1
        inter += m[: len(rest)] @ m[len(rest) :].T
    union = sizes[: len(rest), None] + sizes[None, len(rest) :] - inter
    label = np.array([r[1] for r in rows])
    x, y = np.nonzero(inter >= threshold * union - 1e-6)
    a, b = [], []
    for i, j in zip(x, y + len(rest), strict=True):
        if label[i] != label[j]:
            a.append(rows[i][0])
            b.append(rows[j][0])
            label[label == label[j]] = label[i]
    return a, b


def near_duplicates(
    docs: DataFrame, *, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents linked by a similarity of at least ``threshold``.

    A document's set has its distinct k-word shingles (A-Z in lower case; of fewer words, the whole sequence). Documents
    without words are linked with nothing. component_id is the smallest id that links reach, where a null id gives a null
    id and counts as smaller than all others; kept holds for one row of each group, the first of that id. Rows are told
    apart by ``row_col``, a column of distinct numbers that the result then has too; without it by numbers of their own.
    Rows that repeat an id stand in the order of their texts' hashes, then of those numbers. An empty table gives no rows;
    other columns are ignored.

    Documents with equal sets become one class, a node numbered in the order of the classes' first rows. Classes that share a band key are
    candidates if their packed signatures' estimate comes within SLACK of the threshold. Each bucket gives pairs that
    span its candidates, from its centre where it can, so a large group of near copies costs one pair a member; buckets of
    more than ``block`` classes are spread over the tasks. These are
    confirmed on the whole sets. A family (what candidates connect) whose links leave several components is compared
    again, all members outside its largest component with all its members, in tiles of at most about TILE classes a
    side, so that no link between components is lost and no pair becomes a row."""
    if not LEAST_THRESHOLD <= threshold <= 1:
        raise ValueError(f"the bands find pairs of a similarity of {LEAST_THRESHOLD} or more, not of {threshold}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), *([F.col(row_col).cast("long").alias("row")] if row_col else [])
    ).withColumn("th", F.xxhash64("t"))
    given = ["row"] if row_col else []

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in text_slices(b.column("t")):
                h, at = shingle_sets(*word_hashes(data, offs, lower=True), k)
                n = np.diff(at)
                s, key, sig = sketch(h, at)
                at_band = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                at_sig = np.concatenate([[0], np.cumsum(n > 0)])
                bands = pa.ListArray.from_arrays(pa.array(at_band), pa.array(signed(key.ravel())))
                cols = [b.column(c).slice(lo, hi - lo) for c in ["doc_id", "th", *given]]
                cols += [pa.array(n), pa.array(signed(s[0])), pa.array(signed(s[1])), bands, blobs(sig, at_sig)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", *given, "n", "s1", "s2", "bands", "sig"])

    sk = rows.select("doc_id", "th", *given, "t").mapInArrow(sketches, f"doc_id long, th long,{' row long,' * len(given)} n long, s1 long, s2 long, bands array<long>, sig binary")
    # numbers of rows and nodes are fixed by being written
    sk = materialize(sk if given else sk.withColumn("row", F.monotonically_increasing_id()))
    first_row = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th", "row")
    classes = sk.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min_by(F.struct(first_row.alias("first"), "bands", "sig"), first_row).alias("r"))
    classes = classes.select("n", "s1", "s2", "r.first", "r.bands", "r.sig").repartitionByRange(parts, "first").sortWithinPartitions("first")
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()))
    floor = max(0.0, threshold - SLACK)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rep, sig in _groups(batches, ["key", "rep", "sig"]):
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            two = first[size == 2]
            ok = estimate(sig[two], sig[two + 1]) >= floor
            if ok.any():
                yield _edges(rep[two][ok], rep[two + 1][ok])
            for f, s in zip(first[size > 2], size[size > 2], strict=True):
                a, b = spanning(sig[f : f + s], rep[f : f + s], floor)
                if len(a):
                    yield _edges(a, b)

    # small buckets go to one task whole; large ones, which are few, are dealt out
    large = materialize(classes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > block).select("key"))
    n_large = large.count()
    held = classes.select(F.explode("bands").alias("key"), "rep", "sig")
    buckets = held.join(broadcast_if(large, 16 * n_large), "key", "left_anti") if n_large else held
    found = buckets.repartition(parts, "key").sortWithinPartitions("key", "rep").mapInArrow(stars, "a long, b long")
    if n_large:
        found = found.unionByName(dealt_pairs(materialize(held.join(broadcast_if(large, 16 * n_large), "key", "left_semi")), floor, block))
    pairs = materialize(found.distinct())

    def sets_of(pairs: DataFrame, n: int) -> DataFrame:
        """The sets of the nodes of ``pairs``, from the rows that have their first rows' ids and texts' hashes; which node
        a row's set belongs to is then found by its identity."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        wanted = materialize(classes.join(broadcast_if(ids, 32 * n), "rep", "left_semi").select("n", "s1", "s2", "rep", F.col("first.doc_id").alias("i"), F.col("first.th").alias("h")))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, _, data, offs in text_slices(b.column(0)):
                    h, at = shingle_sets(*word_hashes(data, offs, lower=True), k)
                    _, s = identity(h, at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.diff(at)), pa.array(signed(s[0])), pa.array(signed(s[1])), blobs(h, at)], ["n", "s1", "s2", "shingles"])

        some = rows.join(broadcast_if(wanted.select("i", "h"), 64 * n), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left_semi")
        found = some.select("t").mapInArrow(sets, "n long, s1 long, s2 long, shingles binary")
        named = found.join(broadcast_if(wanted.select("n", "s1", "s2", "rep"), 96 * n), ["n", "s1", "s2"])
        return materialize(named.select(F.col("rep").alias("doc_id"), "shingles").dropDuplicates(["doc_id"]))

    own = sets_of(pairs, pairs.count())

    def confirmed(pairs: DataFrame) -> DataFrame:
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(shared >= threshold * (len(p) + len(q) - shared) - 1e-9)
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

        a = own.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
        b = own.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")

    links = materialize(confirmed(pairs))
    component = materialize(connected_components(links))

    # families: all classes that estimates connect; those whose links leave several components are looked at again
    family = connected_components(pairs).select("node", F.col("component").alias("family"))
    labels = family.join(component, "node", "left").select("node", "family", F.coalesce("component", "node").alias("label"))
    count = labels.groupBy("family", "label").agg(F.count("*").alias("n"))
    open_ = count.groupBy("family").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label"))["label"].alias("main"), F.max("n").alias("most")).filter("most < size")
    todo = materialize(labels.join(open_, "family"))
    if todo.limit(1).count():
        chunks = lambda n: F.ceil(n / TILE).cast("long")
        spread = lambda n: F.pmod(F.xxhash64("node"), chunks(n))
        data = todo.join(own, todo.node == own.doc_id)
        rest_n = F.col("size") - F.col("most")
        rest = data.filter("label <> main").withColumn("i", spread(rest_n)).withColumn("j", F.explode(F.sequence(F.lit(0), chunks(F.col("size")) - 1)))
        every = data.withColumn("j", spread(F.col("size"))).withColumn("i", F.explode(F.sequence(F.lit(0), chunks(rest_n) - 1)))
        cols = ["family", "i", "j", "node", "label", "shingles"]
        tiles = rest.select(*cols, F.lit(True).alias("is_rest")).unionByName(every.select(*cols, F.lit(False).alias("is_rest")))

        def compare(tile: pa.Table) -> pa.Table:
            side: tuple[list, list] = [], []
            for node, label, x, is_rest in zip(*(tile.column(c).to_pylist() for c in ("node", "label", "shingles", "is_rest")), strict=True):
                side[is_rest].append((node, label, np.frombuffer(x, np.uint64)))
            a, b = tile_links(side[1], side[0], threshold) if side[0] and side[1] else ([], [])
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        more = tiles.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")
        component = materialize(connected_components(links.unionByName(materialize(more))))

    # each class of several with its component's first row; the others are their own
    head = classes.select(F.col("rep").alias("component"), F.col("first").alias("head"))
    named = component.join(head, "component").select("node", "head")
    labelled = classes.select("n", "s1", "s2", "rep", "first").join(named, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("head", "first").alias("head"))
    out = sk.select("doc_id", "row", "n", "s1", "s2").join(labelled, ["n", "s1", "s2"], "left")
    linked = F.col("head").isNotNull()
    label = F.when(linked, F.col("head.doc_id")).otherwise(F.col("doc_id"))
    kept = F.when(linked, F.col("head.row") == F.col("row")).otherwise(True)
    return out.select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"), kept.alias("kept"), *([F.col("row").alias(row_col)] if row_col else []))
