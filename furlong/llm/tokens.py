"""Token-ID output by bit-plane shuffling.

Blocks of ``block`` token ids are transposed into bit or byte planes, each plane is compressed with zstandard, and a
chunk index holds where each chunk of documents begins. A chunk is a self-contained binary value, so that the files
can lie in any store that Spark can write and be read by any number of tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .vec import expand
from .work import shared_dir

MAGIC = b"FPS1"
END_ID = 2


#: What the library's patterns may see as white space, a superset in RE2's notation.
BLANK = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
#: A letter before a mark or digit ends a match of either vocabulary's pattern.
MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
#: Marks a cut; a text that has it already goes to the library whole.
CUT = "\x00"


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece of them once.

    With ``keeps_space`` (byte-level vocabularies) a text is cut before each space or line end that a non-space follows,
    and between a letter and a mark: the vocabulary's pattern never matches across such a place, and white space before it
    is matched as it is at a text's end, so the ids of a text are those of its pieces in order. Without it (white space is dropped) texts are cut
    at white space. Arrow finds the distinct pieces of a batch; the new ones are encoded as one text, and the lengths of
    the ids' tokens tell whose they are. A text that holds an added token's content goes to the library whole; where the
    library looks for a content in normalized text, so does this class. The cache is emptied when it holds ``most``
    pieces (some 100 MB), as worker processes keep it into the stages that follow."""

    def __init__(self, path: str, keeps_space: bool, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.keeps_space, self.most = keeps_space, most
        added = self.lib.get_added_tokens_decoder().values()
        self.plain = [t.content for t in added if not t.normalized]
        self.normal = [t.content for t in added if t.normalized]
        suffix = getattr(self.lib.model, "end_of_word_suffix", None) or ""
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each id
        for token, i in vocab.items():
            self.width[i] = len(token.removesuffix(suffix))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.off, self.n = np.zeros(1 << 16, np.int64), 0
        self.cnt = np.zeros(1 << 16, np.int64)

    def add(self, ids: np.ndarray, count: np.ndarray) -> int:
        """Store the ids of ``len(count)`` pieces; the number of the first."""
        k, n, first = len(ids), len(count), self.n
        while self.used + k > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + n > len(self.off):
            self.off, self.cnt = (np.concatenate([a, np.zeros_like(a)]) for a in (self.off, self.cnt))
        self.flat[self.used : self.used + k] = ids
        self.off[first : first + n] = self.used + np.cumsum(count) - count
        self.cnt[first : first + n] = count
        self.used, self.n = self.used + k, first + n
        return first

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def special(self, texts: pa.Array) -> np.ndarray:
        """Rows that the library must see whole."""
        out = np.zeros(len(texts), bool)
        for c in [*self.plain, *[CUT] * self.keeps_space]:
            out |= pc.match_substring(texts, c).to_numpy(zero_copy_only=False)
        if self.normal:
            norm = self.lib.normalizer.normalize_str if self.lib.normalizer else str
            contents = [norm(c) for c in self.normal]
            out |= np.fromiter((any(c in t for c in contents) for t in map(norm, texts.to_pylist())), bool, len(texts))
        return out

    def pieces(self, texts: pa.Array) -> pa.ListArray:
        if not self.keeps_space:
            return pc.ascii_split_whitespace(pc.replace_substring_regex(texts, MARK, r"\1 \2"))
        strange = pc.match_substring_regex(texts, f" ([{BLANK}]|$)")
        cut = pc.replace_substring(texts, " ", CUT + " ")
        if pc.any(strange).as_py():  # some spaces are no places to cut
            cut = pc.if_else(strange, pc.replace_substring_regex(texts, f" ([^{BLANK}])", CUT + r" \1"), cut)
        cut = pc.replace_substring_regex(cut, f"\n([^{BLANK}\\x00])", CUT + "\n\\1")
        return pc.split_pattern(pc.replace_substring_regex(cut, MARK, r"\1" + CUT + r"\2"), CUT)

    def learn(self, new: pa.Array, names: list[str]) -> None:
        """Encode new pieces (the same as an Arrow array and as a list): those that stay apart as one text."""
        # a piece that does not begin with its cut would join the one before it
        apart = f"^[ \n][^{BLANK}]" if self.keeps_space else f"^[^{BLANK}]+$"
        apart = pc.match_substring_regex(new, apart).to_numpy(zero_copy_only=False)
        size = pc.binary_length(new).to_numpy().astype(np.int64)
        joined, one_by_one = np.flatnonzero(apart), np.flatnonzero(~apart).tolist()
        for lo in range(0, len(joined), 4000):
            at = joined[lo : lo + 4000]
            part = [names[k] for k in at]
            text = ("" if self.keeps_space else " ").join(part)
            (ids,) = self.encode([text])
            length = size[at]
            if self.lib.normalizer:
                normal = self.lib.normalizer.normalize_str(text).split(" ")
                length = np.fromiter((len(x.encode()) for x in normal), np.int64, len(normal))
            ids, end = np.array(ids, np.uint32), np.cumsum(length)
            stop = np.cumsum(self.width[ids])
            if len(length) != len(part) or not len(ids) or stop[-1] != end[-1]:
                one_by_one += at.tolist()
                continue
            first = self.add(ids, np.bincount(np.searchsorted(end, stop), minlength=len(part)))
            self.known.update(zip(part, range(first, first + len(part)), strict=True))
        for lo in range(0, len(one_by_one), 4000):
            part = [names[k] for k in one_by_one[lo : lo + 4000]]
            first = self.add_each(part)
            self.known.update(zip(part, range(first, first + len(part)), strict=True))

    def add_each(self, texts: list[str]) -> int:
        got = self.encode(texts)
        return self.add(np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))

    def __call__(self, texts: pa.Array | list[str | None], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a null is empty), each followed by ``end``, and each text's range in them."""
        if self.n > self.most:
            self.clear()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = np.flatnonzero(self.special(texts))
        if len(whole):
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            cut = self.pieces(pc.if_else(pa.array(mask), "", texts))
        else:
            cut = self.pieces(texts)
        offs = np.asarray(cut.offsets).astype(np.int64)
        found = cut.values.slice(offs[0], offs[-1] - offs[0]).dictionary_encode()
        names = found.dictionary.to_pylist()
        unit_of = np.fromiter((self.known.get(x, -1) for x in names), np.int64, len(names))
        new = np.flatnonzero(unit_of < 0)
        if len(new):
            fresh = [names[k] for k in new]
            self.learn(found.dictionary.take(pa.array(new)), fresh)
            unit_of[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        first = self.add_each(texts.take(pa.array(whole)).to_pylist()) if len(whole) else 0
        # each text: its pieces, or its one unit, then the end
        n = np.diff(offs)
        n[whole] = 1
        stop = np.cumsum(n + (end is not None))
        size = int(stop[-1]) if len(stop) else 0
        unit, middle = np.empty(size, np.int64), np.ones(size, bool)
        if end is not None:
            unit[stop - 1], middle[stop - 1] = self.add(np.array([end], np.uint32), np.ones(1, np.int64)), False
        if len(whole):
            last = stop[whole] - 1 - (end is not None)
            unit[last], middle[last] = first + np.arange(len(whole)), False
            keep = np.ones(int(offs[-1] - offs[0]), bool)
            keep[expand(offs[whole] - offs[0], np.diff(offs)[whole])] = False
            unit[middle] = unit_of[np.asarray(found.indices)[keep]]
        else:
            unit[middle] = unit_of[np.asarray(found.indices)]
        count = self.cnt[unit]
        ends = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(self.off[unit] - ends[:-1], count)
        place += np.arange(len(place))
        ids = self.flat[place]
        return ids, ends[np.concatenate([[0], stop])]

    def long(self, text: str, end: int | None, most: int) -> np.ndarray:
        """Ids of one long text, which is cut where pieces begin, so that only ``most`` characters are in work at once."""
        import re

        if self.special(pa.array([text]))[0]:
            return self([text], end)[0]
        place, parts, lo = re.compile(r" (?=[^\s\x1c-\x1f\x85])"), [], 0
        while lo < len(text):
            found = place.search(text, lo + most)
            hi = found.start() if found else len(text)
            parts.append(self([text[lo:hi]], None)[0])
            lo = hi
        return np.concatenate([*parts, np.array([] if end is None else [end], np.uint32)])


@lru_cache(maxsize=1)
def encoder(path: str, keeps_space: bool) -> Encoder:
    """The worker process' encoder: its cache serves all tasks that the process runs."""
    return Encoder(path, keeps_space)


def encoded(coder: Encoder, col: pa.Array, end: int, most: int = 8 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, ranges) for slices of a column of about ``most`` bytes; a longer text is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(col) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(col):
        before = int(size[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + most, "right")))
        if hi == lo + 1 and int(size[lo]) - before > most:
            ids = coder.long(col[lo].as_py(), end, most)
            yield lo, ids, np.array([0, len(ids)])
        else:
            yield lo, *coder(col.slice(lo, hi - lo), end)
        pa.default_memory_pool().release_unused()  # the worker process lives on into other stages
        lo = hi


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def pack_planes(ids: np.ndarray, block: int, bits: bool, level: int = 3) -> bytes:
    """One chunk: a header, then for each block and plane its size and zstandard frame. Planes that are all zero in
    every block are left out of the header's count, low planes first."""
    top = int(ids.max()) if len(ids) else 0
    planes = max(1, top.bit_length() if bits else -(-top.bit_length() // 8))
    press = zstandard.ZstdCompressor(level=level)
    out = [MAGIC, struct.pack("<BBIQ", bits, planes, block, len(ids))]
    for lo in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[lo : lo + block], "<u4")
        for p in range(planes):
            if bits:
                plane = np.packbits((part >> np.uint32(p)).astype(np.uint8) & 1, bitorder="little")
            else:
                plane = part.view(np.uint8)[p::4]
            frame = press.compress(plane.tobytes())
            out += [struct.pack("<I", len(frame)), frame]
    return b"".join(out)


def unpack_planes(chunk: bytes) -> np.ndarray:
    """The ids of a chunk made by ``pack_planes``."""
    if chunk[:4] != MAGIC:
        raise ValueError("not a plane-shuffled chunk")
    bits, planes, block, n = struct.unpack_from("<BBIQ", chunk, 4)
    at, ids, expandz = 18, np.zeros(n, np.uint32), zstandard.ZstdDecompressor()
    for lo in range(0, n, block):
        m = min(block, n - lo)
        for p in range(planes):
            (size,) = struct.unpack_from("<I", chunk, at)
            plane = np.frombuffer(expandz.decompress(chunk[at + 4 : at + 4 + size]), np.uint8)
            at += 4 + size
            one = np.unpackbits(plane, count=m, bitorder="little") if bits else plane
            ids[lo : lo + m] |= one.astype(np.uint32) << np.uint32(p if bits else 8 * p)
    return ids


CHUNKS = "pid int, chunk int, n_ids long, doc_ids array<long>, n_tokens array<int>, payload binary"


def write_token_planes(
    docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", keeps_space: bool = True,
    end: int = END_ID, block: int = 16_384, chunk_ids: int = 262_144, bits: bool = False, partitions: int | None = None,
) -> None:
    """Encode every text and write its ids in ascending ``id_col`` order below ``path``.

    A null text is empty and has the end id alone; a null id comes first, and rows that repeat an id follow each other
    in the order of a hash of their texts. An empty table gives an empty folder with a schema. Other columns are ignored.
    ``path/chunks`` has the chunks, ``path/index`` for each the global number of its first id, its ids and bytes.
    A chunk ends at the first document that fills ``chunk_ids`` ids and holds blocks of ``block`` ids."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pid, chunk = encoder(tokenizer, keeps_space), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        held_docs: list = []
        sizes: list[int] = []
        total = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [[pid], [chunk], [len(ids)], [list(held_docs)], [list(sizes)], [pack_planes(ids, block, bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["pid", "chunk", "n_ids", "doc_ids", "n_tokens", "payload"])

        for b in batches:
            keys = b.column(0).to_pylist()
            for lo, ids, at in encoded(coder, b.column(1), end):
                for j in range(len(at) - 1):
                    held.append(ids[at[j] : at[j + 1]])
                    held_docs.append(keys[lo + j])
                    sizes.append(int(at[j + 1] - at[j]))
                    total += sizes[-1]
                    if total >= chunk_ids:
                        yield flush()
                        held.clear(), held_docs.clear(), sizes.clear()
                        total, chunk = 0, chunk + 1
        if held:
            yield flush()

    ordered = rows.repartitionByRange(n, "i").sortWithinPartitions("i", F.xxhash64("t"))
    ordered.mapInArrow(encode, CHUNKS).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    sums = chunks.groupBy("pid").agg(F.sum("n_ids").alias("n"))
    # one row for each partition of the sort, not for each document
    before = sums.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("pid").orderBy("chunk")) - F.col("n_ids")
    index = chunks.select("pid", "chunk", "n_ids", F.octet_length("payload").alias("n_bytes")).withColumn("inside", inside)
    index.join(before, "pid").select("pid", "chunk", (F.col("base") + F.col("inside")).alias("first_id"), "n_ids", "n_bytes").write.parquet(f"{path}/index")


def read_token_planes(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Documents of a folder made by ``write_token_planes``: doc_id, start (number of the first id), n_tokens, ids_crc32
    (of the ids as little-endian 32-bit integers), and the ids themselves if asked for. All from the decoded planes."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    index = spark.read.schema("pid int, chunk int, first_id long, n_ids long, n_bytes long").parquet(f"{path}/index")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = unpack_planes(r["payload"])
                ends = np.cumsum(r["n_tokens"])
                cols = [
                    pa.array(r["doc_ids"], pa.int64()), pa.array(r["first_id"] + ends - r["n_tokens"], pa.int64()), pa.array(r["n_tokens"], pa.int64()),
                    pa.array([crc32(x) for x in np.split(ids, ends[:-1])], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([x.tolist() for x in np.split(ids, ends[:-1])], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return chunks.join(index.select("pid", "chunk", "first_id"), ["pid", "chunk"]).select("first_id", "doc_ids", "n_tokens", "payload").mapInArrow(decode, schema)


def token_planes(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to a fresh folder in the shared place and read it back."""
    path = shared_dir(docs.sparkSession)
    write_token_planes(docs, path, tokenizer, **options)
    return read_token_planes(docs.sparkSession, path)
