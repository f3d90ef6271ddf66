"""Token ids in binary files: blocks of ids transposed into planes, each plane compressed by zstandard.

A shard is one file of whole documents in ascending order of their ids.  It holds, one after another, the compressed
planes of its blocks of BLOCK ids, the documents' ids and lengths, the index of the blocks (where each begins, how many
ids it has and the size of each of its planes) and a footer of fixed size with the places of these parts.  A byte plane
has one byte of every id of a block, a bit plane one bit; a block has only as many planes as its largest id needs.
Documents may cross blocks, never shards, so a reader gets at any of them through the index alone.

Spark writes the files: documents are dealt by ranges of their ids and sorted, a task packs its range into shards, and
each shard is one row of a text sink (its bytes and a final line break), so the write is committed like any other
and survives lost executors and repeated tasks on every file system that Spark knows.  The number of ids of a shard
stands in the name of its folder, so the place of each shard in the whole sequence comes from a listing.

Order: by id (null first); rows with equal ids by the hash of their text, then by text.  Equal rows are
interchangeable.  A null text is read as empty: only the end id is written.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.arrow import picked, slices
from weftgraph.sources.store import shared_folder

BLOCK = 1 << 16  # ids that are transposed together
SHARD_IDS = 1 << 22  # a shard closes with the document that brings it to so many ids
CACHE_PIECES = 600_000  # pieces whose ids a Python worker keeps, about 110 MB
PIECE = 1 << 16  # characters of a text with unusual spacing that the library gets at once
SLICE = 6_000_000  # bytes of texts that are encoded together
LEVEL = 3
MAGIC = b"WGTP"
HEAD = struct.Struct("<4sBBHI")  # magic, version, bits of a plane's elements (1 or 8), unused, ids of a block
FOOT = struct.Struct("<QQQQQQ4s")  # place and size of the documents, place of the index, documents, ids, blocks, magic
CUT = re.compile(r"(?<=\S) (?=\S)")
CUTS = "\0"  # marks a cut; a text that has it is not cut
STOPS = "([A-Za-z0-9À-ÖØ-öø-ÿ])([.,;:!?)]+)(\\x00|$)"


# Blocks.


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block of ids, lowest first; bits of an element are 1 or 8."""
    if not len(ids):
        return []
    need = int(ids.max()).bit_length()
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [cells[:, k].tobytes() for k in range(-(-need // 8))]
    flags = np.unpackbits(cells, axis=1, count=need, bitorder="little") if need else np.empty((len(ids), 0), np.uint8)
    return [np.packbits(flags[:, k], bitorder="little").tobytes() for k in range(need)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    cells = np.zeros((n, 4), np.uint8)
    if bits == 8:
        for k, plane in enumerate(planes):
            cells[:, k] = np.frombuffer(plane, np.uint8, n)
    elif planes:
        flags = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        packed = np.packbits(flags, axis=1, bitorder="little")
        cells[:, : packed.shape[1]] = packed
    return cells.view("<u4").reshape(-1)


# Shards.


class ShardWriter:
    """Packs documents into one shard; ids are compressed as soon as a block is full."""

    def __init__(self, bits: int) -> None:
        self.bits, self.pack = bits, zstandard.ZstdCompressor(level=LEVEL).compress
        self.out, self.index, self.rest, self.waiting, self.n_ids = bytearray(HEAD.pack(MAGIC, 1, bits, 0, BLOCK)), bytearray(), [], 0, 0
        self.docs: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents one after another: their ids, which of these are null, their numbers of tokens and all their tokens."""
        self.docs.append(np.stack([doc_ids, missing, lengths]).astype("<i8"))
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            whole = np.concatenate(self.rest)
            full = len(whole) // BLOCK * BLOCK
            for at in range(0, full, BLOCK):
                self._block(whole[at : at + BLOCK])
            self.rest, self.waiting = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.pack(p) for p in to_planes(ids, self.bits)]
        self.index += struct.pack(f"<QIB{len(planes)}I", len(self.out), len(ids), len(planes), *map(len, planes))
        for p in planes:
            self.out += p

    def close(self) -> bytes:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        docs = np.concatenate([np.empty((3, 0), "<i8"), *self.docs], axis=1)
        packed, at = self.pack(docs.tobytes()), len(self.out)
        blocks = -(-self.n_ids // BLOCK)
        self.out += packed
        self.out += self.index
        self.out += FOOT.pack(at, len(packed), at + len(packed), docs.shape[1], self.n_ids, blocks, MAGIC)
        return bytes(self.out)


class Shard:
    """A shard's bytes, as written or with the line break that the text sink adds; blocks are unpacked when they are asked for."""

    def __init__(self, content: bytes) -> None:
        end = len(content) - content.endswith(b"\n") - FOOT.size
        magic, version, self.bits, _, self.block = HEAD.unpack_from(content)
        at, size, index, self.n_docs, self.n_ids, blocks, tail = FOOT.unpack_from(content, max(end, 0))
        if (magic, version, tail) != (MAGIC, 1, MAGIC):
            raise ValueError("not a shard of token ids")
        self.content, self.unpack = content, zstandard.ZstdDecompressor().decompress
        self.doc_ids, self.missing, self.lengths = np.frombuffer(self.unpack(content[at : at + size]) if self.n_docs else b"", "<i8").reshape(3, self.n_docs)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.index: list[tuple[int, int, tuple[int, ...]]] = []
        for _ in range(blocks):
            place, n, planes = struct.unpack_from("<QIB", content, index)
            self.index.append((place, n, struct.unpack_from(f"<{planes}I", content, index + 13)))
            index += 13 + 4 * planes
        self._held: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def _ids_of(self, block: int) -> np.ndarray:
        if self._held[0] != block:
            at, n, sizes = self.index[block]
            planes = []
            for s in sizes:
                planes.append(self.unpack(self.content[at : at + s]))
                at += s
            self._held = block, from_planes(planes, n, self.bits)
        return self._held[1]

    def parts(self, k: int) -> Iterator[np.ndarray]:
        """The ids of the k-th document, a part for each block that it lies in."""
        at, end = int(self.starts[k]), int(self.starts[k] + self.lengths[k])
        while at < end:
            block, within = divmod(at, self.block)
            ids = self._ids_of(block)[within : within + end - at]
            yield ids
            at += len(ids)


# Encoding by the tokenizers library.


class LibraryEncoder:
    """Whole texts by the tokenizers library (byte-level BPE), each distinct piece once.

    Byte-level BPE splits a text before every single space and around every single line break between two characters that are
    not white space, and between a letter or digit and the stops behind it; what lies between such places is encoded the
    same in any text.  Arrow cuts texts there and tells the pieces apart, so only new pieces go to the library, many in
    one text: pieces behind a space one after another, where a token that begins with a space begins the next piece, others
    on lines of their own.  Texts with any other spacing go to the library as they are, cut at such places only where they
    are very long.
    """

    def __init__(self, source: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.spaced[i] = token.startswith("Ġ")
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0, "\n": 1}
        self.values, self.sizes = np.array([self.line], np.uint32), np.array([0, 1])

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """The ids of new pieces without white space but for one space in front."""
        behind = [x for x in pieces if x[0] == " "]
        alone = [x for x in pieces if x[0] != " "]
        values, sizes = [self.values], [self.sizes]
        for some, between in ((behind, ""), (alone, "\n")):
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                texts = [between.join(part[k : k + 256]) + between for k in range(0, len(part), 256)]
                ids = np.concatenate(self._library(texts))
                if between:
                    ends = np.flatnonzero(ids == self.line) - np.arange(len(part))
                    ids = ids[ids != self.line]
                    count = np.diff(ends, prepend=0)
                else:
                    count = np.diff(np.flatnonzero(self.spaced[ids]), append=len(ids))
                if len(count) != len(part):
                    raise ValueError("a piece that is not encoded by itself: the vocabulary is not byte-level BPE")
                values.append(ids)
                sizes.append(count)
        n = len(self.sizes)
        self.known.update(zip(behind + alone, range(n, n + len(pieces)), strict=True))
        self.values, self.sizes = np.concatenate(values), np.concatenate(sizes)

    def _whole(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while len(text) - at > PIECE and (m := CUT.search(text, at + PIECE)):
            parts.append(text[at : m.start()])
            at = m.start()
        return np.concatenate([x for k in range(0, len(parts) + 1, 64) for x in self._library([*parts, text[at:]][k : k + 64])])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.sizes) > CACHE_PIECES:
            self.forget()
        n = len(texts)
        if not n:
            return []
        texts = texts.cast(pa.large_string()).fill_null("")
        cut = pc.replace_substring(pc.replace_substring(texts, " ", CUTS + " "), "\n", CUTS + "\n" + CUTS)
        split = pc.split_pattern(pc.replace_substring_regex(cut, STOPS, "\\1" + CUTS + "\\2\\3"), CUTS)
        pieces, count = split.flatten(), split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded, ends = pieces.dictionary_encode(), np.cumsum(count)
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(place < 0)
        other = np.zeros(len(distinct), bool)  # pieces with other white space than one space in front
        new = []
        for k in unknown.tolist():
            x = distinct[k]
            if x[-1].isspace() or x[x[0] == " "].isspace():
                other[k] = True
            else:
                new.append(x)
        place[unknown[~other[unknown]]] = self._placed(new)
        place[other] = 0
        # Texts that are cut at another place than the ones named: they have such a piece, or nothing between two cuts.
        bad = other[which] | (place[which] == 0)
        bad[ends - 1] &= other[which[ends - 1]]
        bad[ends - count] &= other[which[ends - count]]
        odd = np.bitwise_or.reduceat(bad, ends - count) | pc.match_substring(texts, CUTS).to_numpy(zero_copy_only=False)
        place, sizes = place[which], self.sizes
        total = np.r_[0, np.cumsum(sizes[place])][np.r_[ends - count, ends[-1]]]
        known = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(sizes)], self.values)
        values = known.take(pa.array(place)).flatten().to_numpy()
        return [self._whole(texts[k].as_py()) if odd[k] else values[total[k] : total[k + 1]] for k in range(n)]

    def _placed(self, new: list[str]) -> list[int]:
        self._learn(new)
        return [self.known[x] for x in new]


_ENCODER: dict[int, LibraryEncoder] = {}


def _encoder(source) -> LibraryEncoder:
    """A worker's encoder; the words that it knows stay between its tasks."""
    key = source.id if hasattr(source, "id") else hash(source.value)
    if key not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[key] = LibraryEncoder(source.value)
    return _ENCODER[key]


# Writing and reading.

WRITTEN = "part int, shard int, n_ids long, content binary"


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", bits: int = 8, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every text of docs and end_id after each into a new folder of shards.

    path: a byte-level BPE tokenizer file (about 2 MB, broadcast).  docs: an integer id and a string; other columns are
    not read.  A task holds one shard: shard_ids ids and those of its last document.
    """
    source = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, shard, writer = _encoder(source), TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            row = [[part], [shard], [writer.n_ids], [writer.close()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "shard", "n_ids", "content"])

        for batch in (x for whole in batches for x in slices(whole, SLICE)):
            keys = batch.column(0)
            doc_ids, missing = keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False)
            for k, ids in enumerate(coder.encode(batch.column(1))):
                writer = writer or ShardWriter(bits)
                writer.add(doc_ids[k : k + 1], missing[k : k + 1], np.array([len(ids) + 1]), np.append(ids, np.uint32(end_id)))
                if writer.n_ids >= shard_ids:
                    yield closed()
                    writer, shard = None, shard + 1
        if writer:
            yield closed()

    spark = docs.sparkSession
    rows = picked(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    order = (F.asc_nulls_first("id"), F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    files = dealt.mapInArrow(run, WRITTEN).withColumn("content", F.col("content").cast("string"))  # the same bytes
    files.write.partitionBy("part", "shard", "n_ids").option("compression", "none").option("lineSep", "\n").text(folder)


def _shards(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(part, shard, content) and (part, shard, base): each shard's bytes, and the ids in all shards before it; None without files.

    base comes from the folders' names: sums of parts first (one row for each task that wrote), then within each part.
    """
    files = spark.read.format("binaryFile").load(folder)
    if "n_ids" not in files.columns:
        return None
    sizes = files.select("part", "shard", F.col("n_ids").cast("long").alias("n_ids"))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_base"))
    within = sizes.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("shard_base"))
    return files.select("part", "shard", "content"), within.join(parts, "part").select("part", "shard", (F.col("part_base") + F.col("shard_base")).alias("base"))


def _read(spark: SparkSession, folder: str, column: str, kind: str, of_doc, most: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, column): of_doc makes the column's value from the parts of a document's ids."""
    found = _shards(spark, folder)
    schema = f"doc_id long, start long, n_tokens long, {column} {kind}"
    if found is None:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, content in zip(*batch.columns, strict=True):
                s, at = Shard(content.as_buffer().to_pybytes()), 0
                while at < s.n_docs:
                    end = max(at + 1, int(np.searchsorted(s.starts, s.starts[at] + most)))
                    n = min(end, s.n_docs) - at
                    here = slice(at, at + n)
                    columns = [pa.array([part.as_py()] * n, pa.int32()), pa.array([shard.as_py()] * n, pa.int32()), pa.array(s.doc_ids[here], mask=s.missing[here].astype(bool)), pa.array(s.starts[here]), pa.array(s.lengths[here])]
                    yield pa.RecordBatch.from_arrays([*columns, of_doc([s.parts(k) for k in range(at, at + n)])], names=["part", "shard", "doc_id", "at", "n_tokens", column])
                    at += n

    files, bases = found
    rows = files.mapInArrow(run, f"part int, shard int, doc_id long, at long, n_tokens long, {column} {kind}")
    return rows.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", column)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>): every document; start counts the ids of all documents before it."""
    return _read(spark, folder, "ids", "array<int>", lambda docs: pa.array([np.concatenate(list(d)).astype(np.int32) for d in docs], pa.list_(pa.int32())))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the unsigned CRC-32 of a document's ids as little-endian 32-bit numbers."""

    def crc(parts: Iterator[np.ndarray]) -> int:
        value = 0
        for ids in parts:
            value = zlib.crc32(np.ascontiguousarray(ids, "<u4"), value)
        return value

    return _read(spark, folder, "ids_crc32", "long", lambda docs: pa.array([crc(d) for d in docs], pa.int64()))


def new_folder(spark: SparkSession) -> str:
    """A folder for token files that all executors share."""
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4()}"


def written_digests(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the table into a new shared folder and return what read_digests() finds there."""
    folder = new_folder(docs.sparkSession)
    write(docs, folder, path, end_id, id_col, text_col)
    return read_digests(docs.sparkSession, folder)
