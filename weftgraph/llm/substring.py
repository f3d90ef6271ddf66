"""Repeated passages: windows of 13 words as edges of a De Bruijn graph, compacted to long repeated spans.

1. Every text's windows become edges with a 56-bit key; a second hash deals them to buckets.  Within a chunk of texts
   an edge is kept once, with its smallest document; the chunk's other documents that hold it are settled on the spot.
   So an edge that a third of all texts hold leaves each chunk once, and no bucket grows with the edge's frequency.
2. Edges travel packed, one row per chunk and bucket.  Each bucket finds, for every document, its edges that also
   start in a smaller document, and the smallest such document, the edge's source: the repeated part of the graph.
3. A document joins its repeated edges.  Neighbouring ones overlap in 12 words, and as long as they have one source they
   are a nonbranching path: it compacts to one span of words in the document's own coordinates.
4. Each span joins its source document, in which its words must stand: as a whole, or window by window where the path
   in the source is another one.  Keys only propose; what is removed has been found word for word in the source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import map_columns, picked

WINDOW = 13
KEY_BYTES = 7
CHUNK_CHARS = 4_000_000  # of text hashed at once in a task; a longer text is a chunk of its own
BUCKET_CHARS = 12_000_000  # of text whose edges meet in one task, about two million of them
_SEEDS = np.random.default_rng(13).integers(0, 2**63, size=(2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(29)
    return x


def edge_keys(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window of word hashes: a key of KEY_BYTES and 64 bits."""
    n = len(words) - width + 1
    keys = []
    for seeds in _SEEDS:
        total = np.zeros(max(n, 0), np.uint64)
        for i in range(width if n > 0 else 0):
            total += _mixed(words[i : i + n] + seeds[i]) * seeds[i + width]
        keys.append(_mixed(total))
    return keys[0] & np.uint64((1 << 8 * KEY_BYTES) - 1), keys[1]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _edges(ids: list, texts: list, width: int):
    """The edges of a batch in the order of ids: (key, second hash, index into the sorted ids)."""
    rows = sorted((i, at) for at, i in enumerate(ids) if i is not None)
    hashes, words, sizes = _WordHashes(), [], []
    for _, at in rows:
        w = words_of(texts[at])
        sizes.append(len(w))
        words += w
    n = np.array(sizes, np.int64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    key, second = edge_keys(values, width)
    doc = np.repeat(np.arange(len(n)), n)[: len(key)]
    inside = np.arange(len(key)) + width <= np.repeat(np.cumsum(n), n)[: len(key)]
    return np.array([i for i, _ in rows], np.int64), key[inside], second[inside], doc[inside]


def _packed(bucket: np.ndarray, doc: np.ndarray, key: np.ndarray, ids: np.ndarray):
    """(bucket, least id, steps to the next id, counts, keys) as one row per bucket, keys by document, documents by id; a count is a byte, so long runs take several."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, doc, key = bucket[order], doc[order], key[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
        own = doc[a:b]
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        runs = np.diff(np.r_[heads, b - a])
        pieces = (runs + 254) // 255
        counts = np.full(pieces.sum(), 255, np.uint8)
        counts[np.cumsum(pieces) - 1] = runs - (pieces - 1) * 255
        names = np.repeat(ids[own[heads]], pieces)
        yield int(bucket[a]), int(names[0]), _narrow(np.diff(names, prepend=names[:1])), counts.tobytes(), _short(key[a:b])


def _unpacked(least: int, ids: bytes, counts: bytes, keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(id, key) of every edge in a packed row."""
    n = np.frombuffer(counts, np.uint8)
    return np.repeat(np.cumsum(_wide(ids, len(n))) + least, n), _long(keys)


def _narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 in as many bytes as the largest needs."""
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if values.max() <= np.iinfo(t).max)).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // n]).astype(np.int64)


def _short(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _long(raw: bytes) -> np.ndarray:
    key = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    key[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return key.view(np.uint64).ravel()


def _chunks(texts: list):
    """Ranges of texts with at most CHUNK_CHARS characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t or "")
    yield begin, len(texts)


def repeated_edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(to, keys binary, lowest long, sources binary): of each document's windows that also start in a document with a smaller id the keys, and the smallest such ids as steps above the lowest."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.octet_length(f"`{text_col}`"))).first()[0] or 0
    n_buckets = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), chars // BUCKET_CHARS)
    kind = np.uint16 if n_buckets <= 1 << 16 else np.uint32

    def chunk(ids, texts):
        own, key, second, doc = _edges(ids, texts, width)
        if not len(key):
            return
        bucket = (second % np.uint64(n_buckets)).astype(kind)
        del second
        order = np.argsort(key, kind="stable")
        key, bucket, doc = key[order], bucket[order], doc[order]
        new = np.r_[True, key[1:] != key[:-1]]
        least = np.repeat(doc[new], np.diff(np.r_[np.flatnonzero(new), len(key)]))
        settled = (own[doc] > own[least]) & (new | np.r_[True, doc[1:] != doc[:-1]])
        del least, order
        for keep, done in ((new, False), (settled, True)):
            b, d, k = bucket[keep], doc[keep], key[keep]
            back = np.argsort(d, kind="stable")
            for row in _packed(b[back], d[back], k[back], own):
                yield *row, done

    def start():
        def work(ids, texts):
            rows = [row for a, b in _chunks(texts) for row in chunk(ids[a:b], texts[a:b])]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 6

        return work

    packed = map_columns(picked(docs, id_col, text_col), "bucket int, least long, ids binary, counts binary, keys binary, settled boolean", start, size=2 * CHUNK_CHARS)

    def meet(table: pa.Table) -> pa.Table:
        docs_of, keys_of, done_of = [], [], []
        for least, ids, counts, keys, done in zip(*(table.column(c).to_pylist() for c in ("least", "ids", "counts", "keys", "settled")), strict=True):
            doc, key = _unpacked(least, ids, counts, keys)
            docs_of.append(doc)
            keys_of.append(key)
            done_of.append(np.full(len(key), done))
        doc, key, done = np.concatenate(docs_of), np.concatenate(keys_of), np.concatenate(done_of)
        open_key, open_doc = key[~done], doc[~done]
        order = np.lexsort((open_doc, open_key))
        open_key, open_doc = open_key[order], open_doc[order]
        cuts = np.flatnonzero(np.r_[True, open_key[1:] != open_key[:-1]]) if len(open_key) else np.empty(0, np.int64)
        heads, first = open_key[cuts], open_doc[cuts]
        source = np.repeat(first, np.diff(np.r_[cuts, len(open_key)]))
        late = open_doc > source
        # An edge that was settled in its chunk left that chunk with its smallest document, so it is among the heads.
        doc, key, source = np.r_[open_doc[late], doc[done]], np.r_[open_key[late], key[done]], np.r_[source[late], first[np.searchsorted(heads, key[done])]]
        # Back to the documents, packed again: one row for each bucket of documents.
        names, index = np.unique(doc, return_inverse=True)
        dest = (_mixed(names.view(np.uint64)) % np.uint64(n_buckets)).astype(kind)[index]
        order = np.lexsort((source, index, dest))  # the order in which _packed() writes; equal sources side by side compress
        rows = []
        at = 0
        for row in _packed(dest[order], index[order], key[order], names):
            n = len(row[4]) // KEY_BYTES
            rows.append((*row, *_offsets(source[order[at : at + n]])))
            at += n
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], ["dest", "least", "ids", "counts", "keys", "lowest", "sources"])

    def gather(table: pa.Table) -> pa.Table:
        """All keys of each document of one bucket, with their sources."""
        columns = [table.column(c).to_pylist() for c in ("least", "ids", "counts", "keys")]
        pairs = [_unpacked(*row) for row in zip(*columns, strict=True)]
        doc, key = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        raw = zip(table.column("lowest").to_pylist(), table.column("sources").to_pylist(), pairs, strict=True)
        source = np.concatenate([lowest + _wide(x, len(p[1])) for lowest, x, p in raw])
        order = np.argsort(doc, kind="stable")
        doc, key, source = doc[order], key[order], source[order]
        cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        parts = list(zip(cuts, np.r_[cuts[1:], len(doc)], strict=True))
        lowest, sources = zip(*(_offsets(source[a:b]) for a, b in parts), strict=True)
        return pa.table({"to": pa.array(doc[cuts], pa.int64()), "keys": pa.array([_short(key[a:b]) for a, b in parts], pa.binary()), "lowest": pa.array(lowest, pa.int64()), "sources": pa.array(sources, pa.binary())})

    met = packed.groupBy("bucket").applyInArrow(meet, "dest int, least long, ids binary, counts binary, keys binary, lowest long, sources binary")
    return met.groupBy("dest").applyInArrow(gather, "to long, keys binary, lowest long, sources binary")


def _offsets(values: np.ndarray) -> tuple[int, bytes]:
    """The least of some ids and how far the others are above it."""
    least = int(values.min())
    return least, _narrow(values - least)


def spans_of(words: list[bytes], keys: bytes, lowest: int, sources: bytes, width: int = WINDOW) -> list[tuple[int, int, int]]:
    """(from, to, source): the word ranges that the repeated edges of one document compact to: runs of neighbours with one source."""
    hashes = _WordHashes()
    own, _ = edge_keys(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), width)
    if not len(own) or not keys:
        return []
    key = _long(keys)
    source = lowest + _wide(sources, len(key))
    order = np.argsort(key, kind="stable")
    key, source = key[order], source[order]
    near = np.minimum(np.searchsorted(key, own), len(key) - 1)
    at = np.flatnonzero(key[near] == own)
    if not len(at):
        return []
    source = source[near[at]]
    breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(source) != 0))
    begin, end = np.r_[0, breaks + 1], np.r_[breaks, len(at) - 1]
    return list(zip(at[begin].tolist(), (at[end] + width).tolist(), source[begin].tolist(), strict=True))


def found_in(span: list[bytes], source: bytes, width: int) -> list[tuple[int, int]]:
    """The ranges of a span's words whose windows stand in a source (its words with a space before, between and behind)."""
    if b" " + b" ".join(span) + b" " in source:
        return [(0, len(span))]
    return [(i, i + width) for i in range(len(span) - width + 1) if b" " + b" ".join(span[i : i + width]) + b" " in source]


def _text_hash(text: str | None) -> int:
    """Tells rows that share an id apart."""
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "replace")) - (1 << 63)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, spans array<struct<h, from, to>>): the verified word ranges of documents that have any; h is _text_hash() of the row."""
    texts = picked(docs, id_col, text_col).where(F.col(f"`{id_col}`").isNotNull())
    edges = repeated_edges(docs, id_col, text_col, width)

    def compact():
        def work(ids, own, *packed):
            rows = []
            for i, text, *found in zip(ids, own, *packed, strict=True):
                words = words_of(text)
                rows += [(source, i, _text_hash(text), a, b" ".join(words[a:b])) for a, b, source in spans_of(words, *found, width)]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5

        return work

    def verify():
        def work(owners, hashes, begins, spans, sources):
            rows = []
            for i, h, begin, span, text in zip(owners, hashes, begins, spans, sources, strict=True):
                source = b" " + b" ".join(words_of(text)) + b" "
                rows += [(i, h, begin + a, begin + b) for a, b in found_in(span.split(b" "), source, width)]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4

        return work

    # Texts are never broadcast.  A source that very many spans have is no hot group in memory: the merge join streams the spans.
    join = edges["to"] == texts[f"`{id_col}`"]
    paths = map_columns(edges.hint("shuffle_hash").join(texts, join).select(F.col("to"), F.col(f"`{text_col}`"), "keys", "lowest", "sources"), "source long, owner long, h long, begin int, span binary", compact)
    asked = paths.hint("merge").join(texts, paths["source"] == texts[f"`{id_col}`"]).select("owner", "h", "begin", "span", F.col(f"`{text_col}`"))
    verified = map_columns(asked, "owner long, h long, `from` int, `to` int", verify)
    return verified.groupBy("owner").agg(F.collect_list(F.struct("h", "from", "to")).alias("spans"))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, text, spans): every row of docs; spans are null where nothing is repeated.

    Rows without an id take no part.  The others are read in the same way at every join, so that Spark deals the texts
    once and uses that exchange three times.
    """
    rows = picked(docs, id_col, text_col)
    found = repeated_spans(docs, id_col, text_col, width)
    named = rows.where(F.col(f"`{id_col}`").isNotNull())
    joined = named.join(found.hint("shuffle_hash"), named[f"`{id_col}`"] == found["owner"], "left").drop("owner")
    apart = rows.where(F.col(f"`{id_col}`").isNull()).withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType))
    return joined.unionByName(apart)


def _merged(text: str | None, spans: list | None) -> list[tuple[int, int]]:
    """The union of a row's own spans."""
    out: list[tuple[int, int]] = []
    if spans:
        h = _text_hash(text)
        for a, b in sorted((s["from"], s["to"]) for s in spans if s["h"] == h):
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], max(out[-1][1], b)
            else:
                out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, n_words, kept array<string>, spans array<struct<from:int,to:int>>): words that stay, and the word ranges that go.

    A word goes if a window of `width` words over it also starts in a document with a smaller id, judged on the
    input.  Null texts and texts shorter than a window lose nothing; documents with equal ids never count as smaller
    than each other; a row with a null id has no place in the order, loses nothing and takes nothing from others.
    Ids are integers.  An empty table gives an empty one; columns beside these two are not read.
    """

    def start():
        def work(ids, texts, each):
            n, kept, spans = [], [], []
            for text, s in zip(texts, each, strict=True):
                words, found = words_of(text), _merged(text, s)
                n.append(len(words))
                spans.append([{"from": a, "to": b} for a, b in found])
                kept.append([w.decode() for w in _outside(words, found)])
            return [ids, n, kept, spans]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(_with_spans(docs, id_col, text_col, width), f"`{id_col}` {kind}, n_words long, kept array<string>, spans array<struct<from:int,to:int>>", start)


def _outside(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    return out + words[at:]


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256): remove_repeats() without shipping the words back to Spark."""

    def start():
        def work(ids, texts, each):
            n, removed, digests = [], [], []
            for text, s in zip(texts, each, strict=True):
                words = words_of(text)
                kept = _outside(words, _merged(text, s)) if s else words
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            return [ids, n, removed, digests]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(_with_spans(docs, id_col, text_col, width), f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string", start)
