"""Groups of texts whose word shingles are similar, by SimHash ball hashing over many short fingerprints.

op1's one fingerprint of 64 bits links texts that are nearly equal (4 bits are a cosine of about 0.98).  Texts with
a shingle similarity (Jaccard) of 0.8 differ in about 15 % of the bits of a SimHash, so here a text gets TABLES
fingerprints of BAND bits.  In each table a fingerprint emits the ball of all variants within one flip; fingerprints
within two bits share a variant and meet there.  Two texts of similarity 0.8 meet in one table with probability 0.117,
in one of 32 tables with 0.98 (0.999 at 0.85).  Colliding pairs are deduplicated, and verified by their whole sets of
shingles before they count as links.

As in simhash.py, variants are written out where they meet: a text goes, packed with others, to the buckets of the
low bits of its variants.  In a first round every member of a variant meets its head (the smallest hash, so heads agree
across groups), or the member before it if the head is too far.  Texts with a meeting left out meet again in a second
round: there all pairs of a variant that the links of the first have not brought into one component are verified.  So
the components are those of all pairs of all variants.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import map_columns, picked, use_checkpoints
from weftgraph.operators.components import connected_components

SHINGLE = 5
SIMILAR = 0.8
TABLES = 32
BAND = 32  # bits
CHECK_BITS = 18  # of 64 further bits that a pair may differ in: 9.7 are expected at similarity 0.8
MOST_VARIANTS = 4_000_000  # held by a task at once
BUCKET_ROWS = 500_000
SMALL = 1_000_000  # rows of 16 bytes that may be broadcast
_WORDS = TABLES // 2  # of 64 bits
_STEPS = np.random.default_rng(5).integers(0, 2**63, size=_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.random.default_rng(51).integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x0101010101010101)
_RUNS = 256  # of 255 shingles, whose bits are counted at once


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 5)
        return value


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The distinct shingle hashes of all texts, sorted within each; where each text's begin; and a hash of each text's words.

    A-Z is lower-cased.  A text of fewer words than a shingle has is one shingle; one without words is one too.
    """
    known, words, sizes, keys = _WordHashes(), [], [], []
    for t in texts:
        own = (t or "").encode("utf-8", "replace").lower().split()
        words += own
        sizes.append(len(own))
        keys.append(xxhash.xxh64_intdigest(b" ".join(own), 3))
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    del words, known
    windows = np.zeros(max(0, len(hashes) - width + 1), np.uint64)  # over all texts; those across two texts are not taken
    for i in range(width):
        windows += _mixed(hashes[i : i + len(windows)] + _SEEDS[i]) * _SEEDS[i + width]
    windows, sets, at = _mixed(windows), [], 0
    for n, key in zip(sizes, keys, strict=True):
        sets.append(np.unique(windows[at : at + n - width + 1]) if n >= width else np.array([key], np.uint64))
        at += n
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.cumsum([0, *map(len, sets)]), keys


def fingerprints_of(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of 64-bit words for each set of shingles: bit by bit what most of its shingles have.

    Bits are counted in the bytes of a word, eight at a time, over runs of at most 255 shingles of one text.
    """
    n = len(at) - 1
    out = np.zeros((n, _WORDS), np.uint64)
    sizes = np.diff(at)
    runs = (sizes + 254) // 255
    owner = np.repeat(np.arange(n), runs)
    first = np.repeat(at[:-1] - 255 * np.r_[0, np.cumsum(runs)[:-1]], runs) + 255 * np.arange(len(owner)) if n else np.empty(0, np.int64)
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if n else owner
    ends = np.r_[first, len(shingles)]
    for k in range(_WORDS if n else 0):
        lanes = np.empty((8, len(first)), np.uint64)
        for a in range(0, len(first), _RUNS):
            b = min(a + _RUNS, len(first))
            bits = _mixed(shingles[ends[a] : ends[b]] * _STEPS[k])
            for j in range(8):
                lanes[j, a:b] = np.add.reduceat((bits >> np.uint64(j)) & _LANES, first[a:b] - ends[a])
        for j in range(8):
            counts = np.add.reduceat(lanes[j].view(np.uint8).reshape(-1, 8).astype(np.int32), heads, axis=0)
            most = (2 * counts > sizes[:, None]).astype(np.uint8)
            out[:, k] |= most.view(np.uint64).ravel() << np.uint64(j)
    return out


def _prints(rows: DataFrame) -> DataFrame:
    """(row, key long, print binary) of rows (row, text)."""
    kind = rows.schema["row"].dataType.simpleString()

    def start():
        def work(keys, texts):
            shingles, at, hashes = shingle_sets(texts)
            found = fingerprints_of(shingles, at)
            return [keys, np.array(hashes, np.uint64).view(np.int64), [x.tobytes() for x in found]]

        return work

    return map_columns(rows, f"row {kind}, key long, print binary", start)


def _packed(classes: DataFrame, k: int) -> DataFrame:
    """(bucket, members binary): the keys, fingerprints and check words of a batch's texts for each table and low k bits of a variant.

    Of classes with a column root, the roots stand between the check words and the fingerprints.
    """
    low = np.uint32((1 << k) - 1)
    flips = np.array([0, *(1 << i for i in range(k))], np.uint32)

    def start():
        def work(keys, prints, *roots):
            key = np.array(keys, np.int64)
            root = [np.array(r, np.int64) for r in roots]
            bands = np.frombuffer(b"".join(prints), np.uint32).reshape(-1, TABLES)
            words = np.frombuffer(b"".join(prints), np.uint64).reshape(-1, _WORDS)
            buckets, members = [], []
            for t in range(TABLES):
                check = words[:, (t // 2 + 1) % _WORDS]
                to = ((bands[:, t] & low)[:, None] ^ flips[None, :]).ravel()
                who = np.repeat(np.arange(len(key)), len(flips))
                order = np.argsort(to, kind="stable")
                to, who = to[order], who[order]
                cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                for a, b in zip(cuts, np.r_[cuts[1:], len(to)], strict=True):
                    own = who[a:b]
                    buckets.append(t << k | int(to[a]))
                    members.append(b"".join(x.tobytes() for x in (key[own], check[own], *(r[own] for r in root), bands[own, t])))
            return [buckets, members]

        return work

    columns = [c for c in ("key", "print", "root") if c in classes.columns]
    return map_columns(classes.select(*columns), "bucket long, members binary", start, size=8_000_000)


def _ball(band: np.ndarray, bucket: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The variants within one flip whose low k bits are the bucket's, and their owners."""
    away = (band & np.uint32((1 << k) - 1)) ^ np.uint32(bucket)
    own, one = np.flatnonzero(away == 0), np.flatnonzero(np.bitwise_count(away) == 1)
    masks = np.array([0, *(1 << i for i in range(k, BAND))], np.uint32)
    return np.r_[(band[own][:, None] ^ masks[None, :]).ravel(), band[one] ^ away[one]], np.r_[np.repeat(own, len(masks)), one]


def _meetings(band: np.ndarray, check: np.ndarray, bucket: int, k: int, at: np.ndarray, rest: list[np.ndarray] | None = None):
    """Pairs (smaller, larger) of places that meet in a bucket and pass the check; a full bucket is halved.

    rest takes the places of variants with pairs left out: those of three members or more.
    """
    if len(at) * (BAND + 1 - k) > MOST_VARIANTS and k < BAND:
        for half in (bucket, bucket | 1 << k):
            away = (band[at] & np.uint32((1 << k + 1) - 1)) ^ np.uint32(half)
            yield from _meetings(band, check, half, k + 1, at[np.bitwise_count(away) <= 1], rest)
        return
    variant, owner = _ball(band[at], bucket, k)
    owner = at[owner]
    order = np.lexsort((owner, variant))
    variant, owner = variant[order], owner[order]
    new = np.r_[True, variant[1:] != variant[:-1]] if len(variant) else np.empty(0, bool)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.r_[heads, len(owner)])
    head = np.repeat(owner[heads], sizes)
    if rest is not None:
        rest.append(np.unique(owner[np.repeat(sizes, sizes) > 2]))
    near = lambda a, b: np.bitwise_count(check[a] ^ check[b]) <= CHECK_BITS
    member = ~new
    passed = member & near(head, owner)
    yield np.stack([head[passed], owner[passed]])
    missed = np.flatnonzero(member & ~passed)
    before = owner[missed - 1]
    chained = near(before, owner[missed]) & (before != head[missed])
    yield np.stack([before[chained], owner[missed][chained]])


def _across(band: np.ndarray, check: np.ndarray, root: np.ndarray, bucket: int, k: int, at: np.ndarray) -> Iterator[np.ndarray]:
    """All pairs of places of different roots that meet in a bucket and pass the check, some millions at a time; a full bucket is halved."""
    if len(at) * (BAND + 1 - k) > MOST_VARIANTS and k < BAND:
        for half in (bucket, bucket | 1 << k):
            away = (band[at] & np.uint32((1 << k + 1) - 1)) ^ np.uint32(half)
            yield from _across(band, check, root, half, k + 1, at[np.bitwise_count(away) <= 1])
        return
    variant, owner = _ball(band[at], bucket, k)
    owner = at[owner]
    order = np.lexsort((root[owner], variant))
    variant, owner = variant[order], owner[order]
    n, of = len(owner), root[owner]
    new = np.r_[True, variant[1:] != variant[:-1]] if n else np.empty(0, bool)
    other = new | np.r_[True, of[1:] != of[:-1]] if n else new
    end = lambda starts: np.r_[np.flatnonzero(starts)[1:], n][np.cumsum(starts) - 1] if n else np.empty(0, np.int64)
    first = end(other)  # every member meets those of its variant that follow its own root's
    count = end(new) - first
    before = np.r_[0, np.cumsum(count)]
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(before, before[a] + MOST_VARIANTS, "right")) - 1)
        left = np.repeat(np.arange(a, b), count[a:b])
        right = first[left] + np.arange(len(left)) - (before[left] - before[a])
        x, y = owner[left], owner[right]
        near = np.bitwise_count(check[x] ^ check[y]) <= CHECK_BITS
        yield np.unique(np.sort(np.stack([x[near], y[near]]), axis=0), axis=1)
        a = b


def _low_bits(n: int) -> int:
    return max(4, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS)))


def _members(packs: list[bytes], dtypes: tuple[type, ...]) -> list[np.ndarray]:
    """The columns of a bucket's packed members, in the order of keys, which are the first column."""
    width, found = sum(np.dtype(d).itemsize for d in dtypes), [[] for _ in dtypes]
    for raw in packs:
        m, at = len(raw) // width, 0
        for column, d in zip(found, dtypes, strict=True):
            column.append(np.frombuffer(raw, d, m, at))
            at += m * np.dtype(d).itemsize
    columns = [np.concatenate(c) for c in found]
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def _pairs(classes: DataFrame, n: int) -> DataFrame:
    """(a, b): distinct pairs of keys that meet; of the meetings in a bucket each text keeps the one with the smallest key.

    A text with a meeting left out is paired with itself, too.
    """
    k = _low_bits(n)

    def meet(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py() & ((1 << k) - 1)
        key, check, band = _members(table.column("members").to_pylist(), (np.int64, np.uint64, np.uint32))
        rest: list[np.ndarray] = []
        found = np.concatenate([np.empty((2, 0), np.int64), *_meetings(band, check, bucket, k, np.arange(len(key)), rest)], axis=1)
        order = np.lexsort((found[0], found[1]))
        a, b = found[:, order]
        first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.empty(0, bool)
        again = np.unique(np.concatenate([*rest, a[~first], b[~first]]).astype(np.int64))
        return pa.table({"a": pa.array(key[np.r_[a[first], again]], pa.int64()), "b": pa.array(key[np.r_[b[first], again]], pa.int64())})

    return _packed(classes, k).groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def _pairs_across(classes: DataFrame, n: int) -> DataFrame:
    """(a, b): all distinct pairs of keys with different roots that meet; classes (key, print, root)."""
    k = _low_bits(n)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        bucket = table.column("bucket")[0].as_py() & ((1 << k) - 1)
        key, check, root, band = _members(table.column("members").to_pylist(), (np.int64, np.uint64, np.int64, np.uint32))
        for a, b in _across(band, check, root, bucket, k, np.arange(len(key))):
            yield pa.RecordBatch.from_arrays([pa.array(key[a], pa.int64()), pa.array(key[b], pa.int64())], ["a", "b"])

    return _packed(classes, k).groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets of shingles are at least so similar."""
    a, b = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))

    def start():
        def work(left, right, one, two):
            good = []
            for x, y in zip(one, two, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= least * (len(x) + len(y) - common) - 1e-9)
            return [[v for v, g in zip(left, good, strict=True) if g], [v for v, g in zip(right, good, strict=True) if g]]

        return work

    return map_columns(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), "a long, b long", start)


def _sets(rows: DataFrame) -> DataFrame:
    """(key, shingles binary) of rows (key, text)."""

    def start():
        def work(keys, texts):
            shingles, at, _ = shingle_sets(texts)
            return [keys, [shingles[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]]

        return work

    return map_columns(rows.select("key", "text"), "key long, shingles binary", start)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """(id, text_hash, kept): every row of docs with an id, and whether it stays if one document of each group does.

    Groups are connected by texts with equal words and by pairs with a shingle similarity of at least `least`; the
    smallest id of a group stays.  Rows that share an id are told apart by text_hash, xxhash64 of the text; equal rows
    get equal verdicts.  Null and wordless texts are equal to each other.  Rows with a null id are not here.
    """
    spark = docs.sparkSession
    use_checkpoints(spark)
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    prints = _prints(rows).checkpoint()
    classes = prints.groupBy("key").agg(F.min("row").alias("row"), F.min("print").alias("print")).checkpoint()
    met = _pairs(classes, classes.count()).checkpoint()

    def verified(pairs: DataFrame) -> DataFrame:
        # Shingles are made again of one row of each text that is in a pair.
        ends = pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b")).distinct()
        needed = classes.select("key", "row").join(ends, "key", "left_semi").checkpoint()
        few = needed.count() <= SMALL
        sets = _sets(rows.join(F.broadcast(needed) if few else needed, "row").dropDuplicates(["key"])).checkpoint()
        return _verified(pairs, sets, least).checkpoint()

    def rooted(links: DataFrame) -> DataFrame:
        return connected_components(links, "a", "b").select(F.col("node").alias("key"), F.col("component").alias("root"))

    pairs = met.where("a <> b")
    links = verified(pairs)
    roots = rooted(links)
    again = met.where("a = b").select(F.col("a").alias("key"))
    left = classes.select("key", "print").join(again, "key").join(roots, "key", "left").select("key", "print", F.coalesce("root", "key").alias("root")).checkpoint()
    more = _pairs_across(left, left.count()).join(pairs, ["a", "b"], "left_anti").checkpoint()
    if not more.isEmpty():
        roots = rooted(links.unionAll(verified(more)))
    grouped = classes.select("key", F.col("row.id").alias("id")).join(roots, "key")
    least_of = grouped.join(grouped.groupBy("root").agg(F.min("id").alias("least")), "root").select("key", "least")
    kept = classes.join(least_of, "key", "left").select("key", F.coalesce("least", F.col("row.id")).alias("least")).checkpoint()
    return prints.join(kept, "key").select(F.col("row.id").alias(id_col), F.col("row.text_hash").alias("text_hash"), (F.col("row.id") == F.col("least")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """docs with one document of each group of similar_groups(), the one with the smallest id; all columns stay.

    Rows with a null id have no place in the order: they stay and make no other go.  Equal rows of the smallest id
    all stay.  An empty table stays empty; columns of any name in docs are left alone.
    """
    gone = similar_groups(docs, id_col, text_col, least).where("not kept").select(F.col(f"`{id_col}`").alias("id"), "text_hash").distinct()
    hash_of = F.xxhash64(docs[f"`{text_col}`"])
    return docs.join(gone, (docs[f"`{id_col}`"] == gone["id"]) & (hash_of == gone["text_hash"]), "left_anti")
