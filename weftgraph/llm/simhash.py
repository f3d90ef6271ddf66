"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 4 bits share a variant that lies within 2 flips of either, and two
that share such a variant differ in at most 4 bits.  So every distinct fingerprint emits its whole ball of radius
2 (2,081 variants), equal variants meet, and no candidate needs to be guessed.

The variants meet by their low k bits: a fingerprint is sent to every bucket that holds one of its variants
(1 + k + k(k-1)/2 buckets) and the variants of that bucket are written out only there, in numpy.  That is the same
shuffle on variants with about a fiftieth of its bytes.  A bucket with many variants is split by one more bit, again
and again, so memory has a bound whatever the data.  Within a variant's group the smallest fingerprint is linked
to the others: this keeps every component and never makes pairs of a group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import map_columns, picked, use_checkpoints
from weftgraph.operators.components import connected_components

SHINGLE = 4
MOST_VARIANTS = 4_000_000  # held by a task at once
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the space-joined word shingles (A-Z lower-cased, repeats count); 0 if there is no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) < shingle:
        hashes = [digest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        raw = np.frombuffer(b"".join(hashes[at : at + _BLOCK]), np.uint8)
        ones += np.unpackbits(raw).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint of every text as a signed 64-bit number.  Null and wordless texts get 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        return lambda ids, texts: [ids, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_columns(picked(docs, id_col, text_col), f"`{id_col}` {kind}, fp long", start)


def _variants(fps: np.ndarray, bucket: int, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The variants within two flips that fall in a bucket of the low k bits, and their owners; None if too many."""
    high = [np.uint64(1) << np.uint64(j) for j in range(k, 64)]
    low = np.uint64((1 << k) - 1 if k < 64 else 2**64 - 1)
    away = (fps & low) ^ np.uint64(bucket)
    flips = np.bitwise_count(away)
    none, one, two = (np.flatnonzero(flips == n) for n in range(3))
    h = len(high)
    if len(none) * (1 + h + h * (h - 1) // 2) + len(one) * (1 + h) + len(two) > MOST_VARIANTS and k < 64:
        return None
    moved = fps ^ away
    single = np.array([0, *high], np.uint64)
    double = np.array([*single, *(a | b for i, a in enumerate(high) for b in high[:i])], np.uint64)
    parts = [((moved[own][:, None] ^ masks[None, :]).ravel(), np.repeat(own, len(masks))) for own, masks in ((none, double), (one, single), (two, single[:1]))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _links(fps: np.ndarray, bucket: int, k: int) -> list[np.ndarray]:
    """Star links (owner, owner) of the variants in one bucket; it is halved while it holds too many."""
    found = _variants(fps, bucket, k)
    if found is None:
        near = fps[np.bitwise_count((fps & np.uint64((1 << k) - 1)) ^ np.uint64(bucket)) <= 2]
        at = np.searchsorted(fps, near)
        return [at[x] for half in (bucket, bucket | 1 << k) for x in _links(near, half, k + 1)]
    variants, owners = found
    ordered = np.sort(variants)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return []
    near = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
    met = twice[near] == variants
    group, owners = near[met], owners[met]
    order = np.lexsort((owners, group))
    group, owners = group[order], owners[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    head = np.repeat(owners[first], np.diff(np.r_[first, len(group)]))
    return [np.stack([head, owners])[:, head != owners]]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component, for links (a, b) within one bucket."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def fingerprint_links(distinct: DataFrame, n_distinct: int) -> DataFrame:
    """(fp, root): links that connect all fingerprints within 4 bits of each other.  distinct: one column fp."""
    k = min(24, max(4, round(math.log2(max(n_distinct, 1) / 512))))
    masks = [0, *(1 << i for i in range(k)), *(1 << i | 1 << j for i in range(k) for j in range(i))]
    sent = distinct.select("fp", F.explode(F.array(*(F.lit(m) for m in masks))).alias("flip")).select(F.col("fp").bitwiseAND(F.lit((1 << k) - 1)).cast("int").bitwiseXOR(F.col("flip")).alias("bucket"), "fp")

    def meet(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        fps = np.sort(table.column("fp").to_numpy().view(np.uint64))
        links = _links(fps, bucket, k)
        fp = root = np.empty(0, np.int64)
        if links:
            a, b = np.concatenate(links, axis=1)
            label = _roots(len(fps), a, b)
            moved = np.flatnonzero(label != np.arange(len(fps)))
            fp, root = fps[moved].view(np.int64), fps[label[moved]].view(np.int64)
        return pa.table({"fp": pa.array(fp, pa.int64()), "root": pa.array(root, pa.int64())})

    return sent.groupBy("bucket").applyInArrow(meet, "fp long, root long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lowercase hex digits.  component_id: the smallest id that links of 4 or fewer differing bits
    reach, the row's own included.  Null or wordless texts have fingerprint zero and link like any other; rows that
    repeat an id stay as many; a null id never becomes a component id unless the component has no other; an empty
    table gives an empty one.  Columns of docs other than these two are not read.
    """
    spark = docs.sparkSession
    use_checkpoints(spark)
    prints = fingerprints(docs, id_col, text_col).checkpoint()
    least = prints.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least")).checkpoint()
    links = fingerprint_links(least.select("fp"), least.count())
    roots = connected_components(links, "fp", "root")
    rooted = least.join(roots.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Components of one fingerprint need no join by root.
    linked = roots.select(F.col("node").alias("fp"), F.col("component").alias("root")).join(smallest, "root").select("fp", "component_id")
    by_print = least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")).checkpoint()  # both sides of the last join are then plain shuffles, whose hot fingerprints Spark splits
    return prints.join(by_print, "fp").select(F.col(f"`{id_col}`"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
