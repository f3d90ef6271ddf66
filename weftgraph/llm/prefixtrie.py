"""Conversations that share their first turns, as a trie whose nodes are numbered by minimal perfect hashes.

A node is a distinct sequence of first turns; its digest chains the digests of its turns.  Conversations are dealt into
shards, whatever they have in common, so a first turn that very many of them share is spread like any other.  A shard
enumerates the distinct digests of its prefixes, gives each a slot by a minimal perfect hash (every slot's digest and the
parent and turn behind it are compared, so a collision stops the job and never joins two nodes), and scatters its counts
into flat arrays.  The shards' counts of a node, one row each, are summed by Spark.  A node belongs to the shard of its
smallest member; there alone its value stands in the arrays, each shard adds values up through its array of parent
slots, deepest nodes first, and the shards' sums of a node together are those of its whole subtree.

A task holds the prefixes of one shard: about SHARD_TURNS turns, or one conversation and those that borrow from it.

Rows without conv_id belong to no conversation and are left out.  A null role or text is empty.  Turns are ordered by
turn (null first), rows with an equal turn by the digest of role and text; repeated rows are repeated turns.  An empty
table has no conversation, so no node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import picked, use_checkpoints

SHARD_TURNS = 100_000
ENDS = 12  # conversation ids that differ in their last bits only are joined to one text first, at most 4,096 of them
ROOT = bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()

COUNTED = "shard int, a long, b long, pa long, pb long, ta long, tb long, depth long, n_bytes long, n_convs long, conv long"
SUMMED = "a long, b long, saved long, leaves long, conv long, depth long, parent_conv long, n_convs long, n_children long"


class PerfectHash:
    """Slots 0..n-1 for n distinct 128-bit keys, as rows of two 64-bit numbers.

    A key takes the place that it alone has in the first level where there is one; its slot is the number of such
    places before it.  Levels have twice as many places as keys are left, so there are few of them.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.table = np.empty_like(keys)
        left, n = keys, 0
        while len(left):
            at = self._places(left, len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(at, minlength=2 * len(left) + 1) == 1
            self.levels.append((alone, n + np.cumsum(alone) - alone))
            n += int(alone.sum())
            left = left[~alone[at]]
        self.table[self._slots(keys)] = keys

    @staticmethod
    def _places(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        x = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0xD1342543DE82EF95 % (1 << 64)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(m)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._places(keys[open_], level, len(alone))
            hit = alone[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys that are all in the table; any other key is an error."""
        found = self._slots(keys)
        if (found < 0).any() or not np.array_equal(self.table[found], keys):
            raise ValueError("a key that is not in the table")
        return found


def scatter_counts(digests: np.ndarray, links: np.ndarray, depth: np.ndarray, n_bytes: np.ndarray, conv: np.ndarray) -> dict[str, np.ndarray]:
    """Flat arrays by slot from the prefixes of a shard, a row for each conversation and depth.

    digests: two numbers a row; links: four, the digest of the parent and of the last turn.
    """
    table = PerfectHash(np.unique(digests, axis=0))
    slot, n = table.slots(digests), len(table.table)
    out = {"digests": table.table, "links": np.empty((n, 4), np.uint64), "depth": np.empty(n, np.int64), "n_bytes": np.empty(n, np.int64), "n_convs": np.bincount(slot, minlength=n), "conv": np.full(n, np.iinfo(np.int64).max)}
    out["links"][slot], out["depth"][slot], out["n_bytes"][slot] = links, depth, n_bytes
    if not np.array_equal(out["links"][slot], links):
        raise ValueError("two prefixes have one digest")
    np.minimum.at(out["conv"], slot, conv)
    return out


def add_up(digests: np.ndarray, parents: np.ndarray, depth: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sum of values over its subtree, and the row of its parent (its own for a root), of distinct digests.

    values has a column for each quantity; the parents of all rows but roots (depth 0) are rows too.
    """
    table = PerfectHash(digests)
    slot, n = table.slots(digests), len(digests)
    row = np.empty(n, np.int64)
    row[slot] = np.arange(n)
    up = np.arange(n)
    below = depth > 0
    up[below] = row[table.slots(parents[below])]
    sums, order = values.copy(), np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for rows in np.split(order, edges):
        if len(rows) and depth[rows[0]] > 0:
            np.add.at(sums, up[rows], sums[rows])
    return sums, up


def _number(blocks: bytes | bytearray, width: int) -> np.ndarray:
    return np.frombuffer(bytes(blocks), np.uint64).reshape(-1, width)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, {"int": pa.int32(), "long": pa.int64()}[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _signed(x: np.ndarray) -> list[np.ndarray]:
    return list(np.ascontiguousarray(x.T).view(np.int64))


def shared_turns(conv: int) -> int:
    """How many first turns a conversation takes over."""
    return zlib.crc32(str(conv).encode()) % 9


def _count_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (first, conv, turn, n_bytes), by group, its first conversation before the others, and turns in order."""
    digests, links, depths, sizes, convs = bytearray(), bytearray(), [], [], []
    ends: list[tuple[bytes, int]] = []
    now, group, head, taken, at, depth, node = None, None, [], 0, 0, 0, ROOT
    blake = hashlib.blake2b

    def add(turn: bytes, size: int) -> None:
        nonlocal node, depth, digests, links
        links += node
        links += turn
        node = blake(node + turn, digest_size=16).digest()
        digests += node
        depth += 1
        depths.append(depth)
        sizes.append(size)
        convs.append(now)

    for batch in batches:
        for first, conv, turn, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != now:
                if now is not None:
                    ends.append((node, now))
                if first != group:
                    group, head = first, []
                now, taken, at, depth, node = conv, shared_turns(conv), 0, 0, ROOT
                digests += ROOT
                links += ROOT + ROOT
                depths.append(0)
                sizes.append(0)
                convs.append(conv)
                if conv != first:
                    for t in head[:taken]:
                        add(*t)
            at += 1
            if conv == first and at <= 8:
                head.append((turn, size))
            if conv == first or at > taken:
                add(turn, size)
    if now is None:
        return
    ends.append((node, now))
    shard, found = TaskContext.get().partitionId(), scatter_counts(_number(digests, 2), _number(links, 4), np.array(depths), np.array(sizes), np.array(convs))
    n = len(found["conv"])
    yield _batch(COUNTED, [np.full(n, shard), *_signed(found["digests"]), *_signed(found["links"]), found["depth"], found["n_bytes"], found["n_convs"], found["conv"]])
    none = pa.nulls(len(ends), pa.int64())
    yield _batch(COUNTED, [pa.nulls(len(ends), pa.int32()), *_signed(_number(b"".join(d for d, _ in ends), 2)), *[none] * 7, [c for _, c in ends]])


def _sum_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, a, b, pa, pb, depth, own, saved, leaf, conv, n_convs, n_children) of whole shards, one shard after another."""

    def summed(shard: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(shard).combine_chunks()
        c = {k: t[k].to_numpy() for k in t.column_names}
        pair = lambda x, y: np.stack([c[x], c[y]], axis=1).astype(np.int64).view(np.uint64)
        own = c["own"].astype(bool)
        sums, up = add_up(pair("a", "b"), pair("pa", "pb"), c["depth"], np.stack([c["saved"], c["leaf"]], axis=1) * own[:, None])
        known = lambda x, m=~own: pa.array(x, pa.int64(), mask=m)
        return _batch(SUMMED, [c["a"], c["b"], sums[:, 0], sums[:, 1], known(c["conv"]), known(c["depth"]), known(c["conv"][up], ~own | (c["depth"] == 0)), known(c["n_convs"]), known(c["n_children"])])

    held, now = [], None
    for batch in batches:
        shards = batch.column(0).to_numpy()
        for part in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
            if not len(part):
                continue
            if held and shards[part[0]] != now:
                yield summed(held)
                held = []
            now = shards[part[0]]
            held.append(batch.slice(int(part[0]), len(part)))
    if held:
        yield summed(held)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, ids) by node and number; a node's texts of ids are hashed one after another and never held together."""
    node, sha, out = None, None, ([], [], [])

    def close() -> None:
        for c, v in zip(out, (*node, sha.hexdigest()), strict=True):
            c.append(v)

    for batch in batches:
        for a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, b) != node:
                if node:
                    close()
                node, sha = (a, b), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["a", "b", "ends_sha256"])
        out = ([], [], [])
    if node:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["a", "b", "ends_sha256"])


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each node of the rebuilt conversations' trie.

    A conversation c is rebuilt from the first h turns of conversation c - c % 5 (h: the CRC-32 of c's decimal form,
    modulo 9) and its own turns after its first h.  conv_id: the smallest member; depth; parent_conv_id: that of the parent
    (null for the root); n_convs: members; n_children; n_leaves: childless nodes of the subtree; saved_tokens: over the
    subtree, bytes of each node's last text for every member but one; ends_sha256: of the ids of the members that end
    here, ascending, joined by commas.
    """
    use_checkpoints(conversations.sparkSession)
    rows = picked(conversations, "conv_id", "turn", "role", "text").toDF("conv", "turn", "role", "text").where("conv is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    conv = F.col("conv").cast("long")
    turns = rows.select((conv - conv % 5).alias("first"), conv.alias("conv"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    n = max(conversations.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // shard_turns))
    dealt = turns.repartition(n, "first").sortWithinPartitions("first", F.col("conv") != F.col("first"), "conv", F.asc_nulls_first("turn"), "digest")
    counted = dealt.select("first", "conv", "digest", "n_bytes").mapInArrow(_count_shard, COUNTED).checkpoint()

    # Nodes over all shards.
    local, ends = counted.where("shard is not null"), counted.where("shard is null").select("a", "b", "conv")
    link = ("pa", "pb", "ta", "tb", "depth", "n_bytes")
    same = F.lit(True)
    for c in link:
        same = same & (F.min(c) == F.max(c))
    nodes = local.groupBy("a", "b").agg(*(F.min(c).alias(c) for c in link), F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv"), F.min_by("shard", "conv").alias("home"), same.alias("same"))
    nodes = nodes.withColumn("depth", F.when(F.col("same"), F.col("depth")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long")))
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.select("a", "b", "home", "conv", "n_convs", "n_children", "depth", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"))
    known = local.select("shard", "a", "b", "pa", "pb").join(nodes, ["a", "b"])
    known = known.select("shard", "a", "b", "pa", "pb", "depth", (F.col("shard") == F.col("home")).cast("int").alias("own"), "saved", "leaf", "conv", "n_convs", "n_children")
    sums = known.repartitionById(n, F.col("shard") % n).sortWithinPartitions("shard").mapInArrow(_sum_shards, SUMMED)
    total = sums.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("saved", "leaves")), *(F.max(c).alias(c) for c in ("conv", "depth", "parent_conv", "n_convs", "n_children")))

    # Members that end at a node: in texts of neighbouring ids first.
    near = ends.groupBy("a", "b", F.shiftright("conv", ENDS).alias("near")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    hashed = near.repartition(n, "a", "b").sortWithinPartitions("a", "b", "near").select("a", "b", "ids").mapInArrow(_hash_ends, "a long, b long, ends_sha256 string")
    return total.join(hashed, ["a", "b"], "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
