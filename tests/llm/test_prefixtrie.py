"""The prefix trie: perfect hashes, sums in arrays, and the query against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from weftgraph.llm import prefixtrie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 20_000])
def test_perfect_hash_is_minimal_and_knows_its_keys(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, (n, 2)).astype(np.uint64), axis=0)
    table = prefixtrie.PerfectHash(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        table.slots(np.array([[1, 2]], np.uint64))


def test_equal_digests_of_different_prefixes_are_an_error():
    digests, links = np.array([[7, 7], [7, 7]], np.uint64), np.array([[0, 0, 1, 1], [0, 0, 2, 2]], np.uint64)
    with pytest.raises(ValueError):
        prefixtrie.scatter_counts(digests, links, np.ones(2), np.ones(2), np.arange(2))


def brute(rows):
    """All nodes from whole rebuilt conversations; rows: (conv_id, turn, role, text) with distinct turns."""
    own = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    members = defaultdict(list)
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    sha = lambda m: hashlib.sha256(",".join(map(str, sorted(m))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -(10**9), len(m), children[k], leaves[k], saved[k], sha([c for c in m if len(built[c]) == len(k)])) for k, m in members.items())


def got(df):
    return sorted(tuple(-(10**9) if c == "parent_conv_id" and r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def test_query_over_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op13_prefix_trie"](spark, sf_dir)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in found.schema][:8] == [f"{c} {'string' if c == 'ends_sha256' else 'bigint'}" for c in COLUMNS]
    assert got(found) == brute(rows)


def test_common_turns_nulls_and_negative_ids_in_small_shards(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in [*range(-12, 60), 5000, 5003, 9007]:
        if c in (10, 25):
            continue  # conversations that others would take turns from
        hot = c % 3 == 0
        for t in range(int(rng.integers(1, 12))):
            same = hot and t < 6
            rows.append((c, None if t == 0 else t, None if t == 1 else ("user", "assistant")[t % 2], None if t == 2 and not same else f"é{t}" if same else f"text {rng.integers(0, 3)}"))
    rows.append((None, 0, "user", "nobody's"))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, depth int")
    for shard_turns in (7, 100, 10**6):
        assert got(prefixtrie.trie(df.repartition(3), shard_turns)) == brute(rows)


def test_one_long_conversation_and_copies(spark):
    rows = [(4000 + k * 5, t, "user", "same") for k in range(300) for t in range(3)] + [(1, t, "user", str(t)) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert got(prefixtrie.trie(df, 50)) == brute_long(rows)


def brute_long(rows):
    """As brute(), for one chain and copies of one conversation."""
    chain = [r for r in rows if r[0] == 1]
    copies = sorted({r[0] for r in rows if r[0] != 1})
    h = zlib.crc32(b"1") % 9
    chain = chain[h:]  # conversation 0 does not exist
    sha = lambda m: hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()
    n = len(copies)
    out = [(1, 0, -(10**9), n + 1, 2, 2, sum((n - 1) * 4 for _ in range(3)), sha([]))]
    out += [(1, d, 1, 1, int(d < len(chain)), 1, 0, sha([1] if d == len(chain) else [])) for d in range(1, len(chain) + 1)]
    out += [(copies[0], d, 1 if d == 1 else copies[0], n, int(d < 3), 1, (n - 1) * 4 * (4 - d), sha(copies if d == 3 else [])) for d in (1, 2, 3)]
    return sorted(out)


def test_conversation_without_turns_and_repeated_rows(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    df = spark.createDataFrame([(c, 0, "user", "x"), (c, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert got(prefixtrie.trie(df)) == [(c, 0, -(10**9), 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    same = spark.createDataFrame([(5, 0, "user", "x"), (5, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [r[1] for r in got(prefixtrie.trie(same))] == [0, 1, 2]


def test_empty_table(spark):
    assert prefixtrie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_sql_gives_the_same_rows(sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    rows = db.execute(queries.ORACLE_SQL["op13_prefix_trie"]).fetchall()
    assert sorted([tuple(-(10**9) if x is None else x for x in r) for r in rows]) == brute(db.execute("select conv_id, turn, role, text from conversations").fetchall())
