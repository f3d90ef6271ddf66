"""Near groups are those of all pairs that meet, also where many texts share a variant."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import neargroups


def test_pairs_beside_the_head_of_a_variant_are_verified(spark, monkeypatch):
    words = lambda g: [f"g{g}w{i}" for i in range(80)]
    texts = [" ".join(words(g)) + end for g in range(6) for end in ("", " end", " more end")]
    real = neargroups._prints
    monkeypatch.setattr(neargroups, "_prints", lambda rows: real(rows).withColumn("print", F.lit(bytes(4 * neargroups.TABLES))))  # all in one variant
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in neargroups.keep_one(docs).collect()} == {3 * g for g in range(6)}


def test_all_pairs_of_different_roots_meet_in_parts_of_any_size(monkeypatch):
    rng = np.random.default_rng(7)
    band = rng.choice(np.array([3, 19, 35, 1 << 20 | 3], np.uint32), 60)
    check = rng.choice(np.array([0, 1, 2**64 - 1], np.uint64), 60)
    root = rng.integers(0, 9, 60)
    near = lambda i, j: np.bitwise_count(band[i] ^ band[j]) <= 2 and np.bitwise_count(check[i] ^ check[j]) <= neargroups.CHECK_BITS
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if root[i] != root[j] and near(i, j)}
    low = lambda b: np.flatnonzero(np.bitwise_count((band & np.uint32(15)) ^ np.uint32(b)) <= 1)
    for most in (neargroups.MOST_VARIANTS, 500, 7):
        monkeypatch.setattr(neargroups, "MOST_VARIANTS", most)
        got = {tuple(p) for b in range(16) for x in neargroups._across(band, check, root, b, 4, low(b)) for p in x.T.tolist()}
        assert got == want and want
