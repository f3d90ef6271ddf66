"""Spans, their sources and what verification is for."""

import random

import numpy as np

from weftgraph.llm import substring


def brute(rows, width=13):
    """n_removed of each row (id, text): windows that also start in a row with a smaller id."""
    seen = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            seen[k] = min(i, seen.get(k, i))
    out = []
    for i, t in rows:
        w = t.split()
        out.append(len({q for p in range(len(w) - width + 1) if seen[tuple(w[p : p + width])] < i for q in range(p, p + width)}))
    return out


def branching(seed, n=40):
    """Texts that share pieces in other orders, so that paths part and meet, and change their source on the way."""
    r = random.Random(seed)
    pieces = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randint(8, 30))) for _ in range(12)]
    return [(i // 2 * 3 + i % 2 * 50, " ".join(r.choice(pieces) for _ in range(r.randint(1, 8)))) for i in range(n)]


def test_branching_paths_against_brute_force(spark):
    for seed in (1, 2):
        rows = branching(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = sorted(zip((i for i, _ in rows), (len(t.split()) for _, t in rows), brute(rows), strict=True))
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.removal_digests(df).collect()) == want
        assert sum(w[2] for w in want) > 1000


def test_keys_only_propose(spark, monkeypatch):
    """With keys of one byte most proposals are wrong: nothing unlike is removed all the same."""
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(200))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(substring, "KEY_BYTES", 1)
    assert substring.removal_digests(df).where("n_removed > 0").count() == 0


def test_found_in_whole_and_by_window():
    words = [f"w{i}".encode() for i in range(30)]
    joined = lambda w: b" " + b" ".join(w) + b" "
    assert substring.found_in(words, joined([b"x", *words, b"y"]), 13) == [(0, 30)]
    parted = joined([*words[:20], b"x", *words[8:25]])
    assert substring.found_in(words, parted, 13) == [(i, i + 13) for i in range(13)]
    assert substring.found_in(words, joined([b"ww0", *words[1:]]), 13)[0] == (1, 14)


def test_packed_rows_come_back():
    r = np.random.default_rng(3)
    bucket, doc = r.integers(0, 3, 5000), np.sort(r.integers(0, 7, 5000))
    ids, key = np.array([5, 6, 9, 2**40, 2**40 + 1, 2**50, 2**62]), r.integers(0, 2**56, 5000, dtype=np.uint64)
    back = [(b, *x) for b, *row in substring._packed(bucket, doc, key, ids) for x in zip(*(a.tolist() for a in substring._unpacked(*row)), strict=True)]
    assert sorted(back) == sorted(zip(bucket.tolist(), ids[doc].tolist(), key.tolist(), strict=True))
    for values in (np.array([7, 7, 9]), np.array([-5, 2**60])):
        least, raw = substring._offsets(values)
        assert (least + substring._wide(raw, len(values))).tolist() == values.tolist()
