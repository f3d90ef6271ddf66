"""Near-duplicate pairs: candidates that cannot reach the score are left out before they are shuffled, and none that can."""

import math
import random

from pyspark.sql import functions as F

from weftgraph.operators import audit

LEAST = 0.8


def test_candidates_that_share_too_little_go_and_pairs_stay_whole(spark):
    rng = random.Random(5)
    common = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.sample(common, rng.randint(5, 40))) for _ in range(80)]
    texts += [f"{t} extra{i}" for i, t in enumerate(texts[:25])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: frozenset(t.split()) for i, t in enumerate(texts)}
    assert len(set(sets.values())) == len(texts)
    weight = {w: math.log(len(texts) / sum(w in s for s in sets.values())) + 1 for s in sets.values() for w in s}
    norm2 = {i: sum(weight[w] ** 2 for w in s) for i, s in sets.items()}
    want = {}
    for a in sets:
        for b in range(a + 1, len(texts)):
            score = sum(weight[w] ** 2 for w in sets[a] & sets[b]) / math.sqrt(norm2[a] * norm2[b])
            if score >= LEAST:
                want[a, b] = round(score, 4)
    got = {(r.class_a, r.class_b): r.score for r in audit.near_duplicate_pairs(docs, "doc_id", "text", LEAST).collect()}
    assert got == want and len(want) >= 15


def test_texts_of_unlike_weight_are_no_candidates(spark):
    rows = [(i, "rare", float(5 + 20 * i), float(5 + 20 * i)) for i in range(30)]  # squared norms 5, 25, 45, ...
    index = spark.createDataFrame(rows, "id long, token string, low double, norm2 double")
    met = {tuple(r) for r in audit.candidate_pairs(index, LEAST).collect()}
    assert met == {(a, b) for a in range(30) for b in range(a + 1, 30) if (5 + 20 * a) >= LEAST * math.sqrt((5 + 20 * a) * (5 + 20 * b))}
    late = index.withColumn("low", F.lit(4.0))  # nothing is left to share below the token
    assert audit.candidate_pairs(late, LEAST).count() == 0


def test_entries_number_tokens_densely_and_hold_their_texts(spark):
    rows = spark.createDataFrame([(f"t{i % 50}",) for i in range(125)], "token string").repartition(3)
    found = audit.token_entries(rows, 200).collect()
    assert sorted(r.entry // 201 for r in found) == list(range(50))
    assert {r.token: r.entry % 201 for r in found} == {r.token: r.df for r in found} == {f"t{i}": 3 if i < 25 else 2 for i in range(50)}


def test_rare_tokens_and_copies_give_the_same_pairs(spark, monkeypatch):
    texts = [f"one two three four five six seven own{i % 6}" for i in range(12)] + ["one two three four five six seven own1 more1", "alone", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(audit.near_duplicate_pairs(docs, "doc_id", "text", 0.5).collect())
    assert (1, 12) in {(r.class_a, r.class_b) for r in whole} and {r.class_a for r in whole} <= set(range(6))
    monkeypatch.setattr(audit, "COMMON", 3)
    pairs = audit.near_duplicate_pairs(docs, "doc_id", "text", 0.5)
    assert sorted(pairs.collect()) == whole
