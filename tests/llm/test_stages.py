"""Stages of the pipeline and shapes of input that the other tests leave out."""

import random
import string

import numpy as np
import pytest

from weftgraph.llm import bpe, decontam, langid, linededup, neargroups
from weftgraph.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, row string, gone string, doc string, key string"


def rows(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[k], "r", "g", "d", "k") for k, (i, t) in enumerate(texts)], SCHEMA)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def near_texts():
    r, out = random.Random(9), []
    words = ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 8))) for _ in range(3000)]
    for _ in range(150):
        base = [r.choice(words) for _ in range(r.randint(60, 260))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            copy = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
    r.shuffle(out)
    return out


def test_near_groups_against_brute_force(spark, near_texts):
    sets, parent = [shingles(t) for t in near_texts], list(range(len(near_texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {i for i in range(len(sets)) if find(i) == i}
    got = {r.doc_id for r in neargroups.keep_one(rows(spark, list(enumerate(near_texts))).repartition(3)).collect()}
    assert want <= got  # nothing unlike goes
    assert links > 80 and len(got - want) <= 0.04 * (len(near_texts) - len(want))  # recall of the search


def test_near_groups_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    texts = [(5, "One two THREE"), (3, "one  two\nthree"), (3, "one two three"), (None, "one two three"), (8, None), (9, "  \n"), (7, ""), (1, long), (2, long + " end"), (4, "alone"), (4, "other words here")]
    out = neargroups.keep_one(rows(spark, texts))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in out.collect())
    assert [(i, t[:12]) for _, i, t in got] == [(0, "one two thre"), (1, long[:12]), (3, "one  two\nthr"), (3, "one two thre"), (4, "alone"), (4, "other words "), (7, "")]
    assert neargroups.keep_one(out.where("false")).count() == 0


def test_full_buckets_are_halved(monkeypatch):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**32, 300, dtype=np.uint64).astype(np.uint32)
    band = np.concatenate([base, base ^ np.uint32(1 << 20), base ^ np.uint32(1 << 3 | 1 << 30)])
    check = np.zeros(900, np.uint64)

    def found():
        return {tuple(p) for b in range(16) for x in neargroups._meetings(band, check, b, 4, np.flatnonzero(np.bitwise_count((band & np.uint32(15)) ^ np.uint32(b)) <= 1)) for p in x.T.tolist()}

    whole = found()
    monkeypatch.setattr(neargroups, "MOST_VARIANTS", 500)
    assert found() == whole and {(i, i + 300) for i in range(300)} | {(i, i + 600) for i in range(300)} <= whole


def test_fingerprint_bits_are_majorities():
    sh, at, _ = neargroups.shingle_sets(["a b c d e f g h", None, " ".join(str(i) for i in range(1400))])
    got = neargroups.fingerprints_of(sh, at)
    for t in range(3):
        for k in (0, neargroups._WORDS - 1):
            words = [int(x) for x in neargroups._mixed(sh[at[t] : at[t + 1]] * neargroups._STEPS[k])]
            assert int(got[t, k]) == sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in words) > len(words))


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(~langid.held_out()))


def test_language_stage_rejects_what_no_codeword_is_near(spark, model):
    r = random.Random(3)
    gibberish = [" ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(2, 10))) for _ in range(80)) for _ in range(20)]
    blobs = ["".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(800)) for _ in range(20)]
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(langid.held_out()).where("length(text) >= 40")
    clean = clean.select("doc_id", "text", "lang", "source")
    planted = spark.createDataFrame([(10**9 + i, t, "en", "s") for i, t in enumerate([*gibberish, *blobs, None, "", "12 34"])], clean.schema)
    got = {x.doc_id for x in langid.keep_identified(clean.unionByName(planted), model=model).collect()}
    assert not any(i >= 10**9 for i in got)
    assert len(got) >= 0.995 * clean.count()
    # The verdict is the model's: one that knows nothing keeps nothing, looser bounds keep more.
    assert langid.keep_identified(clean, model=langid.Model([], model.weights, model.codes[:0])).count() == 0
    assert langid.keep_identified(planted, model=model, least_score=0, most_loss=9).count() == 40


def test_decoding_is_the_nearest_codeword(model):
    texts = ["the order of the nation and this", "einung der und heit", "bc df gh"]
    names, scores, losses = model.predict(texts)
    for text, name, score, loss in zip(texts, names, scores, losses, strict=True):
        margin = langid.ngrams(text) @ model.weights
        each = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(margin, code, strict=True)) / len(code) for code in model.codes]
        best, second = sorted(each)[:2]
        assert model.languages[int(np.argmin(each))] == name and abs(loss - best) < 1e-6 and abs(score - (second - best) / second) < 1e-5


def test_language_training_learns_every_label_and_ignores_order(spark, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 2)
    data = [(i if i % 11 else None, f"{'xyzw'[i % 2]}a{i % 70} word{i % 70} " * 5, f"l{i % 70}", "s") for i in range(1400)]
    df = spark.createDataFrame(data + data[:50], "doc_id long, text string, lang string, source string")
    a, b = langid.train(df), langid.train(df.repartition(3, "text"))
    assert len(a.languages) == 70 and np.array_equal(a.weights, b.weights)
    out = langid.identify(df, model=a).collect()
    assert len(out) == 1450 and not any(r.held_out for r in out if r.doc_id is None)
    assert langid.identify(spark.createDataFrame([(1, "x" * 3_000_000, "l1", "s")], df.schema), model=a).first().lang_pred in a.languages


def test_line_dedup_with_clashing_columns_null_ids_and_long_texts(spark):
    shared = "All rights reserved"
    texts = [(i, f"own {i}\n{shared}\nend {i}") for i in range(12)] + [(None, f"x\n{shared}"), (None, f"x\n{shared}"), (3, f"own 3\n{shared}\nend 3"), (50, "\n".join(["line"] * 50_000 + [shared]))]
    df = rows(spark, texts, [f"s{k}" for k in range(12)] + ["s1"] * 4).withColumnRenamed("key", "_row").withColumnRenamed("doc", "_gone")
    out = linededup.remove_boilerplate(df)
    assert out.columns == df.columns and out.count() == 16
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.collect())
    assert got[:2] == [(-1, "x"), (-1, "x")] and [t for i, t in got if i == 3] == ["own 3\nend 3"] * 2 and got[-1][1] == "\n".join(["line"] * 50_000)
    assert linededup.removal_digests(df).where("n_removed > 0").count() == 16


def test_decontamination_of_repeated_and_null_items(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, "zz")], "item_id long, text string")
    df = rows(spark, [(1, f"a {item} b"), (1, f"a {item} b"), (None, item), (2, "clean"), (3, None), (4, "")])
    got = sorted((r.n_hit, r.n_items) for r in decontam.contamination(df, bench).collect())
    assert got == [(0, 0)] * 3 + [(11, 2)] * 3
    assert [r.doc_id for r in decontam.keep_clean(df, bench).orderBy("doc_id").collect()] == [2, 3, 4]
    assert decontam.keep_clean(df, bench).columns == df.columns


def test_encoder_keeps_bounded_bytes_and_long_texts_in_pieces(monkeypatch):
    from tokenizers import Tokenizer

    own, v = Tokenizer.from_file(tokenizer_path()), bpe.Vocabulary(open(tokenizer_path()).read())
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcdeé-1") for _ in range(r.randint(1, 12))) for _ in range(400)) + " <|endoftext|>x" for _ in range(6)] + ["", None, "  "]
    want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(bpe, "PIECE", 100)
    monkeypatch.setattr(bpe, "MOST_WORDS", 64)
    coder = bpe.Encoder(v)
    assert [x.tolist() for x in coder.ids(texts)] == want
    assert coder.held <= 10_000 and len(coder.young) + len(coder.old) < 100


def test_decode_of_null_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1, None, 10**7, -1, 2])], "doc_id long, ids array<int>")
    v = bpe.Vocabulary(open(tokenizer_path()).read())
    assert {r.doc_id: r.decoded for r in bpe.decode(df, tokenizer_path()).collect()} == {1: None, 2: "", 3: v.decode([1, 2])}


def test_pipeline_of_nulls_and_of_nothing(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for name, table in (("some", docs.unionByName(spark.createDataFrame([(None,) * len(docs.columns)], docs.schema))), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    out = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert out.columns == ["doc_id", "ids", "decoded"] and 0 < out.count() < docs.count() and out.where("doc_id is null").count() == 0


def test_simhash_of_null_and_repeated_ids_and_long_texts(spark):
    from weftgraph.llm import simhash

    long = " ".join(f"w{i}" for i in range(150_000))
    df = rows(spark, [(None, "only one here"), (7, "same words in both rows"), (7, "same words in both rows"), (7, "other words in this row"), (9, "same words in both rows"), (None, "same words in both rows"), (1, long), (2, long), (5, None), (4, "")])
    got = sorted((r.doc_id or 0, r.component_id or 0, r.fingerprint) for r in simhash.near_duplicates(df).collect())
    assert [(i, c) for i, c, _ in got] == [(0, 0), (0, 7), (1, 1), (2, 1), (4, 4), (5, 4), (7, 7), (7, 7), (7, 7), (9, 7)]
    assert {f for i, _, f in got if i in (4, 5)} == {"0" * 16}


def test_lengths_beyond_32_bits(spark):
    from weftgraph.llm import lengths

    values = [0, 1, 2**33, 2**33, 2**40 + 5]
    got = {r.n_tokens: r for r in lengths.context_limits(lengths.histogram(spark.createDataFrame([(v,) for v in values], "n_tokens long"))).collect()}
    for limit, r in got.items():
        assert r.truncated_total == sum(min(v, limit) for v in values) and r.total_tokens == sum(values) and r.docs_longer == sum(v > limit for v in values)
