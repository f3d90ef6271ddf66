"""The text operators against brute force, round trips and held-out accuracy, with nulls, ties, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontam, htmltext, langid, lengths, linededup, neargroups, quality, secrets, simhash, substring
from weftgraph.llm.queries import QUERIES, tokenizer_path

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, fp long, bucket int, keys string, spans string"


def words(t):
    return re.findall(WORD, t or "")


def rows_of(texts):
    return [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}", 1, 2, "k", "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    vocabulary = ["alpha", "Beta", "gamma!", "delta", "épée", "zeta,", "eta", "Theta", "iota", "#kappa"]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 120))) for _ in range(60)]
    base += [base[3], base[3], base[5] + " more words here", "\n".join([base[7], base[7]]), "", None, "   \n\t ", "one two", "…", "12345", base[9] * 30]
    return base


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(docs, texts, empty):
    def fp(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return 0
        sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fp(t) for t in texts]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = simhash.near_duplicates(docs).orderBy("doc_id").toPandas()
    assert list(got.fingerprint) == [f"{x:016x}" for x in fps]
    assert list(got.component_id) == [find(i) for i in range(len(fps))]
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_within_radius_and_splits_full_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_VARIANTS", 3000)
    import numpy as np

    far = 1 << 63 | 0b111111 << 8
    fps = np.sort(np.array([5, 5 ^ 0b1111 << 30, 5 ^ 0b11111 << 50, far, far ^ 3], np.uint64))
    links = set()
    for bucket in range(16):
        for a, b in [tuple(p) for x in simhash._links(fps, bucket, 4) for p in x.T]:
            links.add((int(fps[a]), int(fps[b])))
    assert {frozenset(p) for p in links} == {frozenset((5, 5 ^ 0b1111 << 30)), frozenset((far, far ^ 3))}


def test_bpe(docs, texts, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    got = bpe.encode(docs, tokenizer_path()).orderBy("doc_id").collect()
    for row, t in zip(got, texts, strict=True):
        e = own.encode(t or "", add_special_tokens=False)
        assert row.ids == e.ids and row.decoded == own.decode(e.ids, skip_special_tokens=False)
    digests = bpe.encode_digests(docs, tokenizer_path()).orderBy("doc_id").collect()
    assert [d.ids_sha256 for d in digests] == [hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in got]
    assert [r.decoded for r in bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()).orderBy("doc_id").collect()] == [r.decoded for r in got]
    assert bpe.encode(empty, tokenizer_path()).count() == 0


def test_bpe_random_and_odd_words():
    from tokenizers import Tokenizer

    own, v, r = Tokenizer.from_file(tokenizer_path()), bpe.Vocabulary(open(tokenizer_path()).read()), random.Random(2)
    odd = ["<|startoftext|>hi<|endoftext|>'s it's 12", "ΣΑΣ Σ İ ǅ ﬁ \x1c\x1d x\x85y", "日本語 한국어 😀", "a" * 500]
    for t in odd + ["".join(r.choice("abcdeéß'-1 ") for _ in range(40)) for _ in range(300)]:
        assert v.encode(t) == own.encode(t, add_special_tokens=False).ids


def test_quality(docs, texts, empty):
    got = quality.quality(docs).orderBy("doc_id").collect()
    for row, t in zip(got, texts, strict=True):
        w = words(t)
        c = collections.Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
        hit = {q for p in range(len(w) - 7) if c[tuple(w[p : p + 8])] > 1 for q in range(p, p + 8)}
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert row.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (row.base_failed and row.kept)
    assert quality.quality(empty).count() == 0


def test_quality_rejects_outliers_of_its_group(spark):
    r = random.Random(7)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(60, 200))) for _ in range(80)]
    junk = [" ".join(f"{w}###$$$" for w in t.split()) for t in texts[:4]]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts + junk)], "doc_id long, text string, lang string, source string")
    kept = {x.doc_id: x.kept for x in quality.quality(df).collect()}
    assert not any(kept[80 + i] for i in range(4)) and sum(kept[i] for i in range(80)) >= 78


def test_substring(docs, texts, empty):
    seen, want = set(), []
    for t in texts:
        w = words(t)
        windows = [tuple(w[p : p + 13]) for p in range(len(w) - 12)]
        gone = {q for p, k in enumerate(windows) if k in seen for q in range(p, p + 13)}
        seen |= set(windows)
        kept = [x for i, x in enumerate(w) if i not in gone]
        want.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    got = substring.removal_digests(docs).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == want
    spans = substring.remove_repeats(docs).orderBy("doc_id").collect()
    assert [sum(s["to"] - s["from"] for s in r.spans) for r in spans] == [w[1] for w in want]
    assert substring.removal_digests(empty).count() == 0


def test_substring_small_chunks_and_null_ids(spark, texts, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_CHARS", 300)
    t = "a b c d e f g h i j k l m n"
    df = spark.createDataFrame([(None, t), (3, t), (9, "x " + t), (9, t), (2**40, t)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring.removal_digests(df).collect()}
    assert got == {(None, 14): 0, (3, 14): 0, (9, 15): 14, (9, 14): 14, (2**40, 14): 14}


def test_decontamination(spark, docs, texts, empty):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(1, " ".join(words(texts[4])[:14])), (2, "one TWO"), (3, None), (4, "!!!"), (5, texts[8])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = low(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[p : p + 10])].add(i)
    want = []
    for t in texts:
        w, hit, found = low(t), set(), set()
        for k, owners in windows.items():
            for p in range(len(w) - len(k) + 1):
                if tuple(w[p : p + len(k)]) == k:
                    hit |= set(range(p, p + len(k)))
                    found |= owners
        want.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    got = [tuple(r)[1:] for r in decontam.contamination(docs, bench).orderBy("doc_id").collect()]
    assert got == want and any(w[4] for w in want)
    assert decontam.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontam.contamination(empty, bench).count() == 0
    assert {r.doc_id for r in decontam.keep_clean(docs, bench).collect()} == {i for i, w in enumerate(want) if not w[4]}


def test_decontamination_blocks_give_the_same(spark, docs, texts, monkeypatch):
    bench = spark.createDataFrame([(i, texts[i]) for i in range(6)], "item_id long, text string")
    once = sorted(map(tuple, decontam.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 200)
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect())) == once


def test_language_id(spark, sf_dir, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    nulls = langid.identify(docs.where("text is null or text rlike '^[^A-Za-zéà]*$'")).collect()
    assert nulls and all(x.lang_pred == "und" and x.score == 0 for x in nulls)
    assert langid.identify(empty).count() == 0
    codes = langid.codewords(9)
    assert len({tuple(c) for c in codes}) == 9


def test_line_dedup(spark, empty):
    shared = "All rights reserved here"
    data = [(i, f"own line {i}\n {shared} \nthe end {i}", "en", f"s{i % 12}") for i in range(24)] + [(90, None, "en", "s1"), (91, "", "en", "s1"), (92, shared, "en", None), (93, "\n" + shared + "\n", "en", "s1")]
    nine = [(100 + i, "nine sites only", "en", f"s{i}") for i in range(9)]
    df = spark.createDataFrame(data + nine, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r.text for r in linededup.remove_boilerplate(df).collect()}
    assert out[3] == "own line 3\nthe end 3" and out[90] is None and out[91] == "" and out[92] == "" and out[93] == "\n" and out[100] == "nine sites only"
    assert linededup.removal_digests(empty.withColumn("text", F.col("text"))).count() == 0


def test_secrets(spark, empty):
    model = secrets.train(secrets.labelled_findings(spark, 1200))
    text = 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### y\ncommit 9233a8ecf7c5b09fe5949719b6b82bc439e9329b done'
    df = spark.createDataFrame([(1, text, "src"), (2, None, None), (3, "", "s"), (4, "plain words only", None)], "doc_id long, text string, source string")
    found = {r.line_no: r for r in secrets.scan(df, model=model).collect()}
    assert found[0].is_secret and not found[1].is_secret and found[0].before == 'x token = "' and len(found) == 2
    assert secrets.scan(empty, model=model).count() == 0


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
    <div class="ad">Buy this now please.</div><article><h1>A &amp; B</h1><p><b>First  line<br>goes on<p>Second &lt;x&gt; &#233;</p><div class="comments"><p>I like it very much</p></div></article>
    <form><p>Sign up for our letter</p></form><footer>&copy; all</footer>"""
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>" + "word " * 40)], "page_id long, url string, html string")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert got[1].text == "A & B\n\nFirst line goes on\n\nSecond <x> é" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].text == ("word " * 40).strip()


def test_lengths(spark):
    values = [0, 3, 3, 7, 300, 5000, 5000, None]
    hist = lengths.histogram(spark.createDataFrame([(v,) for v in values], "n_tokens long"))
    got = {r.n_tokens: r for r in lengths.context_limits(hist).collect()}
    n = [v for v in values if v is not None]
    for limit, r in got.items():
        assert r.truncated_total == sum(min(v, limit) for v in n) and r.docs_longer == sum(v > limit for v in n)
        assert r.tokens_at_most == sum(v for v in n if v <= limit) and r.total_tokens == sum(n) and abs(r.quantile - sum(v <= limit for v in n) / len(n)) < 1e-12
    q = {r.share: r.n_tokens for r in lengths.quantiles(lengths.context_limits(hist), [0.5, 1.0]).collect()}
    assert q == {0.5: 7, 1.0: 5000}
    assert lengths.context_limits(hist.where("false")).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf_dir)
        if name != "bpe_encode_decode":
            assert out.columns == docs.columns
            kept = out.checkpoint()
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids == {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    known = langid.identify(docs).where("not ambiguous").select("doc_id")
    lines = linededup.remove_boilerplate(docs.join(known, "doc_id", "left_semi"))
    first = neargroups.similar_groups(lines).where("kept").select("doc_id")
    clean = decontam.contamination(lines, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select("doc_id")
    assert ids == {r.doc_id for r in first.intersect(clean).collect()}


def test_queries_are_named():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES] == list(range(1, 14))
