"""Token files: blocks, shards, the library's ids, and the query against brute force."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weftgraph.llm import queries, tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("ids", [[], [0], [0] * 100, [1, 2, 3], [255, 256], [2**16 - 1, 2**16], [2**32 - 1, 0, 7], list(range(70_000))])
def test_blocks_round_trip(bits, ids):
    ids = np.array(ids, np.uint32)
    planes = tokenfiles.to_planes(ids, bits)
    need = int(ids.max()).bit_length() if len(ids) else 0
    assert len(planes) == (need if bits == 1 else -(-need // 8))
    assert np.array_equal(tokenfiles.from_planes(planes, len(ids), bits), ids)


@pytest.mark.parametrize("bits", [1, 8])
def test_shards_round_trip(bits):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (1, 3, 0, 70_000, 5, 140_000, 1)]
    writer = tokenfiles.ShardWriter(bits)
    for k, d in enumerate(docs):
        writer.add(np.array([k - 2]), np.array([k == 1]), np.array([len(d)]), d)
    content = writer.close()
    for form in (content, content + b"\n"):
        shard = tokenfiles.Shard(form)
        assert shard.doc_ids.tolist() == [-2, -1, 0, 1, 2, 3, 4] and shard.missing.tolist() == [0, 1, 0, 0, 0, 0, 0]
        for k in (3, 0, 5, 2, 6, 1, 4):  # in any order, through the index
            assert np.array_equal(np.concatenate([np.empty(0, np.uint32), *shard.parts(k)]), docs[k])
    with pytest.raises(ValueError):
        tokenfiles.Shard(b"x" * 200)


def test_words_are_encoded_as_whole_texts_are(library):
    rng = np.random.default_rng(5)
    bits = ["a", "\0", "a.", "é),", "x\u0301.", "ñ!?", "\n", "a", "Wort", "l'été", "don't", "x.\nY", "42", "<|endoftext|>", "日本語", "🙂", " ", "　", "\x1c", "\t", "\n", " ", " ", " ", "  ", "\r\n", "'s", "é", "...", "á", " "]
    texts = ["", " ", "  ", "\n", "a b", " a b ", "a  b", "a \n b", "end\n", "x <|endoftext|> y", None, "word " * 50, "a" * 3000, " b" * 40_000 + "  c"]
    texts += ["".join(rng.choice(bits, rng.integers(1, 30))) for _ in range(600)]
    coder = tokenfiles.LibraryEncoder(open(PATH, encoding="utf-8").read())
    for _ in range(2):  # with unknown and with known words
        got = coder.encode(pa.array(texts))
        for t, ids in zip(texts, got, strict=True):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    assert coder.encode(pa.array([], pa.string())) == []


def expected(library, rows, end_id=2):
    """Brute force: rows (doc_id, text) in order; the ids of all documents before each, its length and checksum."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_over_the_whole_table(spark, sf_dir, library):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = queries.QUERIES["op12_token_files"](spark, sf_dir)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema][:4] == ["doc_id bigint", "start bigint", "n_tokens bigint", "ids_crc32 bigint"]
    assert sorted(map(tuple, got.collect())) == expected(library, rows)


@pytest.mark.parametrize("bits", [1, 8])
def test_nulls_repeats_long_texts_and_small_shards(spark, library, bits, tmp_path):
    rows = [(None, "no id"), (None, None), (3, "same row"), (3, "same row"), (-4, None), (-4, ""), (9, "tail " * 30_000), (5, "  odd   spacing \n"), (7, "x"), (8, "<|endoftext|> y")]
    docs = spark.createDataFrame([(a, b, 1, "clash") for a, b in rows], "doc_id int, text string, n_ids int, content string")
    tokenfiles.write(docs, str(tmp_path / "ids"), PATH, 2, bits=bits, shard_ids=4)
    got = tokenfiles.read_digests(spark, str(tmp_path / "ids")).collect()
    whole = {(r.doc_id, r.start): r for r in tokenfiles.read_ids(spark, str(tmp_path / "ids")).collect()}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = whole[r.doc_id, r.start].ids
        assert r.start == at and len(ids) == r.n_tokens and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [None, None, -4, -4, 3, 3, 5, 7, 8, 9]
    want = sorted((str(d), n, c) for d, _, n, c in expected(library, rows))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want


def test_empty_table(spark, tmp_path):
    tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), PATH, 2)
    found = tokenfiles.read_digests(spark, str(tmp_path / "none"))
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count() == 0
