"""Substring removal where one id stands on several rows."""

import pytest

from weftgraph.llm import substring

TEXT = "a b c d e f g h i j k l m n o p"


@pytest.mark.parametrize("chars", [6_000_000, 10])
def test_repeated_rows_of_one_id_lose_nothing(spark, monkeypatch, chars):
    monkeypatch.setattr(substring, "CHUNK_CHARS", chars)
    df = spark.createDataFrame([(5, TEXT), (5, TEXT), (5, "z " + TEXT)], "doc_id long, text string").coalesce(1)
    assert sorted((r.n_words, r.n_removed) for r in substring.removal_digests(df).collect()) == [(16, 0), (16, 0), (17, 0)]
    more = df.unionAll(spark.createDataFrame([(4, TEXT), (7, TEXT), (7, TEXT)], df.schema)).coalesce(1)
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.removal_digests(more).collect()) == [(4, 16, 0), (5, 16, 16), (5, 16, 16), (5, 17, 16), (7, 16, 16), (7, 16, 16)]
