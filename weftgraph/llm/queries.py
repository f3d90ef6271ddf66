"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, conversation_sql, decontam, htmltext, langid, lengths, linededup, prefixtrie, quality, secrets, simhash, substring, tokenfiles, turnrepair

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(_read(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.removal_digests(_read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", "nth", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_read(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bpe.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path())
    return lengths.context_limits(lengths.histogram(counts))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.report(turnrepair.damage(_read(spark, sf_dir, "conversations")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.written_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), END_ID)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(_read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_bpe_encode_decode,
        op3_quality_rules,
        op4_substring_dedup,
        op5_benchmark_decontamination,
        op6_language_id,
        op7_line_dedup,
        op8_secret_scan,
        op9_html_extraction,
        op10_token_counts,
        op11_conversation_repair,
        op12_token_files,
        op13_prefix_trie,
    )
}

#: op1-op6, op8-op10 and op12 are not SQL (XXH64, tokenizers, trained models, automata); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": linededup.ORACLE_SQL,
    "op11_conversation_repair": conversation_sql.CONVERSATION_REPAIR,
    "op13_prefix_trie": conversation_sql.PREFIX_TRIE,
}
