"""From raw documents to token ids: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontam, langid, linededup, neargroups
from weftgraph.llm.arrow import use_checkpoints
from weftgraph.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, no letter in it, or one that the decoder flags as ambiguous."""
    return langid.keep_identified(docs)


def remove_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites leave the texts; n_chars follows."""
    cleaned = linededup.remove_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (five-word shingles, 0.8 or more) stays, the one with the smallest id."""
    return neargroups.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their decoding."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_shared_lines),
    ("simhash_near_dedup", keep_one_near_duplicate),
    ("benchmark_decontamination", remove_contaminated),
    ("bpe_encode_decode", tokenize),
]

#: Language models, fingerprints and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_checkpoints(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = docs.checkpoint()
    return docs
