"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram answer, for every context limit, how many
documents fit, how many tokens they have and how many are left after truncation.  Lengths are summed in blocks first
and blocks after that, so no task gets more than BLOCK lengths or the list of blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.arrow import use_checkpoints

BLOCK = 256


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): documents by length.  Null lengths are not counted."""
    return lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def context_limits(hist: DataFrame) -> DataFrame:
    """A row for every length that occurs, read as a context limit.

    docs_at_most, tokens_at_most: documents no longer than the limit and their tokens; docs_longer: the rest;
    truncated_total: tokens left if every document is cut at the limit; total_tokens; quantile: the share of documents
    no longer than the limit.  An empty histogram gives no rows.
    """
    use_checkpoints(hist.sparkSession)
    hist = hist.checkpoint()  # as many rows as there are lengths; read twice below, so documents are encoded once
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("b_docs").over(every).alias("total_docs"),
        F.sum("b_tokens").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    joined = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(within), F.lit(0)) + F.col("docs_after")).alias("docs_longer"),
        (F.coalesce(F.sum("tokens").over(within), F.lit(0)) + F.col("tokens_after")).alias("tokens_longer"),
        "total_docs",
        "total_tokens",
    )
    return joined.select(
        "n_tokens",
        "n_docs",
        (F.col("total_docs") - F.col("docs_longer")).alias("docs_at_most"),
        (F.col("total_tokens") - F.col("tokens_longer")).alias("tokens_at_most"),
        "docs_longer",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
        "total_tokens",
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("quantile"),
    )


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that holds at least this share of the documents."""
    one = [limits.where(F.col("quantile") >= s).agg(F.min("n_tokens").alias("n_tokens")).select(F.lit(float(s)).alias("share"), "n_tokens") for s in shares]
    out = one[0]
    for x in one[1:]:
        out = out.unionAll(x)
    return out
