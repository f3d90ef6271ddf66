"""Connected components by alternating large and small stars, for graphs of any size.

Each round needs one grouped minimum and one join per star, both of which Spark splits when a key is hot; the
number of rounds grows with the logarithm of the longest path.  Nothing but two counters reaches the driver.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder that the session names; choose one only where a local session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least")).withColumn("least", F.least("u", "least")).checkpoint()  # so that the join below can split a hub's rows
    if large:  # every larger neighbour of u is hung below u's smallest neighbour: (b, u) are the edges with b > u
        moved = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b"))
    else:  # u and its smaller neighbours are hung below the smallest
        moved = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of an undirected link; component is the smallest node.

    Links with a null end and loops say nothing about other nodes and are left out.
    """
    ensure_checkpoint_dir(links.sparkSession)
    a, b = F.col(left), F.col(right)
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct().checkpoint()
    before = None
    while True:
        edges = _stars(_stars(edges, large=True), large=False).checkpoint()
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select("b", "b").distinct())
        before = now
