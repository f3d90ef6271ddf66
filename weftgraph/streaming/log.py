"""Streaming forms of the log operators; their settled results equal the batch forms'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import semver


def touch_counts(touches: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(slot, ref, touches) per tumbling window of event time; update mode.  State of a window goes once it can get no more rows."""
    timed = touches.withColumn("at", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", width), "ref").agg(F.count("*").alias("touches"))
    return counts.select(F.unix_timestamp("window.start").alias("slot"), "ref", "touches")


def dedup(ops: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Every operation once; append mode.  ts must be one of the keys: exact repeats then lie within the watermark, however late they come."""
    timed = ops.withColumn("at", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(keys).select(*keys)


def last_state(ops: DataFrame) -> DataFrame:
    """(key, op, content): the last of 'source' and 'retire' of each key by seq, whatever the order of arrival; update mode."""
    last = ops.where(F.col("op").isin("source", "retire")).groupBy("key").agg(F.max_by(F.struct("op", "content"), "seq").alias("s"))
    return last.select("key", "s.op", "s.content")


def best_versions(claims: DataFrame) -> DataFrame:
    """(slot_id, best): the highest version claimed in each slot; update mode.  A lower claim that arrives later is born superseded."""
    return claims.groupBy("slot_id").agg(F.max(semver(F.col("value"))).alias("best"))
