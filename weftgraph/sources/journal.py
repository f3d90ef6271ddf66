"""Operation logs in rotated segments of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPERATION = "verb string, ts double, session string, actor string, args string"


def write_journal(ops: DataFrame, folder: str, order: str = "seq", segments: int | None = None) -> None:
    """Write (verb, ts, session, actor, args: a struct, map or JSON text) as segments (below 100,000) whose names sort in the order of the log."""
    dealt = ops.repartitionByRange(segments, order) if segments else ops.repartitionByRange(order)
    fields = [c for c in ("verb", "ts", "session", "actor", "args") if c in ops.columns]
    dealt.sortWithinPartitions(order).select(F.to_json(F.struct(*fields)).alias("value")).write.text(folder)


def read_lines(spark: SparkSession, path: str, tail: str | None = None) -> DataFrame:
    """(seq, segment, line, value): the lines of all segments in append order, blank ones left out.

    Segments are ordered by name, those whose name matches the regular expression `tail` (the live end) behind all others.
    Files are read in splits, in parallel: a line's place is that of its split (one row each is put in order) and its number in
    there, so seq and line are the same for any size of the splits.  seq counts from 0 over all segments.
    """
    name = F.col("_metadata.file_name")
    raw = spark.read.text(path).select("value", name.alias("segment"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    blocks = raw.groupBy("segment", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.sum((F.trim("value") != "").cast("long")).alias("filled"))
    live = F.col("segment").rlike(tail) if tail else F.lit(False)
    before = Window.orderBy(live, "segment", "block").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("segment", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(here), F.lit(0)).alias("above"))
    within = F.col("place") - F.col("first")
    rows = raw.join(F.broadcast(blocks), ["segment", "block"]).where(F.trim("value") != "")  # a row for each split
    return rows.select((F.col("base") + within).alias("seq"), "segment", (F.col("above") + within).alias("line"), "value")


def read_journal(spark: SparkSession, path: str, tail: str | None = None) -> DataFrame:
    """(seq, segment, line, verb, ts, session, actor, args): operations in append order; args stays JSON text.

    A line that is no JSON object gives an operation without a verb, which replay counts as skipped.
    """
    return read_lines(spark, path, tail).withColumn("op", F.from_json("value", OPERATION)).select("seq", "segment", "line", "op.*")


def with_arguments(ops: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """ops with the string arguments of these names as columns in place of args; `actor` and `session` of the operation stay."""
    known = F.from_json("args", ", ".join(f"`{f}` string" for f in fields))
    kept = [c for c in ops.columns if c not in ("args", *fields)]
    both = {f: F.coalesce(known[f], F.col(f)) if f in ops.columns else known[f] for f in fields}
    return ops.select(*kept, *(v.alias(f) for f, v in both.items()))
