"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def use_checkpoints(spark: SparkSession) -> None:
    """Leave the cluster's shared checkpoint folder as it is; choose one only where none is set in a local session (tests)."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `size` bytes, one row at least, so that Python objects of few rows exist at a time."""
    step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_columns(df: DataFrame, schema: str, start: Callable[[], Callable[..., list]], size: int = 3_000_000) -> DataFrame:
    """Run a vectorised function over slices of the Arrow batches of df.

    start() is called once in each task and returns a function that gets one Python list per column of df and
    returns one list (or numpy or Arrow array) per column of schema.  Nothing is kept between slices but what
    start() builds, so memory is bounded by one Arrow batch and one slice of `size` bytes.
    """
    out: StructType = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, fields = None, to_arrow_schema(out)
        for batch in (part for whole in batches for part in slices(whole, size)):
            work = work or start()
            columns = work(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return df.mapInArrow(run, out)


def picked(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that extra columns of any name cannot clash with those that an operator adds."""
    return df.select(*(F.col(f"`{c}`") for c in columns))
