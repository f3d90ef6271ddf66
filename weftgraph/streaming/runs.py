"""Running a streaming query over all that has arrived, with its results in a table beside the shared checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.store import shared_folder


def place(df: DataFrame) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    return f"{shared_folder(df.sparkSession)}/streams/{uuid.uuid4()}"


def settle(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Rows of every micro-batch so far, with its number as batch.

    The checkpoint in the folder is the cursor: called again, only what has arrived since is read.  A batch that is
    run again after a failure replaces its own rows, so each batch counts once.
    """

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key of a stream in update mode."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))
