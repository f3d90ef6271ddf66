"""Tables that are derived once and then read again and again, beside the shared checkpoints."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators.components import ensure_checkpoint_dir

_STORED: dict[tuple, tuple[str, str]] = {}  # what was written last: the version of its sources, its folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def version(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of all files below these paths, however deep."""
    jvm, conf, seen = spark._jvm, spark._jsc.hadoopConfiguration(), hashlib.md5()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        files, found = at.getFileSystem(conf).listFiles(at, True), []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}\n")
        seen.update("".join(sorted(found)).encode())
    return seen.hexdigest()


def stored(spark: SparkSession, name: str, rows: DataFrame, by: str | None, sources: list[str]) -> DataFrame:
    """rows, read back from Parquet files dealt by a column, so that filters on it leave out whole folders.

    They are written when they are first asked for in an application, and again when a file of the sources has changed.
    """
    key = (spark.sparkContext.applicationId, name, *sources)
    stamp = version(spark, sources)
    if _STORED.get(key, ("", ""))[0] != stamp:
        folder = f"{shared_folder(spark)}/store/{name}-{uuid.uuid4()}"
        (rows.write.partitionBy(by) if by else rows.write).parquet(folder)
        _STORED[key] = stamp, folder
    found = spark.read.option("basePath", _STORED[key][1]).schema(rows.schema).parquet(_STORED[key][1])
    return found.select(*rows.columns)
