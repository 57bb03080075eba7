"""Shared storage: lineage cuts, size-checked broadcasts and files that executors write.

Everything here writes below ``spark.checkpoint.dir``, the one folder that the
driver and all executors share. Only where that setting is missing (tests) a
folder of this process is set.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that a side may hold to be broadcast.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared folder; its setting is made where it is missing."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="canopyloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            if f"{shared_dir(spark).removeprefix('file:').lstrip('/')}/" in f:
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(conf).delete(path, True)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``limit`` bytes, else as it is.

    ``df`` has to be cheap to count: a table from ``cut`` or a narrow scan. Beyond
    the limit the join stays a shuffle join, whose skewed partitions AQE splits.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def open_fs(uri: str):
    """(file system, path) for files that executors write or read themselves, by pyarrow."""
    from pyarrow import fs

    if "://" not in uri:
        if uri.startswith("file:"):
            uri = "file://" + uri[5:]
        else:
            return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
