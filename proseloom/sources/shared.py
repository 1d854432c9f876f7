"""Intermediate tables in the folder that the whole cluster shares, and joins behind a check of a side's size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast up to this many bytes, by the rows counted and the width of a row.
BROADCAST_BYTES = 48 << 20
#: Bytes that a string or binary value is taken to have in a broadcast side; columns of longer ones are not broadcast.
STRING_BYTES = 64


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on one machine (local master, as in tests) a temporary folder where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='proseloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, what: str) -> DataFrame:
    """Writes a table once and reads it back, so that later steps neither repeat its work nor depend on executors."""
    path = f"{shared_folder(df.sparkSession)}/proseloom/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(*tables: DataFrame) -> None:
    """Deletes the files of settled tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        files = df.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table with fewer files than there are cores, dealt out to all of them; other tables stay as they are.

    A file may be one row group, which one task reads whole, and all that follows without a shuffle stays in that task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def row_bytes(df: DataFrame) -> int | None:
    """Bytes of a row of fixed width, strings at ``STRING_BYTES``; None if a row has arrays, maps or binaries, whose length is open."""
    out = 16

    def add(kind: T.DataType) -> bool:
        nonlocal out
        if isinstance(kind, T.StructType):
            return all(add(f.dataType) for f in kind)
        out += STRING_BYTES if isinstance(kind, T.StringType) else 8
        return not isinstance(kind, (T.ArrayType, T.MapType, T.BinaryType))

    return out if all(add(f.dataType) for f in df.schema) else None


def small(df: DataFrame, weight=None) -> DataFrame:
    """A broadcast hint for a table whose bytes were counted and lie within ``BROADCAST_BYTES``; others shuffle.

    Rows of fixed width are counted up to the bound; for other rows ``weight`` is a column with a row's bytes.
    """
    width = row_bytes(df)
    if width is not None:
        most = BROADCAST_BYTES // width
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    if weight is None:
        return df
    held = df.agg(F.coalesce(F.sum(weight.cast("long") + 16), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= BROADCAST_BYTES else df
