"""Scanning a stream of file versions: each file's findings replace those of its version before, and go when it goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Files that one table of a batch is told by; the batch's number is part of its path, so that a batch run again replaces itself.
_VERSIONS, _FINDINGS = "versions", "findings"


def changed_files(versions: DataFrame, known: DataFrame) -> DataFrame:
    """(file, text, kind, digest) of the versions (file, text, seq) of a batch that add, change or delete (null text) a file.

    Of several versions of a file the one of largest seq counts, of equal ones the last read.  ``known`` has the digest of
    the version that was scanned last, a row a file, "" of files that are gone: columns only, so that no file is a call of
    its own.
    """
    newest = versions.where("file is not null").groupBy("file").agg(F.max_by(F.struct("text"), F.struct(F.col("seq").cast("long")))["text"].alias("text"))
    rows = newest.withColumn("digest", F.coalesce(F.sha2("text", 256), F.lit(""))).join(known.select("file", F.col("digest").alias("_known")), "file", "left")
    before = F.coalesce("_known", F.lit(""))
    kind = F.when(F.col("digest") == "", "deleted").when(before == "", "added").otherwise("changed")
    return rows.where(F.col("digest") != before).select("file", "text", kind.alias("kind"), "digest")


def _known(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """(file, digest): what the batches before this one have scanned last of each file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_VERSIONS}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "file string, digest string")
    versions = spark.read.schema("file string, kind string, digest string, batch long").parquet(f"{folder}/{_VERSIONS}")
    return versions.where(F.col("batch") < number).groupBy("file").agg(F.max_by("digest", "batch").alias("digest"))


def scan_changes(versions: DataFrame, folder: str, checkpoint: str, findings_of: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Starts a query that scans what changed and writes, for each batch, the files' kinds and digests and their findings.

    ``findings_of`` turns files (file, text) into findings with a column file.  The digests are the state: a batch reads
    those of the batches before it.  A batch that is run again writes the same folders again, so that findings are neither
    lost nor doubled.  Runs until all that is there was read.
    """

    def scan(batch: DataFrame, number: int) -> None:
        changed = changed_files(batch, _known(batch.sparkSession, folder, number)).persist()
        changed.select("file", "kind", "digest").write.mode("overwrite").parquet(f"{folder}/{_VERSIONS}/batch={number}")
        findings_of(changed.where("kind <> 'deleted'").select("file", "text")).write.mode("overwrite").parquet(f"{folder}/{_FINDINGS}/batch={number}")
        changed.unpersist()

    return versions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(scan).trigger(availableNow=True).start()


def current_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of the newest version of each file that is still there: those of its last batch."""
    last = spark.read.parquet(f"{folder}/{_VERSIONS}").groupBy("file").agg(F.max_by("kind", "batch").alias("kind"), F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/{_FINDINGS}").join(last.where("kind <> 'deleted'").select("file", "batch"), ["file", "batch"]).drop("batch")
