"""Incremental scans: each micro-batch judges only units that no batch before has judged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def judged_once(stream: DataFrame, known_path: str, judge: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "key") -> StreamingQuery:
    """Writes judge(new rows) to ``known_path``; rows whose key is there already are skipped.

    A batch that runs again after a failure finds its rows written and adds nothing.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark, fresh = batch.sparkSession, batch.dropDuplicates([key])
        known = spark._jvm.org.apache.hadoop.fs.Path(known_path)
        if known.getFileSystem(spark._jsc.hadoopConfiguration()).exists(known):
            fresh = fresh.join(spark.read.parquet(known_path).select(key), key, "left_anti")
        judge(fresh).write.mode("append").parquet(known_path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
