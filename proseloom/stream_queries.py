"""A query over a stream: the documents as versions of files, some of them changed or deleted by a second one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom import queries as rules
from proseloom.plans.lint import run_lint
from proseloom.registry import register
from proseloom.sources.shared import shared_folder
from proseloom.streaming import scan


@register(
    rules._OUTCOMES
    + """, numbered AS (SELECT 'docs/' || source || '/' || doc_id || '.md' AS file, doc_id, len(string_split(text, chr(10))) + 1 AS line FROM documents WHERE text IS NOT NULL)
SELECT f.file, f.line, f.rule_id FROM findings f JOIN numbered n USING (file) WHERE n.doc_id % 10 <> 0
UNION ALL SELECT file, line, 'typography-ellipsis' FROM numbered WHERE doc_id % 10 = 1"""
)
def incremental_scan(spark: SparkSession, d: str) -> DataFrame:
    """Findings after the stream: one file in ten was deleted, one in ten got a further line."""
    path = f"{d}/documents.parquet"
    # A pattern, as a path that is one file is no folder to watch.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/documents.parque[t]")
    file = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file")
    version = lambda text, seq: F.struct(text.alias("text"), F.lit(seq).alias("seq"))
    second = F.when(F.col("doc_id") % 10 == 0, version(F.lit(None).cast("string"), 2)).when(F.col("doc_id") % 10 == 1, version(F.concat("text", F.lit("\nmore...")), 2))
    versions = stream.select(file, F.explode(F.array_compact(F.array(version(F.col("text"), 1), second))).alias("v")).select("file", "v.text", "v.seq")
    folder = f"{shared_folder(spark)}/proseloom/scan-{uuid.uuid4().hex}"
    scan.scan_changes(versions, f"{folder}/out", f"{folder}/checkpoint", lambda files: run_lint(files).findings.select("file", "line", "rule_id")).awaitTermination()
    return scan.current_findings(spark, f"{folder}/out").select("file", "line", "rule_id")
