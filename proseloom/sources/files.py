"""Sources and sinks: text trees, labelled corpora, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.functions import globs

#: What a scan leaves out, and the extensions it reads.
EXCLUDED = ["**/node_modules/**", "**/dist/**", "**/.next/**", "**/.git/**", "**/results/**", "**/coverage/**", "**/LICENSE*", "**/CHANGELOG.md"]
EXTENSIONS = "md mdx tsx jsx css scss ts js mjs cjs mts cts json yaml yml toml".split()


def selected(path: Column, include: list[str], exclude: list[str] = EXCLUDED) -> Column:
    """Included, and neither the path nor a folder above it excluded."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    out = F.exists(above, lambda p: globs.matches_any(p, exclude) | globs.matches_any(F.concat(p, F.lit("/")), exclude))
    return globs.matches_any(path, include) & ~out


def read_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] = EXCLUDED) -> DataFrame:
    """Text files under a folder: file (path below the root), text.  Paths are filtered before texts are decoded."""
    wanted = include or [f"**/*.{x}" for x in EXTENSIONS] + ["**/.env", "**/.env.*"]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    named = raw.withColumn("file", F.element_at(F.split(F.col("path"), r"\Q" + base + r"\E"), -1))
    return named.where(selected(F.col("file"), wanted, exclude)).select("file", F.decode("content", "UTF-8").alias("text"))


CORPUS_SCHEMA = "id string, rule string, text string, label boolean, labelSource string, split string, family string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled items from JSON lines; rows that do not fit the schema fail the read, repeated ids fail the check."""
    items = spark.read.schema(CORPUS_SCHEMA).option("mode", "FAILFAST").json(path)
    if items.groupBy("id", "rule").count().where("count > 1").limit(1).count():
        raise ValueError("an item id is repeated")
    return items


def json_report(findings: DataFrame) -> DataFrame:
    """One JSON object a finding, keys in fixed order."""
    return findings.select(F.to_json(F.struct(*sorted(findings.columns))).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF results of unsuppressed findings: level note for review, else warning or error by severity."""
    level = F.when(F.col("band") == "review", "note").when(F.col("severity") == "major", "error").otherwise("warning")
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    return findings.where(~F.col("suppressed")).select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.array_join("evidence", ", ").alias("text")).alias("message"), place.alias("locations"))).alias("value"))
