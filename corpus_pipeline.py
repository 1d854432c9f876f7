"""A training-corpus pipeline of five operators: quality rules, line dedup, near duplicates, decontamination, BPE."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.llm import bpe, decontaminate, jaccard, linededup, quality
from proseloom.llm.store import settle, small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: shingles of five words, similarity of 80 % or more.
SHINGLE, PERCENT = 5, 80


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents other than those with the given ids; up to a million ids are broadcast, more are joined by a shuffle."""
    return docs.join(small(gone.select("doc_id").distinct()), "doc_id", "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.kept_documents(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that came earlier go; documents of which nothing with a word is left go."""
    kept = linededup.dedup_lines(docs, carry=("lang", "source"))
    return kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    groups = jaccard.jaccard_components(docs, SHINGLE, PERCENT)
    return _without(docs, settle(groups.where("component_id < doc_id").select("doc_id"), "duplicates"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, settle(decontaminate.contaminated(docs, benchmark).select("doc_id"), "contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays, encoded and decoded again: doc_id, n_tokens and digests of ids and text."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: SQL cannot express the stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
