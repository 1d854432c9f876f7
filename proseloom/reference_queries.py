"""Queries over what files name: trees of documents, manifests and sources are made from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.operators import markdown, references
from proseloom.registry import read, register
from proseloom.sources.shared import spread


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents"))


def linked_files(spark: SparkSession, d: str) -> DataFrame:
    """(file, text): each document links to the next one, to one of another folder, to an image, and every fifth out of the root."""
    number = lambda k: (F.col("doc_id") + k).cast("string")
    text = F.concat(
        F.lit("# Links\n\nSee [the next]("), number(1), F.lit(".md#top) and ![a](<img/"), F.col("source"), F.lit(".png>).\n\n- [other](../src"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), number(7), F.lit('.md "t")\n- <http://x.y/z.md> [route](guide)'),
        F.when(F.col("doc_id") % 5 == 0, F.lit(" [out](../../../z.md)")).otherwise(""), F.lit("\n\n```"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("sh"), F.lit("\nnpm run step"), (F.col("doc_id") % 6).cast("string"), F.lit("\n```\n"),
    )
    return _documents(spark, d).select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), text.alias("text"))


_LINKS = """
WITH files AS (SELECT doc_id, source, 'docs/' || source || '/' || doc_id || '.md' AS file FROM documents),
links AS (
  SELECT file, 3 AS line, (doc_id + 1) || '.md' AS target, 'docs/' || source || '/' || (doc_id + 1) || '.md' AS path FROM files
  UNION ALL SELECT file, 3, 'img/' || source || '.png', 'docs/' || source || '/img/' || source || '.png' FROM files
  UNION ALL SELECT file, 5, '../src' || doc_id % 7 || '/' || (doc_id + 7) || '.md', 'docs/src' || doc_id % 7 || '/' || (doc_id + 7) || '.md' FROM files
  UNION ALL SELECT file, 6, '../../../z.md', NULL FROM files WHERE doc_id % 5 = 0
)"""


@register(_LINKS + " SELECT file, CAST(line AS BIGINT) AS line, target, CASE WHEN path IS NULL THEN 'outside' WHEN path IN (SELECT file FROM files) THEN 'ok' ELSE 'missing' END AS outcome FROM links")
def local_links(spark: SparkSession, d: str) -> DataFrame:
    files = linked_files(spark, d)
    return references.local_links(markdown.document_nodes(files), files).select("file", "line", "target", "outcome")


@register("SELECT 'docs/' || source || '/' || doc_id || '.md' AS file, CAST(8 AS BIGINT) AS line FROM documents WHERE doc_id % 3 = 0")
def untagged_fences(spark: SparkSession, d: str) -> DataFrame:
    return references.untagged_fences(markdown.document_nodes(linked_files(spark, d)))


@register(
    """WITH files AS (SELECT source, doc_id, 'docs/' || source || '/' || doc_id || '.md' AS file FROM documents), manifests AS (SELECT source, list(DISTINCT 'step' || doc_id % 5) AS scripts FROM documents WHERE source LIKE 'src1%' GROUP BY source)
SELECT file, CAST(8 AS BIGINT) AS line, 'step' || doc_id % 6 AS script, CASE WHEN scripts IS NOT NULL THEN 'docs/' || source || '/package.json' END AS manifest,
  CASE WHEN scripts IS NULL THEN 'unknown' WHEN list_contains(scripts, 'step' || doc_id % 6) THEN 'ok' ELSE 'missing' END AS outcome FROM files LEFT JOIN manifests USING (source)"""
)
def missing_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Scripts that documents run, against the manifest of their folder where it has one."""
    docs = _documents(spark, d).where("source like 'src1%'")
    scripts = F.to_json(F.struct(F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit("step"), (F.col("doc_id") % 5).cast("string")).alias("k"), F.lit("x").alias("v")))).alias("scripts")))
    manifests = docs.groupBy("source").agg(scripts.alias("text")).select(F.concat(F.lit("docs/"), "source", F.lit("/package.json")).alias("file"), "text")
    files = linked_files(spark, d)
    return references.missing_scripts(markdown.document_nodes(files), files.unionByName(manifests))


def packaged_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(file, text) of one package for fifty document ids, each with its documents as sources, and peers (folder, name).

    A package depends on long words out of every tenth document of its own and of the next package.
    """
    docs = _documents(spark, d).select("doc_id", F.floor(F.col("doc_id") / 50).alias("g"), "text")
    words = docs.where("doc_id % 10 = 0").select("g", F.regexp_extract("text", "[a-z]{9,}", 0).alias("name")).where("name <> ''")
    folder = lambda g: F.concat(F.lit("pkgs/"), g.cast("string"))
    names = words.select(F.explode(F.array(F.col("g"), F.col("g") - 1)).alias("g"), "name").where("g >= 0").distinct()
    manifests = names.groupBy("g").agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.lit("1"))))).alias("dependencies"))).alias("text"))
    sources = docs.select(F.concat(folder(F.col("g")), F.lit("/src/"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("file"), "text")
    peers = names.where("g % 4 = 0 and length(name) % 2 = 0").select(folder(F.col("g")).alias("folder"), "name")
    return sources.unionByName(manifests.select(F.concat(folder(F.col("g")), F.lit("/package.json")).alias("file"), "text")), peers


@register(
    r"""WITH docs AS (SELECT doc_id // 50 AS g, doc_id, text FROM documents), words AS (SELECT g, regexp_extract(text, '[a-z]{9,}') AS name FROM docs WHERE doc_id % 10 = 0),
names AS (SELECT DISTINCT g - k AS g, name FROM words, (VALUES (0), (1)) AS t(k) WHERE name <> '' AND g >= k),
used AS (SELECT DISTINCT n.g, n.name FROM names n JOIN docs d ON d.g = n.g WHERE contains(d.text, n.name) AND regexp_matches(d.text, '(^|[^\w@/-])' || n.name || '($|[^\w-])') UNION SELECT g, name FROM names WHERE g % 4 = 0 AND length(name) % 2 = 0),
unused AS (SELECT n.g, count(*) AS n, list(n.name ORDER BY n.name) FILTER (u.name IS NULL) AS gone FROM names n LEFT JOIN used u ON u.g = n.g AND u.name = n.name GROUP BY n.g)
SELECT 'pkgs/' || g || '/package.json' AS file, CASE WHEN gone IS NULL THEN 'negative' WHEN len(gone) = n AND n > 1 THEN 'unknown' ELSE 'finding' END AS outcome,
  CASE WHEN gone IS NULL OR (len(gone) = n AND n > 1) THEN '' ELSE array_to_string(gone, ',') END AS unused FROM unused"""
)
def unused_dependencies(spark: SparkSession, d: str) -> DataFrame:
    found = references.unused_dependencies(*packaged_files(spark, d))
    return found.select("file", "outcome", F.coalesce(F.array_join("unused", ","), F.lit("")).alias("unused"))
