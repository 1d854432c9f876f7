"""Order-sensitive structure: headings carried forward, sections, neighbours, heading levels, changed ranges, ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markup blocks in order: level 1-6 for headings, 0 for paragraphs.
_BLOCK = r"(?is)<(h[1-6]|p)\b[^>]*>(.*?)</\1>"


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings and paragraphs of HTML in order: file, at, level, text (tags dropped, white space collapsed).  Approximate: no parser, no nesting."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(_BLOCK), F.lit(0))
    rows = pages.select(F.col(id_col).alias("file"), F.posexplode(found).alias("at", "raw"))
    tag = F.lower(F.regexp_extract("raw", _BLOCK, 1))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("raw", _BLOCK, 2), r"<[^>]*>", ""), r"\s+", " "))
    return rows.select("file", "at", F.when(tag == "p", 0).otherwise(F.substring(tag, 2, 1).cast("int")).alias("level"), plain.alias("text"))


def with_headings(rows: DataFrame) -> DataFrame:
    """Adds heading_above (120 characters at most) and section, the number of headings so far."""
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("level") > 0, F.substring("text", 1, 120))
    return rows.withColumn("heading_above", F.last(heading, ignorenulls=True).over(before)).withColumn("section", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(upto))


def neighbours(rows: DataFrame) -> DataFrame:
    """Adds the nearest texts before and after that are not empty."""
    order = Window.partitionBy("file").orderBy("at")
    said = F.when(F.col("text") != "", F.col("text"))
    return rows.withColumn("previous_text", F.last(said, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next_text", F.first(said, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))


def heading_jumps(rows: DataFrame) -> DataFrame:
    """Headings more than one level below the heading before."""
    heads = rows.where("level > 0").withColumn("before", F.lag("level").over(Window.partitionBy("file").orderBy("at")))
    return heads.where("level > before + 1")


def empty_sections(rows: DataFrame) -> DataFrame:
    """Headings followed by nothing, or by a heading of their level or above."""
    following = rows.withColumn("next_level", F.lead("level").over(Window.partitionBy("file").orderBy("at")))
    return following.where("level > 0 and (next_level is null or (next_level > 0 and next_level <= level))")


def ancestors(path: Column) -> Column:
    """The folders of a path, the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def nearest_ancestor(files: DataFrame, marks: DataFrame) -> DataFrame:
    """For each file the mark (folder, value) of its deepest marked folder."""
    up = files.select("file", F.posexplode(ancestors(F.col("file"))).alias("depth", "folder"))
    return up.join(marks, "folder").groupBy("file").agg(F.max_by("value", "depth").alias("value"), F.max_by("folder", "depth").alias("folder"))


def changed_ranges(patches: DataFrame) -> DataFrame:
    """Ranges of added lines of unified diffs (file, patch): file, start, end."""
    heads = patches.select("file", F.explode(F.regexp_extract_all("patch", F.lit(r"@@ [^@]*\+(\d+(?:,\d+)?) @@"), F.lit(1))).alias("head"))
    start = F.substring_index("head", ",", 1).cast("int")
    count = F.when(F.col("head").contains(","), F.substring_index("head", ",", -1).cast("int")).otherwise(1)
    return heads.select("file", start.alias("start"), (start + count - 1).alias("end")).where("end >= start")
