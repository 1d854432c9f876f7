"""Queries over Markdown files, which are made from the documents' lines; the SQL tells their units without parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.operators import markdown
from proseloom.registry import read, register
from proseloom.sources.shared import spread

_HEAD = "---\ntitle: made\n---\n\n"


def _block(t: Column, n: Column) -> Column:
    """The n-th line of a text as a block of one of ten kinds; the last is read in MDX only."""
    number, lit = n.cast("string"), F.lit
    kinds = (
        F.concat(F.repeat(lit("#"), (1 + F.floor(n / 10) * 3 % 4).cast("int")), lit(" "), t, lit(" ##")),
        F.concat(t, lit(" `c"), number, lit("` end")),
        F.concat(lit("- "), t),
        F.concat(lit("> "), t),
        F.concat(lit("| a"), number, lit(" | b |\n| --- | :-: |\n| "), t, lit(" | *x* |")),
        F.concat(lit("```\n"), t, lit("\n```")),
        F.concat(lit("**"), t, lit("** and [link](http://x.y/"), number, lit(' "t")')),
        F.concat(lit("1. "), t, lit("\n   more")),
        F.concat(t, lit("\n---")),
        F.concat(lit('<Figure caption="'), t, lit('" />')),
    )
    out = kinds[-1]
    for k, kind in reversed(list(enumerate(kinds[:-1]))):
        out = F.when(n % 10 == k, kind).otherwise(out)
    return out


def files(spark: SparkSession, d: str) -> DataFrame:
    """(file, text): documents as Markdown, every third as MDX; of their lines letters, commas, full stops and question marks stay."""
    # All but A-Za-z,.? as ranges: Java takes four times as long to see that a letter is in none of several.
    plain = lambda x: F.trim(F.regexp_replace(x, r"[\x00-+\-/->@\[-`{-\x{10ffff}]+", " "))
    lines = F.filter(F.transform(F.split("text", "\n", -1), plain), lambda x: x != "")
    body = F.array_join(F.transform(lines, _block), "\n\n")
    made = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 1, ".mdx").otherwise(".md")).alias("file")
    return spread(read(spark, d, "documents")).select(made, F.concat(F.lit(_HEAD), body).alias("text"))


_PLAIN = "trim(regexp_replace(x, '[^A-Za-z,.?]+', ' ', 'g'))"
#: Units as the blocks were made: kind of block, place of the unit in it, lines and columns.
UNITS = f"""
WITH texts AS (SELECT 'docs/' || source || '/' || doc_id || CASE WHEN doc_id % 3 = 1 THEN '.mdx' ELSE '.md' END AS file, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_PLAIN}), lambda x: x <> '') AS lines FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT file, unnest(lines) AS t, generate_subscripts(lines, 1) - 1 AS n FROM texts),
placed AS (SELECT *, n % 10 AS k, 5 + coalesce(sum(CASE n % 10 WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 7 THEN 3 WHEN 8 THEN 3 ELSE 2 END) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_line FROM numbered),
parts AS (
  SELECT file, n, 0 AS part, first_line AS line, CASE WHEN k IN (2, 3) THEN 3 WHEN k = 7 THEN 4 WHEN k = 9 THEN 9 ELSE 1 END AS col, CASE WHEN k IN (0, 8) THEN 'heading' WHEN k = 9 THEN 'attr-string' ELSE 'paragraph' END AS kind,
    CASE WHEN k IN (0, 8) THEN 'heading' WHEN k IN (2, 7) THEN 'list-item' WHEN k = 4 THEN 'cell' WHEN k = 9 THEN 'caption' ELSE 'body' END AS role, CAST(CASE k WHEN 0 THEN 1 + n // 10 * 3 % 4 WHEN 8 THEN 2 ELSE 0 END AS INTEGER) AS level,
    CASE k WHEN 1 THEN t || ' c' || n || ' end' WHEN 4 THEN 'a' || n WHEN 6 THEN t || ' and link' WHEN 7 THEN t || ' more' ELSE t END AS text, CASE WHEN k = 1 THEN 1 ELSE 0 END AS n_code_spans, CASE WHEN k = 1 THEN t || ' ' || repeat(' ', 1 + length(n::VARCHAR)) || ' end' END AS masked
  FROM placed WHERE k <> 5 AND (k <> 9 OR file LIKE '%.mdx')
  UNION ALL SELECT file, n, 1, first_line, 5 + length(n::VARCHAR), 'paragraph', 'cell', 0, 'b', 0, NULL FROM placed WHERE k = 4
  UNION ALL SELECT file, n, 2, first_line + 2, 1, 'paragraph', 'cell', 0, t, 0, NULL FROM placed WHERE k = 4
  UNION ALL SELECT file, n, 3, first_line + 2, 4 + length(t), 'paragraph', 'cell', 0, 'x', 0, NULL FROM placed WHERE k = 4
), units AS (
  SELECT *, last_value(CASE WHEN kind = 'heading' THEN substr(text, 1, 120) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY n, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading_above,
    count(*) FILTER (kind = 'heading') OVER (PARTITION BY file ORDER BY n, part) AS section_no FROM parts
)"""


@register(UNITS + " SELECT file, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS \"column\", kind, role, level, text, CAST(n_code_spans AS INTEGER) AS n_code_spans, heading_above, section_no FROM units")
def markdown_units(spark: SparkSession, d: str) -> DataFrame:
    made = markdown.markdown_units(files(spark, d))
    return made.select("file", "line", "column", "kind", "role", "level", "text", F.size("code_spans").alias("n_code_spans"), "heading_above", "section_no")


@register(UNITS + " SELECT file, section_no, string_agg(text, chr(10) ORDER BY n, part) AS section_text FROM units GROUP BY file, section_no")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return markdown.sections(markdown.markdown_units(files(spark, d)))


@register(
    UNITS
    + """, counted AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n, part) AS seq, count(*) OVER (PARTITION BY file) AS n_units FROM units),
heads AS (SELECT *, lag(level) OVER (PARTITION BY file ORDER BY seq) AS level_before, lead(seq) OVER (PARTITION BY file ORDER BY seq) AS next_seq FROM counted WHERE kind = 'heading')
SELECT file, CAST(line AS BIGINT) AS line, level, text, level_before, coalesce(level > level_before + 1, false) AS jumps, coalesce(next_seq, n_units + 1) = seq + 1 AS empty FROM heads"""
)
def markdown_outline(spark: SparkSession, d: str) -> DataFrame:
    return markdown.outline(markdown.markdown_units(files(spark, d))).drop("unit_id")
