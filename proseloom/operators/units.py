"""Units: the typed pieces of text that rules judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import globs, text

#: Doc types by path, first match first.
DOC_TYPES = [("**/README.md", "reference"), ("docs/src0/**", "howto"), ("docs/src1*/**", "ui"), ("docs/**", "explanation")]


def unit_id(file: Column, kind: Column, start: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 over file, kind and start, split by NUL."""
    return F.substring(F.sha2(F.concat(file, F.char(F.lit(0)), kind, F.char(F.lit(0)), start.cast("string")), 256), 1, 16)


def line_units(files: DataFrame, file_col: str = "file", text_col: str = "text", doc_types: list[tuple[str, str]] = DOC_TYPES) -> DataFrame:
    """One paragraph unit for each line with a word: file, unit_id, kind, line, start (code points), text, doc_type, role.

    Null and blank texts have no units.  One generator over the scan; no shuffle, and the work of a file grows as its length.
    """

    def placed(lines: Column) -> Column:
        # The start of each line, for a thousand lines at a time: appending to an array copies it.
        size = 1024
        block = lambda i: F.slice(lines, i * size + 1, F.lit(size))
        firsts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int")), lambda i: F.struct(i.alias("i"), F.aggregate(block(i), F.lit(0), lambda s, x: s + F.length(x) + 1).alias("chars")))

        def starts(b: Column, before: Column) -> Column:
            held = block(b["i"])
            sums = F.aggregate(held, F.struct(before.alias("at"), F.array().cast("array<int>").alias("starts")), lambda s, x: F.struct((s["at"] + F.length(x) + 1).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")))["starts"]
            return F.arrays_zip(held.alias("text"), sums.alias("start"))

        return F.flatten(F.transform(firsts, lambda b: starts(b, F.aggregate(F.filter(firsts, lambda x: x["i"] < b["i"]), F.lit(0), lambda s, x: s + x["chars"]))))

    lines = F.split(F.col(text_col), "\n", -1)
    # Bound once: a column that a lambda names is computed again for each element.
    pieces = F.transform(F.array(lines), placed)[0]
    rows = files.select(F.col(file_col).alias("file"), F.posexplode(pieces).alias("at", "piece"))
    kept = rows.where(F.regexp_like("piece.text", F.lit(r"[^ \t\n\r\f\x0B]")))
    out = kept.select("file", F.lit("paragraph").alias("kind"), (F.col("at") + 1).cast("long").alias("line"), F.col("piece.start").cast("long").alias("start"), text.normalise(F.col("piece.text")).alias("text"))
    return out.select("file", unit_id(F.col("file"), F.col("kind"), F.col("start")).alias("unit_id"), "kind", "line", "start", "text", globs.first_match(F.col("file"), doc_types, "unknown").alias("doc_type"), F.lit("body").alias("role"))

