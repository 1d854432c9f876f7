"""Range edits: fixes of findings on the prose of their units, composed and applied once to each file."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import text
from proseloom.plans.catalogue import Rule


def fixed(prose: Column, names: Column) -> Column:
    """A piece of prose after the named fixes, in the order of the registry."""
    return reduce(lambda out, fix: F.when(F.array_contains(names, fix[0]), fix[1](out)).otherwise(out), text.FIXES.items(), prose)


def mending(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """The rules with a fix: findings of others change nothing."""
    return tuple(r for r in rules if r.fix)


def edits(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(file, start, end, fixes): what findings that act change, from rows with file, rule_id, band, suppressed and fix_ranges.

    Fixes on one range are one edit.  Ranges of units are apart from each other; where they are not, an edit that begins
    inside an earlier one is left out, so that no place is rewritten twice.
    """
    fixes = {r.id: r.fix for r in mending(rules)}
    if not fixes:
        return found.select("file", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("fixes")).where("false")
    names = sorted(set(fixes.values()))
    bit = F.create_map(*(F.lit(x) for rule, fix in fixes.items() for x in (rule, 1 << names.index(fix))))[F.col("rule_id")]
    held = F.col("suppressed") if "suppressed" in found.columns else F.lit(False)
    ranges = found.where((F.col("band") == "act") & ~held).select("file", bit.alias("bit"), F.explode("fix_ranges").alias("r")).where("bit is not null and r.end > r.start")
    grouped = ranges.groupBy("file", F.col("r.start").alias("start"), F.col("r.end").alias("end")).agg(F.bit_or("bit").alias("_bits"))
    before = Window.partitionBy("file").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    named = F.array_compact(F.array(*(F.when(F.col("_bits").bitwiseAND(1 << k) > 0, F.lit(name)) for k, name in enumerate(names))))
    apart = grouped.withColumn("_reach", F.coalesce(F.max("end").over(before), F.lit(0))).where("start >= _reach")
    return apart.select("file", "start", "end", named.alias("fixes"))


def left_for_hands(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings that act, whose rule has a fix, on units without a range that may be rewritten."""
    held = F.col("suppressed") if "suppressed" in found.columns else F.lit(False)
    return found.where((F.col("band") == "act") & ~held & F.col("rule_id").isin(*(r.id for r in rules if r.fix)) & (F.coalesce(F.size("fix_ranges"), F.lit(0)) <= 0))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with their edits as the pieces between the edits, the prose of each, and what is behind the last."""
    for batch in batches:
        edits = batch.column("edits")
        bounds, flat = edits.offsets.to_pylist(), edits.values
        starts, ends = flat.field("start").to_pylist(), flat.field("end").to_pylist()
        kept, prose, rest = [], [], []
        for whole, first, last in zip(batch.column("text").to_pylist(), bounds, bounds[1:]):
            text, behind = whole or "", [0, *ends[first:last]]
            kept.append([text[a:b] for a, b in zip(behind, starts[first:last])])
            prose.append([text[a:b] for a, b in zip(starts[first:last], ends[first:last])])
            rest.append(None if whole is None else text[behind[-1] :])
        fixes = pa.ListArray.from_arrays(edits.offsets, flat.field("fixes"))
        pieces = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(kept, pieces), pa.array(prose, pieces), fixes, pa.array(rest, pa.string())], names=["file", "kept", "prose", "fixes", "rest"])


def apply_edits(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(file, text, n_edits) of files that change: everything outside the edits stays as it is.

    A file's edits come together by its name, sorted; files without edits are not read on.  Tasks cut texts by place in
    Python, as a column would count a text's letters from its beginning for each edit.
    """
    edit = F.struct("start", "end", "fixes")
    listed = changes.groupBy("file").agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    joined = files.select("file", "text").join(listed, "file").select("file", "text", "edits")
    pieces = joined.mapInArrow(_cut, "file string, kept array<string>, prose array<string>, fixes array<array<string>>, rest string")
    mended = F.transform(F.arrays_zip("kept", "prose", "fixes"), lambda x: F.concat(x["kept"], fixed(x["prose"], x["fixes"])))
    return pieces.select("file", F.concat(F.array_join(mended, ""), "rest").alias("text"), F.size("kept").alias("n_edits"))
