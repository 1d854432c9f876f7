"""From rule outcomes to findings: bands, suppression, dedupe, scorecards, coverage, exit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import stats
from proseloom.plans.catalogue import Rule

#: Order of bands and severities.
BAND_RANK, SEVERITY_RANK = {"act": 0, "review": 1, "silent": 2}, {"major": 0, "minor": 1}


def _rank(column: str, ranks: dict[str, int]):
    out = F.lit(len(ranks))
    for name, rank in ranks.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def rule_table(spark, rules: tuple[Rule, ...]) -> DataFrame:
    """The catalogue as a dimension table; its size is the catalogue's."""
    rows = [(r.id, r.category, r.area, r.severity, r.review, r.act, r.review_only, r.tier) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, category string, domain string, severity string, review double, act double, review_only boolean, tier string")


def findings(fired: DataFrame, rules: DataFrame, probability: str = "probability") -> DataFrame:
    """Fired outcomes with rule attributes and band; silent ones go."""
    joined = fired.join(F.broadcast(rules), "rule_id").withColumn("band", stats.band(F.col(probability), F.col("review"), F.col("act"), F.col("review_only")))
    return joined.where("band <> 'silent'")


def suppress(found: DataFrame, pragmas: DataFrame) -> DataFrame:
    """Adds suppressed: a pragma (file, line, rule_id or ``all``) on the same line or the one before."""
    reach = pragmas.select("file", F.explode(F.array(F.col("line").cast("long"), F.col("line").cast("long") + 1)).alias("line"), F.lower("rule_id").alias("pragma"))
    reach = reach.groupBy("file", "line").agg(F.collect_set("pragma").alias("pragmas"))
    hit = F.array_contains("pragmas", F.col("rule_id")) | F.array_contains("pragmas", "all")
    return found.join(reach, ["file", "line"], "left").withColumn("suppressed", F.coalesce(hit, F.lit(False))).drop("pragmas")


def on_changed_lines(found: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings whose line lies in a changed range (file, start, end); ranges are laid out as lines for an equi-join."""
    lines = changed.select("file", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long"))).alias("line")).distinct()
    return found.join(lines, ["file", "line"], "left_semi")


def dedupe_exact(found: DataFrame) -> DataFrame:
    """One finding for each unit and rule, the most probable; the first of equals by ``seq``."""
    first = Window.partitionBy("unit_id", "rule_id").orderBy(F.desc("probability"), "seq")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def merge_categories(found: DataFrame) -> DataFrame:
    """One live finding for each unit and category: best band, then probability; the other rules' ids in ``also``.

    Suppressed findings stay as they are, so that one on a rule never hides a live finding of another.
    """
    held = F.col("suppressed") if "suppressed" in found.columns else F.lit(False)
    group = Window.partitionBy("unit_id", "category", "_held")
    order = group.orderBy("_rank", F.desc("probability"), "seq")
    ranked = found.withColumn("_held", held).withColumn("_rank", _rank("band", BAND_RANK)).withColumn("_n", F.row_number().over(order))
    others = F.collect_list(F.when((F.col("_n") > 1) & ~F.col("_held"), F.struct("_n", "rule_id"))).over(group)
    return ranked.withColumn("also", F.transform(F.array_sort(others), lambda x: x["rule_id"])).where("_n = 1 or _held").drop("_n", "_rank", "_held")


def scorecard(found: DataFrame, rules: DataFrame, by: str) -> DataFrame:
    """act, review and suppressed counts by rule attribute; values without findings appear with zeros."""
    counted = found.groupBy(by).agg(F.count_if((F.col("band") == "act") & ~F.col("suppressed")).alias("act"), F.count_if((F.col("band") == "review") & ~F.col("suppressed")).alias("review"), F.count_if("suppressed").alias("suppressed"))
    return rules.select(by).distinct().join(counted, by, "left").na.fill(0)


def coverage(outcome: DataFrame, rules: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """eligible, answered, negative, pending and unknown units of each rule; ``unknown`` has rule_id and reason."""
    counted = outcome.groupBy("rule_id").agg(F.count("*").alias("eligible"), F.count_if("fired").alias("answered"), F.count_if(~F.col("fired")).alias("negative"))
    joined = rules.select("rule_id").join(counted, "rule_id", "left")
    if unknown is not None:
        pending = F.col("reason").isin("not-judged", "dry-run")
        joined = joined.join(unknown.groupBy("rule_id").agg(F.count_if(pending).alias("pending"), F.count_if(~pending).alias("unknown")), "rule_id", "left")
    return joined.na.fill(0)


def top_rules(found: DataFrame, k: int = 5) -> DataFrame:
    return found.groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(k)


def exit_summary(found: DataFrame, fail_on: str = "minor", units: DataFrame | None = None, strict: bool = True, complete: bool = True) -> DataFrame:
    """Findings, failing ones and the exit code of a run.

    2 if the run is incomplete, or strict and without units; else 1 if an unsuppressed act finding is severe enough.
    """
    failing = F.count_if((F.col("band") == "act") & ~F.col("suppressed") & (_rank("severity", SEVERITY_RANK) <= SEVERITY_RANK[fail_on]))
    empty = strict and units is not None and not units.limit(1).count()
    code = F.lit(2) if empty or not complete else F.when(F.col("failing") > 0, 1).otherwise(0)
    return found.agg(F.count("*").alias("findings"), failing.alias("failing")).withColumn("exit_code", code)


def _report() -> list:
    return ["line", _rank("band", BAND_RANK), _rank("severity", SEVERITY_RANK), F.desc("probability"), "rule_id", "unit_id"]


def ordered(found: DataFrame) -> DataFrame:
    """Findings as a report lists them: by file, line, band, severity, falling probability; equal ones by rule and unit."""
    return found.orderBy("file", *_report())


def places(found: DataFrame) -> DataFrame:
    """Adds place, from 1, of each finding in its file's part of the report; files are sorted apart from each other."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy(*_report())))
