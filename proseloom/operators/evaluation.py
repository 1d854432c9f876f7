"""Rules against labels: confusion, calibration, thresholds, paired tests, splits, agreement, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import stats

#: Thresholds that tuning tries.
GRID = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def confusion(pairs: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Counts and rates of (label, probability) pairs; a rate without cases is 0, its interval the whole range."""
    said = F.col("probability") >= threshold
    c = pairs.groupBy(*by).agg(F.count_if(F.col("label") & said).alias("tp"), F.count_if(~F.col("label") & said).alias("fp"), F.count_if(F.col("label") & ~said).alias("fn"), F.count_if(~F.col("label") & ~said).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    low, high = stats.wilson(tp, tp + fp)
    precision, recall = stats.ratio(tp, tp + fp), stats.ratio(tp, tp + fn)
    return c.select(*by, "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), stats.ratio(tn, tn + fp).alias("tnr"), stats.ratio(2 * precision * recall, precision + recall).alias("f1"), low.alias("precision_low"), high.alias("precision_high"))


def calibration(pairs: DataFrame, buckets: int = 10) -> DataFrame:
    """Equal buckets of probability, the last closed, empty ones kept: bucket, n, mean_probability, positive_rate."""
    edges = pairs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    at = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), sum((F.when(F.col("probability") >= i / buckets, 1).otherwise(0) for i in range(1, buckets)), F.lit(0))))
    counted = pairs.withColumn("bucket", at).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.avg(F.col("label").cast("int")).alias("positive_rate"))
    return F.broadcast(edges).join(counted, "bucket", "left").na.fill(0)


def choose_thresholds(pairs: DataFrame, current: float = 0.7, floor: float = 0.8, least: int = 10, review: float = 0.0) -> DataFrame:
    """For each rule the lowest threshold whose precision clears the floor: rule_id, n, chosen, action, precision_low, recall."""
    grid = [t for t in GRID if t > review]
    sums = [x for t in grid for x in (F.count_if(F.col("label") & (F.col("probability") >= t)).alias(f"tp{t}"), F.count_if(F.col("probability") >= t).alias(f"pp{t}"))]
    wide = pairs.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if("label").alias("positives"), *sums)
    tried = F.array(*(F.struct(F.lit(t).alias("chosen"), stats.wilson(F.col(f"`tp{t}`"), F.col(f"`pp{t}`"))[0].alias("precision_low"), stats.ratio(F.col(f"`tp{t}`"), F.col("positives")).alias("recall"), F.col(f"`pp{t}`").alias("pp")) for t in grid))
    first = F.get(F.filter(tried, lambda x: (x["pp"] > 0) & (x["precision_low"] >= floor)), F.lit(0))
    out = wide.withColumn("first", F.when(F.col("n") >= least, first))
    action = F.when(F.col("n") < least, "insufficient").when(F.col("first").isNull(), "demote").when(F.col("first.chosen") == current, "keep").when(F.col("first.chosen") > current, "raise").otherwise("lower")
    return out.select("rule_id", "n", F.col("first.chosen").alias("chosen"), action.alias("action"), F.coalesce("first.precision_low", F.lit(0.0)).alias("precision_low"), F.coalesce("first.recall", F.lit(0.0)).alias("recall"))


def paired_test(pairs: DataFrame, by: list[str]) -> DataFrame:
    """McNemar's test of a_correct against b_correct: n01 (only b), n10 (only a), p_value."""
    c = pairs.groupBy(*by).agg(F.count_if(~F.col("a_correct") & F.col("b_correct")).alias("n01"), F.count_if(F.col("a_correct") & ~F.col("b_correct")).alias("n10"))
    return c.withColumn("p_value", stats.mcnemar_p(F.col("n01"), F.col("n10")))


def split_leaks(items: DataFrame, key: str) -> DataFrame:
    """Keys whose items lie in more than one split: key, splits."""
    return items.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count_distinct("split").alias("n")).where("n > 1").drop("n")


def label_balance(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by).agg(F.count_if("label").alias("positive"), F.count_if(~F.col("label")).alias("negative"))


def flip_rate(a: DataFrame, b: DataFrame, on: list[str], threshold: float = 0.7) -> DataFrame:
    """Share of pairs answered in both passes that change sides, with its interval."""
    both = a.select(*on, F.col("probability").alias("pa")).join(b.select(*on, F.col("probability").alias("pb")), on)
    c = both.agg(F.count("*").alias("n"), F.count_if((F.col("pa") >= threshold) != (F.col("pb") >= threshold)).alias("flips"))
    low, high = stats.wilson(F.col("flips"), F.col("n"))
    return c.select("n", "flips", stats.ratio(F.col("flips"), F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def agreement(a: DataFrame, b: DataFrame, on: list[str], by: str, least: int = 20, floor: float = 0.9) -> DataFrame:
    """Agreement of two label sources on items that both have; trusted with enough of them."""
    both = a.select(*on, F.col("label").alias("la")).join(b.select(*on, F.col("label").alias("lb")), on).where("la is not null and lb is not null")
    c = both.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("la") == F.col("lb")).alias("agreed"))
    return c.withColumn("rate", F.col("agreed") / F.col("n")).withColumn("trusted", (F.col("n") >= least) & (F.col("rate") >= floor))


def stratified_sample(items: DataFrame, strata: list[str], key: str, k: int = 3) -> DataFrame:
    """At most k items of each stratum, by key: a sampling operator."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy(key))).where(F.col("place") <= k)


def promotion(metrics: DataFrame, floor: float = 0.8, least: int = 10) -> DataFrame:
    """Adds eligible and the first reason against promotion, in order, to rows with leaks, expected, n, positives, negatives and precision_low."""
    reason = F.when(F.col("leaks") > 0, "leak").when(F.col("n") != F.col("expected"), "incomplete").when(F.col("n") < least, "too few").when((F.col("positives") == 0) | (F.col("negatives") == 0), "one class").when(F.col("precision_low") < floor, "precision")
    return metrics.withColumn("reason", F.coalesce(reason, F.lit("clear"))).withColumn("eligible", reason.isNull())
