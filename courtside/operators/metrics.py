"""Model metrics and column statistics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def binary_metrics(df: DataFrame, keys: Sequence[str], label: str, prediction: str) -> DataFrame:
    """n, tp, fp, fn, tn, accuracy, precision, recall, f1 per key; null where nothing counts."""
    both = lambda a, b: F.count_if((F.col(label) == a) & (F.col(prediction) == b))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), both(1, 1).alias("tp"), both(0, 1).alias("fp"), both(1, 0).alias("fn"), both(0, 0).alias("tn"))
    share = lambda a, b, n: F.round(F.try_divide(F.expr(a), F.expr(b)), 6).alias(n)
    return out.select("*", share("tp + tn", "n", "accuracy"), share("tp", "tp + fp", "precision"), share("tp", "tp + fn", "recall"), share("2 * tp", "2 * tp + fp + fn", "f1"))


def roc_auc(df: DataFrame, label: str, score: str, bucket: Column) -> DataFrame:
    """positives, negatives, auc: the share of (positive, negative) pairs in order, ties counting half.

    Rows become class counts per score. Scores are cumulated within ordered buckets, whose totals give the offsets.
    """
    counts = df.withColumn("b", bucket).groupBy("b", score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = counts.groupBy("b").agg(F.sum("n").alias("bn")).select("b", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "b")
    total = placed.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("p") * (F.col("start") + F.col("below") + F.col("n") / 2.0)).alias("won"))
    return total.select("positives", "negatives", F.round(F.try_divide("won", F.col("positives") * F.col("negatives")), 6).alias("auc"))


def mean_iou(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """The mean over classes with a union of intersection over union, and their number."""
    cells = df.groupBy(F.col(label).alias("a"), F.col(prediction).alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("v"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("i"), F.col("n").alias("u"))
    per = sides.groupBy("v").agg(F.sum("i").alias("i"), F.sum("u").alias("u"))
    return per.agg(F.round(F.avg(F.col("i") / F.col("u")), 6).alias("mean_iou"), F.count("*").alias("classes"))


def standardised(df: DataFrame, columns: Sequence[str], population: bool = False) -> DataFrame:
    """Adds <c>_std: less the mean, over the deviation; null where that is 0."""
    dev = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(*(F.avg(c).alias(f"{c}_m") for c in columns), *(dev(c).alias(f"{c}_d") for c in columns))
    out = df.join(F.broadcast(stats))  # one row
    return out.withColumns({f"{c}_std": F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_d")) for c in columns}).drop(*stats.columns)


def latency(df: DataFrame, keys: Sequence[str], millis: str, rate: float) -> DataFrame:
    """n, mean, median and 95th percentile in ms, rows per second, and that against ``rate``."""
    quantile = lambda q: F.percentile(F.col(millis), q)
    per_second = F.count("*") * 1000 / F.sum(millis)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(millis), 6).alias("mean_ms"), F.round(quantile(0.5), 6).alias("p50_ms"), F.round(quantile(0.95), 6).alias("p95_ms"),
        F.round(per_second, 6).alias("per_second"), F.round(per_second / rate, 6).alias("real_time_ratio"),
    )
