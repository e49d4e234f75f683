"""Label distributions, feature statistics by label, drift between runs, and page sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def label_distribution(rows: DataFrame, default: str = "O") -> DataFrame:
    """(label, n), the most frequent first; a missing label counts as the default."""
    label = F.coalesce("label", F.lit(default)).alias("label")
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def rare_class_filter(rows: DataFrame, least: int = 2, label: str = "label") -> DataFrame:
    """Rows of the classes that have at least so many rows. Classes are few; rows aren't shuffled by class."""
    kept = rows.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(label)
    return rows.join(kept, label, "left_semi").select(rows.columns)


def feature_stats(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(feature, label, mean, std, min, max, count) for each; count is of rows, nulls included."""
    stats = [
        F.struct(
            F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.stddev_samp(f).alias("std"), F.min(f).cast("double").alias("min"),
            F.max(f).cast("double").alias("max"),
        ).alias(f)
        for f in features
    ]
    wide = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count"), *stats)
    return wide.select("label", "count", F.explode(F.array(*features)).alias("x")).select(
        "x.feature", "label", "x.mean", "x.std", "x.min", "x.max", "count"
    )


def feature_quantiles(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(feature, label, q1, median, q3): the exact quartiles that a box plot shows."""
    aggregates = [F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f) for f in features]
    wide = rows.groupBy(F.col(label).alias("label")).agg(*aggregates)
    long = wide.select("label", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("q")) for f in features])).alias("x"))
    return long.select("x.feature", "label", *[F.col("x.q")[k].alias(n) for k, n in enumerate(("q1", "median", "q3"))])


def stats_drift(new: DataFrame, old: DataFrame) -> DataFrame:
    """Statistics of two runs side by side where both have the feature and label, with delta_mean = new - old."""
    names = ["mean", "std", "min", "max", "count"]
    both = [d.select("feature", "label", *[F.col(c).alias(f"{c}_{s}") for c in names]) for d, s in ((new, "new"), (old, "old"))]
    return both[0].join(both[1], ["feature", "label"]).withColumn("delta_mean", F.col("mean_new") - F.col("mean_old"))


def session_positions(rows: DataFrame, starts: Column, partition: list[str], order: list[str]) -> DataFrame:
    """Rows numbered from 1 within sessions that a marker row starts; rows before the first marker go.

    In page streams the marker is a text equal to ``html``.
    """
    base = W.Window.partitionBy(*partition).orderBy(*order)
    numbered = rows.withColumn(
        "session", F.sum(F.when(starts, 1).otherwise(0)).over(base.rowsBetween(W.Window.unboundedPreceding, 0))
    ).filter("session > 0")
    within = W.Window.partitionBy(*partition, "session").orderBy(*order)
    return numbered.withColumns({"session": F.col("session").cast("long"), "position": F.row_number().over(within).cast("long")})


def class_weights(rows: DataFrame, label: str = "label", most: float = 25.0, classes: list[str] | None = None) -> DataFrame:
    """(label, n, loss_weight, sample_weight): total / (n + 1e-6) over its mean, at most ``most``; and 1 / n.

    classes adds classes that may be missing from the rows: theirs is the largest weight.
    """
    counted = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    if classes:
        named = rows.sparkSession.createDataFrame([(c,) for c in classes], "label string")
        counted = named.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    whole = W.Window.partitionBy()
    raw = counted.withColumn("_raw", F.sum("n").over(whole) / (F.col("n") + 1e-6))
    weight = F.least(F.lit(float(most)), F.col("_raw") / F.avg("_raw").over(whole))
    return raw.select("label", "n", weight.alias("loss_weight"), F.try_divide(F.lit(1.0), F.col("n").cast("double")).alias("sample_weight"))


def importance_topk(importances: DataFrame, share: float = 0.99) -> DataFrame:
    """(feature, importance, cumulative) while the cumulative importance, largest first, is at most ``share``."""
    order = W.Window.orderBy(F.desc("importance"), "feature").rowsBetween(W.Window.unboundedPreceding, 0)
    return importances.withColumn("cumulative", F.sum("importance").over(order)).filter(F.col("cumulative") <= share)
