"""Predictions against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import share, strip


def compare_predictions(truth: DataFrame, predictions: DataFrame, order: str, default: str = "O") -> DataFrame:
    """truth(text, true_label, ...) with predicted_label and correct, for every row with a label.

    Texts are matched stripped; of predictions that repeat a text the last in the order counts, and a
    missing or null one is the default.
    """
    key = strip(F.col("text"))
    last = predictions.groupBy(key.alias("key")).agg(F.max_by("predicted_label", order).alias("predicted_label"))
    rows = truth.filter(F.col("true_label").isNotNull()).withColumn("key", key).join(last, "key", "left")
    found = F.coalesce("predicted_label", F.lit(default))
    return rows.select(*truth.columns, found.alias("predicted_label"), (F.col("true_label") == found).alias("correct"))


def classification_report(rows: DataFrame, true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """(label, precision, recall, f1, support) of every class of either column, and accuracy and averages.

    Divisions by zero give 0. The rows ``accuracy``, ``macro avg`` and ``weighted avg`` come from the
    class table, which is as long as there are classes.
    """
    pairs = rows.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given"), F.lit(0).cast("long").alias("hits")),
            )
        ).alias("x")
    ).select("x.*")
    classes = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "given", "hits")])
    precision, recall = share(F.col("hits"), F.col("given")), share(F.col("hits"), F.col("support"))
    classes = classes.select(
        "label", precision.alias("precision"), recall.alias("recall"), share(2 * precision * recall, precision + recall).alias("f1"), "support", "hits"
    )
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    weighted = [share(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in names]
    accuracy = share(F.sum("hits"), total)
    tail = [
        classes.agg(F.lit("accuracy").alias("label"), *[accuracy.alias(c) for c in names], total.alias("support")),
        classes.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names], total.alias("support")),
        classes.agg(F.lit("weighted avg").alias("label"), *weighted, total.alias("support")),
    ]
    out = classes.drop("hits")
    for t in tail:
        out = out.unionByName(t)
    return out


def macro_f1(rows: DataFrame, true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """One row: the mean F1 of all classes of either column."""
    return classification_report(rows, true, predicted).filter("label = 'macro avg'").select(F.col("f1").alias("macro_f1"))


def confusion_matrix(rows: DataFrame, labels: list[str] | None = None, true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """True labels down, predicted ones across."""
    return rows.groupBy(true).pivot(predicted, labels).agg(F.count(F.lit(1))).na.fill(0)


def confusion_pairs(rows: DataFrame, true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """(true_label, predicted_label, n): the matrix in long form."""
    return rows.groupBy(F.col(true).alias("true_label"), F.col(predicted).alias("predicted_label")).agg(F.count("*").alias("n"))


#: The parts that predictions are written in.
SPLITS = ("default", "features", "complete")


def split_predictions(rows: DataFrame, default: str = "O", predicted: str = "predicted_label") -> dict[str, DataFrame]:
    """The rows predicted as the default, the others, and all."""
    plain = F.coalesce(F.col(predicted) == default, F.lit(True))
    return dict(zip(SPLITS, (rows.filter(plain), rows.filter(~plain), rows), strict=True))
