"""The four pipelines as steps: preprocess, labelling, training and inference.

Steps hand over lazily; what they write can be read back by the next pipeline.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analysis import label_distribution, session_positions
from ..operators.evaluate import classification_report, compare_predictions, confusion_pairs
from ..operators.features import FEATURES, page_token_features
from ..operators.labeling import card_labels, label_ids, label_map, label_tokens
from ..operators.ml import predict, select_features, train_classifier
from ..operators.normalize import fit_normalizer, transform_normalizer
from ..sources.readers import read_artifact, read_csv, read_html
from ..sources.writers import feature_keys, write_artifact, write_csv, write_distribution, write_json, write_label_ids, write_predictions
from .registry import step


@step("load_pages")
def load_pages(spark: SparkSession, rows: DataFrame | None, folder: str, pattern: str = "*.html", limit: int | None = None) -> DataFrame:
    """(page_id, html): page_id is the file name."""
    return read_html(spark, folder, pattern, limit).select(F.col("filename").alias("page_id"), F.col("content").alias("html"))


@step("extract_features")
def extract_features(spark: SparkSession, rows: DataFrame, strict: bool = False) -> DataFrame:
    tokens = page_token_features(rows, strict=strict)
    return tokens.withColumn("meta", F.create_map(F.lit("filename"), F.col("page_id").cast("string")))


@step("normalize")
def normalize(spark: SparkSession, rows: DataFrame, stats_path: str, fit: bool = True) -> DataFrame:
    """Fits on all rows and saves the statistics, or applies saved ones."""
    if fit:
        fit_normalizer(rows, list(FEATURES)).coalesce(1).write.mode("overwrite").parquet(stats_path)
    return transform_normalizer(rows, spark.read.parquet(stats_path))


@step("save_tokens")
def save_tokens(spark: SparkSession, rows: DataFrame, json_path: str, csv_path: str | None = None, keys_path: str | None = None) -> DataFrame:
    write_json(rows, json_path)
    saved = spark.read.schema(rows.schema).json(json_path)
    if csv_path:
        write_csv(saved, csv_path)
    if keys_path:
        write_artifact(spark, [c for c in feature_keys(rows) if c in FEATURES], keys_path)
    return saved


@step("label")
def label(spark: SparkSession, rows: DataFrame, html_folder: str, json_path: str, ids_path: str, pattern: str = "*.html") -> DataFrame:
    """Labels tokens by the cards of the pages of a folder; the last card by file name and place counts."""
    pages = read_html(spark, html_folder, pattern)
    numbered = pages.select(F.xxhash64("filename").alias("page_id"), "filename", F.col("content").alias("html"))
    found = card_labels(numbered).join(numbered.select("page_id", "filename"), "page_id")
    labelled = label_tokens(rows, label_map(found, "filename", "place"))
    write_json(labelled, json_path)
    saved = spark.read.schema(labelled.schema).json(json_path)
    write_label_ids(label_ids(saved), ids_path)
    return saved


@step("select_features")
def select(spark: SparkSession, rows: DataFrame, path: str, trees: int = 100) -> DataFrame:
    chosen = select_features(rows, list(FEATURES), trees=trees)
    write_artifact(spark, [r.feature for r in chosen.orderBy(F.desc("importance"), "feature").collect()], path)
    return rows


@step("analyse")
def analyse(spark: SparkSession, rows: DataFrame, tokens_path: str, distribution_path: str) -> DataFrame:
    sessions = session_positions(rows, F.col("text") == "html", ["page_id"], ["position"])
    write_json(sessions.select("position", "relative_position", "label", "text"), tokens_path)
    write_distribution(label_distribution(rows), distribution_path)
    return rows


@step("train")
def train(spark: SparkSession, rows: DataFrame, model_path: str, history_path: str, features_path: str | None = None, kind: str = "perceptron") -> DataFrame:
    features = read_artifact(spark, features_path) if features_path else list(FEATURES)
    model, history = train_classifier(rows, features, kind=kind)
    model.write().overwrite().save(model_path)
    write_csv(history, history_path)
    return rows


@step("predict")
def predict_tokens(spark: SparkSession, rows: DataFrame, model_path: str, folder: str, features_path: str | None = None) -> DataFrame:
    features = read_artifact(spark, features_path) if features_path else list(FEATURES)
    scored = predict(PipelineModel.load(model_path), rows, features)
    write_predictions(scored, folder)
    return scored


@step("evaluate")
def evaluate(spark: SparkSession, rows: DataFrame, truth_path: str, folder: str) -> DataFrame:
    truth = read_csv(spark, truth_path, "text string, true_label string")
    compared = compare_predictions(truth, rows.withColumn("_order", F.struct("page_id", "position")), "_order")
    write_csv(compared, f"{folder}/error_analysis")
    write_json(classification_report(compared), f"{folder}/report")
    write_csv(confusion_pairs(compared), f"{folder}/confusion")
    return compared
