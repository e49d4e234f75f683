import pytest

import __spark_entry__
from tessella.queries import QUERIES, SQL

from .conftest import DATA, LARGER


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, agree):
    agree(QUERIES[name], SQL[name], LARGER)


def test_tree_queries_hold_every_feature_of_the_tree(spark):
    from pyspark.sql import functions as F

    from tessella.operators.fast import tree_features
    from tessella.operators.features import structure_features
    from tessella.queries_tree import CONSTANT, FIRST, SECOND

    assert set(structure_features(F.lit(0))) | {"block_text_length_ratio", *CONSTANT} == set(FIRST)
    assert set(tree_features()) == set(SECOND)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"rf_importance", "classifier_predict"}))
def test_query_gives_rows(name, spark):
    assert QUERIES[name](spark, DATA).count() > 0


def test_learning_queries(spark):
    found = QUERIES["rf_importance"](spark, DATA).toPandas()
    assert abs(found.importance.sum() - 1) < 1e-6
    report = QUERIES["classifier_predict"](spark, DATA).toPandas().set_index("label")
    assert report.loc["accuracy", "f1"] >= 0.99 and report.loc["accuracy", "support"] == sum(report.support[x] for x in ("a", "p", "b", "h1", "li", "title", "O") if x in report.index)


def test_training_rows_in_parts(spark, monkeypatch):
    from tessella import queries

    whole = queries._training_rows(spark, DATA)
    monkeypatch.setattr(queries, "PART_BYTES", 1000)
    parts = queries._training_rows(spark, DATA)
    places = lambda rows: sorted(map(tuple, rows.select("page_id", "position", "label", "length", "tf_log").collect()))
    assert places(whole.selectExpr("page_id", "position", "label", "round(length, 6) length", "round(tf_log, 6) tf_log")) == places(
        parts.selectExpr("page_id", "position", "label", "round(length, 6) length", "round(tf_log, 6) tf_log")
    )
    assert len(parts.inputFiles()) > len(whole.inputFiles())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
