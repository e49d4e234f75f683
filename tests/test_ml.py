import random

import pytest

from tessella.operators import ml


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for name, n, at in (("a", 400, (0, 0)), ("b", 60, (4, 0)), ("c", 20, (0, 4)), ("d", 2, (9, 9)), ("e", 1, (-9, 9))):
        data += [(name, rng.gauss(at[0], 0.6), rng.gauss(at[1], 0.6)) for _ in range(n)]
    data += [("a", 0.0, 0.0)] * 40  # equal rows count one by one
    return spark.createDataFrame(data, "label string, x double, y double")


def counts(frame):
    return {r.label: r["count"] for r in frame.groupBy("label").count().collect()}


@pytest.mark.parametrize("size", [100_000, 50])
def test_split_gives_each_class_its_part(rows, monkeypatch, size):
    monkeypatch.setattr(ml, "CLASS_ROWS", size)
    train, test = (counts(x) for x in ml.stratified_split(rows, part=0.2))
    assert {k: train.get(k, 0) + test.get(k, 0) for k in "abcde"} == {"a": 440, "b": 60, "c": 20, "d": 2, "e": 1}
    assert (test["d"], train["e"], test.get("e", 0)) == (1, 1, 0)
    for k, n in (("a", 440), ("b", 60), ("c", 20)):
        assert test[k] == pytest.approx(0.2 * n, abs=0 if size > 50 else 5)


def test_balanced_rows(rows):
    found = counts(ml.balanced(rows.filter("label < 'd'")))
    assert sum(found.values()) == pytest.approx(520, rel=0.1) and max(found.values()) < 1.3 * min(found.values())


@pytest.mark.parametrize("kind", ["perceptron", "logistic"])
def test_training_stops_early_and_keeps_the_best(rows, kind):
    kept = rows.filter("label < 'd'")
    model, history = ml.train_classifier(kept, ["x", "y"], kind=kind, epochs=60, step=5, patience=2)
    found = history.toPandas()
    assert list(found.columns) == ["epoch", "train_loss", "val_loss", "val_f1_macro"] and len(found) < 12
    best = found.val_f1_macro.idxmax()
    assert len(found) - 1 - best <= 2 and found.val_f1_macro.max() > 0.9
    scored = ml.predict(model, kept, ["x", "y"])
    assert scored.filter("label = predicted_label").count() > 0.95 * kept.count()


def test_weights_help_rare_classes(spark):
    rng = random.Random(1)
    data = [("a", rng.gauss(0, 1)) for _ in range(900)] + [("b", rng.gauss(1.5, 1)) for _ in range(45)]
    rows = spark.createDataFrame(data, "label string, x double")
    hits = {}
    for weighted in (True, False):
        model, _ = ml.train_classifier(rows, ["x"], epochs=20, hidden=4, weighted=weighted)
        hits[weighted] = ml.predict(model, rows, ["x"]).filter("label = 'b' and predicted_label = 'b'").count()
    assert hits[True] > hits[False] + 10


def test_rate_of_descent(rows):
    _, history = ml.train_classifier(rows.filter("label < 'd'"), ["x", "y"], epochs=15, step=5, rate=0.05)
    assert 1 <= history.count() <= 3


def test_forest(rows):
    found = {r.feature: r.importance for r in ml.forest_importances(rows, ["x", "y"], trees=10).collect()}
    assert sum(found.values()) == pytest.approx(1) and min(found.values()) > 0.1
    assert {r.feature for r in ml.select_features(rows, ["x", "y"], share=1.0, trees=10).collect()} == {"x", "y"}


@pytest.mark.parametrize("size", [100_000, 50])
def test_split_is_exact_whatever_the_size_of_classes(spark, monkeypatch, size):
    monkeypatch.setattr(ml, "CLASS_ROWS", size)
    data = [("many", k) for k in range(1013)] + [("alike", 7)] * 258 + [(None, k) for k in range(13)] + [("two", 1)] * 2 + [("one", 1)]
    rows = spark.createDataFrame(data, "label string, x long").repartition(3)
    train, test = (x.collect() for x in ml.stratified_split(rows))
    found = {k: sum(r.label == k for r in test) for k in ("many", "alike", None, "two", "one")}
    assert found == {"many": 203, "alike": 52, None: 3, "two": 1, "one": 0}
    assert sorted(map(str, map(tuple, train + test))) == sorted(map(str, data))


def test_split_of_nothing(spark):
    train, test = ml.stratified_split(spark.createDataFrame([], "label string, x long"))
    assert (train.count(), test.count()) == (0, 0)


def test_turns_of_training_read_written_rows(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    kept = rows.filter("label < 'd'")
    ml.train_classifier(kept.mapInArrow(counted, kept.schema), ["x", "y"], epochs=20, step=5, patience=4)
    assert seen.value <= 8 * kept.count()


def test_scores_are_those_of_the_report(rows):
    from pyspark.sql import functions as F

    from tessella.operators.evaluate import macro_f1

    model, history = ml.train_classifier(rows, ["x", "y"], epochs=5, step=5)
    loss, score = ml._scores(model, rows.withColumn("label", F.when(F.col("x") > -9, F.col("label"))), "label")
    scored = ml.predict(model, rows, ["x", "y"]).filter("x > -9")
    assert score == pytest.approx(macro_f1(scored, "label", "predicted_label").first().macro_f1) and 0 < loss < 5
