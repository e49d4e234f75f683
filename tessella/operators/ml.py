"""Feature selection, training and scoring with pyspark.ml.

What is fitted more than once is expected to be a table already written: nothing is cached here. Training writes
the two sides of its split to the shared folder while it lasts, as every turn reads both.
"""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import AtomicType

from ..session import remove, shared_dir
from .analysis import class_weights, importance_topk, rare_class_filter

#: A split narrows a class's place by whole buckets of draws until so many rows are left, then by single draws.
CLASS_ROWS = 100_000


def assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with a vector column ``features``; nulls count as 0."""
    filled = rows.na.fill(0.0, features)
    return VectorAssembler(inputCols=features, outputCol="features").transform(filled)


def _draw(rows: DataFrame, seed: int) -> Column:
    """A number from the row's values, the same in every run."""
    return F.xxhash64(F.lit(seed), *[f.name for f in rows.schema.fields if isinstance(f.dataType, AtomicType)])


def stratified_split(rows: DataFrame, label: str = "label", part: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; each class gives its part, to the row.

    A class of two rows or more has one on either side at least, one of a single row is trained on. Rows are
    put in order by a hash of their values, and equal rows count one by one. Where the test part ends is found
    at once, by counts, so only equal rows on either side of that place are ever sorted.
    """
    names = rows.columns
    found = rows.withColumn("_draw", _draw(rows, seed))
    ends = _ends(found, label, part)
    if ends is None:
        return rows, rows.filter(F.lit(False))
    found = found.join(F.broadcast(ends), F.col(label).eqNullSafe(F.col("_label")), "left")
    tied = F.coalesce((F.col("_draw") == F.col("_end")) & (F.col("_rest") < F.col("_n")), F.lit(False))
    if ends.filter("_rest < _n").count():
        place = F.row_number().over(W.Window.partitionBy("_label").orderBy("_draw"))
        found = found.filter(~tied).withColumn("_place", F.lit(0)).unionByName(found.filter(tied).withColumn("_place", place))
    else:
        found = found.withColumn("_place", F.lit(0))
    test = F.coalesce((F.col("_draw") <= F.col("_end")) & (F.col("_place") <= F.col("_rest")), F.lit(False))
    return found.filter(~test).select(names), found.filter(test).select(names)


def _ends(rows: DataFrame, label: str, part: float) -> DataFrame | None:
    """(_label, _end, _n, _rest) of classes that are tested on: the last draw of the test part, how many rows have it, and how many of these it takes.

    Draws are counted by their first 16 bits, then by more of them within the bucket in which the part ends.
    """
    rows, at, bits = rows.select(F.col(label).alias("_label"), "_draw"), None, 48
    while True:
        inside = rows
        if at is not None:
            known = at.select(F.col("_label").alias("_known"), "_end", "_rest")
            inside = rows.join(F.broadcast(known), F.col("_label").eqNullSafe(F.col("_known")) & (F.shiftright("_draw", above) == F.col("_end")))
        inside = inside.groupBy("_label", F.shiftright("_draw", bits).alias("_bucket"), *(["_rest"] if at is not None else [])).agg(F.count("*").alias("_n"))
        own = W.Window.partitionBy("_label")
        n = F.sum("_n").over(own)
        wanted = F.when(n < 2, 0).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.round(part * n)))).cast("long") if at is None else F.col("_rest")
        inside = inside.withColumns({"_wanted": wanted, "_before": F.sum("_n").over(own.orderBy("_bucket")) - F.col("_n")})
        last = inside.filter("_before < _wanted and _wanted <= _before + _n")
        found = last.select("_label", F.col("_bucket").alias("_end"), "_n", (F.col("_wanted") - F.col("_before")).alias("_rest"))
        kept = found.collect()
        if not kept:
            return None
        at = rows.sparkSession.createDataFrame(kept, found.schema)
        if not bits:
            return at
        above, bits = bits, 0 if max(r._n for r in kept) <= CLASS_ROWS else bits - 16


def balanced(rows: DataFrame, label: str = "label", seed: int = 42) -> DataFrame:
    """As many rows as there are, drawn so that every class is expected to give the same number.

    A row of a class of n among N rows and C classes comes N / (C n) times: so many whole times, and once more
    with the probability that is left, by a hash of its values.
    """
    weights = class_weights(rows, label).select(F.col("label").alias("_label"), F.col("sample_weight").alias("_weight"))
    total = weights.agg(F.sum(1 / F.col("_weight")).alias("_total"), F.count("*").alias("_classes"))
    weights = weights.join(F.broadcast(total)).select("_label", (F.col("_total") / F.col("_classes") * F.col("_weight")).alias("_times"))
    found = rows.withColumn("_draw", F.pmod(_draw(rows, seed + 1), F.lit(1 << 20)) / (1 << 20))
    found = found.join(F.broadcast(weights), F.col(label) == F.col("_label"))
    times = (F.floor("_times") + (F.col("_draw") < F.col("_times") - F.floor("_times")).cast("long")).cast("int")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(0), times))).filter("_copy > 0").select(rows.columns)


def forest_importances(rows: DataFrame, features: list[str], label: str = "label", trees: int = 100, seed: int = 42, least: int = 2, depth: int = 30) -> DataFrame:
    """(feature, importance) of a random forest on a stratified 80 % of the classes with ``least`` rows or more."""
    kept = rare_class_filter(rows, least, label)
    train, _ = stratified_split(kept, label, 0.2, seed)
    indexed = StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetAsc").fit(kept).transform(train)
    model = RandomForestClassifier(labelCol="label_id", numTrees=trees, seed=seed, maxDepth=depth).fit(assemble(indexed, features))
    values = model.featureImportances.toArray()
    return rows.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double")


def select_features(rows: DataFrame, features: list[str], label: str = "label", share: float = 0.99, **options) -> DataFrame:
    """The features of largest importance while they make up at most ``share`` of it."""
    return importance_topk(forest_importances(rows, features, label, **options), share)


def _scores(model: PipelineModel, held: DataFrame, label: str) -> tuple[float, float]:
    """Loss and macro F1 on held-out rows, from one pass over them; classes are few."""
    scored = model.transform(held).filter(F.col(label).isNotNull())
    own = F.get(vector_to_array("probability"), F.col("label_id").cast("int"))
    pairs = scored.groupBy(F.col(label).alias("t"), F.col("predicted_label").alias("p"))
    found = pairs.agg(F.count("*").alias("n"), F.sum(-F.log(F.greatest(own, F.lit(1e-15)))).alias("loss")).collect()
    support, given, hits = Counter(), Counter(), Counter()
    for r in found:
        support[r.t] += r.n
        given[r.p] += r.n
        hits[r.t] += r.n * (r.t == r.p)
    names, n = support.keys() | given.keys(), sum(support.values())
    loss = sum(r.loss for r in found) / n if n else 0.0
    return loss, sum(2 * hits[x] / (support[x] + given[x]) for x in names) / len(names) if names else 0.0


def train_classifier(
    rows: DataFrame, features: list[str], label: str = "label", kind: str = "perceptron", hidden: int = 64, part: float = 0.2, seed: int = 42,
    epochs: int = 50, step: int = 10, patience: int = 3, weighted: bool = True, decay: float = 0.0, rate: float | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """The model of best macro F1 on held-out rows, and (epoch, train_loss, val_loss, val_f1_macro) of all that were tried.

    Training goes on from the last weights, ``step`` epochs at a time, until ``epochs`` are done or the score hasn't
    grown for ``patience`` turns. Each token is scored by itself. With ``weighted``, classes weigh alike:
    ``perceptron`` (one hidden layer) is trained on ``balanced`` rows, ``logistic`` by the weights of ``class_weights``;
    the latter begins anew at each turn and has the penalty ``decay``. A ``rate`` makes the perceptron descend by
    gradients of that rate, which is halved each time the score doesn't grow; without one it is L-BFGS.
    """
    rows = rows.na.fill(0.0, features)
    train, held = stratified_split(rows, label, part, seed)
    indexer = StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
    weights = None
    if weighted and kind == "logistic":
        weights = class_weights(train, label).select(F.col("label").alias(label), F.col("loss_weight").alias("weight"))
        train = train.join(F.broadcast(weights), label)
    elif weighted:
        train = balanced(train, label, seed)
    work = f"{shared_dir(rows.sparkSession)}/learning-{uuid.uuid4().hex}"
    try:
        sides = []
        for name, side in (("train", train), ("held", held)):
            side = side.select(label, *features, *(["weight"] if name == "train" and weights is not None else []))
            side.write.parquet(f"{work}/{name}")
            sides.append(rows.sparkSession.read.schema(side.schema).parquet(f"{work}/{name}"))
        return _fitted(*sides, indexer, features, label, kind, hidden, seed, epochs, step, patience, weighted, decay, rate)
    finally:
        remove(rows.sparkSession, work)


def _fitted(
    train: DataFrame, held: DataFrame, indexer: StringIndexerModel, features: list[str], label: str, kind: str, hidden: int, seed: int,
    epochs: int, step: int, patience: int, weighted: bool, decay: float, rate: float | None,
) -> tuple[PipelineModel, DataFrame]:
    """Turns of training on written rows; see ``train_classifier``."""
    names = indexer.labels
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=[*names, "O"])
    ready = assembler.transform(indexer.transform(train))
    best, history, start, waited = None, [], None, 0
    for epoch in range(step, epochs + 1, step):
        if kind == "logistic":
            estimator = LogisticRegression(labelCol="label_id", maxIter=epoch, regParam=decay, weightCol="weight" if weighted else None)
        else:
            estimator = MultilayerPerceptronClassifier(labelCol="label_id", layers=[len(features), hidden, len(names) + 1], maxIter=step, seed=seed)
            if rate:
                estimator.setSolver("gd").setStepSize(rate)
            if start is not None:
                estimator.setInitialWeights(start)
        fitted = estimator.fit(ready)
        start = fitted.weights if kind != "logistic" else None
        losses = fitted.summary().objectiveHistory if kind != "logistic" else fitted.summary.objectiveHistory
        model = PipelineModel(stages=[indexer, assembler, fitted, back])
        loss, score = _scores(model, held, label)
        history.append((epoch, float(losses[-1]) if losses else None, loss, score))
        if best is None or score > best[0]:
            best, waited = (score, model), 0
        else:
            waited, rate = waited + 1, rate and rate / 2
            if waited == patience:
                break
    return best[1], train.sparkSession.createDataFrame(history, "epoch int, train_loss double, val_loss double, val_f1_macro double")


def predict(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with predicted_label and probability."""
    return model.transform(rows.na.fill(0.0, features)).drop("features", "rawPrediction", "prediction", "label_id")
