import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.operators.analysis import class_weights
from tessella.operators.features import FEATURES
from tessella.operators.normalize import fit_normalizer, transform_normalizer
from tessella.plans import pipelines  # noqa: F401  registers the steps
from tessella.plans.registry import StepConfig, load_config, run_steps
from tessella.sources import readers, writers
from tessella.sources.files import SharedFile
from tessella.sources.paths import current_version, new_version, versions
from tessella.streaming.tokens import stream_pages, stream_tokens, write_features

from .test_labeling import card


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("pages")
    for k in range(8):
        cards = "".join(card(f"€ {100 + j}", f"Via Roma {j}", f"{j + 1} locali", "Ascensore") for j in range(4))
        (base / f"page_{k}.html").write_text(f"<!DOCTYPE html><html><body><h1>Listing {k}</h1>{cards}<p>Some text {k}.</p></body></html>")
    (base / "note.txt").write_text("no page")
    return base


def test_html_folder(spark, folder):
    rows = readers.read_html(spark, str(folder), limit=3)
    assert [r.filename for r in rows.collect()] == ["page_0.html", "page_1.html", "page_2.html"]
    assert readers.read_html(spark, str(folder)).count() == 8
    assert [r.filename for r in readers.read_html(spark, str(folder), ordered=True).collect()] == [f"page_{k}.html" for k in range(8)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_html(spark, str(folder / "none")).count()


def test_pipelines_end_to_end(spark, folder, tmp_path):
    out = str(tmp_path)
    config = {
        "preprocess": [
            {"name": "load", "step": "load_pages", "params": {"folder": str(folder)}},
            {"name": "features", "step": "extract_features"},
            {"name": "norm", "step": "normalize", "params": {"stats_path": f"{out}/stats"}},
            {"name": "save", "step": "save_tokens", "params": {"json_path": f"{out}/tokens", "csv_path": f"{out}/csv", "keys_path": f"{out}/keys.json"}},
        ],
        "labeling": [
            {"name": "label", "step": "label", "params": {"html_folder": str(folder), "json_path": f"{out}/labelled", "ids_path": f"{out}/ids.json"}},
            {"name": "analyse", "step": "analyse", "params": {"tokens_path": f"{out}/sessions", "distribution_path": f"{out}/distribution"}},
            {"name": "train", "step": "train", "params": {"model_path": f"{out}/model", "history_path": f"{out}/history", "kind": "logistic"}},
            {"name": "predict", "step": "predict", "params": {"model_path": f"{out}/model", "folder": f"{out}/predictions"}},
        ],
    }
    (tmp_path / "config.json").write_text(json.dumps(config))
    tokens = run_steps(spark, load_config(tmp_path / "config.json", "preprocess"))
    assert set(FEATURES) <= set(tokens.columns)
    assert json.loads((tmp_path / "keys.json").read_text()) == list(FEATURES)
    scored = run_steps(spark, load_config(tmp_path / "config.json", "labeling"), tokens)
    assert json.loads((tmp_path / "ids.json").read_text()) == {"FEATURE_ASCENSORE": 0, "FEATURE_LOCALI": 1, "FEATURE_PREZZO": 2, "FEATURE_TITOLO": 3, "O": 4}
    right = scored.agg(F.avg((F.col("label") == F.col("predicted_label")).cast("double"))).first()[0]
    assert right > 0.8
    truth = scored.select("text", F.col("label").alias("true_label")).distinct()
    writers.write_csv(truth, f"{out}/truth")
    compared = run_steps(spark, [StepConfig.of({"name": "e", "step": "evaluate", "params": {"truth_path": f"{out}/truth", "folder": f"{out}/eval"}})], scored)
    assert compared.count() == truth.count()
    back = readers.read_tokens(spark, f"{out}/labelled", labelled=True)
    assert back.count() == tokens.count()
    text = "\n".join(p.read_text() for p in (tmp_path / "distribution").glob("part-*"))
    assert text.splitlines()[0].startswith("O: ") or "FEATURE" in text


def test_config_rejects_unknown():
    with pytest.raises(ValueError):
        StepConfig.of({"name": "x", "step": "nothing"})
    with pytest.raises(ValueError):
        StepConfig.of({"name": "x", "step": "normalize", "more": 1})


def test_normalizer_of_few_and_no_values(spark):
    rows = spark.createDataFrame([(1.0, None, 5.0), (3.0, None, None)], "a double, b double, c double")
    stats = {r.feature: (r.mean, r["std"], r.n) for r in fit_normalizer(rows).collect()}
    assert stats["b"] == (0, 0, 0) and stats["c"] == (5, 0, 1) and stats["a"][0] == 2
    found = transform_normalizer(rows, fit_normalizer(rows)).collect()
    assert found[0].c == 0 and found[1].c is None and found[0].b is None
    assert found[0].a == pytest.approx(-(0.5**0.5))


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"text": "a", "label": "X"}\nnot json\n{"text": "b"}\n')
    assert readers.read_tokens(spark, str(tmp_path / "t.json"), tolerant=True).count() == 2
    assert readers.read_tokens(spark, str(tmp_path / "t.json"), tolerant=True, labelled=True).count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_tokens(spark, str(tmp_path / "t.json")).collect()


def test_json_round_trip(spark):
    rows = spark.createDataFrame([("a", 1.5)], "text string, length double")
    back = readers.from_token_json(readers.to_token_json(rows)).first()
    assert back.text == "a" and back.length == 1.5 and back.n_words is None


def test_versions(spark, tmp_path):
    first = new_version(spark, tmp_path / "a.json", datetime(2024, 1, 2, 3, 4, 5))
    assert first.endswith("/a_20240102_030405.json")
    with pytest.raises(FileNotFoundError):
        current_version(spark, tmp_path / "a.json")
    for name in ("a_20240102_030405.json", "a_x_20250102_030405.json", "a_old.json", "b_20260101_000000.json", "a_20260101_000000.csv"):
        (tmp_path / name).write_text("{}")
    assert [x for x, _ in versions(spark, f"file://{tmp_path}/a.json")] == ["", "20240102_030405", "20250102_030405"]
    assert current_version(spark, f"file://{tmp_path}/a.json").endswith("/a_x_20250102_030405.json")
    writers.write_artifact(spark, {"é": [1]}, tmp_path / "a_20270101_000000.json")
    assert readers.read_artifact(spark, tmp_path / "a.json") == {"é": [1]}
    (tmp_path / "a.json").write_text("{}")
    assert readers.read_artifact(spark, tmp_path / "a.json") == {}
    assert not SharedFile(spark, f"{tmp_path}/none/x").siblings()


def test_metric_log(spark, tmp_path):
    log = writers.MetricLog(spark, tmp_path / "metrics", lines=2)

    @log.timed
    def fetch(fail):
        if fail:
            raise ValueError("no")
        return 1

    assert fetch(False) == 1
    for _ in range(2):
        with pytest.raises(ValueError):
            fetch(True)
    log.close()
    found = [(r.method, r.status_code, r.message) for r in readers.read_metrics(spark, str(tmp_path / "metrics"), "fetch").collect()]
    assert sorted(found) == [("fetch", 200, ""), ("fetch", 500, "no"), ("fetch", 500, "no")]
    assert readers.read_metrics(spark, str(tmp_path / "metrics"), "other").count() == 0


def test_truth_skeleton(spark, tmp_path):
    writers.write_truth_skeleton(spark.createDataFrame([("a, b", 1), ("c", 2)], "text string, n long"), str(tmp_path / "truth"))
    assert sorted(r.text for r in readers.read_csv(spark, str(tmp_path / "truth"), "text string").collect()) == ["a, b", "c"]


def test_missing_class_has_the_largest_weight(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    found = {r.label: r.loss_weight for r in class_weights(rows, classes=["a", "b", "c"]).collect()}
    assert found["c"] > found["b"] > found["a"]


def test_streams(spark, folder, tmp_path):
    tokens = stream_tokens(stream_pages(spark, str(folder))).writeStream.format("memory").queryName("tokens").trigger(availableNow=True).start()
    tokens.awaitTermination(120)
    assert spark.table("tokens").select("page_id").distinct().count() == 8
    write_features(stream_pages(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.table("tokens").count()
