import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluate
from tessella.operators.labeling import LABEL_RULES, card_labels, label_ids, label_map, label_tokens, rule_label

ITEMS = {
    "90 m²": "FEATURE_SUPERFICIE", "120 mq": "FEATURE_SUPERFICIE", "3 locali": "FEATURE_LOCALI", "2 bagni": "FEATURE_BAGNI",
    "Due bagni": "FEATURE_BAGNI", "Piano terra": "FEATURE_PIANO", "Ascensore": "FEATURE_ASCENSORE", "balcone": "FEATURE_BALCONE",
    "Terrazzo": "FEATURE_TERRAZZO", "Cantina": "FEATURE_CANTINA", "Arredato": "FEATURE_ARREDATO", "di lusso": "FEATURE_LUSSO",
    "da € 5": "FEATURE_PREZZO", "01/02/2024": "FEATURE_DATA", "in asta": "FEATURE_TIPOLOGIA", "altro": "O",
    "3 locali con 2 bagni": "FEATURE_LOCALI",
}


def card(price, title, *items):
    spans = "".join(f'<div class="styles_in-listingCardFeatureList__item__CKRyT"><span>{x}</span></div>' for x in items)
    return (
        f'<div class="nd-mediaObject__content"><div class="styles_in-listingCardPrice__earBq"><span>{price}</span></div>'
        f'<a class="styles_in-listingCardTitle__Wy437 x">{title}</a>{spans}</div>'
    )


def test_rules_in_order(spark):
    assert len({label for label, *_ in LABEL_RULES}) == 13
    rows = spark.createDataFrame([(k,) for k in ITEMS], "t string").select("t", rule_label(F.col("t")).alias("label"))
    assert {r.t: r.label for r in rows.collect()} == ITEMS


def test_a_page_that_fails_is_left_out(spark, monkeypatch):
    from tessella.operators import labeling

    def broken(html):
        if "bad" in html:
            raise ValueError("bad page")
        return labeling.parse(html) and [("item", "x")]

    monkeypatch.setattr(labeling, "_found", broken)
    batch = spark.createDataFrame([(1, "bad"), (2, "fine")], "page_id long, html string").toArrow().to_batches()
    rows = [r for out in labeling._cards(batch) for r in out.to_pylist()]
    assert [(r["page_id"], r["kind"], r["error"]) for r in rows] == [(1, None, "ValueError: bad page"), (2, "item", None)]


def test_cards(spark):
    pages = spark.createDataFrame([(1, card("€ 100", "Via Roma", *ITEMS)), (2, None), (3, "<p>no card</p>")], "page_id long, html string")
    found = [(r.token, r.label) for r in card_labels(pages).orderBy("page_id", "place").collect()]
    assert found == [("€ 100", "FEATURE_PREZZO"), ("Via Roma", "FEATURE_TITOLO"), *ITEMS.items()]


def test_last_label_wins_and_default(spark):
    labels = spark.createDataFrame([(1, 0, " Roma", "A"), (2, 0, "roma ", "B"), (2, 1, "x", "C")], "page_id long, place long, token string, label string")
    tokens = spark.createDataFrame([("ROMA",), ("x",), ("y",), (None,)], "text string")
    found = {r.text: r.label for r in label_tokens(tokens, label_map(labels, "page_id", "place")).collect()}
    assert found == {"ROMA": "B", "x": "C", "y": "O", None: "O"}
    assert {r.label: r.id for r in label_ids(labels).collect()} == {"A": 0, "B": 1, "C": 2}


def test_predictions_look_up(spark):
    truth = spark.createDataFrame([(" a", "X"), ("b", "Y"), ("c", None), ("d", "O")], "text string, true_label string")
    given = spark.createDataFrame([("a", "Y", 1), ("a ", "X", 2), ("b", None, 1)], "text string, predicted_label string, n int")
    found = {r.text: (r.predicted_label, r.correct) for r in evaluate.compare_predictions(truth, given, "n").collect()}
    assert found == {" a": ("X", True), "b": ("O", False), "d": ("O", True)}


def test_report_of_nothing(spark):
    rows = spark.createDataFrame([], "true_label string, predicted_label string")
    assert evaluate.macro_f1(rows).collect()[0].macro_f1 is None


@pytest.mark.parametrize("name", ["default", "features", "complete"])
def test_split(spark, name):
    rows = spark.createDataFrame([("a", "O"), ("b", "X"), ("c", None)], "text string, predicted_label string")
    wanted = {"default": {"a", "c"}, "features": {"b"}, "complete": {"a", "b", "c"}}
    assert {r.text for r in evaluate.split_predictions(rows)[name].collect()} == wanted[name]
