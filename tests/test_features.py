import math
import statistics

import pytest

from tessella.functions.text import char_entropy, strip, text_features, word_list
from tessella.operators.features import FEATURES, page_token_features


@pytest.fixture(scope="module")
def page(spark):
    def run(html, **options):
        rows = spark.createDataFrame([(1, html)], "page_id long, html string")
        return [r.asDict() for r in page_token_features(rows, **options).orderBy("position").collect()]

    return run


def test_there_are_a_hundred():
    assert len(FEATURES) == len(set(FEATURES)) == 100


SAMPLES = ["90 m²", "Via Roma 12, TRILOCALE!", "a", "12345", " x ", "étè", "A.B.C!?", "été", "aa bb  cc", "²³"]


def test_text_features_equal_python(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(s.strip(),) for s in SAMPLES], "t string").withColumn("w", word_list(F.col("t")))
    found = frame.select("t", *[c.alias(n) for n, c in text_features(F.col("t"), F.col("w")).items()]).collect()
    for r in found:
        t, words = r.t, r.t.split()
        upper, lower = sum(map(str.isupper, t)), sum(map(str.islower, t))
        assert r.length == len(t) and r.n_words == len(words)
        assert r.n_digits == sum(map(str.isdigit, t))
        assert r.n_special_chars == sum(not c.isalnum() and not c.isspace() for c in t)
        assert r.is_numeric_token == float(t.isdigit())
        assert r.capital_ratio == pytest.approx(upper / (upper + lower) if upper + lower else 0)
        assert r.distinct_ratio == pytest.approx(len(set(t)) / len(t))
        entropy = -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))
        assert r.char_entropy == pytest.approx(entropy)
        bigrams = [t[i : i + 2] for i in range(len(t) - 1)]
        assert r.uniq_bigram_ratio == pytest.approx(len(set(bigrams)) / len(bigrams) if bigrams else 0)


def test_strip_and_entropy_of_nothing(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("  a 　", "aa")], "a string, b string").select(strip(F.col("a")).alias("a"), char_entropy(F.col("b")).alias("e")).first()
    assert row.a == "a" and row.e == 0


def test_blocks_between_delimiters(page):
    html = "".join(f"<p>{t}</p>" for t in ["intro", "€ 1", "aaaa", "3 locali", "bb", "€ 2", "one", "€ 3", "xx", "yy"])
    found = page(html)
    by = {r["text"]: r for r in found}
    assert by["aaaa"]["is_between_price_and_locali"] == 1 and by["bb"]["is_between_price_and_locali"] == 0
    assert [by[t]["length_rank_in_block"] for t in ("3 locali", "aaaa", "bb")] == [1, 2, 3]
    assert by["intro"]["dist_from_last_price_token"] == 1 and by["bb"]["dist_from_last_price_token"] == 3
    assert by["€ 1"]["length_rank_in_block"] == 0
    assert by["one"]["length_z_to_block_median"] == 0 and by["xx"]["length_z_to_block_median"] == 0
    lengths = [8, 4, 2]
    assert by["3 locali"]["length_z_to_block_median"] == pytest.approx((8 - 4) / statistics.stdev(lengths))


def test_strict_leaves_out_what_cannot_be_divided(page):
    flat = "".join(f"<p>{t}</p>" for t in ["€ a", "xx", "yy", "€ b", "zzz"])
    assert len(page(flat)) == 5
    assert page(flat, strict=True) == []
    equal = "<p>aa</p><p>bb</p>"
    assert [r["length_zscore"] for r in page(equal)] == [0, 0] and page(equal, strict=True) == []


def test_one_token_and_empty_pages(page):
    only = page("<p>x</p>")[0]
    assert only["relative_position"] == 0 and only["length_zscore"] == 0 and only["window_std_length"] == 0
    assert page("") == [] and page(None) == []


def test_quirks(page):
    found = page("<div><p>ab</p><p>cde</p></div>")
    assert [r["relative_depth_ratio"] for r in found] == [2.5, 2.5]  # ancestors + 1 / greatest depth
    assert {r["dom_path_length"] for r in found} == {1.0} and found[0]["path_length"] == 3
    assert found[0]["neigh_len_diff"] == pytest.approx((2 + 1) / 2)


def test_second_variant(spark):
    from tessella.operators.fast import fast_token_features

    html = "<div><p>aa Bb</p><p>aa</p><p>cccc €</p></div>"
    found = [r.asDict() for r in fast_token_features(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("position").collect()]
    assert [r["length_rank_in_block"] for r in found] == [2, 3, 1]
    assert [r["percentile_token_length"] for r in found] == pytest.approx([2 / 3, 1 / 3, 1])
    assert [r["token_distance_to_next"] for r in found] == [2, 6, 0]
    assert {r["dom_path_length"] for r in found} == {2} and found[0]["capital_ratio"] == 0.25
    assert [r["token_dist_to_block_mid"] for r in found] == pytest.approx([1 / 3, 0, 1 / 3])
    assert {r["block_avg_token_distance"] for r in found} == {0}
    assert [r["uniq_ratio"] for r in found] == [0.5, 0.25, 0.5]
