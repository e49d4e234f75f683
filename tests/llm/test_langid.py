import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm.langid import BLOCK, Model, fold, predict_languages
from tessella.llm.queries import QUERIES


def phrases(symbols, sample):
    """Greedy phrases by searching the sample itself."""
    text, of, n = bytes(symbols), bytes(sample), 0
    for lo in range(0, len(text), BLOCK):
        block, at = text[lo : lo + BLOCK], 0
        while at < len(block):
            size = 1
            while at + size <= len(block) and block[at : at + size] in of:
                size += 1
            at += max(1, size - 1)
            n += 1
    return n


SYMBOLS = st.lists(st.integers(0, 4), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(SYMBOLS, min_size=1, max_size=4), SYMBOLS.filter(bool), SYMBOLS.filter(bool))
def test_phrases_equal_brute_force(texts, one, two):
    arrays = [np.array(t, np.uint8) for t in texts]
    samples = {"a": np.array(one, np.uint8), "b": np.array(two, np.uint8)}
    found = Model(samples).phrases(arrays)
    assert found.tolist() == [[phrases(t, samples[x]) for x in "ab"] for t in arrays]


def test_blocks_of_long_texts():
    sample = fold("the cat sat on the mat and that was that")
    text = fold("the cat and the hat sat on that mat " * 100)
    assert Model({"x": sample}).phrases([text])[0, 0] == phrases(text, sample)


def test_fold():
    assert fold("Ab,  C!") .tolist() == [1, 2, 0, 3]
    assert fold("").tolist() == [] and fold("12 !").tolist() == []
    assert (fold("éß日😀𐐀") > 26).sum() == 4


def test_held_out_accuracy(spark):
    found = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id")
    held = found[found.held_out]
    assert (held.lang_pred.values == docs.lang[held.doc_id].values).mean() >= 0.97
    assert found.score.between(0, 1).all() and 0.25 < found.held_out.mean() < 0.42


def test_edges(edge_docs, empty_docs):
    found = predict_languages(edge_docs, F.col("lang").isNotNull()).collect()
    assert len(found) == edge_docs.count()
    by = {r.doc_id: r for r in found if r.doc_id}
    for k in (3, 4, 5, 6):
        assert by[k].lang_pred == "und" and by[k].score == 0 and by[k].phrases_per_symbol is None
    assert by[1].lang_pred == "en" and by[7].lang_pred != "und"
    assert predict_languages(empty_docs, F.col("lang").isNotNull()).count() == 0
    nothing = predict_languages(edge_docs, F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_single_language_and_ties(spark):
    rows = spark.createDataFrame([(1, "abc abd", "b"), (2, "abc abd", "a")], "doc_id long, text string, lang string")
    found = predict_languages(rows, F.lit(True)).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("a", 0.0)}
    only = predict_languages(rows.filter("lang = 'b'"), F.lit(True)).collect()
    assert (only[0].lang_pred, only[0].score) == ("b", 1.0)
    assert only[0].phrases_per_symbol == pytest.approx(1 / 7)


def test_languages_of_long_documents_only_are_learnt(spark):
    rows = [(k, "the quick brown fox runs over the hills " * 30, "en") for k in range(5)]
    rows += [(k, "12 34 " * 4_000 + "быстрая рыжая лиса бежит через холмы " * 600, "ru") for k in range(5, 10)]
    found = predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {k: lang for k, _, lang in rows}


def test_query_against_brute_force(spark, tmp_path):
    """Samples, phrases, verdicts and scores of the registered query, by plain loops."""
    import re
    import zlib

    import xxhash

    from tessella.llm import langid

    words = {"en": "the cat sat on a mat and then it ran off to sea", "de": "die katze sass auf der matte und lief dann fort", "ru": "кошка сидела на коврике а потом ушла к морю"}
    rows = []
    for k in range(90):
        lang = ("en", "de", "ru")[k % 3]
        own = words[lang].split()
        rows.append((k, "12, " + ". ".join(own[(k * 7 + j * j) % len(own)].capitalize() + " " + own[(k + 3 * j) % len(own)] for j in range(k % 17)), lang if k % 10 else None))
    rows += [(90, None, "en"), (91, "123", "de"), (None, words["en"], "en"), (92, words["ru"] * 40, None), (5, words["de"], "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9), r.n_symbols) for r in QUERIES["op5_language_id"](spark, str(tmp_path)).collect())

    def plain_fold(text):
        out = []
        for c in re.sub(r"^[\W\d_]+|[\W\d_]+$", "", text or ""):
            low = ord(c.lower()[0])
            symbol = 0 if not c.isalpha() else low - 96 if 97 <= low <= 122 else 27 + low % 36
            if symbol or out[-1]:
                out.append(symbol)
        return out

    def learnt(doc_id):
        return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1

    def number(x, seed=42):
        h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True) if isinstance(x, int) else x.encode(), seed)
        return h - (1 << 64) if h >> 63 else h

    samples = {}
    for lang in words:
        own = sorted((number(d), number(t), t) for d, t, tag in rows if tag == lang and t is not None and learnt(d))[: langid.SAMPLE_DOCS]
        symbols = [y for _, _, t in own for y in (*plain_fold(t), 0)]
        samples[lang] = symbols[: langid.SAMPLE_SYMBOLS]
    wanted = []
    for d, text, _ in rows:
        symbols = plain_fold(text)
        pred, score = "und", 0.0
        if symbols:
            cost = sorted((phrases(symbols, samples[x]) * np.log2(len(samples[x])) / len(symbols), x) for x in sorted(samples))
            pred, score = cost[0][1], (cost[1][0] - cost[0][0]) / cost[1][0]
        wanted.append((str(d), d is not None and zlib.crc32(str(d).encode()) % 3 == 1, pred, round(score, 9), len(symbols)))
    assert found == sorted(wanted)
