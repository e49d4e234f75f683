import numpy as np
import pytest

from tessella.llm.mixing import DIMENSIONS, mix, probabilities, sample_documents
from tessella.llm.queries import QUERIES, SQL


def test_query_equals_sql(agree):
    name = "op2_source_mixing"
    agree(QUERIES[name], SQL[name], "/root/testdata/sf0.01")


def test_marginals_are_met(spark, tmp_path):
    rows = [(s, lang, t, n) for s, n0 in (("a", 900), ("b", 90), ("c", 10)) for lang, f in (("en", 3), ("de", 1)) for t, g in (("x", 1), ("y", 2)) for n in [n0 * f * g]]
    found = probabilities(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), 0.2, str(tmp_path)).toPandas()
    assert found.raked_share.sum() == pytest.approx(1)
    powers = {"source": 0.5, "lang": 0.5, "topic": 0.8}
    for d in DIMENSIONS:
        natural = {}
        for r in rows:
            natural[dict(zip(DIMENSIONS, r, strict=False))[d]] = natural.get(dict(zip(DIMENSIONS, r, strict=False))[d], 0) + r[3]
        total = sum(natural.values())
        target = {k: (v / total) ** powers[d] for k, v in natural.items()}
        norm = sum(target.values())
        own = found.groupby(d).raked_share.sum().to_dict()
        assert own == pytest.approx({k: v / norm for k, v in target.items()}, abs=1e-6)
    tokens = {r[:3]: r[3] for r in rows}
    kept = sum(tokens[r.source, r.lang, r.topic] * r.probability for r in found.itertuples())
    assert kept == pytest.approx(0.2 * sum(tokens.values()))
    assert found.probability.max() <= 1


UNEVEN = [(s, lang, t, n) for s, a in (("a", 5000), ("b", 60), ("c", 7)) for lang, b in (("en", 9), ("de", 1)) for t, c in (("x", 1), ("y", 30)) for n in [a * b * c] if (s, lang, t) not in {("a", "de", "y"), ("c", "en", "x")}]
TARGETS = {"source": {"a": 0.2, "c": 0.5, "absent": 0.1}, "lang": {"de": 0.7}}


def scaled(rows, targets, powers):
    """The raked shares, by sweeps until nothing moves."""
    total = sum(r[3] for r in rows)
    w = {r[:3]: r[3] / total for r in rows}
    want = []
    for i, d in enumerate(DIMENSIONS):
        natural = {v: sum(x for k, x in w.items() if k[i] == v) for v in {k[i] for k in w}}
        given = targets.get(d, {})
        rest = {v: x ** powers[d] for v, x in natural.items() if v not in given}
        left = 1 - sum(given.values()) if given else 1
        t = {v: given.get(v, left * rest.get(v, 0) / (sum(rest.values()) or 1)) for v in natural}
        want.append({v: x / sum(t.values()) for v, x in t.items()})
    for _ in range(3000):
        for i in range(3):
            sums = {v: sum(x for k, x in w.items() if k[i] == v) for v in want[i]}
            w = {k: x * want[i][k[i]] / sums[k[i]] for k, x in w.items()}
    return w, want


@pytest.mark.parametrize("many", [False, True])
def test_given_targets_are_met(spark, tmp_path, many):
    from tessella.llm import mixing

    powers = mixing.POWERS
    frame = spark.createDataFrame(UNEVEN, "source string, lang string, topic string, tokens long")
    found = (mixing.many_probabilities if many else probabilities)(frame, 0.1, str(tmp_path), None, TARGETS).toPandas()
    wanted, marginals = scaled(UNEVEN, TARGETS, powers)
    assert {(r.source, r.lang, r.topic): r.raked_share for r in found.itertuples()} == pytest.approx(wanted, abs=1e-5)
    for i, d in enumerate(DIMENSIONS[:2]):
        assert found.groupby(d).raked_share.sum().to_dict() == pytest.approx(marginals[i], abs=1e-6)
    assert marginals[0]["a"] / marginals[0]["c"] == pytest.approx(0.4)


def test_it_sweeps_until_the_marginals_are_met(spark, tmp_path, monkeypatch):
    from tessella.llm import mixing

    monkeypatch.setattr(mixing, "SWEEPS", 1)
    frame = spark.createDataFrame(UNEVEN, "source string, lang string, topic string, tokens long")
    found = probabilities(frame, 0.1, str(tmp_path), None, TARGETS).toPandas()
    wanted, _ = scaled(UNEVEN, TARGETS, mixing.POWERS)
    assert np.allclose([wanted[r.source, r.lang, r.topic] for r in found.itertuples()], found.raked_share, atol=1e-5)
    impossible = [("a", "en", "x", 10), ("b", "de", "x", 10)]  # source and lang go together
    frame = spark.createDataFrame(impossible, "source string, lang string, topic string, tokens long")
    found = probabilities(frame, 0.5, f"{tmp_path}/2", None, {"source": {"a": 0.9}, "lang": {"en": 0.1}}).toPandas()
    assert found.raked_share.sum() == pytest.approx(1) and found.probability.between(0, 1).all()


def test_wrong_targets_raise(spark, edge_docs):
    for targets in ({"source": {"a": 0.7, "b": 0.7}}, {"color": {"red": 1.0}}, {"lang": {"en": -0.1}}):
        with pytest.raises(ValueError):
            mix(edge_docs, targets=targets)


def test_sample_is_that_of_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chosen = {r.doc_id for r in mix(docs).filter("sampled").collect()}
    found = sample_documents(docs)
    assert found.columns == docs.columns and {r.doc_id for r in found.collect()} == chosen


def test_shuffled_path_for_many_cells(spark, sf, monkeypatch):
    from tessella.llm import mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = {r.doc_id: r.probability for r in mix(docs).collect()}
    monkeypatch.setattr(mixing, "CELLS", 0)
    assert {r.doc_id: r.probability for r in mix(docs).collect()} == pytest.approx(few, abs=1e-6)


def test_edges(edge_docs, empty_docs):
    found = mix(edge_docs).collect()
    assert len(found) == edge_docs.count()
    assert all(r.source and r.lang and 0 <= r.probability <= 1 for r in found)
    assert len({r.sampled for r in found if r.doc_id == 2}) == 1
    assert mix(empty_docs).count() == 0
    kept = sample_documents(edge_docs, keep_share=1.0)
    assert kept.columns == edge_docs.columns
    assert sample_documents(empty_docs).count() == 0
