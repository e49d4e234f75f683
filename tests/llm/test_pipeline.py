import numpy as np
import public_tokenizers

import corpus_pipeline
from tessella.llm.mixing import mix

from .test_decontamination import brute as brute_benchmark
from .test_near_dup import brute as brute_near
from .test_packing import wanted as packed
from tessella.llm.token_encode import PieceEncoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf, docs):
    frame = spark.createDataFrame(docs[COLUMNS])
    rows = {d: t for d, t in zip(docs.doc_id, docs.text, strict=True)}
    names = [f for _, f in corpus_pipeline.STAGES]
    one = names[0](spark, frame, sf)
    assert one.columns == COLUMNS and {r.doc_id for r in one.collect()} == set(rows)
    component, _ = brute_near(list(rows.items()), 5, 80)
    two = names[1](spark, one, sf)
    kept = {d for d in rows if component[d] == d}
    assert {r.doc_id for r in two.collect()} == kept < set(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_benchmark([(d, rows[d]) for d in kept], items)}
    three = names[2](spark, two, sf)
    assert {r.doc_id for r in three.collect()} == kept - leaked
    four = names[3](spark, three, sf)
    chosen = {r.doc_id for r in mix(three).filter("sampled").collect()}
    assert four.columns == COLUMNS and {r.doc_id for r in four.collect()} == chosen
    encoder = PieceEncoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    five = sorted(tuple(r) for r in names[4](spark, four, sf).collect())
    assert five == packed([(int(d), rows[d]) for d in chosen], encoder)
    assert np.all(sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == np.array(five))


def test_edges(spark, sf, edge_docs, empty_docs):
    docs = edge_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == edge_docs.columns
    left = {r.doc_id for r in docs.collect()}
    assert not left & {None, 2, 3, 4, 5, 6, 8, 10}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs, sf).count() == 0


def test_rows_are_judged_by_text_whatever_their_id(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    clean = "the people of the town were glad that the long winter was over and that the fields were green again"
    names = [f for _, f in corpus_pipeline.STAGES]
    rows = [(None, "before " + item, "en"), (None, clean, "en"), (7, "x " + item, "en"), (7, clean + " seven", "en"), (8, None, "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'clash' as mark", "'clash' as _id")
    left = names[2](spark, frame, sf).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(None, clean), (7, clean + " seven"), (8, None)], key=str)
    own = [(k, clean + f" number {k} " * 3, "en") for k in range(20)]
    foreign = [(None, "ზღვა და მთა არის ლამაზი", None), (30, "მთვარე ანათებს", None)]
    texts = {r.text for r in names[0](spark, spark.createDataFrame(own + foreign + [(None, clean, None), (31, "Yes.", None), (32, "12", "en")], frame.schema[:3]), sf).collect()}
    assert texts == {t for _, t, _ in own} | {clean, "Yes."}


def test_one_document_of_each_group_stays(spark, sf):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, base), (None, base), (5, base), (5, base), (9, base + " tail"), (None, base + " more"), (None, "other text alone"), (None, "other text alone"), (6, "lone"), (6, "lone"), (6, base + " x"), (None, None), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["9 MinHash near-dedup"](spark, frame, sf).collect()), key=str)
    assert left == sorted([(5, base), (None, "other text alone"), (None, None)], key=str)


def test_work_folders_are_removed(spark, sf):
    from tessella.llm.shared import folders

    before = set(folders(spark))
    corpus_pipeline.run(spark, sf).count()
    assert [x.rsplit("/", 1)[1].split("-")[0] for x in folders(spark) if x not in before] == ["pipeline", "packed"]
