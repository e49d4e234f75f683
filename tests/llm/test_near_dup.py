import random
import re

import numpy as np
import pytest

from tessella.llm.graph import connected_components
from tessella.llm.near_dup import chunk_borders, chunk_keys, near_duplicates, radius_for
from tessella.llm.queries import QUERIES, SQL


def brute(rows, n, percent):
    """Component of each row by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows}, {d: len(s) for (d, _), s in zip(rows, sets, strict=True)}


def test_radius_and_borders():
    assert radius_for(1.0) == 0
    r = radius_for(0.85)
    assert 18 < r < 28
    borders = chunk_borders(r)
    assert borders[0] == 0 and borders[-1] == 64 and r < 2 * (len(borders) - 1)


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(1)
    radius = radius_for(0.85)
    borders = chunk_borders(radius)
    for _ in range(300):
        a = rng.integers(0, 256, (1, 64), np.uint8)
        b = a.copy()
        wrong = rng.choice(64, radius, replace=False)
        b[0, wrong] ^= rng.integers(1, 256, radius, np.uint8)
        assert set(chunk_keys(a, borders)[0].tolist()) & set(chunk_keys(b, borders)[0].tolist())


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, n, percent):
    rng = random.Random(n)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 30, 120, 300]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((k, " ".join(copy)))
            k += 1
            base = copy if rng.random() < 0.3 else base
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    component, sizes = brute(rows, n, percent)
    found = near_duplicates(frame, n, percent).collect()
    assert {r.doc_id: r.component_id for r in found} == component
    assert {r.doc_id: r.n_shingles for r in found} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_large_buckets_in_blocks(spark, monkeypatch):
    from tessella.llm import near_dup

    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(7)
    common = [f"c{k}" for k in range(100)]
    rows = [(k, " ".join(common + [f"d{k}_{j}" for j in range(rng.randint(5, 40))])) for k in range(60)]
    component, _ = brute(rows, 3, 85)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in found} == component


def test_shuffled_path_for_many_ids(spark, monkeypatch, docs):
    from tessella.llm import near_dup

    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    component, _ = brute(rows, 3, 85)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in found} == component


def test_query_equals_sql(agree):
    name = "op9_minhash_near_dedup"
    agree(QUERIES[name], SQL[name], "/root/testdata/sf0.01")


def test_edges(edge_docs, empty_docs):
    found = near_duplicates(edge_docs, 3, 85).collect()
    assert len(found) == edge_docs.count()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by[2].component_id == 1 and by[8].component_id == 7 and by[10].component_id == 9
    assert by[3].n_shingles == 0 and by[3].component_id == 3 and by[5].kept
    nulls = [r for r in found if r.doc_id is None]
    assert len(nulls) == 2 and all(r.component_id is None and r.kept for r in nulls)
    assert near_duplicates(empty_docs).count() == 0


def test_components_of_a_chain(spark, tmp_path):
    rows = [(k, k + 1) for k in range(40)] + [(100, 101), (None, 3)]
    found = connected_components(spark.createDataFrame(rows, "a long, b long"), str(tmp_path)).collect()
    assert {r.node: r.component for r in found} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_low_thresholds_lose_no_pair(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        words = [f"w{k}x{rng.randrange(10**9)}" for _ in range(53)]
        rows += [(2 * k, " ".join(words[:40])), (2 * k + 1, " ".join(words[13:]))]  # 27 of 53 in common
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words_per_shingle=1, percent=50).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: k - k % 2 for k in range(800)}


def test_each_text_of_an_id_is_linked(spark):
    texts = [" ".join(f"{x}{k}" for k in range(60)) for x in "abcde"]
    rows = [(1, x) for x in texts] + [(k + 2, x + " more") for k, x in enumerate(texts)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words_per_shingle=3, percent=85).collect()
    assert len(found) == 10 and {r.component_id for r in found} == {1}


@pytest.mark.parametrize("percent", [50, 60, 70, 85])
def test_recall_is_one_with_repeated_ids(spark, percent):
    rng = random.Random(percent)
    rows = []
    for k in range(120):
        size, share = rng.randint(30, 90), percent / 100
        common = [f"c{k}x{j}" for j in range(size)]
        own = max(0, int(size * (1 - share) / (2 * share)) - rng.randint(0, 1))  # about at the threshold
        rows += [(3 * k, " ".join(common + [f"a{k}x{j}" for j in range(own)])), (3 * k + 1, " ".join(common + [f"b{k}x{j}" for j in range(own)]))]
        if k % 3 == 0:
            rows.append((3 * k, " ".join(f"z{k // 6}x{j}" for j in range(40))))  # another text of an id, which others have too
    component, _ = brute(rows, 1, percent)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent).collect()
    assert len(found) == len(rows) and {r.doc_id: r.component_id for r in found} == component
    assert len(set(component.values())) < 2 * 120


@pytest.mark.parametrize("block", [4, 4096])
def test_large_buckets_components_and_copies_in_parts(spark, monkeypatch, block):
    from tessella.llm import near_dup, shared

    for module in (near_dup, shared):
        monkeypatch.setattr(module, "HOT_ROWS", 6)
    monkeypatch.setattr(near_dup, "PROBE", 1)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(11)
    common = [f"c{k}" for k in range(100)]
    rows = [(k, " ".join(common + [f"d{k % 50}_{j}" for j in range(rng.randint(5, 40))])) for k in range(80)]
    rows += [(k, " ".join(common)) for k in range(100, 130)] + [(k, None) for k in range(130, 150)] + [(None, " ".join(common))] * 8
    component, _ = brute([x for x in rows if x[0] is not None], 3, 85)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == component


def test_join_with_frequent_keys(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from tessella.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    left = spark.createDataFrame([(k % 3 if k < 200 else 100 + k, k) for k in range(220)] + [(None, 1)], "key long, x long")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "bb"), (205, "c"), (None, "n")], "key long, y string")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, left.join(right, "key", how).collect()), key=str)
        assert sorted(map(tuple, shared.join_hot(left, right, "key", F.col("x"), f"{tmp_path}/{how}", how).collect()), key=str) == plain


def test_a_cluster_has_to_name_its_shared_folder():
    from types import SimpleNamespace

    from tessella.llm.shared import shared_dir

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("spark://x", "hdfs://a/b/")) == "hdfs://a/b" and shared_dir(session("local[4]", None)).startswith("file:")
    with pytest.raises(ValueError):
        shared_dir(session("spark://x", None))
