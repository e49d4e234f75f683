import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tessella.llm import decontamination
from tessella.llm.decontamination import BITS, RADIUS, Group, ItemIndex, contaminated, fingerprints, hashed_words

WORD = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def shingles(text, n=5):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def brute(docs, items, least=0.8):
    out = {}
    for d, text in docs:
        for i, item in items:
            n = min(5, len(shingles(item, 1)))
            own, wanted = shingles(text, n or 1), Counter(shingles(item, n or 1))
            size = sum(wanted.values())
            m = min(size, len(own))
            for at in range(len(own) - m + 1) if m else ():
                c = Counter(own[at : at + m])
                common = sum(min(n, wanted[k]) for k, n in c.items())
                s = common / (m + size - common)
                if s >= least and s > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (s, at)
    return out


def test_against_all_windows(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = contaminated(spark.createDataFrame(docs), items).collect()
    wanted = brute(docs[["doc_id", "text"]].values.tolist(), [(r.item_id, r.text) for r in items.collect()])
    assert wanted and {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in found} == wanted
    assert all(r.distance <= RADIUS for r in found)


def test_changed_copies(spark, docs):
    item = " ".join(f"item{k}" for k in range(60))
    words = item.split()
    one, two = list(words), list(words)
    one[-2], two[20], two[40] = "other", "x", "y"
    rows = [(1, "before " + item.upper() + ", after"), (2, "a b " + " ".join(one)), (3, " ".join(two)), (4, " ".join(words[:55])), (5, ", ".join(words))]
    found = {r.doc_id for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert found == {d for d, _ in brute(rows, [(9, item)])} == {1, 2, 4, 5}


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(0)
    group = Group(list(range(300)), list(rng.integers(0, 1 << 63, (300, 20), np.uint64)))
    for k in rng.integers(300, size=100).tolist():
        bits = np.unpackbits(group.prints[k : k + 1].view(np.uint8))
        bits[rng.choice(BITS, RADIUS, replace=False)] ^= 1
        _, items, distance = group.candidates(np.packbits(bits).view(np.uint16)[None])
        assert distance[items == k].tolist() == [RADIUS]


def test_values_within_the_wrong_bits():
    rng = np.random.default_rng(0)
    wanted = rng.integers(0, 65536, 50).astype(np.uint16)
    for n in (100, 30_000):  # compared with all values, or all wrong bits enumerated
        values = np.unique(rng.integers(0, 65536, n).astype(np.uint16))
        close = np.nonzero(np.bitwise_count(wanted[:, None] ^ values) <= decontamination.ERRORS)
        found = decontamination.near_values(wanted, values)
        assert sorted(zip(*map(list, found), strict=True)) == sorted(zip(*map(list, close), strict=True))


def test_few_unrelated_pairs_are_candidates():
    rng = np.random.default_rng(1)
    group = Group(list(range(500)), list(rng.integers(0, 1 << 63, (500, 20), np.uint64)))
    other = rng.integers(0, 65536, (200, BITS // 16)).astype(np.uint16)
    shared = sum((np.bitwise_count(other[:, None, b] ^ group.prints[None, :, b]) <= decontamination.ERRORS).astype(int) for b in range(BITS // 16))
    assert (shared >= decontamination.ENOUGH).mean() < 0.01


def test_prints_of_windows_are_those_of_their_shingles(monkeypatch):
    own = np.random.default_rng(2).integers(0, 1 << 63, 500, np.uint64)
    monkeypatch.setattr(decontamination, "SPAN", 60)
    found = fingerprints(own, np.arange(451), 50)
    for k in (0, 1, 59, 60, 300, 450):
        assert found[k].tolist() == fingerprints(own[k : k + 50], np.array([0]), 50)[0].tolist()


def test_short_items_match_equal_sequences(spark):
    docs = [(1, "He asked: who wrote Hamlet, Shakespeare?"), (2, "who wrote hamlet"), (3, "who wrote the hamlet shakespeare"), (4, "hamlet"), (None, "WHO WROTE HAMLET SHAKESPEARE")]
    items = [(1, "who wrote hamlet shakespeare"), (2, "Hamlet"), (None, "wrote hamlet"), (None, "who wrote"), (5, "--"), (6, None)]
    frame = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = sorted(((r.doc_id, r.item_id, r.first_word, r.n_words) for r in frame.collect()), key=str)
    full = [(1, 2, 4, 1), (1, 1, 2, 4), (1, None, 2, 2), (1, None, 3, 2), (2, 2, 2, 1), (2, None, 0, 2), (2, None, 1, 2), (3, 2, 3, 1), (3, None, 0, 2), (4, 2, 0, 1)]
    full += [(None, 1, 0, 4), (None, 2, 2, 1), (None, None, 0, 2), (None, None, 1, 2)]
    assert found == sorted(full, key=str)


def test_very_long_text_and_clashing_columns(spark):
    item = " ".join(f"item{k}" for k in range(40))
    long = " ".join(f"w{k % 5000} item{k % 40}" for k in range(60_000)) + " " + item + " tail"
    docs = spark.createDataFrame([(1, long, "x", "y")], "doc_id long, text string, item_id string, mark string")
    bench = spark.createDataFrame([(7, item, "z", "z")], "item_id long, text string, doc_id string, mark string")
    assert [(r.doc_id, r.item_id, r.first_word) for r in contaminated(docs, bench).collect()] == [(1, 7, 120_000)]


def test_passes_over_a_large_benchmark(spark, monkeypatch, docs):
    items = [(k, docs.text[k][:400]) for k in range(20)]
    frame, bench = spark.createDataFrame(docs), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in contaminated(frame, bench).collect()}
    monkeypatch.setattr(decontamination, "INDEX_BYTES", 20_000)
    assert {(r.doc_id, r.item_id) for r in contaminated(frame, bench).collect()} == whole != set()


def test_edges(spark, edge_docs, empty_docs):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, "too few words"), (None, "with a tail the big bad wolf"), (1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    found = contaminated(edge_docs, items).collect()
    assert sorted(((r.doc_id or -1, r.item_id) for r in found), key=str) == [(-1, 1), (1, 1), (2, 1), (2, 1)]
    assert contaminated(empty_docs, items).count() == 0
    assert contaminated(edge_docs, items.limit(0)).count() == 0


def test_short_document_is_compared_whole():
    index = ItemIndex([1], [" ".join(f"t{k}" for k in range(30))])
    hashes, _ = hashed_words(pa.array([" ".join(f"t{k}" for k in range(27))]))
    assert index.matches(hashes, 0.8)[0][2] == 27
