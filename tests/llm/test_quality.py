import re
from collections import Counter
from math import log

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from tessella.llm import quality_classifier as classifier
from tessella.llm import quality_rules as rules
from tessella.llm.quality_classifier import LABELLERS, classify_quality, fit_label_model

WORD = r"[^\x20\x09-\x0D]+"


def repeated(w):
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(grams)
    return len({j for i, g in enumerate(grams) if counts[g] > 1 for j in (i, i + 1, i + 2)})


def base(text):
    text = text or ""
    w = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n, r = len(w), repeated(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(w):
    """As the engine hashes: XXH64 with seed 42, the hash of one word seeding the next."""
    one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    two = [xxhash.xxh64_intdigest(b.encode(), h) for h, b in zip(one, w[1:], strict=False)]
    return [signed(h) % rules.BUCKETS for h in one + two]


def test_against_brute_force(spark, docs):
    found = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(docs)).collect()}
    raw, target, own = Counter(), Counter(), {}
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        n, chars, symbols, dup, repeat, failed = base(text)
        r = found[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        own[d] = buckets(re.findall(WORD, text))
        raw.update(own[d])
        if n >= 50 and 50 * symbols <= n and 3 * n <= chars <= 12 * n and dup == 0:
            target.update(own[d])
    a, b = sum(raw.values()) + rules.BUCKETS, sum(target.values()) + rules.BUCKETS
    for d, grams in own.items():
        score = sum(log((target[g] + 1) / b) - log((raw[g] + 1) / a) for g in grams) / len(grams)
        assert found[d].log_ratio == pytest.approx(score, abs=1e-9) and found[d].n_ngrams == len(grams)
        assert found[d].kept == (not found[d].base_failed and score >= rules.THRESHOLD)


TEXTS = ["a b c a b c", "x x x x x", "a b c d a b c d a b", "one\none\n \n one\none", "# * é <b>|\x1c y", "a b c", "\t\n", "p q r s t p q r"]


def test_odd_texts(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in rules.quality_rules(frame).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(TEXTS[r.doc_id])


def test_windows_of_equal_hashes_are_compared(spark, monkeypatch):
    from pyspark.sql import functions as F

    true_hash = F.xxhash64
    monkeypatch.setattr(rules.F, "xxhash64", lambda *c: true_hash(*c) % 3 if len(c) == 3 else true_hash(*c))
    frame = spark.createDataFrame(list(enumerate(TEXTS + ["a b c d e f g h i j", "a b c x a b d y a b c z b c x"])), "doc_id long, text string")
    for r in rules.base_counts(frame).collect():
        assert r.n_repeat_words == repeated(r.words)


def test_rules_edges(edge_docs, empty_docs):
    found = rules.quality_rules(edge_docs).collect()
    assert len(found) == edge_docs.count()
    by = {r.doc_id: r for r in found if r.doc_id}
    for k in (3, 4, 5):
        assert by[k].n_words == 0 and by[k].base_failed and not by[k].kept and by[k].log_ratio is None
    assert by[7].n_words == 80_000
    assert rules.quality_rules(empty_docs).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    accuracy = [0.95, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(20_000) < 0.2, 0, np.where(rng.random(20_000) < a, 1, -1) * np.where(truth, 1, -1)) for a in accuracy], axis=1)
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, tables, good = fit_label_model(patterns.astype(np.int8), counts.astype(float))
    assert prior == pytest.approx(0.7, abs=0.03)
    for k, a in enumerate(accuracy):
        assert tables[k, 1, 2] / (tables[k, 1, 0] + tables[k, 1, 2]) == pytest.approx(a, abs=0.05)
    assert ((good[index.ravel()] > 0.5) == truth).mean() > 0.9


def test_classifier_against_labels(spark):
    base_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base_dir}/documents.parquet")
    found = classify_quality(docs).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{base_dir}/labels.parquet").toPandas().drop_duplicates("doc_id").set_index("doc_id")
    own = found.loc[labels.index]
    assert own.kept[labels.quality == 1].mean() > 0.98 and own.kept[labels.quality == 0].mean() < 0.3
    assert set(found.votes.str.len()) == {len(LABELLERS)}


def plain_votes(text):
    data = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    low = re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", data.lower())
    n, size, m = len(w), sum(map(len, w)), len(low)

    def count(cond):
        return sum(map(cond, data))

    symbols, upper, digits = count(lambda b: b in b"#*$%&|<>{}=~^\\"), count(lambda b: 65 <= b <= 90), count(lambda b: 48 <= b <= 57)
    letters = count(lambda b: 97 <= (b | 32) <= 122 or b >= 192)
    ends, distinct = sum(x[-1:] in (b".", b"!", b"?") for x in w), len(set(low))
    function, insults = (sum(x.decode() in words for x in low) for words in (set(classifier.FUNCTION_WORDS), set(classifier.INSULTS)))

    def vote(bad, good):
        return "0" if bad else "2" if good else "1"

    return "".join([
        vote(10 * symbols > n, 50 * symbols <= n and n > 0), vote(10 * upper > 3 * letters, 20 * upper <= 3 * letters and letters > 0),
        vote(size < 2 * n or size > 14 * n, 3 * n <= size <= 10 * n and n > 0), vote(10 * distinct < 3 * min(m, 300) and m >= 40, 2 * distinct > m > 0),
        vote(n < 5, n >= 50), vote(100 * ends < n and n >= 40, 50 * ends >= n > 0), vote(50 * function < m and m >= 40, 10 * function >= m),
        vote(5 * digits > size, 20 * digits <= size and size > 0), vote(insults >= 2 and 400 * insults >= m, False),
    ])


def plain_posteriors(votes):
    """Expectation-maximisation over plain dictionaries."""
    counts = Counter(votes)
    good = {v: min(0.95, max(0.05, 0.5 + sum(int(c) - 1 for c in v) / (2 * len(v)))) for v in counts}
    for _ in range(100):
        prior = (sum(n * good[v] for v, n in counts.items()) + 1) / (sum(counts.values()) + 2)
        table = {}
        for k in range(len(LABELLERS)):
            for side in (0, 1):
                sums = [1 + sum(n * (good[v] if side else 1 - good[v]) for v, n in counts.items() if v[k] == c) for c in "012"]
                table[k, side] = [x / sum(sums) for x in sums]
        after = {v: 1 / (1 + np.exp(-np.clip(log(prior / (1 - prior)) + sum(log(table[k, 1][int(c)] / table[k, 0][int(c)]) for k, c in enumerate(v)), -50, 50))) for v in counts}
        moved = max(abs(after[v] - good[v]) for v in counts)
        if moved < 1e-9:
            break
        good = after
    return good


def plain_features(text):
    import pyarrow as pa

    from tessella.llm.textops import MARKS, mixed, rolled_hashes, text_bytes, word_hashes, words

    data, offsets = text_bytes(pa.array([text or ""], pa.large_string()), lower=True)
    low = word_hashes(data, *words(data, offsets, MARKS)[:2])
    pairs = mixed(rolled_hashes(low, 2))[: max(0, len(low) - 1)]
    found = Counter(int(h) % classifier.DIMENSIONS for h in [*low.tolist(), *pairs.tolist()])
    norm = sum(found.values()) ** 0.5
    return {k: n**0.5 / norm for k, n in found.items()}


def test_classifier_against_brute_force(spark, docs):
    """Votes, posteriors, the sample, the scorer and all scores, by plain loops."""
    texts = [*docs.text.tolist(), docs.text[0], None, "", "!!!"]  # a repeated text, a tie, counts twice among the votes and once in training
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("votes", F.lit("clash")).repartition(3)
    found = {r.doc_id: r for r in classify_quality(frame).collect()}
    votes = [plain_votes(t) for t in texts]
    good = plain_posteriors(votes)
    sample = sorted({(signed(xxhash.xxh64_intdigest(t.encode(), 42)), t, good[v]) for t, v in zip(texts, votes, strict=True) if t and len(t) <= classifier.TRAIN_CHARS})
    rows, weights, squares = [plain_features(t) for _, t, _ in sample], Counter(), Counter()
    order = np.random.default_rng(0)
    for _ in range(classifier.EPOCHS):
        for k in order.permutation(len(rows)):
            x = {**rows[k], -1: 1.0}
            error = 1 / (1 + np.exp(-np.clip(sum(weights[i] * v for i, v in x.items()), -50, 50))) - sample[k][2]
            for i, v in x.items():
                squares[i] += (error * v) ** 2
                weights[i] -= 0.5 * error * v / np.sqrt(squares[i] + 1e-2)
    for k, (text, v) in enumerate(zip(texts, votes, strict=True)):
        x = plain_features(text)
        score = 1 / (1 + np.exp(-(sum(weights[i] * y for i, y in x.items()) + weights[-1]))) if x else 0.0
        assert found[k].votes == v and found[k].posterior == pytest.approx(good[v], abs=1e-6)
        assert found[k].score == pytest.approx(score, abs=1e-6) and found[k].kept == (found[k].score >= 0.5)


def test_classifier_edges(edge_docs, empty_docs):
    found = classify_quality(edge_docs).collect()
    assert len(found) == edge_docs.count()
    assert all(r.score == 0 and not r.kept for r in found if r.doc_id in (3, 4, 5))
    assert classify_quality(empty_docs).count() == 0
