"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the
counts of all vote patterns (of which there are 3 ** labellers at most, however large the corpus) fits
how often each labeller gives each vote to good and to bad documents, as if they erred independently.
The posterior of its pattern labels a document; a logistic scorer on hashed words and word pairs is
then trained on posteriors of a bounded sample, and scores every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, prepare, workdir
from .textops import MARKS, mixed, rolled_hashes, text_bytes, word_hashes, words

DIMENSIONS = 1 << 16
#: Documents that the scorer is trained on at most, the first by hash, of at most so many characters each.
TRAIN_DOCS, TRAIN_CHARS, EPOCHS = 8192, 20_000, 6

#: Frequent words of running text in several languages.
FUNCTION_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or an they which you"
    " der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass"
    " le la les de des et en un une du dans que qui pour pas sur au plus ne se par est ce avec son il sont"
    " el los las del y a por con para una su al lo como más pero sus o este sí"
).split()
#: Insults and slurs in the wide sense.
INSULTS = (
    "idiot idiots moron morons stupid worthless loser losers trash scum clown clowns dumb imbecile pathetic disgusting"
    " bastard bastards bitch crap damn asshole fuck fucking shit retard retarded"
).split()


def _hashes(values: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array([" ".join(values)], pa.large_string()))
    starts, lengths, _ = words(data, offsets)
    return np.unique(word_hashes(data, starts, lengths))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[at])


class Batch:
    """Per-document counts of a batch of texts, for labellers."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        size = int(offsets[-1])
        own = data[:size]
        starts, lengths, at = words(data, offsets)
        self.n_words = np.diff(at)
        self.n_bytes = _sums(lengths, at)
        self.symbols = _sums(_SYMBOL[own], offsets)
        self.upper = _sums((own >= 65) & (own <= 90), offsets)
        self.letters = _sums(((own | 32) >= 97) & ((own | 32) <= 122) | (own >= 192), offsets)
        self.digits = _sums((own >= 48) & (own <= 57), offsets)
        last = own[starts + lengths - 1] if len(starts) else np.zeros(0, np.uint8)
        self.sentence_ends = _sums(np.isin(last, list(b".!?")), at)
        low, low_offsets = text_bytes(column, lower=True)
        low_starts, low_lengths, self.low_at = words(low, low_offsets, MARKS)
        self.low = word_hashes(low, low_starts, low_lengths)
        self.low_words = np.diff(self.low_at)
        self.function_words = _sums(np.isin(self.low, _FUNCTION), self.low_at)
        self.insults = _sums(np.isin(self.low, _INSULT), self.low_at)
        self.distinct = np.array([len(np.unique(self.low[a:b])) for a, b in zip(self.low_at[:-1], self.low_at[1:], strict=True)], np.int64)


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}=~^\\")] = True
_FUNCTION, _INSULT = _hashes(FUNCTION_WORDS), _hashes(INSULTS)


def _votes(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


#: Labellers by name; each gives -1, 0 or 1 for each document of a batch.
LABELLERS = {
    "symbols": lambda b: _votes(10 * b.symbols > b.n_words, (50 * b.symbols <= b.n_words) & (b.n_words > 0)),
    "capitals": lambda b: _votes(10 * b.upper > 3 * b.letters, (20 * b.upper <= 3 * b.letters) & (b.letters > 0)),
    "word_length": lambda b: _votes((b.n_bytes < 2 * b.n_words) | (b.n_bytes > 14 * b.n_words), (b.n_bytes >= 3 * b.n_words) & (b.n_bytes <= 10 * b.n_words) & (b.n_words > 0)),
    "repetition": lambda b: _votes((10 * b.distinct < 3 * np.minimum(b.low_words, 300)) & (b.low_words >= 40), (2 * b.distinct > b.low_words) & (b.low_words > 0)),
    "length": lambda b: _votes(b.n_words < 5, b.n_words >= 50),
    "sentences": lambda b: _votes((100 * b.sentence_ends < b.n_words) & (b.n_words >= 40), (50 * b.sentence_ends >= b.n_words) & (b.n_words > 0)),
    "function_words": lambda b: _votes((50 * b.function_words < b.low_words) & (b.low_words >= 40), 10 * b.function_words >= b.low_words),
    "digits": lambda b: _votes(5 * b.digits > b.n_bytes, (20 * b.digits <= b.n_bytes) & (b.n_bytes > 0)),
    "insults": lambda b: _votes((b.insults >= 2) & (400 * b.insults >= b.low_words), np.zeros(len(b.n_words), bool)),
}


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, P(vote | bad or good) as labellers x 2 x 3, and each pattern's posterior of good.

    It starts from the majority of votes and smooths each table by one vote of each kind. Class 1 is the
    one that starts from the good majority.
    """
    good = np.clip(0.5 + patterns.sum(axis=1) / (2.0 * max(1, patterns.shape[1])), 0.05, 0.95)
    prior, tables = 0.5, np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        weights = np.stack((counts * (1 - good), counts * good))
        prior = float((weights[1].sum() + 1) / (weights.sum() + 2))
        for k in range(patterns.shape[1]):
            for v in range(3):
                tables[k, :, v] = weights[:, patterns[:, k] == v - 1].sum(axis=1) + 1
        tables /= tables.sum(axis=2, keepdims=True)
        odds = np.full(len(patterns), np.log(prior / (1 - prior)))
        for k in range(patterns.shape[1]):
            odds += np.log(tables[k, 1, patterns[:, k] + 1] / tables[k, 0, patterns[:, k] + 1])
        after = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if len(after) == 0 or np.abs(after - good).max() < 1e-9:
            break
        good = after
    return prior, tables, good


def hashed_features(low: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices and unit-length weights (roots of counts) of each document's words and word pairs."""
    pairs, out = mixed(rolled_hashes(low, 2)), []
    for a, b in zip(at[:-1], at[1:], strict=True):
        every = np.concatenate((low[a:b], pairs[a : max(a, b - 1)])) & np.uint64(DIMENSIONS - 1)
        index, n = np.unique(every.astype(np.int64), return_counts=True)
        weight = np.sqrt(n.astype(np.float64))
        out.append((index, weight / np.sqrt((weight**2).sum()) if len(index) else weight))
    return out


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic scorer, by AdaGrad over the rows in a fixed order."""
    weights, squares = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-2)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            index, x = rows[k]
            error = 1 / (1 + np.exp(-np.clip(weights[index] @ x + weights[-1], -50, 50))) - labels[k]
            step = error * x
            squares[index] += step**2
            weights[index] -= 0.5 * step / np.sqrt(squares[index])
            squares[-1] += error**2
            weights[-1] -= 0.5 * error / np.sqrt(squares[-1])
    return weights


def _vote_rows(batches):
    for batch in batches:
        counts = Batch(batch.column(1))
        votes = np.stack([f(counts) for f in LABELLERS.values()], axis=1) + 1
        texts = pa.array(["".join(map(str, x)) for x in votes.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2)], ["doc_id", "votes", "mark"])


def _score(weights, posteriors):
    def run(batches):
        w, known = weights.value, posteriors.value
        for batch in batches:
            counts = Batch(batch.column(1))
            votes = np.stack([f(counts) for f in LABELLERS.values()], axis=1) + 1
            marks = ["".join(map(str, x)) for x in votes.tolist()]
            raw = np.array([w[i] @ x + w[-1] for i, x in hashed_features(counts.low, counts.low_at)])
            score = np.where(counts.low_words > 0, 1 / (1 + np.exp(-np.clip(raw, -50, 50))), 0.0) if len(raw) else raw
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks, pa.string()), pa.array([known.get(x, 0.5) for x in marks], pa.float64()), pa.array(score, pa.float64())],
                ["doc_id", "votes", "posterior", "score"],
            )

    return run


def classify_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) of every row of docs(doc_id, text, ...).

    votes has a digit for each labeller (0 bad, 1 nothing, 2 good); posterior is the label model's, score
    the trained scorer's; kept says score >= threshold. A null or wordless text has score 0. Null doc_ids
    and repeated rows each come back; equal texts have equal results. Other columns are not read; an empty
    table gives no rows.

    Label model: votes of all documents, whole texts however long, repeated ones as often as they occur.
    Scorer: TRAIN_DOCS distinct texts of up to TRAIN_CHARS characters, the first by hash.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = workdir(spark, "quality")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark")
    )
    voted = materialize(texts.mapInArrow(_vote_rows, "doc_id long, votes string, mark long"), f"{folder}/votes")
    found = sorted((r.votes, r.n) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).toLocalIterator())
    patterns = np.array([[int(c) - 1 for c in v] for v, _ in found], np.int8).reshape(len(found), len(LABELLERS))
    _, _, good = fit_label_model(patterns, np.array([n for _, n in found], float))
    posteriors = {v: float(p) for (v, _), p in zip(found, good, strict=True)}
    short = texts.filter(F.char_length("text").between(1, TRAIN_CHARS)).select("mark")
    marks = short.distinct().orderBy("mark").limit(TRAIN_DOCS)
    sample = texts.join(F.broadcast(marks), "mark").join(F.broadcast(voted.select("mark", "votes").join(F.broadcast(marks), "mark").distinct()), "mark")
    rows, labels = [], []
    for r in sample.select("mark", "text", "votes").dropDuplicates(["mark"]).orderBy("mark").toLocalIterator():
        own = Batch(pa.array([r.text], pa.large_string()))
        rows += hashed_features(own.low, own.low_at)
        labels.append(posteriors[r.votes])
    weights = train_scorer(rows, np.array(labels))
    scored = texts.select("doc_id", "text").mapInArrow(
        _score(spark.sparkContext.broadcast(weights), spark.sparkContext.broadcast(posteriors)),
        "doc_id long, votes string, posterior double, score double",
    )
    return scored.withColumn("kept", F.col("score") >= threshold)
