"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a labelled sample. A text is cut greedily
into phrases, each the longest match with the sample (or a single symbol that it lacks); the language
that needs the fewest phrases, each counted as log2(sample size) bits a symbol, wins.

Texts are first folded to 64 symbols: letters a to z, 36 classes of other letters, and one symbol for
each run of anything else. A parse begins anew every BLOCK symbols, so that long and short texts alike
are parsed in blocks side by side: one numpy step moves every block of a batch by a symbol, in all
languages at once. A restart and a phrase's end are both marked in the transition table, which needs
no suffix links at parse time.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import prepare, tidied

#: Symbols learnt of a language at most, documents drawn for them, and bytes of all transition tables.
SAMPLE_SYMBOLS, SAMPLE_DOCS, TABLE_BYTES = 32_768, 64, 256 << 20
#: Documents longer than this aren't drawn for learning (all are predicted, whole).
SAMPLE_CHARS = 20_000
ALPHABET, BLOCK, LANES = 64, 512, 4096
PAD = ALPHABET - 1
_NEW = 1 << 30


def _fold_table() -> np.ndarray:
    table = np.zeros(65536, np.uint8)
    for cp in range(65536):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 36
    return table


_table: list[np.ndarray] = []


def fold(text: str) -> np.ndarray:
    """Symbols of a text: 1 to 62 for letters, 0 for each run of anything else; no such run at the ends."""
    if not _table:
        _table.append(_fold_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = _table[0][np.minimum(points, 65535)]
    for i in np.flatnonzero(points > 65535):
        out[i] = 27 + points[i] % 36 if chr(points[i]).isalpha() else 0
    letters = out > 0
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    return out[keep][: None if not len(out) or letters[-1] else -1]


def suffix_automaton(symbols: np.ndarray) -> np.ndarray:
    """Transitions (states x ALPHABET) of the automaton of all substrings; -1 where there is none."""
    following, link, length, last = [[-1] * ALPHABET], [-1], [0], 0
    for c in symbols.tolist():
        state = len(length)
        following.append([-1] * ALPHABET)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and following[p][c] < 0:
            following[p][c] = state
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(length)
                following.append(following[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p][c] == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return np.array(following, np.int32)


class Model:
    """Transition tables of all languages in one, as offsets; a marked entry ends a phrase first."""

    def __init__(self, samples: dict[str, np.ndarray]):
        self.languages = sorted(samples)
        self.bits = np.array([np.log2(max(2, len(samples[x]))) for x in self.languages])
        parts, self.roots, base = [], [], 0
        for x in self.languages:
            nxt = suffix_automaton(samples[x])
            dead = len(nxt)  # after a symbol that the sample lacks, which is a phrase by itself
            fresh = np.where(nxt[0] >= 0, nxt[0], dead)
            nxt = np.concatenate((nxt, np.full((1, ALPHABET), -1, np.int32)))
            table = np.where(nxt >= 0, nxt, fresh | _NEW)
            table[0] = fresh
            table = (table & (_NEW - 1)) * ALPHABET + base * ALPHABET | (table & _NEW)
            table[:, PAD] = (np.arange(len(nxt)) + base) * ALPHABET
            parts.append(table.astype(np.int32))
            self.roots.append(base * ALPHABET)
            base += len(nxt)
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        sizes = np.array([len(x) for x in texts])
        counts = -(-sizes // BLOCK)
        if not counts.sum() or not self.languages:
            return out
        flat = np.full(int(counts.sum()) * BLOCK, PAD, np.uint8)
        at = np.concatenate(([0], np.cumsum(counts))) * BLOCK
        for k, x in enumerate(texts):
            flat[at[k] : at[k] + len(x)] = x
        blocks = flat.reshape(-1, BLOCK)
        lengths = (blocks != PAD).sum(axis=1)
        order = np.argsort(-lengths, kind="stable")
        found = np.zeros((len(blocks), len(self.languages)), np.int64)
        for lo in range(0, len(blocks), LANES):
            rows = order[lo : lo + LANES]
            steps = np.ascontiguousarray(blocks[rows, : lengths[rows[0]]].T).astype(np.int32)
            for k, root in enumerate(self.roots):
                state = np.full(len(rows), root, np.int32)
                ended = np.ones(len(rows), np.int32)  # the phrase that the block's end closes
                for step in steps:
                    state = self.table[state + step]
                    ended += state >> 30
                    state &= _NEW - 1
                found[rows, k] = ended
        np.add.at(out, np.repeat(np.arange(len(texts)), counts), found)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, phrases a symbol in the language that won (null where there is none), and symbols."""
        folded = [fold(x or "") for x in texts]
        sizes = np.array([len(x) for x in folded])
        names, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
        own = np.flatnonzero(sizes > 0)
        if len(own) and self.languages:
            phrases = self.phrases([folded[i] for i in own])
            cost = phrases * self.bits / sizes[own, None]
            best = cost.argmin(axis=1)
            lowest = cost[np.arange(len(own)), best]
            for i, b in zip(own, best, strict=True):
                names[i] = self.languages[b]
            score[own] = 1.0
            if len(self.languages) > 1:
                second = np.partition(cost, 1, axis=1)[:, 1]
                score[own] = (second - lowest) / second
            rate[own] = phrases[np.arange(len(own)), best] / sizes[own]
        return names, score, rate, sizes


def learn(docs: DataFrame, among: Column) -> Model:
    """A model of the rows of docs(doc_id, text, lang) for which ``among`` is true.

    Of each language at most SAMPLE_DOCS documents, the first by hash, are learnt, up to SAMPLE_SYMBOLS
    symbols; fewer if all tables would pass TABLE_BYTES. Of a document up to SAMPLE_CHARS characters from
    its first letter on are learnt. The sample alone comes to the driver.
    """
    rows = docs.select(
        F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), among.alias("among")
    ).filter("among and lang is not null and text is not null")
    slim = rows.select("id", "lang", F.xxhash64("text").alias("mark"))
    order = W.Window.partitionBy("lang").orderBy(F.xxhash64("id"), "mark")
    drawn = slim.withColumn("k", F.row_number().over(order)).filter(f"k <= {SAMPLE_DOCS}")
    chosen = rows.withColumn("mark", F.xxhash64("text")).join(F.broadcast(drawn), ["id", "lang", "mark"])
    excerpt = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, SAMPLE_CHARS).alias("text")
    picked = chosen.select("lang", "k", excerpt).dropDuplicates(["lang", "k"])
    texts: dict[str, list] = {}
    for lang, _, text in sorted((r.lang, r.k, r.text) for r in picked.toLocalIterator()):
        texts.setdefault(lang, []).append(fold(text))
    each = min(SAMPLE_SYMBOLS, TABLE_BYTES // (4 * ALPHABET * 2 * max(1, len(texts))))
    samples = {}
    for lang, folded in texts.items():
        joined = np.concatenate([np.concatenate((x, [0])) for x in folded]).astype(np.uint8)[:each]
        if joined.any():
            samples[lang] = joined
    return Model(samples)


def _predict(model):
    def run(batches):
        for batch in batches:
            names, score, rate, sizes = model.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names, pa.string()),
                    pa.array(score),
                    pa.array(rate, mask=np.isnan(rate)),
                    pa.array(sizes, pa.int64()),
                    batch.column(2),
                ],
                ["doc_id", "lang_pred", "score", "phrases_per_symbol", "n_symbols", "mark"],
            )

    return run


def predict_languages(docs: DataFrame, among: Column, mark: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, phrases_per_symbol, n_symbols) of every row of docs(doc_id, text, lang, ...).

    ``among`` says which rows may be learnt from. lang_pred is a learnt language, or ``und`` with score 0
    if the text is null or has no letter, or if nothing was learnt. score is the share by which the
    second-best language costs more (1 with a single language); equal costs give the first language in
    alphabetical order and score 0. Null doc_ids and repeated rows each come back; other columns aren't read;
    very long texts are parsed whole, in blocks; an empty table gives no rows. With ``mark``, a last column is
    the hash (xxhash64) of the row's text, for callers that know rows by text.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(learn(docs, among))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    found = rows.mapInArrow(
        tidied(_predict(model)), "doc_id long, lang_pred string, score double, phrases_per_symbol double, n_symbols long, mark long"
    )
    return found if mark else found.drop("mark")
