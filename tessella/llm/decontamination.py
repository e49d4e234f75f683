"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Words are lower-cased runs of letters and digits. A benchmark item of L words is compared with the
windows of L words of a document (with the whole document if it is shorter): both get a SimHash of BITS
bits of their 5-word shingles, each as heavy as it is frequent. An item of fewer than five words is one
shingle, so only an equal sequence of words is similar.

Fingerprints are looked up in a multi-index of BLOCKS blocks of 16 bits. If a pair differs in at most
RADIUS bits, at most (RADIUS // (ERRORS + 1)) blocks have more than ERRORS wrong bits, so the other
ENOUGH ones or more are found by value, all values of up to ERRORS wrong bits enumerated. Pairs found in
fewer blocks are no candidates: of unrelated pairs three in a thousand remain, and no pair within the
radius is lost. At a similarity of 0.8 the expected distance is 39 of 256 and RADIUS = 63 is 4.2
standard deviations above it. Candidates are then verified by the exact weighted similarity, sum of
least over sum of greatest shingle counts.

Only windows that hold a shingle of some item of their size are fingerprinted: any other has a
similarity of 0. Clean text so costs one look-up a word.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, prepare, tidied, workdir
from .textops import MARKS, mixed, rolled_hashes, text_bytes, word_hashes, words

SHINGLE, BITS, ERRORS, RADIUS = 5, 256, 4, 63
BLOCKS = BITS // 16
#: Blocks with at most ERRORS wrong bits that a pair within the radius has at least.
ENOUGH = BLOCKS - RADIUS // (ERRORS + 1)
#: Bytes of the index of a part of the benchmark that is broadcast at once, and what an item and a byte of it take.
INDEX_BYTES, ITEM_BYTES, BYTES_A_BYTE = 256 << 20, 512, 8
#: Words of a document whose running sums are held at once.
SPAN = 16_384
_FILTER_BITS = 22
_SEEDS = np.random.default_rng(9).integers(1, 1 << 63, BITS // 64, np.uint64)
#: All 16-bit values of up to ERRORS bits.
_MASKS = np.array([sum(1 << b for b in c) for n in range(ERRORS + 1) for c in combinations(range(16), n)], np.uint16)


def shingle_size(n_words: int) -> int:
    return min(SHINGLE, n_words)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words before each text."""
    data, offsets = text_bytes(texts, lower=True)
    starts, lengths, word_at = words(data, offsets, MARKS)
    return word_hashes(data, starts, lengths), word_at


def fingerprints(shingles: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """SimHash (n x BLOCKS numbers of 16 bits) of ``count`` shingles from each first one on; a bit is 1 if most have it."""
    out, i = np.zeros((len(first), BLOCKS), np.uint16), 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(first, first[i] + SPAN - count, "right")))
        own = shingles[first[i] : first[j - 1] + count]
        wide = np.stack([mixed(own ^ s) for s in _SEEDS], axis=1)
        ones = np.unpackbits(wide.view(np.uint8), axis=1)
        running = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(ones, axis=0, dtype=np.int32)))
        at = first[i:j] - first[i]
        out[i:j] = np.packbits(2 * (running[at + count] - running[at]) > count, axis=1).view(np.uint16)
        i = j
    return out


def near_values(wanted: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of wanted, value) of all stored sorted distinct values within ERRORS wrong bits, by the shorter enumeration."""
    if len(values) <= len(_MASKS):
        rows, at = np.nonzero(np.bitwise_count(wanted[:, None] ^ values) <= ERRORS)
        return rows, at
    present = np.full(65536, -1, np.int64)
    present[values] = np.arange(len(values))
    found = present[wanted[:, None] ^ _MASKS]
    rows, _ = np.nonzero(found >= 0)
    return rows, found[found >= 0]


class Group:
    """Items of one size in a multi-index of blocks by value."""

    def __init__(self, owners: list[int], shingles: list[np.ndarray]):
        self.owners = owners
        self.prints = np.concatenate([fingerprints(x, np.array([0]), len(x)) for x in shingles])
        self.counts = [np.unique(x, return_counts=True) for x in shingles]
        self.blocks = []
        for b in range(BLOCKS):
            order = np.argsort(self.prints[:, b], kind="stable")
            values, at = np.unique(self.prints[order, b], return_index=True)
            self.blocks.append((values, np.append(at, len(order)), order))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of prints, item, distance) of all pairs within RADIUS, by the blocks that they share."""
        n, found = len(self.prints), []
        for b, (values, at, order) in enumerate(self.blocks):
            rows, k = near_values(prints[:, b], values)
            sizes = at[k + 1] - at[k]
            items = order[np.repeat(at[k] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            found.append(np.repeat(rows, sizes) * n + items)
        pairs, times = np.unique(np.concatenate(found), return_counts=True)
        rows, items = np.divmod(pairs[times >= ENOUGH], n)
        distance = np.bitwise_count(prints[rows] ^ self.prints[items]).sum(axis=1, dtype=np.int64)
        close = distance <= RADIUS
        return rows[close], items[close], distance[close]


class ItemIndex:
    """Items by their number of words."""

    def __init__(self, ids: list, texts: list[str]):
        hashes, at = hashed_words(pa.array(texts, pa.large_string()))
        self.ids = ids
        sizes: dict[int, list] = {}
        for k, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if hi > lo:
                size = shingle_size(hi - lo)
                sizes.setdefault(hi - lo, []).append((k, rolled_hashes(hashes[lo:hi], size)[: hi - lo - size + 1]))
        self.groups = {n: Group([k for k, _ in items], [x for _, x in items]) for n, items in sizes.items()}
        self.known: dict[int, tuple] = {}
        for size in {shingle_size(n) for n in sizes}:
            seen = [(np.unique(x), n) for n, items in sizes.items() if shingle_size(n) == size for _, x in items]
            pairs = np.unique(np.rec.fromarrays([np.concatenate([x for x, _ in seen]), np.concatenate([np.full(len(x), n) for x, n in seen])], names="h,n"))
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[pairs["h"] >> np.uint64(64 - _FILTER_BITS)] = True
            self.known[size] = pairs["h"].copy(), pairs["n"].copy(), maybe

    def matches(self, hashes: np.ndarray, least: float) -> list[tuple]:
        """(item id, first word, words, distance, similarity) of the best window for each item found in a document."""
        out: dict = {}
        for size, (known, owner_sizes, maybe) in self.known.items():
            rolled = rolled_hashes(hashes, size)[: max(0, len(hashes) - size + 1)]
            at = np.flatnonzero(maybe[rolled >> np.uint64(64 - _FILTER_BITS)])
            lo, hi = (np.searchsorted(known, rolled[at], side) for side in ("left", "right"))
            hit = hi > lo
            if not hit.any():
                continue
            times = (hi - lo)[hit]
            places = np.repeat(at[hit], times)
            owners = owner_sizes[np.repeat(lo[hit] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            for n in np.unique(owners).tolist():
                self._windows(rolled, size, n, np.unique(places[owners == n]), least, out)
        return [(self.ids[k], -s, size, -d, x) for k, (x, s, d, size) in sorted(out.items())]

    def _windows(self, rolled: np.ndarray, size: int, n: int, anchors: np.ndarray, least: float, out: dict) -> None:
        """Puts the best of the windows of n words that hold an anchor into out, by item."""
        count = min(n - size + 1, len(rolled))
        last = len(rolled) - count
        near = np.zeros(last + 2, np.int64)
        np.add.at(near, np.clip(anchors - count + 1, 0, last), 1)
        np.add.at(near, np.clip(anchors, 0, last) + 1, -1)
        starts, group = np.flatnonzero(np.cumsum(near) > 0), self.groups[n]
        for lo in range(0, len(starts), 4096):
            part = starts[lo : lo + 4096]
            rows, items, distances = group.candidates(fingerprints(rolled, part, count))
            for at, k, distance in zip(part[rows].tolist(), items.tolist(), distances.tolist(), strict=True):
                similarity = _similarity(rolled[at : at + count], *group.counts[k])
                found = (similarity, -at, -distance, count + size - 1)
                owner = group.owners[k]
                key = owner if self.ids[owner] is None else self._first(owner)
                if similarity >= least and found > out.get(key, (0, 0, 0, 0)):
                    out[key] = found

    def _first(self, owner: int) -> int:
        """The first item with the id of an item: items that repeat an id are one item."""
        if not hasattr(self, "by_id"):
            self.by_id = {x: k for k, x in reversed(list(enumerate(self.ids)))}
        return self.by_id[self.ids[owner]]


def _similarity(window: np.ndarray, shingles: np.ndarray, counts: np.ndarray) -> float:
    own, n = np.unique(window, return_counts=True)
    at = np.searchsorted(shingles, own)
    at[at == len(shingles)] = 0
    common = int(np.minimum(n, counts[at])[shingles[at] == own].sum())
    return common / (len(window) + int(counts.sum()) - common)


def _scan(index, least: float):
    def run(batches):
        for batch in batches:
            hashes, at = hashed_words(batch.column(1))
            rows = []
            for doc_id, mark, lo, hi in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), at[:-1], at[1:], strict=True):
                rows += [(doc_id, *x, mark) for x in index.value.matches(hashes[lo:hi], least)]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)],
                    ["doc_id", "item_id", "first_word", "n_words", "distance", "similarity", "mark"],
                )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, mark: bool = False) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): each document and item that it holds.

    The best window of a document for an item is given, the first of equals. Texts that are null or
    without words match nothing, on either side; items of fewer than five words match equal sequences of
    words only, and documents of fewer than five words match such items only. A null doc_id or item_id is
    kept as such, each item without an id by itself; rows of docs that repeat each match, and items that
    repeat an id count as one item. Of a very long text only SPAN words at a time are worked on. Other
    columns are not read on either side; an empty table on either side gives no rows. With ``mark``, a
    last column is the hash (xxhash64) of the row's text, for callers that know rows by text.

    The index of the benchmark goes to all tasks. If it passes INDEX_BYTES the benchmark goes in parts, each
    dropped before the next, with one pass over the documents for each: documents are never shuffled.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("text is not null").distinct()
    size = items.agg(F.sum(BYTES_A_BYTE * F.octet_length("text") + ITEM_BYTES)).first()[0] or 0
    passes = max(1, -(-size // INDEX_BYTES))
    text = F.col("text").cast("string").alias("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64(F.col("text").cast("string")).alias("mark"))
    folder = workdir(spark, "benchmark") if passes > 1 else ""
    dealt = F.pmod(F.coalesce(F.xxhash64("item_id"), F.lit(0)) + F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(0), F.lit(passes))
    found = None
    for k in range(passes):
        part = sorted(((r.item_id, r.text) for r in items.filter(dealt == k).toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        index = spark.sparkContext.broadcast(ItemIndex([x for x, _ in part], [x for _, x in part]))
        rows = texts.mapInArrow(
            tidied(_scan(index, least)),
            "doc_id long, item_id long, first_word long, n_words long, distance long, similarity double, mark long",
        )
        if passes > 1:
            rows = materialize(rows, f"{folder}/{k}")
            index.destroy()
        found = rows if found is None else found.union(rows)
    return found if mark else found.drop("mark")
