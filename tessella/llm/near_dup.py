"""MinHash near-duplicate detection by a multi-index Hamming join of b-bit signatures.

Every distinct shingle set gets a signature of ``symbols`` b-bit symbols (the low bits of one MinHash
each). Two sets of Jaccard similarity s differ in a symbol with a probability of at most 1 - s, so
pairs at the similarity threshold have a signature distance over ``radius`` with a probability of at
most ``miss``. The signature is cut into ``chunks`` chunks; by the pigeonhole principle, of two
signatures whose distance is under ``2 * chunks`` some chunk has one wrong symbol at most. Each chunk
therefore gives one key for each of its symbols, with that symbol left out: every pair within the
radius meets in a key, and no other means of finding candidates is needed.

Candidates are confirmed on full shingle sets. Exact copies of a set are one node from the start.
Links go to the smallest node of a key's bucket first (of each part of a large bucket, and from there to
the smallest of all); a bucket whose nodes are then in one component is done. Only buckets that still hold
several components are compared across components, in blocks of bounded size: the other nodes with those
of the bucket's largest component and with one another, never that component with itself. Of those pairs
only the few leave their task that the parities of the sets, which bound their difference, allow to be
links. So no bucket is expanded into all its pairs, and no link between different components is lost.

A key, text or component that holds a large share of all rows is dealt to several tasks everywhere.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .graph import connected_components
from .shared import BROADCAST_IDS, HOT_ROWS, discard, join_hot, materialize, prepare, tidied, workdir
from .textops import shingle_hashes, text_bytes, word_hashes, words

#: Symbols of a signature; bits of a symbol.
SYMBOLS, BITS = 64, 8
#: Bits of the parities that bound how far two sets differ.
PARITY_BITS = 2048
#: Nodes of a bucket that one task compares with one another or with so many others.
BLOCK = 4096
#: One node of so many is looked at to find large buckets, which are then dealt to several tasks.
PROBE = 16


def radius_for(similarity: float, miss: float = 2e-5, symbols: int = SYMBOLS) -> int:
    """The smallest distance that a pair at the similarity exceeds with a probability of at most ``miss``."""
    p, tail, r = 1 - similarity, 1.0, -1
    while tail > miss:
        r += 1
        tail -= comb(symbols, r) * p**r * (1 - p) ** (symbols - r)
    return r


def chunk_borders(radius: int, symbols: int = SYMBOLS) -> list[int]:
    """Borders of the fewest chunks of which one has an error at most within the radius."""
    chunks = radius // 2 + 1
    return [symbols * k // chunks for k in range(chunks + 1)]


def _multipliers(symbols: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 32, (2, symbols), np.uint64).astype(np.uint32) | np.uint32(1)


def _signatures(shingles: np.ndarray, at: np.ndarray, symbols: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (n x symbols, uint8) of the sets that have a shingle, and sketches: the highest bits of 64 symbols.

    So two sketches differ in as many bits as the signatures do in symbols, or fewer.
    """
    mult, add = _multipliers(symbols, seed)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, symbols), np.uint32)
    for k in range(symbols if len(full) else 0):
        out[full, k] = np.minimum.reduceat((short ^ add[k]) * mult[k], at[:-1][full])
    out = (out ^ (out >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    out = (out ^ (out >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    out ^= out >> np.uint32(16)
    sketch = np.packbits((out >> np.uint32(7)).astype(np.uint8) & 1, axis=1)
    return (out & np.uint32(255)).astype(np.uint8), sketch[:, :8].copy().view(np.int64).ravel()


def _shingles_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column, lower=True)
    starts, lengths, word_at = words(data, offsets)
    return shingle_hashes(word_hashes(data, starts, lengths), word_at, n)


def _parity(shingles: np.ndarray) -> bytes:
    """For each of PARITY_BITS classes, whether an odd number of the set's shingles is in it.

    Two sets' parities differ in as many bits as the sets differ in shingles, or fewer: a bound that
    loses nothing, and that is close to the difference while that is well below PARITY_BITS.
    """
    counts = np.bincount((shingles & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _fingerprint(n: int, symbols: int, seed: int):
    def run(batches):
        for batch in batches:
            shingles, at = _shingles_of(batch.column(1), n)
            signatures, sketches = _signatures(shingles, at, symbols, seed)
            sizes, digests, parities = [], [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                own = np.unique(shingles[lo:hi])
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                parities.append(_parity(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([x.tobytes() for x in signatures], pa.binary()),
                    pa.array(sketches, pa.int64()),
                    pa.array(parities, pa.binary()),
                    batch.column(2),
                ],
                ["doc_id", "n_shingles", "digest", "signature", "sketch", "parity", "mark"],
            )

    return run


def chunk_keys(signatures: np.ndarray, borders: list[int]) -> np.ndarray:
    """A 64-bit key for each symbol: that symbol's chunk without the symbol, with both their places."""
    weights = np.random.default_rng(3).integers(1, 1 << 63, signatures.shape[1], np.uint64) | np.uint64(1)
    table = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64)
    terms = table[signatures] * weights
    out = np.empty(signatures.shape, np.uint64)
    for lo, hi in zip(borders[:-1], borders[1:], strict=True):
        whole = terms[:, lo:hi].sum(axis=1, dtype=np.uint64)
        for k in range(lo, hi):
            out[:, k] = (whole - terms[:, k]) * np.uint64(2 * k + 1) + np.uint64(k)
    return out.view(np.int64)


def _keys(borders: list[int]):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                signatures = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, -1)
                keys = chunk_keys(signatures, borders)
                at = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))],
                    ["node", "n", "sketch", "keys"],
                )

    return run


def _set_rows(n: int):
    def run(batches):
        for batch in batches:
            shingles, at = _shingles_of(batch.column(1), n)
            sets = [np.unique(shingles[lo:hi]).tobytes() for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep, last, set_b = [], None, None
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                own, other = np.frombuffer(x.as_buffer(), np.uint64), y.as_buffer()
                if last is None or not other.equals(last):
                    last, set_b = other, np.frombuffer(other, np.uint64)
                at = np.searchsorted(set_b, own)
                at[at == len(set_b)] = 0
                common = int((set_b[at] == own).sum()) if len(set_b) else 0
                keep.append(100 * common >= percent * (len(own) + len(set_b) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(radius: int, percent: int):
    """Pairs of different components within the radius, of each run of equal (key, kind, i, j)."""

    def close(rows: list) -> list:
        side = np.array([x[4] for x in rows], bool)
        node = np.array([x[5] for x in rows])
        component, n = np.array([x[6] for x in rows]), np.array([x[7] for x in rows])
        sketch = np.array([x[8] for x in rows], np.int64)
        signature = np.frombuffer(b"".join(x[9] for x in rows), np.uint8).reshape(len(rows), -1)
        parity = np.frombuffer(b"".join(x[10] for x in rows), np.uint64).reshape(len(rows), -1)
        left = np.flatnonzero(~side)
        right = np.flatnonzero(side) if side.any() else left
        found = []
        for k in left:
            others = right[(component[right] != component[k]) & (node[right] != node[k])]
            others = others[100 * np.minimum(n[others], n[k]) >= percent * np.maximum(n[others], n[k])]
            others = others[np.bitwise_count(sketch[others] ^ sketch[k]) <= radius]
            others = others[(signature[others] != signature[k]).sum(axis=1) <= radius]
            most = (100 - percent) * (n[others] + n[k]) // (100 + percent)  # shingles that a link may differ in
            others = others[np.bitwise_count(parity[others] ^ parity[k]).sum(axis=1) <= most]
            found += [(min(node[k], x), max(node[k], x)) for x in node[others].tolist()]
        return sorted(set(found))

    def run(batches):
        held, key = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key:
                    if held and (pairs := close(held)):
                        yield _pairs(pairs)
                    held, key = [], row[:4]
                held.append(row)
        if held and (pairs := close(held)):
            yield _pairs(pairs)

    return run


def _pairs(pairs: list) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(a, pa.int64())], ["a", "b"])


def _same_id(prints: DataFrame, nodes: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) between a doc_id of several shingle sets and the nodes of these."""
    own = prints.filter("digest is not null and doc_id is not null").select("doc_id", "digest")
    mark = F.xxhash64("digest")
    several = own.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo <> hi").select("doc_id")
    several = materialize(several, f"{folder}/several")
    few = several.count() <= BROADCAST_IDS
    rows = own.join(F.broadcast(several) if few else several, "doc_id").distinct().join(nodes.select("digest", "node"), "digest")
    return materialize(rows.filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), f"{folder}/same")


def _buckets(nodes: DataFrame, borders: list[int], folder: str) -> DataFrame:
    """(key, parts, node, n, sketch, low) of all keys of all nodes; low is the smallest node of a part of a bucket.

    Buckets of over HOT_ROWS nodes, as one node of PROBE shows them, have several parts by a hash of the
    node. Nodes that are alone in a bucket are left out.
    """

    def keyed(rows: DataFrame) -> DataFrame:
        found = rows.select("node", "n", "sketch", "signature").mapInArrow(tidied(_keys(borders)), "node long, n long, sketch long, keys array<long>")
        return found.select(F.explode("keys").alias("key"), "node", "n", "sketch")

    probe = keyed(nodes.filter(F.pmod(F.xxhash64("node"), F.lit(PROBE)) == 0)).groupBy("key").agg(F.count("*").alias("k"))
    hot = probe.filter(F.col("k") * PROBE > HOT_ROWS).select("key", F.ceil(F.col("k") * PROBE / HOT_ROWS).cast("int").alias("parts"))
    hot = materialize(hot, f"{folder}/hot")
    rows, n_hot = keyed(nodes), hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        rows = rows.withColumn("parts", F.lit(1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), "parts"))
    part = W.Window.partitionBy("key", "part")
    rows = rows.select("*", F.min(F.struct("node", "n", "sketch")).over(part).alias("low"), F.count("*").over(part).alias("size"))
    return materialize(rows.filter("size > 1 or parts > 1").select("key", "parts", "node", "n", "sketch", "low"), f"{folder}/shared")


def _mixed(placed: DataFrame, nodes: DataFrame, folder: str) -> DataFrame:
    """Rows of the buckets that hold several components, repeated for each block of rows they are compared with.

    kind 0: a bucket of up to BLOCK nodes, compared with itself. Of larger ones, 1: a block of the largest
    component with one of the others; 2: two blocks of the others.
    """
    keys = placed.groupBy("key").agg(F.min("component").alias("lowest"), F.max("component").alias("highest"), F.count("*").alias("size"))
    keys = materialize(keys.filter("lowest <> highest").select("key", "size"), f"{folder}/mixed-keys")
    if keys.count() <= BROADCAST_IDS:
        rows = placed.join(F.broadcast(keys), "key")
    else:
        rows = join_hot(placed, keys, "key", F.col("node"), f"{folder}/hot-mixed")
    rows = materialize(rows, f"{folder}/mixed")
    large = rows.filter(F.col("size") > BLOCK).groupBy("key", "component").agg(F.count("*").alias("k"))
    main = large.groupBy("key").agg(F.max(F.struct("k", "component")).alias("x")).select("key", F.col("x.component").alias("main"), F.col("x.k").alias("k"))
    main = materialize(main, f"{folder}/main")
    rows = rows.join(F.broadcast(main) if main.count() <= BROADCAST_IDS else main, "key", "left")
    blocks = F.ceil(F.when(F.col("component") == F.col("main"), F.col("k")).otherwise(F.col("size") - F.col("k")) / BLOCK)
    rows = rows.withColumns({"of_main": F.ceil(F.col("k") / BLOCK).cast("int"), "of_rest": F.ceil((F.col("size") - F.col("k")) / BLOCK).cast("int")})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce(blocks, F.lit(1))).cast("int"))

    def task(kind: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))

    own, zero, no, yes = F.col("own"), F.lit(0), F.lit(False), F.lit(True)

    def every(n: str, body) -> Column:
        return F.transform(F.sequence(zero, F.col(n) - 1), body)

    tasks = (
        F.when(F.col("main").isNull(), F.array(task(0, zero, zero, no)))
        .when(F.col("component") == F.col("main"), every("of_rest", lambda j: task(1, own, j, no)))
        .otherwise(
            F.concat(
                every("of_main", lambda i: task(1, i, own, yes)),
                every("of_rest", lambda j: task(2, F.least(own, j), F.greatest(own, j), own > j)),
            )
        )
    )
    full = rows.select("key", "node", "n", "sketch", "component", tasks.alias("tasks")).join(
        nodes.select("node", "n", "sketch", "signature", "parity"), ["node", "n", "sketch"]
    )
    return full.select("*", F.explode("tasks").alias("t")).select(
        "key", "t.kind", "t.i", "t.j", "t.side", "node", "component", "n", "sketch", "signature", "parity"
    )


def near_duplicates(
    docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, seed: int = 1, symbols: int = SYMBOLS, mark: bool = False
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...).

    Documents are linked if 100 * common >= percent * united distinct shingles of lower-cased (A-Z)
    words. component_id is the smallest doc_id reachable; kept says whether it is the document's own.

    Null or wordless text: no shingles, linked with nothing. Fewer words than a shingle: the whole
    sequence is one shingle. Null doc_id: the row stays, its component_id is null and kept is true.
    Rows that repeat a doc_id each come back; if their texts differ, they are one document, linked by any
    of them. Very long texts are taken whole. Columns other than doc_id and text are not read. An empty table
    gives no rows. With ``mark``, a last column is the hash (xxhash64) of the row's text, for callers that know
    rows by text.
    """
    spark = docs.sparkSession
    prepare(spark)
    work = workdir(spark, "near-dup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = materialize(
        texts.withColumn("mark", F.xxhash64("text")).mapInArrow(
            tidied(_fingerprint(words_per_shingle, symbols, seed)),
            "doc_id long, n_shingles long, digest binary, signature binary, sketch long, parity binary, mark long",
        ),
        f"{work}/prints",
    )
    nodes = materialize(
        prints.filter("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "n_shingles", "sketch", "signature", "parity")).alias("x"))
        .select(
            "digest", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n"), "x.sketch", "x.signature", "x.parity"
        ),
        f"{work}/nodes",
    )
    same = _same_id(prints, nodes, work)
    radius = radius_for(percent / 100, symbols=symbols)
    shared = _buckets(nodes, chunk_borders(radius, symbols), work)
    inside = shared.filter("node <> low.node").select("node", "n", "sketch", "low")
    ends = shared.filter("parts > 1 and node = low.node")
    lowest = ends.groupBy("key").agg(F.min("low").alias("low"))
    between = ends.drop("low").join(lowest, "key").filter("node <> low.node").select("node", "n", "sketch", "low")
    candidates = (
        inside.union(between)
        .filter(f"100 * least(n, low.n) >= {percent} * greatest(n, low.n)")
        .filter(f"bit_count(sketch ^ low.sketch) <= {radius}")
        .select(F.col("node").alias("a"), F.col("low.node").alias("b"))
        .distinct()
    )
    firm = _confirmed(candidates, texts, nodes, words_per_shingle, percent, f"{work}/first")
    first = connected_components(firm.union(same), f"{work}/first")
    placed = shared.join(first, "node", "left").select("key", "node", "n", "sketch", F.coalesce("component", "node").alias("component"))
    across = (
        _mixed(materialize(placed, f"{work}/placed"), nodes, work)
        .repartition("key", "kind", "i", "j")
        .sortWithinPartitions("key", "kind", "i", "j")
        .mapInArrow(tidied(_across(radius, percent)), "a long, b long")
        .distinct()
    )
    more = _confirmed(across, texts, nodes, words_per_shingle, percent, f"{work}/second")
    component = connected_components(firm.union(same).union(more), f"{work}/second")
    own = nodes.select("digest", "node").join(component, "node", "left")
    own = materialize(own.select("digest", F.coalesce("component", "node").alias("component_id")), f"{work}/classes")
    slim = prints.select("doc_id", "n_shingles", "digest", "mark")
    rows = join_hot(slim.filter("digest is not null"), own, "digest", F.col("doc_id"), f"{work}/hot-rows", "left")
    rows = rows.unionByName(slim.filter("digest is null").withColumn("component_id", F.lit(None).cast("long")))
    discard(spark, *(f"{work}/{x}" for x in ("shared", "placed", "mixed", "mixed-keys", "main", "nodes", "same", "first", "second")))
    found = F.coalesce("component_id", "doc_id")
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), found).alias("component_id"),
        F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"),
        *(["mark"] if mark else []),
    )


def _confirmed(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, n: int, percent: int, folder: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    Sets are made again from the texts, for the documents of the pairs only: sets of all documents would
    take more room than the texts. Over BROADCAST_IDS documents, texts are shuffled by id to find them.
    """
    pairs = materialize(pairs, f"{folder}/pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(wanted, f"{folder}/wanted")
    small = wanted.count() <= BROADCAST_IDS
    named = texts.withColumnRenamed("doc_id", "node").join(F.broadcast(wanted) if small else wanted, "node", "left_semi")
    sets = materialize(
        named.mapInArrow(tidied(_set_rows(n)), "node long, shingles binary").filter("length(shingles) > 0").distinct(),
        f"{folder}/sets",
    )
    ends = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    joined = (
        join_hot(pairs, ends, "b", F.col("a"), f"{folder}/hot")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .select("a", "b", "x", "y")
    )
    return materialize(joined.mapInArrow(tidied(_confirm(percent)), "a long, b long").distinct(), f"{folder}/links")
