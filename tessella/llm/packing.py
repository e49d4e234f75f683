"""Token ids of a corpus in bit-packed files, in ascending doc_id order.

File format (all numbers little-endian):

    bytes 0-7    magic ``TESSPK01``
    blocks       BLOCK ids each (the last has fewer), id i of a block in its bits [i * w, (i + 1) * w),
                 lowest first, where w is the fewest bits that hold vocabulary - 1; blocks begin on bytes
    doc_ids      n signed 64-bit numbers, and n bytes that are 1 where the doc_id is null
    doc_starts   n + 1 unsigned 64-bit numbers: ids before each document of the file
    offsets      m + 1 unsigned 64-bit numbers: where each block begins, and where the last ends
    last 40      w, n, m, number of ids, and place of doc_ids: five unsigned 64-bit numbers

Any range of ids needs only the blocks around it (``PackedFile.ids``); a block is unpacked by numpy at
once.
"""

from __future__ import annotations

import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, materialize, prepare, tidied, workdir
from .token_encode import cuts_apply, encoder, vocabulary_of

MAGIC, BLOCK, TAIL = b"TESSPK01", 8192, 40


def id_bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """The ids' bits one after the other, lowest first: 64 ids fill ``width`` words of 64 bits."""
    n = len(ids)
    rows = np.zeros((-(-n // 64), 64), np.uint64)
    rows.ravel()[:n] = ids
    out = np.zeros((len(rows), width), "<u8")
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[:, word] |= rows[:, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return out.tobytes()[: -(-n * width // 8)]


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    full = -(-count // 64)
    words = np.frombuffer(bytes(data).ljust(full * width * 8, b"\0"), "<u8", full * width).reshape(full, width)
    out, mask = np.empty((full, 64), np.uint32), np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = value & mask
    return out.ravel()[:count]


class PackedWriter:
    def __init__(self, uri: str, width: int):
        fs, path = filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.width = fs.open_output_stream(path), width
        self.out.write(MAGIC)
        self.offsets, self.total, self.rest = [len(MAGIC)], 0, np.zeros(0, np.uint32)
        self.doc_ids, self.nulls, self.sizes = [], [], []

    def add(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += [0 if x is None else x for x in doc_ids]
        self.nulls += [x is None for x in doc_ids]
        self.sizes += sizes.tolist()
        self.total += len(ids)
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"id {ids.max()} doesn't fit {self.width} bits")
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) // BLOCK * BLOCK
        if whole:
            self.out.write(pack(ids[:whole], self.width))
            self.offsets += [self.offsets[-1] + (k + 1) * BLOCK * self.width // 8 for k in range(whole // BLOCK)]
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self.out.write(data := pack(self.rest, self.width))
            self.offsets.append(self.offsets[-1] + len(data))
        self.out.write(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes())
        self.out.write(np.concatenate(([0], np.cumsum(np.array(self.sizes, "<u8")))).astype("<u8").tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        blocks = len(self.offsets) - 1
        self.out.write(np.array([self.width, len(self.doc_ids), blocks, self.total, self.offsets[-1]], "<u8").tobytes())
        self.out.close()


class PackedFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.width, docs, blocks, self.total, at = np.frombuffer(self._read(size - TAIL, TAIL), "<u8").tolist()
        index = self._read(at, size - TAIL - at)
        if self._read(0, 8) != MAGIC:
            raise ValueError(f"{uri} isn't a packed file")
        ids = np.frombuffer(index, "<i8", docs).tolist()
        nulls = np.frombuffer(index, np.uint8, docs, docs * 8).tolist()
        self.doc_ids = [None if gone else x for x, gone in zip(ids, nulls, strict=True)]
        self.doc_starts = np.frombuffer(index, "<u8", docs + 1, docs * 9).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1, docs * 17 + 8).astype(np.int64)

    def _read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, from the blocks that hold them."""
        start, stop = max(0, start), min(stop, self.total)
        if start >= stop:
            return np.zeros(0, np.uint32)
        lo, hi = start // BLOCK, -(-stop // BLOCK)
        data = self._read(int(self.offsets[lo]), int(self.offsets[hi] - self.offsets[lo]))
        return unpack(data, self.width, min(hi * BLOCK, self.total) - lo * BLOCK)[start - lo * BLOCK : stop - lo * BLOCK]

    def document(self, row: int) -> np.ndarray:
        return self.ids(int(self.doc_starts[row]), int(self.doc_starts[row + 1]))

    def close(self) -> None:
        self.file.close()


def _write(folder: str, tokenizer, pieces: bool, width: int, end_id: int):
    def run(batches):
        part, writer, uri = TaskContext.get().partitionId(), None, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tpk"  # every attempt has a file of its own
                writer = PackedWriter(uri, width)
            ids, at = encoder(tokenizer.value, pieces).encode(batch.column(1))
            ids = np.insert(ids, at[1:], np.uint32(end_id))
            sizes = np.diff(at) + 1
            writer.add(batch.column(0).to_pylist(), sizes, ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "uri": uri, "n_docs": len(writer.sizes), "n_ids": writer.total}])

    return run


def _read(step: int = 1 << 20):
    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = PackedFile(uri)
                starts, crcs = packed.doc_starts, np.zeros(len(packed.doc_ids), np.int64)
                for lo in range(0, packed.total, step):
                    hi = min(lo + step, packed.total)
                    data = memoryview(packed.ids(lo, hi).astype("<u4").view(np.uint8))
                    first, last = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")
                    for k in range(first, last):
                        own = data[4 * (max(lo, starts[k]) - lo) : 4 * (min(hi, starts[k + 1]) - lo)]
                        crcs[k] = zlib.crc32(own, int(crcs[k]))
                packed.close()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(packed.doc_ids, pa.int64()),
                        pa.array(starts[:-1] + base),
                        pa.array(np.diff(starts)),
                        pa.array(crcs),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def write_packed(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2) -> DataFrame:
    """Packs the ids of every text into files below folder; a table of the files (part, uri, n_docs, n_ids).

    Files are in ascending doc_id order by part, and so are the documents of a file (null ids first; rows
    that share an id, or have none, by a hash of the text, then by text, so that they may be in several
    files). A null or empty text has only the end id. The width is that of the tokenizer's largest id; an
    id that doesn't fit raises.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = Path(tokenizer_path).read_text()
    tokenizer = spark.sparkContext.broadcast(source)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    ordered = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")
    files = ordered.mapInArrow(
        tidied(_write(folder, tokenizer, cuts_apply(source), id_bits(max(vocabulary_of(source), end_id + 1)), end_id), "encoders"), "part long, uri string, n_docs long, n_ids long"
    )
    return materialize(files, f"{folder}/files")


def read_packed(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files.

    Only the table of files, a row for each file, comes to the driver.
    """
    spark = files.sparkSession
    prepare(spark)
    rows, base = [], 0
    for uri, n in files.orderBy("part").select("uri", "n_ids").toLocalIterator():
        rows.append((uri, base))
        base += n
    listed = spark.createDataFrame(rows, "uri string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(tidied(_read()), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes the packed files and returns what ``read_packed`` finds in them.

    Each row comes back: rows without doc_id first, rows that repeat one each with a start of its own. A
    null or empty text is the end id alone; a very long one is written and read a part at a time. An empty
    table gives no files and no rows. Columns other than doc_id and text are not read.
    """
    folder = workdir(docs.sparkSession, "packed")
    return read_packed(write_packed(docs, tokenizer_path, folder, end_id))
