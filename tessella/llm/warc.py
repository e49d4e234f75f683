"""WARC archives with a two-level capture index.

Writing: one gzip member for each record, in files of their own for each task attempt; payloads met
before are revisit records. Index: lines sorted by reversed-host URL key and page_id go into compressed
blocks of BLOCK_LINES; each index file ends with its directory, the first key and the place of each
block, and the driver holds one first key for each index file only. A look-up searches that list, then
a file's directory, then one block, all by bisection, and range-reads one archive record.

Payloads are found equal by digest in a first pass, which shuffles digests and ids only; the second pass
writes records from the scan, next to the table of payloads that several rows have.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, discard, filesystem, join_hot, materialize, prepare, tasks_for, workdir

BLOCK_LINES, FILE_BYTES = 512, 1 << 30
#: Bytes of archives that one task of a reading pass looks records up in.
READ_BYTES = 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def uri_of(url: str) -> str:
    """The URL as WARC headers carry it; what is already escaped stays."""
    return quote(url, safe="/:?&=%#,;@!$'()*+~[]")


def url_key(url: str) -> str:
    """Reversed-host key: ``https://www.b.example:8080/x?y#z`` is ``example,b,www:8080)/x?y``."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe="/:?&=%")
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    port_text = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return quote(",".join(reversed(host.split("."))) + port_text + ")" + tail, safe="/:?&=%,);@!$'(*+~[]")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(uri_of(url or ''))} {(page_id if page_id is not None else -(1 << 63)) + (1 << 63):020d}"


def _page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(url: str, page_id: int | None, payload: bytes, refers: tuple[int, str] | None, date: str) -> bytes:
    """One WARC record, uncompressed; a revisit has the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {_page_uri(page_id)}",
        f"WARC-Target-URI: {uri_of(url)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {_page_uri(refers[0])}",
            f"WARC-Refers-To-Target-URI: {uri_of(refers[1])}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-cased name) and payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if f"sha1:{digest_of(block)}" != headers["warc-block-digest"]:
        raise ValueError(f"damaged record {headers['warc-record-id']}")
    return headers, block.partition(b"\r\n\r\n")[2]


def _write(folder: str, date: str):
    def run(batches):
        out, uri, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out:
                        out.close()
                    uri = f"{folder}/archive-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    fs, path = filesystem(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out, at = fs.open_output_stream(path, compression=None), 0
                payload = (html or "").encode("utf-8", "surrogatepass")
                refers = (first, first_url or "") if first is not None and first != page_id else None
                data = gzip.compress(record(url or "", page_id, payload, refers, date), 6, mtime=0)
                out.write(data)
                rows.append((capture_key(url, page_id), page_id, uri, at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _CAPTURE_TYPES, strict=True)], _CAPTURE_NAMES
                )
        if out:
            out.close()

    return run


_CAPTURE_NAMES = ["key", "page_id", "uri", "at", "size"]
_CAPTURE_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) and returns captures(key, page_id, uri, at, size).

    Of equal payloads of at least least_bytes bytes, the smallest page_id's is the response (each, if
    rows repeat it) and the others are revisits of it. A null html is an empty payload, a null url an
    empty one; a row without page_id is a revisit if another row with the same payload has one.
    """
    prepare(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    marked = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    large = marked.filter(F.octet_length("html") >= least_bytes)
    firsts = (
        large.select("sha", F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")).alias("own"))
        .groupBy("sha")
        .agg(F.min("own").alias("x"), F.count("*").alias("n"))
        .filter("n > 1 and x is not null")
    )
    firsts = materialize(firsts.select("sha", F.col("x.page_id").alias("first"), F.col("x.url").alias("first_url")), f"{folder}/firsts")
    if firsts.count() <= BROADCAST_IDS:
        whole = marked.join(F.broadcast(firsts), "sha", "left")
    else:
        spread = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
        whole = join_hot(marked, firsts, "sha", spread, f"{folder}/hot", "left")
    whole = whole.select("page_id", "url", "html", "first", "first_url")
    captures = whole.mapInArrow(_write(f"{folder}/archives", date), "key string, page_id long, uri string, at long, size long")
    captures = materialize(captures, f"{folder}/captures")
    discard(pages.sparkSession, f"{folder}/firsts", f"{folder}/hot")
    return captures


def _index(folder: str):
    def run(batches):
        out, directory, lines, first, uri, at = None, [], [], None, "", 0

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(lines).encode())
            out.write(data)
            directory.append(f"{lines[0].partition('\t')[0]}\t{at}\t{len(data)}")
            at += len(data)
            lines.clear()

        for batch in batches:
            for key, page_id, warc, place, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    uri = f"{folder}/index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdxz"
                    fs, path = filesystem(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out, first = fs.open_output_stream(path, compression=None), key
                lines.append(f"{key}\t{'' if page_id is None else page_id}\t{warc}\t{place}\t{size}")
                if len(lines) == BLOCK_LINES:
                    flush()
        if out:
            if lines:
                flush()
            data = zlib.compress("\n".join(directory).encode())
            out.write(data + at.to_bytes(8, "little") + len(data).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_pylist([{"first_key": first, "uri": uri, "n_blocks": len(directory)}])

    return run


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts the captures into index files; a table of the files (first_key, uri, n_blocks)."""
    ordered = captures.select(*_CAPTURE_NAMES).repartitionByRange("key", "uri", "at").sortWithinPartitions("key", "uri", "at")
    return materialize(ordered.mapInArrow(_index(f"{folder}/index"), "first_key string, uri string, n_blocks long"), f"{folder}/index-files")


class CaptureIndex:
    """Look-ups in the index files; blocks, directories and open archives are kept while they are in use."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = sorted(files)
        self.firsts = [x for x, _ in self.files]
        self.directory = lru_cache(16)(self._directory)
        self.block = lru_cache(16)(self._block)
        self.open = lru_cache(64)(lambda uri: (lambda fs_path: fs_path[0].open_input_file(fs_path[1]))(filesystem(uri)))

    def _directory(self, uri: str) -> tuple[list[str], list[tuple[int, int]]]:
        file = self.open(uri)
        size = file.size()
        tail = file.read_at(16, size - 16)
        at, n = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little")
        rows = [x.split("\t") for x in zlib.decompress(file.read_at(n, at)).decode().split("\n")]
        return [x[0] for x in rows], [(int(x[1]), int(x[2])) for x in rows]

    def _block(self, uri: str, at: int, size: int) -> tuple[list[str], list[str]]:
        lines = zlib.decompress(self.open(uri).read_at(size, at)).decode().split("\n")
        return [x.partition("\t")[0] for x in lines], lines

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(archive, place, size) of all captures with the key."""
        out = []
        lo = max(0, bisect_left(self.firsts, key) - 1)
        for _, uri in self.files[lo : bisect_right(self.firsts, key)]:
            firsts, places = self.directory(uri)
            for at, size in places[max(0, bisect_left(firsts, key) - 1) : bisect_right(firsts, key)]:
                keys, lines = self.block(uri, at, size)
                for line in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                    _, _, warc, place, length = line.split("\t")
                    out.append((warc, int(place), int(length)))
        return out

    def read(self, capture: tuple[str, int, int]) -> tuple[dict[str, str], bytes]:
        uri, at, size = capture
        return parse_record(gzip.decompress(self.open(uri).read_at(size, at)))


def _read(files):
    def run(batches):
        index = CaptureIndex(files.value)

        @lru_cache(256)
        def original(uri: str, page_id: int) -> tuple[int, str]:
            headers, payload = index.read(index.find(capture_key(uri, page_id))[0])
            return len(payload), digest_of(payload)

        last, turn = None, 0
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                turn = turn + 1 if key == last else 0
                last = key
                headers, payload = index.read(index.find(key)[turn])
                refers = headers.get("warc-refers-to")
                page = None if refers is None else _page_of(refers)
                if refers is None:
                    size, digest = len(payload), digest_of(payload)
                else:
                    size, digest = original(headers["warc-refers-to-target-uri"], page)
                if f"sha1:{digest}" != headers["warc-payload-digest"]:
                    raise ValueError(f"wrong payload for {headers['warc-record-id']}")
                rows.append((_page_of(headers["warc-record-id"]), size, digest, headers["warc-type"], page))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return run


def _key_rows(batches):
    for batch in batches:
        keys = [capture_key(u, p) for u, p in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])


def read_captures(pages: DataFrame, index_files: DataFrame, archive_bytes: int) -> DataFrame:
    """Looks up every row's url and page_id in the index and reads its record.

    Look-ups are sorted by key, so each index block is unpacked about once; repeated rows get the
    captures of their key one after the other. One first key for each index file goes to all tasks. The
    number of tasks follows the bytes of the archives, since the keys that are shuffled are small.
    """
    spark = pages.sparkSession
    prepare(spark)
    files = [(r.first_key, r.uri) for r in index_files.select("first_key", "uri").toLocalIterator()]
    keys = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(_key_rows, "key string")
    return (
        keys.repartitionByRange(tasks_for(archive_bytes, READ_BYTES), "key")
        .sortWithinPartitions("key")
        .mapInArrow(
            _read(spark.sparkContext.broadcast(files)),
            "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
        )
    )


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes, indexes and reads back all rows: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    payload_bytes and payload_digest are of the full payload, which for a revisit is read from the
    response it refers to. Nulls are as in ``write_archives``; repeated rows and rows without page_id each
    come back; very long payloads are one record each. An empty table gives no rows; other columns are not read.
    """
    folder = workdir(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, least_bytes)
    index_files = build_index(captures, folder)
    size = captures.agg(F.sum("size")).first()[0] or 0
    return read_captures(pages, index_files, size)
