"""WARC archives with identical-payload revisits, and a two-level capture index over them.

Writing: each task writes its rows as records, one gzip member each, into files of the shared folder and returns one
capture line per record. A retried task writes new files under new names; lines only ever point to whole files.

Index: capture lines sorted by reversed-host URL key and page id, cut into compressed blocks of LINES lines; the sparse
directory keeps the first key of each block. A lookup goes to the part of the index that may hold its key, searches the
directory of the part, opens one block, searches it, and reads the record's byte range from its archive.

Of records with equal payloads of at least LEAST bytes the one with the smallest page_id is the response, others revisit
it; smaller ones are all responses. A null html is an empty payload, a null url an empty key. Rows that repeat a
response's page_id and payload are responses too; a null page_id revisits a numbered one and is a response otherwise.
Repeated rows give repeated records.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import shared_path, stored

LEAST = 100
LINES = 256
FILE_BYTES = 256 << 20
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def url_key(url: Column) -> Column:
    """Host labels reversed, then path and query: https://www.b.org:80/x?y -> org,b)/x?y."""
    url = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://", ""), r"[\x00-\x20]", "%")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@|:\d*$", "")
    host = F.regexp_replace(host, r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*(.*)$", 1), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def capture_key(url: Column, page_id: Column) -> Column:
    """The sort key of a capture: URL key, blank, page id as 20 digits that sort like the number (null first)."""
    shifted = page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    digits = F.lpad(shifted.cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(url_key(url), F.lit(" "), F.coalesce(digits, F.lit("")))


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: response) of every row.

    The smallest id of each digest is aggregated before anything is joined; the join is on digests, and small payloads
    have a key of their own, so empty pages don't meet in one task.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    large = F.octet_length("payload") >= LEAST
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select(F.col("digest").alias("same"), "first")
    alone = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("digest"))
    rows = rows.withColumn("same", F.when(large, F.col("digest")).otherwise(alone))
    joined = rows.join(first, "same", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _field(text: str) -> str:
    """A header value: control characters escaped."""
    return "".join(c if " " <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = "none" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = http
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, type and referred page of a record; a payload is measured and hashed anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    name = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    page = None if name == "none" else int(name)
    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "revisit":
        refers = int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
        return page, int(fields["X-Payload-Length"]), stated, "revisit", refers
    payload = block.partition(b"\r\n\r\n")[2]
    found = hashlib.sha256(payload).hexdigest()
    if found != stated:
        raise ValueError(f"payload of page {page} doesn't match its digest")
    return page, len(payload), found, "response", None


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                lines = []
                for page, url, payload, digest, refers, key in zip(*(c.to_pylist() for c in batch), strict=True):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        store.create_dir(base, recursive=True)
                        out, at = store.open_output_stream(f"{base}/{name}", compression=None), 0
                    member = _member(record(page, url, payload, digest, refers))
                    out.write(member)
                    lines.append((key, name, at, len(member)))
                    at += len(member)
                    if at >= FILE_BYTES:
                        out.close()
                        out = None
                if lines:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in zip(*lines, strict=True)], ["key", "file", "offset", "length"]
                    )
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the records below ``folder``; the capture lines (key, file, offset, length), stored."""
    rows = with_revisits(pages).withColumn("key", capture_key(F.col("url"), F.col("page_id")))
    lines = rows.mapInArrow(_writer(folder), "key string, file string, offset long, length long")
    return stored(lines, "captures")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, block, held = TaskContext.get().partitionId(), 0, []

    def row(lines: list[tuple]) -> pa.RecordBatch:
        body = "\n".join(f"{key} {json.dumps([file, at, n])}" for key, file, at, n in lines)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int64()),
                pa.array([lines[0][0]]),
                pa.array([zlib.compress(body.encode())], pa.binary()),
            ],
            ["part", "block", "first_key", "lines"],
        )

    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch), strict=True)
        while len(held) >= LINES:
            yield row(held[:LINES])
            held, block = held[LINES:], block + 1
    if held:
        yield row(held)


def build_index(captures: DataFrame) -> DataFrame:
    """The index: (part, block, first_key, lines), keys ascending over parts and blocks. Stored.

    Keys are unique but for repeated rows, so a host with a third of all captures is cut like any other range; file and
    offset join the range key for rows that repeat.
    """
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("key", "file", "offset")
    ranged = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = ranged.mapInArrow(_pack, "part int, block long, first_key string, lines binary")
    return stored(packed, "index")


def _find(directory: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """Captures of the wanted keys within one part: directory search, one block at a time, search in the block."""
    directory = directory.sort_values("block")
    firsts = [k.encode() for k in directory["first_key"]]
    blobs = list(directory["lines"])
    found, opened, lines, keys = [], -1, [], []
    for key in sorted({k.encode() for k in wanted["key"]}):
        block = max(bisect.bisect_left(firsts, key) - 1, 0)  # equal keys may begin in the block before
        while block < len(blobs) and firsts[block] <= key:
            if block != opened:
                lines = zlib.decompress(blobs[block]).split(b"\n")
                keys, opened = [line[: line.index(b" [")] for line in lines], block
            at = bisect.bisect_left(keys, key)
            while at < len(keys) and keys[at] == key:
                found.append(tuple(json.loads(lines[at][len(key) + 1 :])))
                at += 1
            block += 1
    return pd.DataFrame(found, columns=["file", "offset", "length"])


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, offset, length) of all captures of the wanted keys (column key; each is looked up once).

    A key goes to every part whose range may hold it; the ranges, one row per part of the index, are all that is sent
    to the tasks.
    """
    bounds = index.groupBy("part").agg(F.min("first_key").alias("first")).orderBy("part").collect()
    parts, firsts = [b["part"] for b in bounds], [b["first"].encode() for b in bounds]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, to = [], []
            for key in batch.column(0).to_pylist():
                raw = key.encode()
                for at in range(max(bisect.bisect_left(firsts, raw) - 1, 0), bisect.bisect_right(firsts, raw)):
                    keys.append(key)
                    to.append(parts[at])
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(keys, pa.string())], ["part", "key"])

    routed = wanted.select("key").mapInArrow(route, "part int, key string")
    return (
        index.groupBy("part")
        .cogroup(routed.groupBy("part"))
        .applyInPandas(_find, "file string, offset long, length long")
    )


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, archive = None, None
        for batch in batches:
            rows = []
            for file, at, n in zip(*(c.to_pylist() for c in batch), strict=True):
                if file != name:
                    name, archive = file, store.open_input_file(f"{base}/{file}")
                rows.append(parsed(zlib.decompress(archive.read_at(n, at), 31)))
            if rows:
                page, size, digest, kind, refers = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(page, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(digest),
                        pa.array(kind),
                        pa.array(refers, pa.int64()),
                    ],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return read


def fetch(places: DataFrame, folder: str) -> DataFrame:
    """Read the byte ranges; ranges of a file come in ascending order, spread over tasks by megabyte."""
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = places.withColumn("span", F.shiftright("offset", 20))
    near = near.repartition(parts, "file", "span").sortWithinPartitions("file", "offset")
    return near.select("file", "offset", "length").mapInArrow(
        _reader(folder),
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, look every page's capture up and read its record."""
    folder = shared_path(pages.sparkSession, "warc")
    captures = write_archives(pages, folder)
    index = build_index(captures)
    wanted = pages.select(capture_key(F.col("url").cast("string"), F.col("page_id").cast("long")).alias("key"))
    return fetch(lookup(index, wanted), folder)


SQL = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (
  SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM payloads),
firsts AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM hashed)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM firsts
"""
