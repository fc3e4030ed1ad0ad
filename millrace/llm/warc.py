"""WARC archives written and read as a table of chunks, never as whole records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, stored
from millrace.session import scratch_dir

# Bytes of a payload in one row; a batch of rows sent to Spark has a few of them.
CHUNK = 1 << 20
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2_000
# An archive is closed after the record that brings it to this many payload bytes.
ARCHIVE_BYTES = 256 << 20
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"
# The pages have no time of capture.
DATE = "1970-01-01T00:00:00Z"
_EDGE = b"\r\n"


def chunked(df: DataFrame, payload: str, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of a binary column: chunk_no (from 0), last, data.

    The rows of a record follow one another, in order, in one partition; an empty or
    null payload has one empty chunk.  The column itself is dropped.
    """
    rest = [c for c in df.columns if c != payload]
    size = F.coalesce(F.octet_length(payload), F.lit(0))
    parts = F.greatest(F.lit(1), F.ceil(size / chunk)).cast("int")
    numbered = df.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("chunk_no"))
    data = F.substring(F.col(payload), F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return numbered.select(
        *rest,
        "chunk_no",
        (F.col("chunk_no") == parts - 1).alias("last"),
        F.coalesce(data, F.lit(b"")).alias("data"),
    )


def with_digests(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table: its other columns, payload_bytes, sha1 (hex).

    The digest is carried from chunk to chunk; only one chunk is held.
    """
    kept = [f for f in chunks.schema if f.name not in ("chunk_no", "last", "data")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, digest = 0, hashlib.sha1()
        for batch in batches:
            rows, sizes, digests = [], [], []
            for row in range(batch.num_rows):
                if batch["chunk_no"][row].as_py() == 0:
                    size, digest = 0, hashlib.sha1()
                data = batch["data"][row].as_py()
                size += len(data)
                digest.update(data)
                if batch["last"][row].as_py():
                    rows.append(row)
                    sizes.append(size)
                    digests.append(digest.hexdigest())
            picked = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch[n].take(picked) for n in names],
                 pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                [*names, "payload_bytes", "sha1"],
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return chunks.mapInArrow(run, f"{ddl}, payload_bytes long, sha1 string")


def base32_of(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _line(value: str) -> str:
    """A header value: what would end the line is written as in an address."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def record_head(
    page_id: int | None, uri: str | None, kind: str, refers_to: int | None, size: int, sha1: str
) -> bytes:
    """The headers of a record and of the HTTP response that it holds."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {size}\r\n\r\n"
    ).encode()
    named = lambda i: f"<{ID_PREFIX}{'' if i is None else i}>"
    lines = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {named(page_id)}",
        f"WARC-Date: {DATE}",
    ]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_line(uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32_of(sha1)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {named(refers_to)}"]
    body = len(http) + (size if kind == "response" else 0)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {body}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + _EDGE * 2 + http


class _Archive:
    """A gzip file with a member for each record, written chunk by chunk."""

    def __init__(self, folder: str):
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        # A fresh name: an attempt that fails leaves a file that no manifest names.
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.uri = f"{folder}/{name}"
        self.out = files.open_output_stream(f"{path}/{name}", compression=None)
        self.records = 0
        self.payload_bytes = 0
        info = b"software: millrace\r\nformat: WARC File Format 1.1\r\n"
        head = (
            f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
            f"WARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\n"
            f"Content-Length: {len(info)}\r\n\r\n"
        )
        self.begin(head.encode())
        self.add(info)
        self.end()
        self.records = 0

    def begin(self, head: bytes) -> None:
        self.packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.out.write(self.packer.compress(head))

    def add(self, data: bytes) -> None:
        self.out.write(self.packer.compress(data))
        self.payload_bytes += len(data)

    def end(self) -> None:
        self.out.write(self.packer.compress(_EDGE * 2) + self.packer.flush())
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.records, self.payload_bytes


def write_archives(records: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a chunk table as archives; the manifest of those that were completed.

    ``records``: page_id, url, record_type, refers_to, payload_bytes, sha1 and the
    columns of ``chunked``.  The manifest (archive, records, payload_bytes) is stored
    in the shared folder: it names the files of successful tasks only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive: _Archive | None = None
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in range(batch.num_rows):
                value = {n: batch[n][row].as_py() for n in batch.schema.names if n != "data"}
                if archive is None:
                    archive = _Archive(folder)
                if value["chunk_no"] == 0:
                    archive.begin(
                        record_head(
                            value["page_id"], value["url"], value["record_type"],
                            value["refers_to"], value["payload_bytes"], value["sha1"],
                        )
                    )
                if value["record_type"] == "response":
                    archive.add(batch["data"][row].as_py())
                if value["last"]:
                    archive.end()
                    if archive.payload_bytes >= limit:
                        done.append(archive.close())
                        archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            uris, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uris), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                ["archive", "records", "payload_bytes"],
            )

    return stored(
        records.mapInArrow(run, "archive string, records long, payload_bytes long"),
        "warc-manifest",
    )


class _Unpacked:
    """The bytes of a gzip file of many members, read piece by piece."""

    def __init__(self, source: BinaryIO, chunk: int = CHUNK):
        self.source = source
        self.chunk = chunk
        self.member: zlib._Decompress | None = None
        self.packed = b""
        self.ready = b""

    def more(self) -> bool:
        """Unpack up to a chunk; false at the end of the file."""
        while True:
            if not self.packed:
                self.packed = self.source.read(self.chunk)
                if not self.packed:
                    if self.member is not None:
                        raise ValueError("the archive ends within a record")
                    return False
            if self.member is None:
                self.member = zlib.decompressobj(31)
            data = self.member.decompress(self.packed, self.chunk)
            self.packed = self.member.unconsumed_tail
            if self.member.eof:
                self.packed = self.member.unused_data
                self.member = None
            if data:
                self.ready += data
                return True

    def line(self) -> bytes | None:
        """The next line without its end, or none at the end of the file."""
        while (at := self.ready.find(_EDGE)) < 0:
            if not self.more():
                if self.ready:
                    raise ValueError("the archive ends within a line")
                return None
        found, self.ready = self.ready[:at], self.ready[at + 2 :]
        return found

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in pieces of full chunks and a rest."""
        while size:
            wanted = min(size, self.chunk)
            while len(self.ready) < wanted:
                if not self.more():
                    raise ValueError("the archive ends within a record")
            found, self.ready = self.ready[:wanted], self.ready[wanted:]
            size -= wanted
            yield found


def _headers(source: _Unpacked) -> dict[str, str]:
    found: dict[str, str] = {}
    while line := source.line():
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _id_in(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(ID_PREFIX)
    return int(text) if text else None


def records_in(source: BinaryIO, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunks of the responses and revisits of an archive.

    Each chunk carries the bytes and the digest of its record's payload so far.  A
    revisit has one empty chunk, with the size and digest of the payload it refers to.
    """
    unpacked = _Unpacked(source, chunk)
    number = -1
    while (first := unpacked.line()) is not None:
        if not first:
            continue  # between records
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        head = _headers(unpacked)
        size = int(head["content-length"])
        kind = head["warc-type"]
        if kind not in ("response", "revisit"):
            for _ in unpacked.pieces(size):
                pass
            continue
        number += 1
        # Read the HTTP headers byte by byte of what is counted as the block.
        http = [unpacked.line() or b""]
        while http[-1]:
            http.append(unpacked.line() or b"")
        size -= sum(len(x) + 2 for x in http)
        lengths = [int(x.split(b":")[1]) for x in http if x.lower().startswith(b"content-length:")]
        declared = head["warc-payload-digest"].removeprefix("sha1:")
        base = {
            "record_no": number, "page_id": _id_in(head.get("warc-record-id")),
            "url": head.get("warc-target-uri"), "record_type": kind,
            "refers_to": _id_in(head.get("warc-refers-to")),
        }
        if kind == "revisit":
            for _ in unpacked.pieces(size):
                pass
            yield base | {"chunk_no": 0, "last": True, "data": b"",
                          "payload_bytes": lengths[0], "payload_digest": declared}
            continue
        digest = hashlib.sha1()
        done = 0
        for no, data in enumerate(unpacked.pieces(size) if size else [b""]):
            digest.update(data)
            done += len(data)
            so_far = base32_of(digest.hexdigest())
            last = done == size
            if last and so_far != declared:
                raise ValueError(f"record {base['page_id']}: {so_far} is not {declared}")
            yield base | {"chunk_no": no, "last": last, "data": data,
                          "payload_bytes": done, "payload_digest": so_far}


_CHUNK_SCHEMA = pa.schema(
    [("archive", pa.string()), ("record_no", pa.int64()), ("page_id", pa.int64()),
     ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)
_CHUNK_DDL = (
    "archive string, record_no long, page_id long, url string, record_type string,"
    " refers_to long, chunk_no int, last boolean, data binary, payload_bytes long,"
    " payload_digest string"
)


def read_archives(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives that a manifest names.

    Archives are dealt to tasks one by one.  payload_bytes and payload_digest count up
    to the chunk; where ``last`` is true they are the record's, checked against the
    digest that the record declares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = fs.FileSystem.from_uri(uri)
                with files.open_input_stream(path, compression=None) as source:
                    for row in records_in(source, chunk):
                        held.append(row | {"archive": uri})
                        size += len(row["data"])
                        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(held, _CHUNK_SCHEMA)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _CHUNK_SCHEMA)

    names = manifest.select("archive")
    parts = max(1, names.count())
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    dealt = names.repartition(min(parts, 64 * cores), "archive")
    return dealt.mapInArrow(run, _CHUNK_DDL)


def _first_of_each(digests: DataFrame) -> DataFrame:
    """Payloads that several records share, with the smallest id that has them."""
    return stored(
        digests.groupBy("sha1", "payload_bytes")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("sha1").alias("_sha1"), F.col("payload_bytes").alias("_bytes"), "first_id"),
        "warc-firsts",
    )


def archive_pages(
    df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html", min_revisit_bytes: int = 0, chunk: int = CHUNK,
) -> DataFrame:
    """Write a record for every page; the manifest of the archives.

    Of the pages with equal payloads of at least ``min_revisit_bytes`` bytes, that with
    the smallest id is a response with the payload, and the others are revisits of it;
    smaller ones are all responses.  A null page is an empty payload.  Where only some
    ids are null, their pages are revisits; where all are, all are responses, and so
    are rows that repeat the smallest id.
    """
    pages = df.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    digests = stored(
        with_digests(chunked(pages.select("page_id", "payload"), "payload", chunk)),
        "warc-digests",
    )
    firsts = _first_of_each(digests.where(F.col("payload_bytes") >= min_revisit_bytes))
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    named = pages.withColumns(
        {"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    same = (F.col("sha1") == F.col("_sha1")) & (F.col("payload_bytes") == F.col("_bytes"))
    joined = named.join(firsts, same, "left")
    revisit: Column = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(
        F.col("first_id")
    )
    records = joined.select(
        "page_id", "url", "payload_bytes", "sha1",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    return write_archives(chunked(records, "payload", chunk), folder)


def archived_records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table that was read."""
    return chunks.where("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


def warc_round_trip(df: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read these back.

    Result, one row per row of ``df``: page_id, payload_bytes, payload_digest (base32
    SHA-1 of the full payload), record_type, refers_to, url.  See ``archive_pages``
    for nulls and repeated rows; other columns are ignored; an empty table gives an
    empty result.
    """
    folder = scratch_dir(df.sparkSession, "warc")
    return archived_records(read_archives(archive_pages(df, folder)))
