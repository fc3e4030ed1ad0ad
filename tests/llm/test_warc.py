"""Archives against hashlib and against a plain reader."""

import base64
import glob
import gzip
import hashlib
import io

import pytest

from checks.compare import connect, difference
from millrace.llm import warc as W
from millrace.llm.queries import ORACLE, QUERIES
from tests.conftest import SF


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(pages, least=0):
    """(page_id, bytes, digest, type, refers_to) by whole payloads."""
    raw = [(i, (h or "").encode()) for i, h in pages]
    first = {}
    for i, data in raw:
        if i is not None and len(data) >= least:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, data in raw:
        to = first.get(data)
        revisit = to is not None and to != i and len(data) >= least
        out.append((i, len(data), digest(data), "revisit" if revisit else "response",
                    to if revisit else None))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def test_query_equals_whole_payloads(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = rows(QUERIES["op2_warc_chunks"](spark, SF))
    assert got == plain([(p.page_id, p.html) for p in pages])


def test_query_equals_its_sql(spark):
    got = QUERIES["op2_warc_chunks"](spark, SF).toPandas().astype({"refers_to": "Int64"})
    want = connect(SF).execute(ORACLE["op2_warc_chunks"]).df()
    want = want.astype({"refers_to": "Int64"})
    assert difference(got, want) is None


@pytest.mark.parametrize("chunk", [7, 1000, W.CHUNK])
@pytest.mark.parametrize("least", [0, 4])
def test_archives(spark, tmp_path, chunk, least):
    big = "é0123456789" * 3000
    pages = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (None, "n", "same"),
             (1, "u1", ""), (2, "u2", None), (4, "a\r\nb", big), (6, "u6", big), (7, "u7", "WARC/1.1\r\n"),
             (8, "u8", "\r\n\r\n"), (None, "x", "alone"), (8, "u8", "\r\n\r\n"), (10, "", "abc"), (11, "", "abc")]
    frame = spark.createDataFrame(
        [(*p, "clash") for p in pages], "page_id long, url string, html string, data string"
    )
    folder = f"file://{tmp_path}/out"
    manifest = W.archive_pages(frame, folder, min_revisit_bytes=least, chunk=chunk)
    chunks = W.read_archives(manifest, chunk)
    assert rows(W.archived_records(chunks)) == plain([(i, h) for i, _, h in pages], least)
    assert manifest.agg({"records": "sum"}).first()[0] == len(pages)
    # The chunks of each response are its payload.
    found = {}
    for r in chunks.orderBy("archive", "record_no", "chunk_no").collect():
        assert len(r.data) <= chunk
        found.setdefault((r.archive, r.record_no, r.page_id, r.record_type), []).append(bytes(r.data))
    payloads = {i: (h or "").encode() for i, _, h in pages if i is not None}
    for (_, _, i, kind), parts in found.items():
        if i is not None:
            assert b"".join(parts) == (payloads[i] if kind == "response" else b"")
    # A plain reader of whole files finds the same records.
    seen = 0
    for path in glob.glob(f"{tmp_path}/out/*.warc.gz"):
        data = gzip.open(path).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            body, data = rest[:size], rest[size:]
            assert data.startswith(b"\r\n\r\n")
            data = data[4:]
            if fields[b"WARC-Type"] == b"response":
                payload = body.partition(b"\r\n\r\n")[2]
                assert fields[b"WARC-Payload-Digest"] == b"sha1:" + digest(payload).encode()
            seen += fields[b"WARC-Type"] != b"warcinfo"
    assert seen == len(pages)


def test_archives_are_closed_at_their_limit(spark, tmp_path):
    frame = spark.range(40).selectExpr("id page_id", "'u' url", "repeat(id, 500) html")
    ready = W.chunked(
        frame.selectExpr("page_id", "url", "encode(html, 'UTF-8') payload", "'response' record_type",
                         "cast(null as long) refers_to", "octet_length(html) + 0L payload_bytes",
                         "sha1(html) sha1"), "payload", 300)
    manifest = W.write_archives(ready, f"file://{tmp_path}/out", 2000)
    assert manifest.count() > 8
    assert W.archived_records(W.read_archives(manifest)).count() == 40


@pytest.mark.parametrize("harm", ["digest", "end", "start"])
def test_damaged_archives_are_refused(harm):
    head = W.record_head(1, "u", "response", None, 3, hashlib.sha1(b"abc").hexdigest())
    body = {"digest": b"abd\r\n\r\n", "end": b"ab", "start": b"abc\r\n\r\nnoise\r\n"}[harm]
    with pytest.raises(ValueError):
        list(W.records_in(io.BytesIO(gzip.compress(head + body))))


def test_empty_table(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.warc_round_trip(frame).collect() == []
