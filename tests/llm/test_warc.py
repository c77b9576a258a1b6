import base64
import gzip
import hashlib
import zlib

import pytest

from riskframe.llm.warc import (export_files, inflated, load_files, normalise, read_records, records, round_trip,
                                sidecar, with_revisits, write_archives)

ROWS = [(3, "http://a/é", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (2, "http://c\r\nX: y", ""), (4, None, None),
        (5, "http://d", "y" * 5000), (None, "http://e", "<p>x</p>"), (1, "http://b", "<p>x</p>"),
        (6, "http://f", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, None, "only null")]
SCHEMA = "page_id long, url string, html string"


def want(min_bytes=0):
    out = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        ids = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        first = min(ids) if ids and len(data) >= min_bytes else None
        revisit = first is not None and page != first
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def got(df):
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(*r, "z") for r in ROWS], SCHEMA + ", data string").repartition(2)
    out = round_trip(pages, min_bytes=min_bytes)
    assert got(out) == want(min_bytes)
    payloads = {r.page_id: bytes(r.payload) for r in out.collect() if r.record_type == "response"}
    assert payloads[5] == b"y" * 5000 and payloads[6] == b"\r\n\r\nWARC/1.1\r\n\r\n"
    assert round_trip(pages.limit(0)).count() == 0


def test_members_files_and_index(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    archives = write_archives(with_revisits(pages, "page_id", "url", "html"), target_bytes=2000).cache()
    normal = normalise(archives).cache()
    index = sidecar(normal).collect()
    whole = {r.archive: bytes(r.data) for r in archives.collect()}
    for r in normal.collect():
        data = bytes(r.data)
        assert gzip.decompress(data) == gzip.decompress(whole[r.archive])  # the same records in the same order
        for e in (i for i in index if i.archive == r.archive):
            (head, _), = records(iter([zlib.decompress(data[e.offset:e.offset + e.length], 31)]))
            assert head["warc-record-id"] == e.record_id
    assert len(index) == len(ROWS) and len(whole) > 1
    export_files(normal, str(tmp_path))
    files = load_files(spark, f"{tmp_path}/*.gz")
    assert got(read_records(normalise(files))) == want()  # many members are read as well as one


def test_broken_streams():
    box = zlib.compressobj(3, zlib.DEFLATED, 31)
    data = box.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc") + box.flush()
    with pytest.raises(ValueError):
        list(records(inflated(data)))
    with pytest.raises(ValueError):
        list(inflated(data[:-12]))
