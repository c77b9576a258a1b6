"""WARC archives: write, normalise monolithic gzip streams, index, read back.

:func:`write_archives` writes records as whole-file gzip streams (one member
for a file of many records).  :func:`normalise` inflates each stream once,
front to back, rewrites every record as a gzip member of its own and lists the
members' offsets in a sidecar index, so :func:`read_records` can open any
record alone.

Archives travel as rows (archive, data), so that Spark's readers and writers
carry them to any store; :func:`load_files` reads real ``.warc.gz`` files and
:func:`export_files` writes archives and sidecars to a mounted folder.  An
archive row is as large as ``target_bytes`` of records, or one record.

Records with equal payloads: the smallest id is the response, the others are
revisits without a payload that refer to it.  Defined cases: a null payload
counts as empty; a null id sorts last, and refers to its response like others;
repeated rows of the smallest id are all responses; payloads under
``min_bytes`` are always responses; a null url becomes ``urn:page:<id>``;
control characters in urls are percent-encoded; an empty table gives no
archive; a stream that ends inside a record is an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_slices, written

TARGET_BYTES = 16 << 20
LEVEL = 3
_STEP = 1 << 20
_GZIP = 31  # zlib's wbits for gzip framing
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")
_INDEX = ("array<struct<offset: long, length: long, record_id: string, record_type: string, uri: string, "
          "digest: string>>")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page))}>"


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """id, url, payload, first (id of the response) and revisit for every row.

    Groups are written before the join, so adaptive execution can split the
    rows of a payload that very many pages share.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"),
                        payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"))
    groups = written(rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1")
                     .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    met = rows.join(groups, "sha1", "left")
    return met.select("id", "url", "payload", "first", (
        (F.octet_length("payload") >= min_bytes) & F.col("first").isNotNull()
        & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"))


def _record(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page}"
    block = _HTTP if revisit else _HTTP + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page)),
            ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
            ("X-Payload-Bytes", len(payload)), ("X-Page-Id", "" if page is None else page)]
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page-Id", first)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def _writer(prefix: str, date: str, target: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, number, size, out = TaskContext.get().partitionId(), 0, 0, None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "archive": pa.array([f"{prefix}-{part:06d}-{number:06d}.warc.gz"]),
                "data": pa.array([b"".join(kept) + out.flush()], pa.binary())})
        for whole in batches:
            for batch in row_slices(whole, "payload"):
                for r in batch.to_pylist():
                    if out is None:
                        out, kept, size = zlib.compressobj(level, zlib.DEFLATED, _GZIP), [], 0
                    data = _record(r["id"], r["url"], r["payload"].encode(), r["first"], r["revisit"], date)
                    kept.append(out.compress(data))
                    size += len(data)
                    if size >= target:
                        yield close()
                        out, number = None, number + 1
        if out is not None:
            yield close()
    return run


def write_archives(records: DataFrame, prefix: str = "pages", date: str = "2020-01-01T00:00:00Z",
                   target_bytes: int = TARGET_BYTES, level: int = LEVEL) -> DataFrame:
    """(archive, data): rows of :func:`with_revisits` as monolithic gzip streams."""
    return records.mapInArrow(_writer(prefix, date, target_bytes, level), "archive string, data binary")


def inflated(data: bytes) -> Iterator[bytes]:
    """The stream's bytes in pieces of bounded size; one member or many."""
    while data:
        stream = zlib.decompressobj(_GZIP)
        for at in range(0, len(data), _STEP):
            part = data[at:at + _STEP]
            while part and not stream.eof:
                yield stream.decompress(part, _STEP)
                part = stream.unconsumed_tail
            if stream.eof:
                data = stream.unused_data + data[at + _STEP:]
                break
        else:
            while tail := stream.decompress(stream.unconsumed_tail, _STEP):
                yield tail
            if not stream.eof:
                raise ValueError("the gzip stream ends early")
            data = stream.unused_data


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and the whole bytes of each record."""
    buffer = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            buffer.extend(piece)
        return piece is not None
    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        total = end + 4 + int(head["content-length"]) + 4
        while len(buffer) < total:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(buffer[:total])
        del buffer[:total]


def _normaliser(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()),
                                   ("record_type", pa.string()), ("uri", pa.string()), ("digest", pa.string())]))
        for batch in batches:
            for i in range(batch.num_rows):
                out, index, offset = [], [], 0
                for head, data in records(inflated(batch.column("data")[i].as_py())):
                    box = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                    member = box.compress(data) + box.flush()
                    index.append({"offset": offset, "length": len(member), "record_id": head["warc-record-id"],
                                  "record_type": head["warc-type"], "uri": head["warc-target-uri"],
                                  "digest": head["warc-payload-digest"].partition(":")[2]})
                    out.append(member)
                    offset += len(member)
                yield pa.RecordBatch.from_pydict({"archive": batch.column("archive").slice(i, 1),
                                                  "data": pa.array([b"".join(out)], pa.binary()),
                                                  "index": pa.array([index], kind)})
    return run


def normalise(archives: DataFrame, level: int = LEVEL) -> DataFrame:
    """(archive, data, index): one gzip member per record, and the sidecar index of their offsets."""
    return archives.select("archive", "data").mapInArrow(
        _normaliser(level), f"archive string, data binary, index {_INDEX}")


def sidecar(normal: DataFrame) -> DataFrame:
    """The offset index as rows; reads no archive data."""
    return normal.select("archive", F.explode("index").alias("i")).select("archive", "i.*")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            data, rows = batch.column("data")[i].as_py(), []
            for entry in batch.column("index")[i].as_py():
                member = data[entry["offset"]:entry["offset"] + entry["length"]]
                (head, record), = records(iter([zlib.decompress(member, _GZIP)]))
                block = record[len(record) - 4 - int(head["content-length"]):-4]
                payload = block[block.index(b"\r\n\r\n") + 4:]
                revisit = head["warc-type"] == "revisit"
                if not revisit and payload_digest(payload) != entry["digest"]:
                    raise ValueError(f"{entry['record_id']}: the payload does not match its digest")
                number = lambda name: int(head[name]) if head.get(name) else None
                rows.append({"page_id": number("x-page-id"), "uri": head["warc-target-uri"],
                             "payload_bytes": number("x-payload-bytes"), "payload_digest": entry["digest"],
                             "record_type": head["warc-type"], "refers_to": number("x-refers-to-page-id"),
                             "payload": None if revisit else payload})
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[at:at + 1000], pa.schema([
                    ("page_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("payload", pa.binary())]))


def read_records(normal: DataFrame) -> DataFrame:
    """Every record, opened alone through the index; response payloads are checked against their digest."""
    return normal.select("data", "index").mapInArrow(
        _reader, "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, "
                 "refers_to long, payload binary")


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, data) of real ``.warc.gz`` files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data"))


def export_files(normal: DataFrame, folder: str) -> None:
    """Write archives and ``.idx`` sidecars to ``folder``, which every machine must have mounted."""
    def put(rows) -> None:
        import os
        for r in rows:
            for name, data in ((r.archive, bytes(r.data)), (r.archive + ".idx", "".join(
                    f"{e.offset}\t{e.length}\t{e.record_id}\t{e.record_type}\t{e.digest}\t{e.uri}\n"
                    for e in r["index"]).encode())):
                scratch = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(scratch, "wb") as f:
                    f.write(data)
                os.replace(scratch, os.path.join(folder, name))  # a retried task leaves whole files
    normal.foreachPartition(put)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back; the archives and the normalised archives stay in the shared folder."""
    archives = written(write_archives(with_revisits(pages, id_col, url_col, payload_col, min_bytes)), "archives")
    return read_records(written(normalise(archives), "normalised"))
