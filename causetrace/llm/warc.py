"""WARC archives: records written as one gzip stream a file, normalised to one member a record with an offset index, and read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causetrace.llm.common import remove, shared_dir, stage, unstage

#: Bytes of records after which a task begins its next archive; bytes inflated or written at once.
ARCHIVE_BYTES, CHUNK = 128 << 20, 1 << 20
# Names of the archive format, version 1.1.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"
INDEX = "record_id string, record_type string, uri string, digest string, archive string, offset bigint, length bigint"


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all tasks share."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


def with_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, digest, record_type, refers_to`` of every row of ``pages(page_id, url, html)``; null html is empty.

    Of rows with equal payloads of at least ``min_bytes`` bytes those with the largest ``page_id`` are responses, the others revisit it. A null id is the
    largest only where the payload has no other. Only digests and ids are grouped; payloads meet the rows that repeat, not each other.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    short = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    groups = short.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keep")
    again = short.join(groups.hint("merge"), "digest").where(~F.col("page_id").eqNullSafe(F.col("keep"))).distinct()
    again = stage(again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "keep"), "again")
    got = rows.join(again, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left")
    kind = F.when(F.col("d").isNotNull(), "revisit").otherwise("response")
    return got.select("page_id", "url", "html", "digest", kind.alias("record_type"), F.col("keep").alias("refers_to"))


def _record(page_id, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to, date: str) -> tuple[bytes, bytes]:
    """(header, block). A revisit keeps the HTTP header, whose length is that of the payload, and leaves the payload out."""
    name = lambda x: f"<{_ID}{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url:  # no blanks or line ends in a header
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    fields.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(fields).encode() + b"\r\n\r\n", block


def write_archives(records: DataFrame, folder: str, max_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of the rows of ``with_types``, each one gzip stream; returns ``archive, n_records, n_bytes``, staged.

    A task writes one archive after another, each of about ``max_bytes`` uncompressed. Names are drawn anew for each attempt of a task, and only archives in the result count, so a
    task that is run again leaves no half archive in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        name, out, gz, n, size = "", None, None, 0, 0

        def closed() -> pa.RecordBatch:
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n], "n_bytes": [size]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, gz = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                page_id, url, html, digest, kind, refers_to = row
                for piece in (*_record(page_id, url, html.encode(), digest, kind == "revisit", refers_to, date), b"\r\n\r\n"):
                    out.write(gz.compress(piece))
                    size += len(piece)
                n += 1
                if size >= max_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    _make(records.sparkSession, folder)
    return stage(records.select("page_id", "url", "html", "digest", "record_type", "refers_to").mapInArrow(run, "archive string, n_records bigint, n_bytes bigint"), "archives")


def _make(spark, folder: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def _header(stream: BinaryIO) -> tuple[bytes, dict[str, str]] | None:
    """(bytes, fields by lower-case name) of the next record, None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a record: {line[:40]!r}")
    raw, fields = [line], {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a header ends too early")
        raw.append(line)
        key, _, value = line.decode("utf-8", "replace").partition(":")
        fields[key.strip().lower()] = value.strip()
    return b"".join(raw) + b"\r\n", fields


def split_members(source: BinaryIO, out: BinaryIO, archive: str) -> Iterator[dict]:
    """Inflate ``source`` once, whatever its members, and write each record as a member of its own; yields an index entry a record.

    Works a chunk at a time, so neither a long archive nor a long record is held whole.
    """
    stream, at = gzip.GzipFile(fileobj=source), 0
    while (head := _header(stream)) is not None:
        raw, fields = head
        gz, length, left = zlib.compressobj(6, zlib.DEFLATED, 31), 0, int(fields["content-length"])
        pieces = [raw]
        while pieces:
            for piece in pieces:
                length += out.write(gz.compress(piece))
            pieces = [stream.read(min(left, CHUNK))] if left else []
            if left and not pieces[0]:
                raise ValueError(f"{archive}: a record ends too early")
            left -= len(pieces[0]) if pieces else 0
        length += out.write(gz.compress(b"\r\n\r\n")) + out.write(gz.flush())
        yield {
            "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"),
            "digest": fields.get("warc-payload-digest"), "archive": archive, "offset": at, "length": length,
        }
        at += length


def normalise(archives: DataFrame, folder: str, target: str) -> DataFrame:
    """The archives of ``folder`` with one gzip member a record, in ``target``; returns ``archive, sidecar, n_records``, staged.

    Beside each archive lies its sidecar: a JSON line a record with its id, type, address, digest, offset and length. An archive is inflated once, as a
    stream, by one task; several streams or members in one file are read on. A file that breaks off is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, root), (to_fs, to) = _opened(folder), _opened(target)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                with fs.open_input_stream(f"{root}/{archive}", compression=None) as source, to_fs.open_output_stream(f"{to}/{name}", compression=None) as out, to_fs.open_output_stream(f"{to}/{name}.idx", compression=None) as sidecar:
                    for entry in split_members(source, out, name):
                        sidecar.write((json.dumps(entry) + "\n").encode())
                        n += 1
                yield pa.RecordBatch.from_pydict({"archive": [name], "sidecar": [f"{name}.idx"], "n_records": [n]})

    _make(archives.sparkSession, target)
    spread = archives.select("archive").repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "archive")
    return stage(spread.mapInArrow(run, "archive string, sidecar string, n_records bigint"), "normalised")


def read_index(normalised: DataFrame, folder: str) -> DataFrame:
    """The entries of the sidecars of ``normalised``: ``record_id, record_type, uri, digest, archive, offset, length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        names = ["record_id", "record_type", "uri", "digest", "archive", "offset", "length"]
        types = [pa.string()] * 5 + [pa.int64()] * 2
        for batch in batches:
            for sidecar in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{sidecar}") as f:
                    entries = [json.loads(line) for line in f.read().splitlines()]
                for at in range(0, len(entries), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array([e[n] for e in entries[at : at + 4096]], type=t) for n, t in zip(names, types, strict=True)], names=names)

    return normalised.select("sidecar").mapInArrow(run, INDEX)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``page_id, uri, payload, payload_bytes, payload_digest, record_type, refers_to, intact`` of the records that ``index`` points at, each read by its offset alone.

    ``page_id`` and ``refers_to`` are text. ``payload_bytes`` and ``payload_digest`` are of the full payload, of a revisit too, whose ``payload`` is null. ``intact``
    tells whether a response's payload has the length and the digest that its record states.
    """

    def one(raw: bytes) -> tuple:
        import io

        stream = io.BytesIO(gzip.decompress(raw))
        _, fields = _header(stream)
        block = stream.read(int(fields["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?mi)^content-length: *(\d+)", http)[1])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        told = lambda k: fields[k].strip("<>").removeprefix(_ID) or None if k in fields else None
        if fields["warc-type"] == "revisit":
            return told("warc-record-id"), fields.get("warc-target-uri"), None, size, digest, "revisit", told("warc-refers-to"), None
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return told("warc-record-id"), fields.get("warc-target-uri"), payload, size, digest, fields["warc-type"], None, len(payload) == size and own == digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        names = ["page_id", "uri", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
        types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        opened, f = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for at in range(0, len(rows), 256):
                out = []
                for archive, offset, length in rows[at : at + 256]:
                    if archive != opened:
                        opened, f = archive, fs.open_input_file(f"{root}/{archive}")
                    out.append(one(f.read_at(length, offset)))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    columns = "page_id string, uri string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string, intact boolean"
    return index.select("archive", "offset", "length").mapInArrow(run, columns)


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0, max_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as archives with a member a record into ``folder``; returns the staged list of archives and sidecars (see ``normalise``)."""
    raw = f"{shared_dir(pages.sparkSession)}/warc-raw-{uuid.uuid4().hex}"
    written = write_archives(with_types(pages, min_bytes), raw, max_bytes)
    listed = normalise(written, raw, folder)
    unstage(written)
    remove(pages.sparkSession, raw)
    return listed


def report(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` what its record says when the archives are read back: length and digest of the payload, type, and the response that a revisit refers to.

    Null html is an empty payload; a null url has no address; a null page_id stays null (see ``with_types``). Rows that repeat an id and a payload share one
    decision, and each has its record. Extra columns are ignored; an empty table gives an empty result. Archives stay in the shared folder until the application ends.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    got = read_records(read_index(archive_pages(pages, folder), folder), folder)
    kind = pages.schema["page_id"].dataType
    return got.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact")
