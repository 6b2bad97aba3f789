"""WARC archives: writing pages as transactions and assembling transactions from archives.

A page is written as three records: the response (or a revisit of an equal payload
written elsewhere), its request and its metadata; the last two name the first in
WARC-Concurrent-To. Archives are read back record by record, one task a file, and
the records of a transaction are joined through these identifiers into one nested
row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from testfloor.session import materialize, scratch_path, write_bytes

REVISIT_BYTES = 1000  # equal payloads of fewer bytes are written again
FILE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
MOST_TASKS = 20_000

# Names and values fixed by the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = {
    "request": "application/http; msgtype=request",
    "response": "application/http; msgtype=response",
    "revisit": "application/http; msgtype=response",
    "metadata": "application/warc-fields",
}
PRINCIPAL = ("response", "revisit", "resource")

RECORD = (
    "file string, offset long, type string, record_id string, concurrent_to array<string>, refers_to string, "
    "target_uri string, date string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>, error string"
)


def _record(kind: str, record_id: str, date: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{name}: {value}" for name, value in headers if value is not None]
    lines += [f"Content-Type: {TYPES[kind]}", f"Content-Length: {len(block)}", "", ""]
    return _member("\r\n".join(lines).encode() + block + b"\r\n\r\n")


def _member(data: bytes) -> bytes:
    """One gzip member; a record is one, so that it can be read from its offset."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _line(text: str | None) -> str | None:
    """A value that fits a header line: blanks at the ends and control characters as %XX."""
    if text is None or (text.isprintable() and text == text.strip()):
        return text
    return "".join(c if c.isprintable() and c != " " else quote(c) for c in text)


def _transaction(run: uuid.UUID, date: str, page_id, url: str | None, payload: bytes, digest: str, row: int, first: int | None) -> bytes:
    """The three records of a page; ``first`` is the row of the response that it revisits."""
    name = lambda kind, number: uuid.uuid5(run, f"{kind} {number}").urn
    capture, target = name("capture", row), _line(url)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    named = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is None:
        main = _record("response", capture, date, named, head + payload)
    else:
        seen = [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{name('capture', first)}>")]
        main = _record("revisit", capture, date, named + seen, head)
    try:
        parts = urlsplit(target or "")
        host, path = parts.netloc, quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._") + (f"?{parts.query}" if parts.query else "")
    except ValueError:  # not a URL: asked for as it stands
        host, path = "", quote(target or "/")
    linked = [("WARC-Target-URI", target), ("WARC-Concurrent-To", f"<{capture}>")]
    request = _record("request", name("request", row), date, linked, f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    about = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    return request + main + _record("metadata", name("metadata", row), date, linked, about)


def write(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as compressed archives; (file, size, captures) lists them.

    The payload is the html in UTF-8, empty if NULL. Of equal payloads of at least ``revisit_bytes`` bytes the one
    with the largest page_id is a response, the others are revisits that refer to it; a NULL page_id is smaller than any,
    and of repeated rows with that page_id one is the response. Every row is a capture, repeated ones too. Other columns
    are ignored. A NULL url leaves out the target. Files of lost or repeated tasks stay unlisted; no pages, no files.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # A row's number names its records, so it has to be written before they refer to each other.
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
    rank = F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63)))
    groups = rows.filter(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes")
    groups = groups.agg(F.max_by("row", rank).alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = materialize(groups.drop("n"), "payloads")  # which of equal rows is first is decided once
    decided = rows.join(groups, ["digest", "bytes"], "left")
    first = F.when(F.col("first") != F.col("row"), F.col("first"))
    decided = decided.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", "row", first.alias("first"))

    run, date = uuid.uuid4(), datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, captures = bytearray(), 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            write_bytes(uri, bytes(held))
            made = [pa.array([uri]), pa.array([len(held)], pa.int64()), pa.array([captures], pa.int64())]
            return pa.RecordBatch.from_arrays(made, names=["file", "size", "captures"])

        for batch in batches:
            for values in zip(*batch.columns):
                held += _transaction(run, date, *(v.as_py() for v in values))
                captures += 1
                if len(held) >= file_bytes:
                    yield close()
                    held, captures = bytearray(), 0
        if captures:
            yield close()

    return materialize(decided.mapInArrow(archive, "file string, size long, captures long"), "archives")


class _Archive:
    """The records of one archive, plain or compressed, read in order with bounded buffers."""

    def __init__(self, uri: str):
        known = "://" in uri or uri.startswith("file:")
        system, path = fs.FileSystem.from_uri(uri if known else f"file://{uri}")
        raw = io.BufferedReader(system.open_input_stream(path, compression=None), 1 << 20)
        self.source = gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
        self.at = 0

    def line(self) -> bytes:
        line = self.source.readline(1 << 20)
        self.at += len(line)
        return line

    def block(self, size: int) -> bytes:
        data = self.source.read(size)
        self.at += len(data)
        if len(data) < size:
            raise EOFError("the archive ends inside a record")
        return data

    def headers(self) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        while line := self.line():
            if line in (b"\r\n", b"\n"):
                return out
            text = line.decode(errors="replace").rstrip("\r\n")
            if text[:1] in " \t" and out:  # a folded line goes on
                out[-1] = out[-1][0], f"{out[-1][1]} {text.strip()}"
                continue
            name, colon, value = text.partition(":")
            if not colon:
                raise ValueError(f"not a header line: {text[:80]!r}")
            out.append((name.strip().lower(), value.strip()))
        raise EOFError("the archive ends inside a record's header")

    def records(self) -> Iterator[tuple[int, list[tuple[str, str]], bytes]]:
        while True:
            start, line = self.at, self.line()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("a record does not begin with WARC/")
            headers = self.headers()
            size = dict(headers).get("content-length", "")
            if not size.isdecimal():
                raise ValueError("a record without a Content-Length")
            yield start, headers, self.block(int(size))


def _bare(identifier: str | None) -> str | None:
    return None if identifier is None else identifier.strip().removeprefix("<").removesuffix(">")


def _hex_sha1(digest: str | None) -> str | None:
    """A labelled SHA-1 in hexadecimal or base 32 as bare lower-case hexadecimal, else NULL."""
    label, _, value = (digest or "").partition(":")
    if label.lower() != "sha1":
        return None
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError:
            return None
    return value.lower() if len(value) == 40 else None


def _fields(block: bytes) -> list[tuple[str, str]]:
    pairs = (line.partition(":") for line in block.decode(errors="replace").splitlines())
    return list({name.strip().lower(): value.strip() for name, colon, value in pairs if colon}.items())


def _row(file: str, offset: int, headers: list[tuple[str, str]], block: bytes, payloads: bool) -> dict:
    of = dict(headers)
    kind, content = of.get("warc-type", "").lower(), of.get("content-type", "").lower()
    payload, fields = block, []
    if content.startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = _fields(head.partition(b"\r\n")[2])
    elif content.startswith("application/warc-fields"):
        fields = _fields(block)
    full = kind != "revisit"  # a revisit leaves its payload out
    return {
        "file": file,
        "offset": offset,
        "type": kind,
        "record_id": _bare(of.get("warc-record-id")),
        "concurrent_to": [_bare(v) for n, v in headers if n == "warc-concurrent-to"],
        "refers_to": _bare(of.get("warc-refers-to")),
        "target_uri": of.get("warc-target-uri"),
        "date": of.get("warc-date"),
        "payload_digest": hashlib.sha1(payload).hexdigest() if full else _hex_sha1(of.get("warc-payload-digest")),
        "payload_bytes": len(payload) if full else None,
        "payload": payload if full and payloads else None,
        "fields": fields,
        "error": None,
    }


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in RECORD.split(", "))])


def read(files: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """All records of the archives in ``files`` (column file), one row each with its headers, fields and payload.

    The digest and size are computed from the bytes of the payload; a revisit has the digest of its header and no size.
    ``payloads`` False leaves the bytes themselves out. ``offset`` counts bytes as they are after decompression. A file
    that is damaged or cut off is an error, or without ``strict`` a row of type ``error`` after its whole records.
    Repeated files are read once, a NULL file gives nothing. A task reads a file in order and holds one record.
    """
    schema = _schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                archive = None
                try:
                    archive = _Archive(file)
                    for offset, headers, block in archive.records():
                        rows.append(_row(file, offset, headers, block, payloads))
                        held += 1000 + (len(block) if payloads else 0)
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                except (ValueError, EOFError, OSError, zlib.error) as error:
                    if strict:
                        raise ValueError(f"{file}: {error}") from error
                    rows.append({"file": file, "offset": archive.at if archive else 0, "type": "error", "error": str(error)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    listed = files.select("file").filter("file is not null").distinct()
    # A stated number, as a list of names looks too small to Spark to be worth many tasks.
    return listed.repartition(min(max(1, listed.count()), MOST_TASKS), "file").mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response, revisit or resource record with ``requests`` and ``metadata`` records.

    Records belong together where one names the other in WARC-Concurrent-To, whichever way. The columns of the main
    record stay; requests and metadata are arrays of structs ordered by record id, empty where there are none. Records
    of other types, and requests and metadata that lead to no capture, are left out; a main record without an id stands
    alone. Main records that repeat an id (an archive read twice) are rows of their own, other repeats count once.
    ``records`` is read several times, so it should be a table and not the reading of archives itself.
    """
    linked = ("record_id", "target_uri", "date", "fields", "payload_digest", "payload_bytes")
    main = records.filter(F.col("type").isin(*PRINCIPAL))
    others = records.filter(F.col("type").isin("request", "metadata") & F.col("record_id").isNotNull())
    there = others.select(F.col("record_id").alias("other_id"), F.explode("concurrent_to").alias("capture_id"))
    back = main.select(F.explode("concurrent_to").alias("other_id"), F.col("record_id").alias("capture_id"))
    links = there.union(back).filter("capture_id is not null and other_id is not null").distinct()
    held = others.select(F.col("record_id").alias("other_id"), "type", F.struct(*linked).alias("record")).dropDuplicates(["other_id"])
    found = links.join(held, "other_id").groupBy(F.col("capture_id").alias("record_id"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("record"))), lambda a, b: (
        F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    ))
    found = found.agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    none = lambda c: F.coalesce(F.col(c), F.array().cast(found.schema[c].dataType))
    whole = main.drop("error").join(found, "record_id", "left")
    return whole.select(*[c for c in main.columns if c != "error"], none("requests").alias("requests"), none("metadata").alias("metadata"))


def resolve(assembled: DataFrame) -> DataFrame:
    """``assembled`` captures with ``first``: the (record_id, payload_bytes, payload_digest, metadata) a revisit refers to.

    NULL for other records and where the referred record is not there. Of several records with that id any one counts.
    """
    target = assembled.filter("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.struct("record_id", "payload_bytes", "payload_digest", "metadata").alias("first")
    )
    # Most captures refer to nothing: joined as well, they would all be rows of one key.
    referring = assembled.filter("refers_to is not null").join(target.dropDuplicates(["refers_to"]), "refers_to", "left")
    others = assembled.filter("refers_to is null").withColumn("first", F.lit(None).cast(target.schema["first"].dataType))
    return referring.select(*assembled.columns, "first").union(others)
