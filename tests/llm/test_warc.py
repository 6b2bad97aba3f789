import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from testfloor.llm import warc

PAGES = "page_id long, url string, html string"


def read_back(spark, pages, **options):
    files = warc.write(spark.createDataFrame(pages, PAGES).selectExpr("*", "7 as row", "'x' as digest"), **options)
    rows = warc.resolve(warc.captures(warc.read(files))).collect()
    page = lambda records: records[0].fields.get("page-id")
    out = []
    for r in rows:
        payload_bytes = r.payload_bytes if r.type == "response" else r.first.payload_bytes
        out.append((page(r.metadata), r.target_uri, r.type, payload_bytes, r.payload_digest, r.payload, r.first and page(r.first.metadata)))
        assert len(r.requests) == len(r.metadata) == 1 and r.requests[0].record_id != r.record_id
    return files, out


def expected(pages, least=1000):
    out, taken = [], set()
    data = lambda html: (html or "").encode()
    number = lambda i: -(1 << 63) if i is None else i
    for page_id, url, html in pages:
        payload = data(html)
        same = [number(i) for i, _, h in pages if data(h) == payload]
        main = len(payload) < least or number(page_id) == max(same) and payload not in taken
        if main and len(payload) >= least:
            taken.add(payload)
        first = None if main or max(same) == -(1 << 63) else str(max(same))
        digest = hashlib.sha1(payload).hexdigest()
        out.append((None if page_id is None else str(page_id), url, "response" if main else "revisit", len(payload), digest, payload if main else None, first))
    return out


def test_round_trip(spark):
    long, tricky = "ä€𝄞" * 400, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30
    pages = [(i, f"http://h{i}.example/p?q={i}", f"<p>{i % 7}</p>" * (i * 20)) for i in range(40)]
    pages += [(100 + i, "http://h/é x", long) for i in range(5)] + [(200, "http://h/", tricky), (201, None, tricky)]
    pages += [(300, "", "x" * 999), (301, "no url", "x" * 999), (302, "http://[bad/", "x" * 1000), (303, "http://a/b", "x" * 1000)]
    pages += [(400, "u", ""), (401, "u", None), (402, "u", "\r\n\r\n"), (403, "u", "y" * 3_000_000)]
    pages += [(500, "u", "z" * 2000)] * 3 + [(None, "u", "z" * 2000), (None, "v", "n" * 1500), (None, "v", "n" * 1500)]
    files, rows = read_back(spark, pages, file_bytes=20_000)
    assert sorted(rows, key=repr) == sorted(expected(pages), key=repr)
    assert files.count() > 3 and files.agg(F.sum("captures")).first()[0] == len(pages)
    for r in files.collect():  # every file is a row of gzip members and begins with a record
        assert gzip.open(r.file.removeprefix("file:")).read().startswith(b"WARC/1.1\r\n")


def test_header_lines_stay_lines(spark):
    _, rows = read_back(spark, [(1, "http://h/a\r\nWARC-Type: x", "p"), (2, " http://h/ b ", "q")])
    assert {r[1] for r in rows} == {"http://h/a%0D%0AWARC-Type:%20x", "%20http://h/%20b%20"}


def test_empty(spark):
    files, rows = read_back(spark, [])
    assert rows == [] and files.count() == 0


def record(kind, record_id, block, *headers, content="application/http"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *headers, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Links from the response to the request, several links, folded headers, base 32, plain files."""
    html = b"HTTP/1.1 200 OK\r\nX-A: 1\r\n\r\nbody"
    digest = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    data = record("warcinfo", "i", b"a: b\r\n", content="application/warc-fields")
    data += record("request", "q", b"GET / HTTP/1.1\r\n\r\n") + record("response", "r", html, "WARC-Concurrent-To: <q>", "WARC-Concurrent-To:\r\n <m1>")
    data += record("metadata", "m1", b"n: 1\r\n", content="application/warc-fields")
    data += record("metadata", "m2", b"n: 2\r\nno field\r\n", "WARC-Concurrent-To: <r>", content="application/warc-fields")
    data += record("metadata", "lost", b"n: 3\r\n", "WARC-Concurrent-To: <nowhere>", content="application/warc-fields")
    data += record("revisit", "v", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <r>", f"WARC-Payload-Digest: sha1:{digest}")
    data += record("revisit", "w", b"", "WARC-Refers-To: <gone>") + record("resource", "s", b"raw", content="text/plain")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data[: len(data) // 3]) + gzip.compress(data[len(data) // 3 :]))
    for name in ("a.warc", "b.warc.gz"):
        files = spark.createDataFrame([(str(tmp_path / name),), (str(tmp_path / name),), (None,)], "file string")
        rows = {r.record_id: r for r in warc.resolve(warc.captures(warc.read(files))).collect()}
        assert sorted(rows) == ["r", "s", "v", "w"]
        r = rows["r"]
        assert bytes(r.payload) == b"body" and r.fields == {"x-a": "1"} and [q.record_id for q in r.requests] == ["q"]
        assert [m.fields["n"] for m in r.metadata] == ["1", "2"]
        assert rows["v"].payload_digest == hashlib.sha1(b"body").hexdigest() == rows["v"]["first"].payload_digest
        assert rows["w"]["first"] is None and rows["w"].payload_digest is None and rows["s"].requests == []


@pytest.mark.parametrize("name", ["cut.warc", "cut.warc.gz", "junk.warc", "none.warc"])
def test_damaged_archives_are_told(spark, tmp_path, name):
    whole = record("response", "a", b"HTTP/1.1 200 OK\r\n\r\nx" * 50)
    data = {"cut.warc": whole + whole[:-30], "cut.warc.gz": gzip.compress(whole) + gzip.compress(whole * 40)[:-30], "junk.warc": whole + b"junk\r\n"}
    if name in data:
        (tmp_path / name).write_bytes(data[name])
    files = spark.createDataFrame([(str(tmp_path / name),)], "file string")
    with pytest.raises(Exception, match=name):
        warc.read(files).collect()
    rows = warc.read(files, strict=False).collect()
    assert rows[-1].type == "error" and rows[-1].error and all(r.type == "response" for r in rows[:-1])
    assert (len(rows) > 1) == (name != "none.warc")
