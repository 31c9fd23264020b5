"""WARC records of other writers beside this library's own."""

from __future__ import annotations

import base64
import hashlib

import pytest
import zstandard

from factloom.llm import warc

BODY = b"<html>" + b"a page " * 40 + b"</html>"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def record(kind, block, *headers, version=b"WARC/1.0"):
    lines = [version, b"WARC-Type: " + kind, b"WARC-Date: 2024-01-02T03:04:05Z", *headers, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def base32(data):
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


UUID = b"<urn:uuid:6f1fe2f7-0e1a-4b6b-8f0f-0123456789ab>"
STANDARD = [
    record(b"warcinfo", b"software: x\r\nformat: WARC File Format 1.0\r\n", b"WARC-Record-ID: " + UUID, b"Content-Type: application/warc-fields"),
    record(b"request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", b"WARC-Record-ID: <urn:uuid:2>", b"Content-Type: application/http; msgtype=request", b"WARC-Target-URI: http://x/"),
    record(b"response", HTTP + BODY, b"WARC-Record-ID: <urn:uuid:3>", b"Content-Type: application/http; msgtype=response", b"WARC-Target-URI: http://x/", b"WARC-Payload-Digest: " + base32(BODY), b"WARC-Block-Digest: " + base32(HTTP + BODY)),
    record(b"metadata", b"fetchTimeMs: 5\r\n", b"WARC-Record-ID: <urn:uuid:4>", b"X-Long: one", b"  two"),
    record(b"revisit", HTTP, b"WARC-Record-ID: <urn:uuid:5>", b"WARC-Refers-To: <urn:uuid:3>", b"WARC-Payload-Digest: " + base32(BODY), b"Content-Type: application/http"),
    record(b"resource", BODY, b"WARC-Record-ID: <urn:uuid:6>", b"WARC-Payload-Digest: SHA-256:" + hashlib.sha256(BODY).hexdigest().upper().encode(), version=b"WARC/1.1"),
    record(b"response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n", b"WARC-Record-ID: <urn:uuid:7>", b"Content-Type: application/http", b"WARC-Payload-Digest: " + base32(b"abc")),
    record(b"conversion", b"text", b"WARC-Record-ID: <urn:uuid:8>", b"WARC-Payload-Digest: blake3:0abc"),
]
BAD = [record(b"resource", BODY, b"WARC-Payload-Digest: " + base32(b"other")), record(b"resource", BODY, b"WARC-Block-Digest: md5:" + b"0" * 32), record(b"new", b""), b"junk"]


def test_standard_records():
    info, request, response, metadata, revisit, resource, chunked, conversion = map(warc.read_record, STANDARD)
    assert (info["record_type"], info["record_id"], info["page_id"], info["date"]) == ("warcinfo", UUID.decode(), None, "2024-01-02T03:04:05Z")
    assert (request["url"], request["payload"]) == ("http://x/", b"")
    assert (response["payload"], response["payload_bytes"], response["payload_digest"]) == (BODY, len(BODY), base32(BODY).decode())
    assert metadata["payload"] == b"fetchTimeMs: 5\r\n"
    assert (revisit["refers_to"], revisit["refers_to_id"], revisit["payload_bytes"]) == (None, "<urn:uuid:3>", None)
    assert resource["payload_digest"] == hashlib.sha256(BODY).hexdigest()
    assert chunked["payload_digest"] == base32(b"abc").decode() and conversion["payload_digest"] == "blake3:0abc"


@pytest.mark.parametrize("bad", BAD)
def test_bad_ones_stop_a_strict_reader(bad):
    with pytest.raises(warc.BadRecord):
        warc.read_record(bad)


def test_files_of_mixed_records(spark, tmp_path):
    """Foreign and own records in one file, with a skippable frame between; bad ones are rows, and a broken frame ends its file alone."""
    pack = zstandard.ZstdCompressor().compress
    own = warc.write_record("response", 7, "u", hashlib.sha256(BODY).hexdigest(), len(BODY), None, BODY)
    whole = b"".join(map(pack, STANDARD)) + (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"12345" + b"".join(map(pack, [*BAD, own]))
    (tmp_path / "a.warc.zst").write_bytes(whole)
    (tmp_path / "b.warc.zst").write_bytes(pack(own) + pack(STANDARD[0])[:-5])
    rows = warc.read_files(spark, str(tmp_path), strict=False).collect()
    assert sum(r.error is not None for r in rows) == len(BAD) + 1 and all(r.record_type is None for r in rows if r.error)
    assert sum(r.error is None for r in rows) == len(STANDARD) + 2
    assert [(r.page_id, bytes(r.payload), r.payload_digest) for r in rows if r.page_id is not None] == [(7, BODY, hashlib.sha256(BODY).hexdigest())] * 2
    with pytest.raises(Exception, match="digest differ"):
        warc.read_files(spark, str(tmp_path)).collect()
