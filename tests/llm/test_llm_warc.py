import base64
import gzip
import hashlib

import pytest
import zstandard

from vacatlas.llm import common, warc

BIG = "<p>" + "é" * 200 + "</p>"


def pages(spark):
    rows = [
        (3, "http://a/\r\nX: y", BIG, "c"), (1, None, BIG, "c"), (2, "http://b", "x", None), (4, "http://c", "x", "c"),
        (5, "http://d", None, "c"), (None, "http://e", BIG, "c"), (1, "http://f", BIG, "c"), (6, "http://g", "", "c"),
        (None, "http://h", "only " * 50, "c"), (None, "http://i", "only " * 50, "c"), (7, "http://j", "long \n" * 100_000, "c"),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string")


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark), path, archive_bytes=200)
    assert spark.read.format("binaryFile").load(path).count() > 1
    found = warc.read_archives(spark, path, with_payload=True).collect()
    assert len(found) == 11
    for r in found:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in found)
    assert kinds == [
        (0, "response", 0), (0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "response", 0),
        (3, "revisit", 1), (4, "response", 0), (5, "response", 0), (6, "response", 0), (7, "response", 0),
    ]
    big = hashlib.sha256(BIG.encode()).hexdigest()
    assert all(r.payload_bytes == len(BIG.encode()) for r in found if r.payload_digest == big)
    assert [r.url for r in found if r.page_id == 3] == ["http://a/%0D%0AX: y"]


def test_empty_table(spark, tmp_path):
    warc.write_archives(pages(spark).limit(0), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def archive(records, dictionary=b"d" * 100, pack=False):
    body = zstandard.ZstdCompressor().compress(dictionary) if pack else dictionary
    lead = warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
    tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    return lead + b"".join(tool.compress(x) for x in records)


RECORD = warc.warc_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)


def test_archives_of_others():
    assert [x for _, x in warc.frames(archive([RECORD, b"two" * 100_000], pack=True))] == [RECORD, b"two" * 100_000]
    assert [x for _, x in warc.frames(zstandard.compress(RECORD))] == [RECORD]  # without a dictionary
    assert list(warc.frames(b"")) == []


def test_damage_raises():
    data = archive([RECORD, RECORD])
    for bad in (data[:-3], data + b"xx", data[:60], gzip.compress(RECORD), data[:-8] + b"\0" * 8):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(bad))


@pytest.mark.parametrize("old, new", [
    (b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Date", b"WARC-Fate"),
    (b"\r\n\r\n", b"\r\n \r\n"), (b"WARC-Type:", b"WARC-Type"),
])
def test_bad_heads_raise(old, new):
    with pytest.raises(ValueError):
        warc.parse_record(RECORD.replace(old, new, 1))


def test_payload_is_checked():
    headers, block = warc.parse_record(RECORD)
    assert warc.http_payload(headers, block) == (b"payload", 7)
    for bad in (block[:-1], block.replace(b"payload", b"pAyload"), b"no head"):
        with pytest.raises(ValueError):
            warc.http_payload(headers, bad)


def foreign(kind, block, **headers):
    """A record as another writer may write it."""
    own = {"WARC-Record-ID": "<urn:uuid:6d058047-ede2-4a13-be79-90c17c631dd4>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in (own | {k.replace("_", "-"): v for k, v in headers.items()}).items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def test_whole_archives_of_other_writers(spark, tmp_path):
    http = "application/http;msgtype=response"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    records = [
        foreign("warcinfo", b"software: other\r\n", Content_Type="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http;msgtype=request"),
        foreign("response", b"HTTP/1.1 200 OK\r\n\r\nhello", Content_Type=http, WARC_Payload_Digest=sha1, WARC_Target_URI="u1"),
        foreign("response", b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n3\r\nhel\r\n2;x=1\r\nlo\r\n0\r\n\r\n", Content_Type=http, WARC_Payload_Digest=sha1),
        foreign("response", b"20240101 1.2.3.4", Content_Type="text/dns", WARC_Target_URI="dns:host"),
        foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 900\r\n\r\nhel", Content_Type=http, WARC_Truncated="length", WARC_Payload_Digest=sha1),
        foreign("revisit", b"", WARC_Payload_Digest=sha1, WARC_Refers_To_Target_URI="u1"),
        foreign("metadata", b"fetchTimeMs: 3\r\n"), RECORD,
    ]
    path = str(tmp_path / "w")
    files = spark.createDataFrame([(bytearray(archive(records) + warc.TAIL),)], "file binary")
    common.write_files(files, path)
    found = warc.read_archives(spark, path, with_payload=True).collect()
    hello = hashlib.sha256(b"hello").hexdigest()
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, bytes(r.payload or b"")) for r in found] == [
        (None, 5, hello, "response", b"hello"), (None, 5, hello, "response", b"hello"),
        (None, 900, hashlib.sha256(b"hel").hexdigest(), "response", b"hel"), (None, None, sha1, "revisit", b""),
        (1, 7, hashlib.sha256(b"payload").hexdigest(), "response", b"payload"),
    ]
    assert found[0].url == "u1" and found[0].record_id.startswith("<urn:uuid:")


@pytest.mark.parametrize("block", [
    b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n9\r\nhello\r\n0\r\n\r\n",
    b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\nhello", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\nContent-Length: 6\r\n\r\nhello",
    b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\nhello", b"HTTP/1.1 200 OK\r\n\r\nhellO",
])
def test_bad_bodies_of_others_raise(block):
    digest = "sha1:" + hashlib.sha1(b"hello").hexdigest()
    headers, own = warc.parse_record(foreign("response", block, WARC_Payload_Digest=digest))
    with pytest.raises(ValueError):
        warc.http_payload(headers, own)
