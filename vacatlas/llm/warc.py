"""WARC archives compressed with zstandard: one frame per record against a dictionary in the leading skippable frame.

Writing marks records of equal payloads as revisits of the first one; reading takes a whole archive of any writer that
follows the convention, decodes frame by frame and validates every header and length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import TAIL, bounded, read_files, record, write_files

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of frames in an archive; payloads, and bytes of each, that the dictionary is trained on; its size.
ARCHIVE_BYTES, SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 256, 1 << 14, 1 << 15
STEP = 1 << 16


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded number of payloads; it alters sizes, never contents."""
    rows = pages.where("html <> ''").select(F.left("html", F.lit(SAMPLE_BYTES)).alias("html")).limit(SAMPLE_PAGES).collect()
    samples = [r.html.encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or bytes(8))[:DICTIONARY_BYTES].ljust(8, b"\0")


def with_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, html, digest, first: ``first`` is the least page_id of equal payloads, where they are revisited.

    Digests are counted before anything is joined, and only those met again are joined; a payload that a third of
    all pages share is one row of that side.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = (
        rows.where(F.octet_length("html") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    return rows.join(firsts, "digest", "left")


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record. A revisit (``first`` is another page) holds the HTTP head only."""
    revisit = first is not None and page_id != first
    name = "null" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


FILE = pa.schema([("file", pa.binary())])


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """Write one record per row of ``pages`` (page_id, url, html).

    Of records with equal payloads of at least ``min_bytes`` the one with the least page_id is a response and the
    others, of any other id or none, are its revisits; rows that repeat that least id are all responses. If none of
    them has an id, and for smaller payloads, all are responses. A null html is an empty payload, a null url leaves
    its header out. An empty table gives no archive. Other columns are not read.
    """
    dictionary = train_dictionary(pages)
    lead = DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary

    def build(batches):
        tool = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True
        )
        frames, size = [], 0
        for batch in bounded(batches, "html"):
            columns = [batch.column(x).to_pylist() for x in ("page_id", "url", "html", "digest", "first")]
            for page_id, url, html, digest, first in zip(*columns, strict=True):
                frames.append(tool.compress(warc_record(page_id, url, html.encode(), digest, first)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield record(FILE, {"file": [lead + b"".join(frames) + TAIL]})
                    frames, size = [], 0
        if frames:
            yield record(FILE, {"file": [lead + b"".join(frames) + TAIL]})

    write_files(with_revisits(pages, min_bytes).mapInArrow(build, "file binary"), path)


def frames(data: bytes | memoryview) -> Iterator[tuple[int, bytes]]:
    """(place, decoded bytes) of each frame; the leading skippable frame is the dictionary, others are passed over."""
    data, place, tool = memoryview(data).cast("B"), 0, zstandard.ZstdDecompressor()
    while place < len(data):
        if len(data) - place < 8:
            raise ValueError(f"{len(data) - place} bytes after the last frame, at {place}")
        magic, size = int.from_bytes(data[place:place + 4], "little"), int.from_bytes(data[place + 4:place + 8], "little")
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            body = bytes(data[place + 8:place + 8 + size])
            if len(body) != size:
                raise ValueError(f"skippable frame cut short at {place}")
            if magic == DICTIONARY_MAGIC and not place:
                if body[:4] == FRAME_MAGIC:
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            place += 8 + size
            continue
        if data[place:place + 4] != FRAME_MAGIC:
            raise ValueError(f"no frame at {place}")
        one, out, at = tool.decompressobj(), [], place
        while not one.eof:
            if at >= len(data):
                raise ValueError(f"frame cut short at {place}")
            part = data[at:at + STEP]
            out.append(one.decompress(part))
            at += len(part)
        yield place, b"".join(out)
        place = at - len(one.unused_data)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, names in lower case, and block of a record; raises where they are not valid."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in VERSIONS:
        raise ValueError("no WARC head")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        key = name.decode("ascii").lower()
        if not colon or not name.strip() or key in headers and key != "warc-concurrent-to":
            raise ValueError(f"bad header {line[:80]!r}")
        headers[key] = value.decode().strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    length = headers["content-length"]
    if not length.isdecimal() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"content-length {length}, but the block has {len(rest) - 4} bytes")
    return headers, rest[:-4]


def _unchunked(body: bytes) -> bytes:
    """A body without its chunked transfer coding; raises where that is not whole."""
    out, place = [], 0
    while True:
        line, found, _ = body[place:place + 1024].partition(b"\r\n")
        number = line.partition(b";")[0].strip()
        if not found or not re.fullmatch(rb"[0-9A-Fa-f]+", number):
            raise ValueError(f"no chunk at {place} of the body")
        size, place = int(number, 16), place + len(line) + 2
        if not size:
            return b"".join(out)
        if body[place + size:place + size + 2] != b"\r\n":
            raise ValueError(f"chunk cut short at {place} of the body")
        out.append(body[place:place + size])
        place += size + 2


def digest_fits(stated: str, payload: bytes) -> bool:
    """Whether a stated digest is that of a payload, in hex or base 32; digests of other algorithms are taken as they are."""
    kind, _, value = stated.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    own = hashlib.new(kind, payload, usedforsecurity=False).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def http_payload(headers: dict[str, str], block: bytes) -> tuple[bytes, int | None]:
    """The payload a record holds, without transfer coding, and the full payload's length; checks length and digest.

    Of a revisit that is the length its HTTP head states, None where it states none.
    """
    kind, digest, name = headers["warc-type"], headers.get("warc-payload-digest"), headers["warc-record-id"]
    if kind == "revisit" and not block:
        head, found, body = b"HTTP/", b"", b""
    else:
        head, found, body = block.partition(b"\r\n\r\n")
        if not found or not head.startswith(b"HTTP/"):
            raise ValueError("no HTTP head")
    fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])]
    lengths = {v for k, v in fields if k == b"content-length"}
    if len(lengths) > 1 or not all(v.isdigit() for v in lengths):
        raise ValueError("no single length in the HTTP head")
    chunked = any(k == b"transfer-encoding" and b"chunked" in v.lower() for k, v in fields)
    size = int(next(iter(lengths))) if lengths and not chunked else None
    if kind == "revisit":
        if body or not digest or not ("warc-refers-to" in headers or "warc-refers-to-target-uri" in headers):
            raise ValueError(f"the revisit {name} has a body or lacks what it refers to")
        return b"", size
    if chunked and not headers.get("warc-truncated"):
        body = _unchunked(body)
    if headers.get("warc-truncated"):  # a payload cut by its crawler has neither its length nor its digest
        return body, len(body) if size is None else size
    if (size is not None and len(body) != size) or (digest and not digest_fits(digest, body)):
        raise ValueError(f"the payload of {name} does not fit its length or digest")
    return body, len(body)


READ = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()),
    ("payload", pa.binary()),
])
_PAGE = re.compile(r"<urn:page:(-?\d{1,19})>\Z")


def _page(name: str | None) -> int | None:
    """The page that a record id of this module's writer names; null for its null page, and for ids of others."""
    found = _PAGE.match(name or "")
    return int(found[1]) if found else None


def _is_http(headers: dict[str, str]) -> bool:
    kind = headers.get("content-type", "application/http").lower()
    return headers["warc-type"] in ("response", "revisit") and kind.startswith("application/http")


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every HTTP response and revisit of the archives in a folder; ``payload`` (of responses) only if asked for.

    Length and digest are of the full payload: the SHA-256 of what a response holds, and for revisits what their heads
    state, the length null where they state none, and the digest with its algorithm where that is not SHA-256. Records of
    other types, or of other protocols, are passed over. Records of other writers have a ``record_id``, but no page. Damage
    raises.
    """

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                out: dict = {name: [] for name in READ.names}
                for place, data in frames(content.as_buffer()):
                    try:
                        headers, block = parse_record(data)
                        if not _is_http(headers):
                            continue
                        body, size = http_payload(headers, block)
                    except ValueError as error:
                        raise ValueError(f"record at {place}: {error}") from error
                    stated = headers.get("warc-payload-digest", "")
                    whole = headers["warc-type"] == "response" and not stated.startswith("sha256:")
                    row = (
                        _page(headers["warc-record-id"]), size,
                        hashlib.sha256(body).hexdigest() if whole else stated.removeprefix("sha256:"),
                        headers["warc-type"], _page(headers.get("warc-refers-to")), headers.get("warc-target-uri"),
                        headers["warc-record-id"],
                        body if with_payload and headers["warc-type"] == "response" else None,
                    )
                    for name, value in zip(READ.names, row, strict=True):
                        out[name].append(value)
                    if len(out["page_id"]) >= 1024:
                        yield record(READ, out)
                        out = {name: [] for name in READ.names}
                yield record(READ, out)

    return read_files(spark, path).select("content").mapInArrow(
        read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "url string, record_id string, payload binary"
    )
