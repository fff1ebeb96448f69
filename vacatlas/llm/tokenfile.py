"""Token-id files: one zstandard frame per document against a shared dictionary, with an index for single documents.

A file holds, in order: a head of 64 bytes (magic, range, part, documents, ids, SHA-256 of the dictionary), the
frames, the index (ids of documents, null flags, frame ends, counts), and a foot (place of the index, magic). One
document is read with the foot, the index and its own frame. The dictionary is a file beside the data.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import TAIL, bounded, crc, read_files, record, texts, write_files
from .tokens import encode_ids

HEAD, FOOT, HEAD_BYTES, FOOT_BYTES = "<8sIIQQ32s", "<Q8s", 64, 16
MAGIC, END = b"VTOK0001", b"VTOKEND1"
#: Pieces that a worker keeps with their ids; writing files leaves the memory for it.
MOST_PIECES = 800_000
#: Bytes of frames in a file, documents in a range, ranges at most, and documents and bytes of text the dictionary is
#: trained on. The dictionary alters sizes, never contents.
FILE_BYTES, RANGE_DOCS, RANGES, SAMPLE_DOCS, SAMPLE_BYTES = 16 << 20, 2048, 100_000, 512, 1 << 14


def _serial(ids: bytes) -> bytes:
    """Ids as 16 bits where all fit, else as 32 bits, behind a byte that says which."""
    values = np.frombuffer(ids, "<u4")
    return b"\2" + values.astype("<u2").tobytes() if not len(values) or values.max() < 1 << 16 else b"\4" + ids


def _ids(serial: bytes) -> bytes:
    return serial[1:] if serial[:1] == b"\4" else np.frombuffer(serial[1:], "<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, size: int = 1 << 15) -> bytes:
    """A dictionary from the id arrays of a bounded number of documents; few samples give plain shared content."""
    rows = docs.where("text <> ''").select(F.left("text", F.lit(SAMPLE_BYTES)).alias("text")).limit(SAMPLE_DOCS).collect()
    samples = [_serial(ids) for ids in encode_ids(tokenizer, [r.text for r in rows])]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or bytes(8))[:size].ljust(8, b"\0")


def _bounds(docs: DataFrame) -> list[int]:
    ranges = min(RANGES, docs.count() // RANGE_DOCS + 1)
    if ranges == 1:
        return []
    steps = [i / ranges for i in range(1, ranges)]
    return sorted(set(docs.select(F.percentile_approx("id", steps, 100 * ranges)).first()[0] or []))


def build_file(bucket: int, part: int, key: bytes, rows: list[tuple[int | None, int, bytes]]) -> bytes:
    """rows: id, number of ids, frame; in order."""
    frames = b"".join(r[2] for r in rows)
    head = struct.pack(HEAD, MAGIC, bucket, part, len(rows), sum(r[1] for r in rows), key)
    index = (
        np.array([r[0] or 0 for r in rows], "<i8").tobytes() + np.array([r[0] is None for r in rows], "u1").tobytes()
        + np.cumsum([len(r[2]) for r in rows]).astype("<u8").tobytes() + np.array([r[1] for r in rows], "<u8").tobytes()
    )
    return head + frames + index + struct.pack(FOOT, len(head) + len(frames), END) + TAIL


class TokenFile:
    """A file's documents by place; frames are decoded only when asked for."""

    def __init__(self, data: bytes, dictionary: bytes):
        data = memoryview(data)
        magic, self.bucket, self.part, n, self.total, key = struct.unpack_from(HEAD, data, 0)
        place, end = struct.unpack_from(FOOT, data, len(data) - FOOT_BYTES - len(TAIL) - 1)
        if magic != MAGIC or end != END or len(data) != place + 25 * n + FOOT_BYTES + len(TAIL) + 1:
            raise ValueError("not a whole token file")
        if key != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        cut = np.cumsum([place, 8 * n, n, 8 * n, 8 * n])
        null = np.frombuffer(data[cut[1]:cut[2]], "u1")
        self.ids = [None if x else i for i, x in zip(np.frombuffer(data[cut[0]:cut[1]], "<i8").tolist(), null, strict=True)]
        self.ends = np.concatenate([[0], np.frombuffer(data[cut[2]:cut[3]], "<u8")]).astype(np.int64) + HEAD_BYTES
        self.counts = np.frombuffer(data[cut[3]:cut[4]], "<u8").astype(np.int64)
        if self.ends[-1] != place or self.counts.sum() != self.total:
            raise ValueError("the index does not fit the frames")
        self.data, self.tool = data, zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def tokens(self, i: int) -> bytes:
        """Ids of document ``i`` as little-endian unsigned 32-bit integers."""
        out = _ids(self.tool.decompress(self.data[self.ends[i]:self.ends[i + 1]]))
        if len(out) != 4 * self.counts[i]:
            raise ValueError(f"document {self.ids[i]} has {len(out) // 4} ids, its index says {self.counts[i]}")
        return out


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, file_bytes: int = FILE_BYTES,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, in ascending order of id, nulls first.

    Texts are encoded where they are read; only compressed frames move to their range of ids. Null and empty texts
    hold the end id alone; rows of one id keep the order of their contents; an empty table gives no data file. Other
    columns are not read.
    """
    spark, docs = docs.sparkSession, texts(docs, id_col, text_col)
    dictionary = train_dictionary(docs, tokenizer)
    key, bounds = hashlib.sha256(dictionary).digest(), np.array(_bounds(docs), np.int64)
    write_files(spark.createDataFrame([(bytearray(dictionary),)], "file binary"), f"{path}/dictionary")
    schema = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("frame", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        tool = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True,
        )
        for batch in bounded(batches):
            ids = [x + end for x in encode_ids(tokenizer, batch.column("text"), MOST_PIECES)]
            known = np.asarray(batch.column("id").fill_null(np.iinfo(np.int64).min))
            yield record(schema, {
                "bucket": np.searchsorted(bounds, known, "left").astype(np.int32), "id": batch.column("id"),
                "n": [len(x) // 4 for x in ids], "frame": [tool.compress(_serial(x)) for x in ids],
            })

    def build(batches):
        bucket, part, rows, size = None, 0, [], 0
        for batch in batches:
            for b, i, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (b != bucket or size + len(frame) > file_bytes):
                    yield record(FILE, {"file": [build_file(bucket, part, key, rows)]})
                    part, rows, size = part + 1 if b == bucket else 0, [], 0
                bucket = b
                rows.append((i, n, frame))
                size += len(frame)
        if rows:
            yield record(FILE, {"file": [build_file(bucket, part, key, rows)]})

    frames = docs.mapInArrow(encode, "bucket int, id bigint, n bigint, frame binary")
    frames = frames.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "id", "n", "frame")
    write_files(frames.mapInArrow(build, "file binary"), f"{path}/data")


FILE = pa.schema([("file", pa.binary())])
READ = pa.schema([
    ("bucket", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()),
    ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()),
])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document in the files; ``ids`` null unless asked for.

    ``start`` counts the ids of all documents before it: those of earlier files, which their heads tell, and those
    before it in its own file. A damaged file or another dictionary raises.
    """
    dictionary = bytes(read_files(spark, f"{path}/dictionary").first().content)[:-1]
    files = read_files(spark, f"{path}/data")

    def decode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                file = TokenFile(content.as_buffer(), dictionary)
                starts = np.cumsum(file.counts) - file.counts
                for a in range(0, len(file.ids), 512):
                    own = range(a, min(a + 512, len(file.ids)))
                    ids = [file.tokens(i) for i in own]
                    yield record(READ, {
                        "bucket": [file.bucket] * len(own), "part": [file.part] * len(own),
                        "doc_id": file.ids[own.start:own.stop], "local": starts[own.start:own.stop],
                        "n_tokens": file.counts[own.start:own.stop], "ids_crc32": [crc(x) for x in ids],
                        "ids": ids if with_ids else [None] * len(own),
                    })

    def head(batches):
        for batch in batches:
            heads = [struct.unpack(HEAD, x.as_py()) for x in batch.column("head")]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in heads], pa.int64()) for i in (1, 2, 4)], ["bucket", "part", "total"])

    heads = files.select(F.substring("content", 1, HEAD_BYTES).alias("head")).mapInArrow(head, "bucket bigint, part bigint, total bigint")
    before = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = heads.select("bucket", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    docs = files.select("content").mapInArrow(
        decode, "bucket bigint, part bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    )
    return docs.join(starts, ["bucket", "part"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )
