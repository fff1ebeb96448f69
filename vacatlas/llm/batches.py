"""Numbered batches of texts, and names that batches ask ranges of names about.

Counting names one row at a time costs a shuffle several times the text. Here a batch sends each distinct name once,
sorted, as packed gaps, to the range that its top bits choose; the range answers with one number per name in the order
asked, so answers need no names. A name that every text holds is one entry per batch, whatever its share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded


def numbered(batches, limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number, rows) of the batches of a partition; a number stands for the same rows whenever they are read again."""
    context, n = TaskContext.get(), 0
    for batch in bounded(batches, limit=limit):
        if batch.num_rows:
            yield (context.partitionId() << 32) + n, batch
            n += 1


def held(rows: DataFrame, limit: int) -> DataFrame:
    """(batch, data): each numbered batch as one compressed value."""

    def hold(batches):
        for number, batch in numbered(batches, limit):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            data = pa.array([out.getvalue().to_pybytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([number]), data], ["batch", "data"])

    return rows.mapInArrow(hold, "batch bigint, data binary")


def opened(table: pa.Table) -> tuple[int, pa.Table]:
    """The number and rows of a held batch."""
    return table.column("batch")[0].as_py(), pa.ipc.open_stream(table.column("data")[0].as_buffer()).read_all()


def ranges_for(rows: DataFrame, bytes_each: int, least: int = 8) -> int:
    """A power of two of ranges that grows with the bytes of text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, 1 << max(0, -(-size // bytes_each) - 1).bit_length())


def cuts(names: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """(range, its part) of ascending names, for ranges that have any."""
    edges = [np.searchsorted(names, np.uint64(r << (64 - ranges.bit_length() + 1))) for r in range(ranges)] + [len(names)]
    for r in range(ranges):
        if edges[r] < edges[r + 1]:
            yield r, slice(edges[r], edges[r + 1])


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_names(names: np.ndarray) -> bytes:
    """Ascending names as their gaps, byte planes apart, so that the high bytes compress away."""
    gaps = np.diff(names, prepend=np.uint64(0)).astype("<u8")
    return pack(gaps.view(np.uint8).reshape(-1, 8).T)


def unpack_names(data: bytes) -> np.ndarray:
    planes = unpack(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class Keys:
    """The distinct 64-bit or 128-bit keys of a batch in order, and where each of the given ones is."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None = None):
        order = np.argsort(first, kind="stable") if second is None else np.lexsort((second, first))
        one = first[order]
        new = np.ones(len(one), bool)
        new[1:] = one[1:] != one[:-1]
        if second is not None:
            new[1:] |= second[order][1:] != second[order][:-1]
        self.at = np.empty(len(one), np.int64)
        self.at[order] = np.cumsum(new) - 1
        self.first = one[new]
        self.second = None if second is None else second[order][new]
        self.counts = np.bincount(self.at, minlength=len(self.first))


ASK = "part bigint, batch bigint, first binary, second binary, many binary"
ASKED = pa.schema([
    ("part", pa.int64()), ("batch", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("many", pa.binary()),
])


def questions(number: int, kinds: list[Keys], ranges: int) -> pa.RecordBatch:
    """A row per kind and range of names; part is the kind's place times the ranges, plus the range."""
    out: list[tuple] = []
    for kind, keys in enumerate(kinds):
        for r, own in cuts(keys.first, ranges):
            second = None if keys.second is None else pack(keys.second[own])
            out.append((kind * ranges + r, number, pack_names(keys.first[own]), second, pack(np.packbits(keys.counts[own] > 1))))
    columns = zip(*out, strict=True) if out else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ASKED, strict=True)], schema=ASKED)


ANSWERED = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("flags", pa.binary())])


def _meet(table: pa.Table) -> pa.Table:
    """For each batch, of each key in its order: 1 if the key stands in more than one place, 2 if no earlier batch has it."""
    names = [unpack_names(x) for x in table.column("first").to_pylist()]
    sizes = [len(x) for x in names]
    many = np.concatenate([
        np.unpackbits(unpack(x, np.uint8), count=n) for x, n in zip(table.column("many").to_pylist(), sizes, strict=True)
    ])
    paired = table.column("second")[0].as_py() is not None
    second = np.concatenate([unpack(x, np.uint64) for x in table.column("second").to_pylist()]) if paired else None
    keys = Keys(np.concatenate(names), second)
    batches = table.column("batch").to_numpy()
    owner = np.repeat(batches, sizes)
    first = np.full(len(keys.first), np.iinfo(np.int64).max)
    np.minimum.at(first, keys.at, owner)
    places = keys.counts + np.bincount(keys.at, many, len(keys.first))
    flags = ((places > 1)[keys.at] + 2 * (first[keys.at] == owner)).astype(np.uint8)
    cut = np.cumsum([0, *sizes])
    data = [pack(flags[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    return pa.table([table.column("part"), table.column("batch"), pa.array(data, pa.binary())], schema=ANSWERED)


def answers(asked: DataFrame) -> DataFrame:
    return asked.groupBy("part").applyInArrow(_meet, "part bigint, batch bigint, flags binary")


def flags_of(table: pa.Table, kinds: list[tuple[int, Keys]], ranges: int) -> list[np.ndarray]:
    """The flags of each kind's keys, from all answers to a batch."""
    table = table.sort_by("part")
    parts, data, out = table.column("part").to_numpy(), table.column("flags").to_pylist(), []
    for kind, keys in kinds:
        own = [unpack(data[i], np.uint8) for i in np.flatnonzero(parts // ranges == kind)]
        flags = np.concatenate(own) if own else np.empty(0, np.uint8)
        if len(flags) != len(keys.first):
            raise RuntimeError("the texts were read in another order than before")
        out.append(flags)
    return out
