"""Weights of all terms of all texts, without a row per text and term in a shuffle.

Texts are dealt in parts by their keys, so that texts of one key are together. A part asks for each of its distinct terms
once, packed by ranges of the terms' hashes; a range adds up the texts of all parts and answers with numbers in the order
asked. The parts, whose texts are read again from the same shuffle, weigh their terms by the answers.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package


class Counts:
    """Terms of a part: ``terms`` in the order of hash and term, and (row of the key, term, n) of each key and term."""

    def __init__(self, keys: pa.ChunkedArray, lists: pa.ChunkedArray):
        keys = _whole(keys).dictionary_encode(null_encoding="encode")
        lists = _whole(lists)
        lengths = np.diff(lists.offsets.to_numpy())
        found = lists.flatten().dictionary_encode()
        place, self.hashes, self.terms = _in_order(found.dictionary)
        owner = np.repeat(keys.indices.to_numpy().astype(np.int64), lengths)
        size = max(1, len(self.terms))
        pairs, self.n = np.unique(owner * size + place[found.indices.to_numpy()], return_counts=True)
        self.owner, self.term = np.divmod(pairs, size)
        self.keys = keys.dictionary

    def rows(self) -> np.ndarray:
        """Keys that have a term, for each term."""
        return np.bincount(self.term, minlength=len(self.terms)).astype(np.int32)

    def ranges(self, many: int) -> list[tuple[int, int, int]]:
        """(range, first, end) of the terms of each range that has some."""
        own = range_of(self.hashes, many)
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []
        return [(int(own[a]), a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pa.concat_arrays([column]) if column.offset else column


def range_of(hashes: np.ndarray, many: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(many)) >> np.uint64(32)


def _in_order(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each term stands in the order of hash and term, the hashes in order, and the terms in order."""
    values = terms.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    if (sorted_[1:] == sorted_[:-1]).any():  # the order must not depend on that of the rows
        order = np.lexsort((values.astype(str), hashes))
        sorted_ = hashes[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, sorted_, terms.take(pa.array(order))


def pack(terms: pa.Array, rows: np.ndarray) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.concat_arrays([terms]), pa.array(rows, pa.int32())], ["term", "rows"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes | pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


ASKED = "part int, range int, asked binary"
ANSWERED = "part int, range int, rows binary"


def ask(table: pa.Table, many: int) -> pa.Table:
    """Distinct terms of a part (part, key, _terms), and how many of its keys have each, for every range."""
    counts = Counts(table["key"], table["_terms"])
    rows, cells = counts.rows(), counts.ranges(many)
    part = table["part"][0].as_py()
    return pa.table({
        "part": pa.array([part] * len(cells), pa.int32()), "range": pa.array([r for r, _, _ in cells], pa.int32()),
        "asked": pa.array([pack(counts.terms.slice(a, b - a), rows[a:b]) for _, a, b in cells], pa.binary()),
    })


def answer(table: pa.Table) -> pa.Table:
    """Keys of all parts that have each of the terms asked for, in the order asked."""
    cells = [unpack(cell.as_buffer()) for cell in table["asked"]]
    codes = pa.concat_arrays([cell.column("term") for cell in cells]).dictionary_encode().indices.to_numpy()
    rows = np.concatenate([cell.column("rows").to_numpy() for cell in cells])
    total = np.bincount(codes, weights=rows).astype(np.int64)[codes]
    ends = np.cumsum([cell.num_rows for cell in cells])
    found = [part.tobytes() for part in np.split(total, ends[:-1])]
    return pa.table({"part": table["part"], "range": table["range"], "rows": pa.array(found, pa.binary())})


def weigh(table: pa.Table, answers: pa.Table, rows: int) -> pa.Table:
    """(key, term, n, idf, weight) of a part by the answers to what it asked."""
    if not len(table):
        raise ValueError("answers without a part")
    counts = Counts(table["key"], table["_terms"])
    by_range = sorted(zip(answers["range"].to_pylist(), answers["rows"], strict=True), key=lambda cell: cell[0])
    met = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(cell.as_buffer(), np.int64) for _, cell in by_range)])
    if len(met) != len(counts.terms):
        raise ValueError("a part has other terms than it asked for")
    idf = (np.log((1 + rows) / (1 + met)) + 1)[counts.term]
    raw = counts.n * idf
    length = np.sqrt(np.bincount(counts.owner, weights=raw * raw, minlength=len(counts.keys)))
    return pa.table({
        "key": counts.keys.take(pa.array(counts.owner)), "term": counts.terms.take(pa.array(counts.term)),
        "n": pa.array(counts.n.astype(np.int64)), "idf": pa.array(idf), "weight": pa.array(raw / length[counts.owner]),
    })
