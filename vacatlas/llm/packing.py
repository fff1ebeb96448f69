"""Packing of documents into sequences by first-fit decreasing, in randomised groups of pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, crc, record, stored, texts
from .tokens import encode_ids

#: Pieces a group holds on average; one group is packed in one task.
GROUP_PIECES = 4096
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
])


class Tournament:
    """Room of each bin at the leaves, the most room of two below at every inner node."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Put ``size`` into the leftmost bin with room for it; its number. The root must have the room."""
        node, room = 1, self.room
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        found = node - self.leaves
        room[node] -= size
        while node > 1:
            node >>= 1
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each piece; equal lengths go in the order given."""
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int(np.searchsorted(-lengths[order], -capacity, "right"))
    bins[order[:full]], places[order[:full]] = np.arange(full), 0
    tree, used = Tournament(max(1, len(lengths) - full), capacity), [0] * max(1, len(lengths) - full)
    for i, size in zip(order[full:].tolist(), lengths[order[full:]].tolist(), strict=True):
        found = tree.first_fit(size)
        bins[i], places[i] = full + found, used[found]
        used[found] += size
    return bins, places


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document's ids with the end id, cut every ``capacity`` ids; only lengths and checksums leave the task."""

    def cut(batches):
        for batch in bounded(batches):
            out: dict = {name: [] for name in PIECES.names}
            ends = np.array([end_id], "<u4").tobytes()
            keys, rows = batch.column("id").to_pylist(), batch.column("row").to_pylist()
            for key, row, ids in zip(keys, rows, encode_ids(tokenizer, batch.column("text")), strict=True):
                ids += ends
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start:4 * (start + capacity)]
                    for name, value in zip(PIECES.names, (key, row, start, len(part) // 4, crc(part), n), strict=True):
                        out[name].append(value)
            yield record(PIECES, out)

    rows = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(cut, "doc_id bigint, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, group_pieces: int = GROUP_PIECES,
    seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded.

    ``padded`` is the length its sequence is padded to: the capacity, or nothing where its length is a power of two.
    Pieces are dealt to groups by a seeded hash of their row and start, so neither a source, a long document nor
    repeated rows fill a group. Null and empty texts hold the end id alone; a null doc_id stays null; an empty table
    gives no rows; other columns are not read.
    """
    found = stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    groups = max(1, -(-found.count() // group_pieces))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("row", "start", F.lit(seed)), F.lit(groups)))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("start", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, places = first_fit_decreasing(lengths, capacity)
        used = np.bincount(bins, weights=lengths).astype(np.int64)
        padded = np.where(used & (used - 1), capacity, used)
        group = table.column("bucket")[0].as_py()
        table = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        for name, values in (("sequence_id", (group << 32) + bins), ("offset", places), ("padded", padded[bins])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return dealt.groupBy("bucket").applyInArrow(
        fill, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, padded bigint"
    )
