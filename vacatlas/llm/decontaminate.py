"""Benchmark items inside documents, by containment of word shingles.

Items are partitioned by the size of their shingle sets. Of each item the least values of one hash are kept, all of
them for small sets; a text holds at least the threshold's share of an item only if it holds enough of these, how
many depending on the size class. The share found estimates containment; exact shingles of the candidates verify it.

Kept values are a stored table. A filter of a bounded number of bits over them goes with every task, so one pass over
the documents leaves the few texts that hold some; joins on values, then on pairs, do the rest. Neither the items nor
what is found passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructType
from xxhash import xxh3_128_digest

from .common import bounded, record, stored, texts
from .words import distinct, folded, mixed, named, shingles

#: Values kept of an item; the probability with which a text over the threshold may hold too few of them.
KEPT, MISS = 16, 1e-9
#: Bits of the filter for a value, at most in all, and looked at for a value.
VALUE_BITS, MOST_BITS, PROBES = 64, 1 << 27, 6
#: Items that may hold a value before items find texts by their other values, as far as those suffice.
COMMON = 64
#: Bytes of a table that is broadcast; a larger one is joined, each of its rows in ``SALTS`` places.
BROADCAST_BYTES, SALTS = 8 << 20, 16
#: Bytes of items that are verified against a text at once.
LIST_BYTES = 1 << 20


def least_hits(size: int, threshold: float, kept: int = KEPT, miss: float = MISS) -> int:
    """Kept values that a text with the threshold's share of ``size`` shingles holds, but for probability ``miss``."""
    k, good = min(size, kept), ceil(threshold * size - 1e-9)
    below, hits = 0.0, 0
    while hits < k:
        below += comb(good, hits) * comb(size - good, k - hits) / comb(size, k)
        if below > miss:
            break
        hits += 1
    return max(1, hits)


@lru_cache(maxsize=None)
def class_hits(bits: int, threshold: float) -> int:
    """The least that any size of a class, those of ``bits`` binary digits, needs; large classes by steps."""
    first, last = 1 << (bits - 1), (1 << bits) - 1
    return min(least_hits(size, threshold) for size in {*range(first, last, max(1, first // 256)), last})


def exact_shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}


# -- items ------------------------------------------------------------------

ITEM = pa.schema([
    ("id", pa.int64()), ("item", pa.binary()), ("text", pa.string()), ("width", pa.int32()), ("bits", pa.int32()),
    ("hits", pa.int32()), ("kept", pa.list_(pa.int64())),
])
ITEM_DDL = "id bigint, item binary, text string, width int, bits int, hits int, kept array<bigint>"


def item_table(items: DataFrame, width: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """The items that have words, stored: ``item`` names equal word sequences, ``text`` is their words joined."""

    def sketch(batches):
        for batch in bounded(batches):
            out = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not (words := folded(text)):
                    continue
                w, joined = min(width, len(words)), b" ".join(words)
                values, _ = distinct(*shingles(*named([words]), w), 1)
                size = len(values)
                hits = class_hits(size.bit_length(), threshold) if size > KEPT else least_hits(size, threshold)
                least = values[np.argsort(mixed(values))][:KEPT].view(np.int64)
                out.append((key, xxh3_128_digest(joined), joined.decode(), w, size.bit_length(), hits, least))
            yield record(ITEM, dict(zip(ITEM.names, zip(*out, strict=True) if out else [()] * len(ITEM), strict=True)))

    return stored(texts(items, id_col, text_col).mapInArrow(sketch, ITEM_DDL), "items")


def kept_values(classes: DataFrame, common: int = COMMON) -> DataFrame:
    """(value, item, place, needed, bits), stored by size class: the values that find each item, and how many must.

    Where an item needs h of its values, h - 1 may be left unasked: those that more than ``common`` items hold, the
    commonest first. As many fewer are needed of the others.
    """
    rows = classes.select("bits", "item", "hits", F.posexplode("kept").alias("place", "value"))
    many = rows.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > common)
    own = Window.partitionBy("item")
    ranked = rows.join(many, "value", "left").withColumn("rank", F.row_number().over(own.orderBy(F.desc_nulls_last("n"), "value")))
    left = F.col("n").isNotNull() & (F.col("rank") < F.col("hits"))
    asked = ranked.withColumn("left", left).withColumn("needed", F.col("hits") - F.sum(F.col("left").cast("int")).over(own))
    return stored(asked.where(~F.col("left")).select("value", "item", "place", F.col("needed").cast("int"), "bits"), "item-values", "bits")


def _place(values: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit of a filter that a probe sets or looks at."""
    return (values + np.uint64(probe) * (mixed(values) | np.uint64(1)) if probe else values) & np.uint64(bits - 1)


def value_filter(values: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """A Bloom filter of the values in 64-bit words: a power of two of bits, at most ``most``, whatever the number of values."""
    bits = min(most, 1 << max(10, (values.count() * VALUE_BITS).bit_length()))

    def fill(batches):
        for batch in batches:
            own = np.asarray(batch.column(0)).view(np.uint64)
            at = np.concatenate([_place(own, j, bits) for j in range(PROBES)])
            word, back = np.unique(at >> np.uint64(6), return_inverse=True)
            own = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(own, back, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(own.view(np.int64))], ["word", "own"])

    set_bits = values.select("value").mapInArrow(fill, "word bigint, own bigint").groupBy("word").agg(F.bit_or("own").alias("own")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[set_bits["word"].to_numpy()] = set_bits["own"].to_numpy().view(np.uint64)
    return out


def held(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the values that a filter may hold."""
    at = np.arange(len(values))
    for j in range(PROBES):
        place = _place(values[at], j, len(words) << 6)
        at = at[(words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return at


# -- documents --------------------------------------------------------------


def marked(rows: DataFrame, words: np.ndarray, widths: Sequence[int], everything: bool) -> DataFrame:
    """``rows`` with a number each and the values of the filter that its text holds, stored; null where it holds none.

    The numbers are fixed by the write. Rows whose text holds no value are left out unless ``everything`` is asked for.
    """
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "*")
    out = StructType([*numbered.schema.fields]).add("values", ArrayType(LongType()))

    def mark(batches):
        for batch in bounded(batches):
            names, starts = named([folded(x) for x in batch.column("text").to_pylist()])
            found, owners = [], []
            for w in widths:
                values, text = shingles(names, starts, w, short=False)
                at = held(values, words)
                found.append(values[at])
                owners.append(text[at])
            values, cut = distinct(np.concatenate(found), np.concatenate(owners), batch.num_rows)
            some = np.diff(cut) > 0
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values.view(np.int64)), mask=pa.array(~some))
            own = pa.RecordBatch.from_arrays([*batch.columns, lists], out.names)
            yield own if everything else own.filter(pa.array(some))

    return stored(numbered.mapInArrow(mark, out), "marked")


def beside(rows: DataFrame, table: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``rows`` joined with a table on ``key``: broadcast within ``limit`` bytes, else salted by the number of the row."""
    if (table.agg(F.sum(size)).first()[0] or 0) <= limit:
        return rows.join(F.broadcast(table), key)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def verified(suspects: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """(row, id, item, n_shingles, n_shared) of the pairs whose exact shingles reach the threshold."""
    out = pa.schema([
        ("row", pa.int64()), ("id", pa.int64()), ("item", pa.binary()), ("n_shingles", pa.int64()), ("n_shared", pa.int64())
    ])

    def verify(batches):
        for batch in bounded(batches):
            found = []
            for i in range(batch.num_rows):
                words, own = folded(batch.column("text")[i].as_py()), {}
                for one in batch.column("items")[i].as_py():
                    w = one["width"]
                    if w not in own:
                        own[w] = exact_shingles(words, w)
                    need = exact_shingles(one["words"].encode().split(), w)
                    if len(need & own[w]) >= threshold * len(need) - 1e-9:
                        found.append((batch.column("row")[i].as_py(), batch.column("id")[i].as_py(), one["item"], len(need), len(need & own[w])))
            yield record(out, dict(zip(out.names, zip(*found, strict=True) if found else [()] * len(out), strict=True)))

    return suspects.join(lists, "row").select("row", "id", "text", "items").mapInArrow(
        verify, "row bigint, id bigint, item binary, n_shingles bigint, n_shared bigint"
    )


def search(rows: DataFrame, items: DataFrame, threshold: float, everything: bool, limit: int) -> tuple[DataFrame, DataFrame] | None:
    """The marked rows and the verified pairs; None without items. ``rows`` have text, and id where the pairs are to."""
    classes = items.groupBy("item").agg(*(F.first(c).alias(c) for c in ("text", "width", "bits", "hits", "kept")))
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    if not widths:
        return None
    values = kept_values(classes)
    seen = marked(rows, value_filter(values), widths, everything)
    suspects = seen.where(F.col("values").isNotNull())
    met = beside(suspects.select("row", F.explode("values").alias("value")), values, "value", F.lit(40), limit)
    hits = met.groupBy("row", "item").agg(F.bit_or(F.expr("shiftleft(1, place)")).alias("places"), F.max("needed").alias("needed"))
    pairs = hits.where(F.bit_count("places") >= F.col("needed")).select("row", "item")
    words = classes.select("item", "width", F.col("text").alias("words"))
    long = beside(pairs, words, "item", F.octet_length("words") + 32, limit)
    read = F.sum(F.octet_length("words").cast("bigint")).over(Window.partitionBy("row").orderBy("item"))
    lists = long.withColumn("part", F.floor(read / LIST_BYTES)).groupBy("row", "part").agg(
        F.collect_list(F.struct("item", "width", "words")).alias("items")
    )
    own = F.col("id") if "id" in rows.columns else F.lit(None).cast("bigint")
    return seen, verified(suspects.select("row", own.alias("id"), "text"), lists, threshold)


FOUND_DDL = "doc_id bigint, item_id bigint, n_shingles bigint, n_shared bigint, containment double"


def contaminated(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id",
    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document and item of whose distinct word shingles the document holds at least ``threshold``.

    Words are ASCII-blank separated with A-Z in lower case. An item of fewer words than ``width`` is one shingle of
    its length. Items and texts without words, null texts among them, match nothing; null ids stay null; repeated
    rows are reported each. Empty tables give no rows. Other columns are not read.
    """
    table = item_table(items, width, threshold, item_id_col, item_text_col)
    found = search(texts(docs, id_col, text_col), table, threshold, False, broadcast_bytes)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND_DDL)
    members = table.select("item", F.col("id").alias("item_id"))
    return beside(found[1], members, "item", F.lit(40), broadcast_bytes).select(
        F.col("id").alias("doc_id"), "item_id", "n_shingles", "n_shared",
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"),
    )


def remove_contaminated(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are.

    Null and empty texts hold none and stay, repeated rows stay or go together, an empty table gives an empty one,
    and columns may have any names.
    """
    table = item_table(items, width, threshold, item_id_col, item_text_col)
    at = docs.columns.index(text_col)
    names = ["text" if i == at else f"c{i}" for i in range(len(docs.columns))]
    found = search(docs.toDF(*names), table, threshold, True, broadcast_bytes)
    if found is None:
        return docs
    seen, pairs = found
    clean = seen.where(F.col("values").isNull()).select(*names)
    return clean.unionAll(
        seen.where(F.col("values").isNotNull()).join(pairs.select("row").distinct(), "row", "left_anti").select(*names)
    ).toDF(*docs.columns)
