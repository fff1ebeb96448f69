"""Near-duplicate documents by Jaccard similarity of word-shingle sets, from bottom-k sketches of one hash function.

Documents of equal sets are one class, so copies are never compared. Of each class the least shingle values are kept.
Inverted lists of the kept values generate candidates: sets that similar share at least ``SHARED`` of their
``INDEXED`` least values, but for a probability below 1e-7, so two of them meet in a list of the rarest
``INDEXED - SHARED + 1`` values of each. Values that many documents hold come last in that order, so a passage in a
third of all documents is no key of a document that has enough other values.

* In a list of a bounded number of classes all are compared by their union sketches, and the pairs whose estimate is
  within five standard deviations of the threshold are verified on full sets.
* A longer list is cut into blocks, each pair of blocks is one group, and its classes are compared on full sets at
  once, as products of 0-1 matrices; only links that join something in the group leave it.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_digest

from .common import bounded, record, stored, texts
from .components import components
from .words import distinct, folded, named, shingles

SKETCH, INDEXED, SHARED = 64, 24, 8
#: Classes of a list that is compared by sketches; classes of a block of a longer list; columns of a matrix.
SHORT_LIST, BLOCK, COLUMNS = 64, 1024, 4096


def shingle_sets(items: list[str], width: int) -> list[np.ndarray]:
    """The distinct shingle values of each text in ascending order."""
    values, cut = distinct(*shingles(*named([folded(x) for x in items]), width), len(items))
    return [values[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(xxh3_128_digest(x.tobytes()) for x in sets), "<i8").reshape(-1, 2)


SKETCHES = pa.schema([
    ("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.list_(pa.int64())),
])


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """id, n (set size), a 128-bit digest of the set, and its ``SKETCH`` least values."""

    def emit(batches):
        for batch in bounded(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            digests = _digests(sets)
            least = [x[:SKETCH].view(np.int64) for x in sets]
            offsets = np.cumsum([0, *map(len, least)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(least) if least else np.empty(0, np.int64))
            yield record(SKETCHES, {
                "id": batch.column("id"), "n": [len(x) for x in sets], "d1": digests[:, 0], "d2": digests[:, 1], "sketch": lists,
            })

    return rows.mapInArrow(emit, "id bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>")


def keys(classes: DataFrame) -> DataFrame:
    """(value, cid): for each class the rarest of its indexed values that others have too, as many as needed."""
    indexed = classes.select("cid", F.least("n", F.lit(INDEXED)).alias("k"), F.explode(F.slice("sketch", 1, INDEXED)).alias("value"))
    often = indexed.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    ranked = indexed.join(often, "value").groupBy("cid", "k").agg(
        F.array_sort(F.collect_list(F.struct("often", "value"))).alias("found")
    )
    shared = F.when(F.col("k") < INDEXED, F.greatest(F.lit(1), F.floor(F.col("k") / 3))).otherwise(SHARED)
    # values of one class only come first; they can be no key, but they take their places in the order
    needed = F.greatest(F.lit(0), F.col("k") - shared + 1 - (F.col("k") - F.size("found"))).cast("int")
    return ranked.select("cid", F.explode(F.slice("found", F.lit(1), needed)).alias("key")).select(F.col("key.value").alias("value"), "cid")


def _overlaps(values: list[np.ndarray]) -> np.ndarray:
    """Numbers of common values of all pairs of sets, by products of 0-1 matrices of a bounded number of columns."""
    n = len(values)
    flat, owner = np.concatenate(values), np.repeat(np.arange(n), [len(v) for v in values])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    column, owner = column[count[column] > 1], owner[count[column] > 1]  # a value of one set is in no pair
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        own = slice(*np.searchsorted(column, [a, a + COLUMNS]))
        matrix = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - a)), np.float32)
        matrix[owner[own], column[own] - a] = 1
        out += matrix @ matrix.T
    return out


def estimate(one: np.ndarray, two: np.ndarray, size: int = SKETCH) -> float:
    """Share of the union's least values that both sets have; exact where the sketches hold both sets."""
    union, counts = np.unique(np.concatenate([one, two]), return_counts=True)
    return float((counts[:size] > 1).mean())


def alike(sizes: np.ndarray, shared: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Jaccard similarity of at least share[0] / share[1], in whole numbers; sizes and shared of pairs."""
    return share[1] * shared >= share[0] * (sizes - shared)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def short_pairs(lists: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Distinct (a, b) of the classes in short lists that pass the estimate; ``lists`` has members (cid, n, sketch)."""
    t = share[0] / share[1]
    margin = 5 * sqrt(t * (1 - t) / SKETCH)

    def emit(batches):
        for batch in batches:
            out: set[tuple[int, int]] = set()
            members = batch.column("members")
            for i in range(len(members)):
                rows = members[i].values
                ids, sizes = rows.field("cid").to_numpy(), rows.field("n").to_numpy()
                cut, flat = rows.field("sketch").offsets.to_numpy(), rows.field("sketch").values.to_numpy().view(np.uint64)
                own = [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                met = _overlaps([x[:INDEXED] for x in own])
                small = np.minimum(sizes, INDEXED)
                least = np.where(small < INDEXED, np.maximum(1, small // 3), SHARED)
                low, high = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
                good = (met >= np.minimum.outer(least, least)) & (share[1] * low >= share[0] * high)
                for a, b in zip(*np.nonzero(np.triu(good, 1)), strict=True):
                    exact = sizes[a] <= SKETCH and sizes[b] <= SKETCH
                    pair = (min(ids[a], ids[b]), max(ids[a], ids[b]))
                    if pair not in out and estimate(own[a], own[b], 2 * SKETCH if exact else SKETCH) >= t - (1e-9 if exact else margin):
                        out.add(pair)
            a, b = np.array(sorted(out), np.int64).reshape(-1, 2).T
            yield record(PAIR, {"a": a, "b": b})

    return lists.mapInArrow(emit, "a bigint, b bigint").distinct()


def _forest(n: int, pairs) -> list[tuple[int, int]]:
    """The pairs that join two parts not joined by those before them."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        if (x := find(a)) != (y := find(b)):
            root[x] = y
            out.append((a, b))
    return out


def verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets are as similar."""

    def check(batches):
        for batch in batches:
            good = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, two))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bool(alike(len(x) + len(y), shared, share)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("cid").alias("a"), F.col("values").alias("one"))
    two = sets.select(F.col("cid").alias("b"), F.col("values").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(check, "a bigint, b bigint")


def long_links(entries: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links within long lists: (value, cid, blocks) against full sets, a pair of blocks at a time."""
    own = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    dealt = entries.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("value", "cid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("cid").to_numpy()
        values = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("values")]
        sizes = np.array([len(v) for v in values])
        shared = _overlaps(values).astype(np.int64)
        good = alike(sizes[:, None] + sizes[None, :], shared, share)
        links = _forest(len(ids), zip(*(x.tolist() for x in np.nonzero(np.triu(good, 1))), strict=True))
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])}, schema=PAIR)

    return dealt.join(sets, "cid").groupBy("value", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, width: int = 5, share: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Documents are linked if the sets of their distinct ``width``-word shingles have a Jaccard similarity of at least
    share[0] / share[1]; the component is the least id that links reach. Words are ASCII-blank separated, A-Z in
    lower case; with fewer words the whole sequence is one shingle. Null and empty texts have an empty set and are
    linked with nothing. Rows repeated whole are each reported; rows of one id with different texts are linked by
    their own texts, each by itself. A row without an id stands with its copies: it takes
    their component, or none if no copy has an id, links nothing itself, and is not kept. An empty table gives none.
    Other columns are not read.
    """
    rows = texts(docs, id_col, text_col)
    found = stored(sketches(rows, width), "sketches")
    classes = stored(  # an id may stand on rows of several sets, so classes have numbers of their own
        found.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .where("least is not null").withColumn("cid", F.monotonically_increasing_id()), "classes",
    )
    entries = stored(keys(classes), "keys")
    sizes = entries.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    listed = entries.join(sizes, "value")
    short = (
        listed.where(F.col("size") <= SHORT_LIST).join(classes.select("cid", "n", "sketch"), "cid")
        .groupBy("value").agg(F.collect_list(F.struct("cid", "n", "sketch")).alias("members")).select("members")
    )
    pairs = stored(short_pairs(short, share), "pairs")
    long = listed.where(F.col("size") > SHORT_LIST).select("value", "cid", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(long.select("cid")).distinct()
    ids = classes.join(wanted, "cid", "left_semi").select(F.col("least").alias("id")).distinct()

    def full(batches):
        for batch in bounded(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            digests = _digests(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([x.tobytes() for x in sets], pa.binary())
            ], ["least", "d1", "d2", "values"])

    sets = rows.join(ids, "id", "left_semi").mapInArrow(full, "least bigint, d1 bigint, d2 bigint, values binary")
    chosen = classes.select("cid", "least", "d1", "d2")
    sets = stored(sets.join(chosen, ["least", "d1", "d2"]).dropDuplicates(["cid"]).select("cid", "values"), "sets")
    links = verified(pairs, sets, share).union(long_links(long, sets, share))
    linked = components(links).withColumnRenamed("id", "cid").join(classes.select("cid", "least"), "cid")
    first = linked.groupBy("root").agg(F.min("least").alias("first"))
    roots = classes.select("d1", "d2", "cid", "least").join(linked.join(first, "root").select("cid", "first"), "cid", "left").select(
        "d1", "d2", F.coalesce("first", "least").alias("component_id")
    )
    out = found.select("id", "n", "d1", "d2").join(roots, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def keep_one(
    docs: DataFrame, width: int = 5, share: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` but for those linked to a document of a lesser id, all columns as they are.

    Rows that repeat an id are one document and stay or go together; rows without an id stay.
    """
    found = near_duplicates(docs.select(id_col, text_col), width, share, id_col, text_col)
    gone = found.where("doc_id is not null and not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
