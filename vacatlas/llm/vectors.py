"""Near-duplicate vectors of equal label, by random-hyperplane sign hashing and exact cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_digest

from .common import record, stored
from .components import components

#: Bits of a hash and tables. A pair of cosine 0.98 differs in a bit with probability 0.064, so it meets in no table
#: with probability (1 - 0.936 ** 14) ** 32 = 9e-8; closer pairs with less.
BITS, TABLES, BLOCK = 14, 32, 512


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits * tables))


def codes(units: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(vectors, tables): the sign bits of each vector in each table as one number."""
    if not len(units):
        return np.empty((0, tables), np.int64)
    signs = (units @ planes(units.shape[1], bits, tables, seed) >= 0).reshape(len(units), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


CLASS = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("vec", pa.binary())])


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, and of vectors that can be compared the label, a digest of label and components, and the components as
    doubles; null, zero and non-finite vectors, and those without a label, keep the id alone."""

    def emit(batches):
        for batch in batches:
            ids, labels, out = batch.column("id"), batch.column("label").to_pylist(), {n: [] for n in CLASS.names}
            for label, vec in zip(labels, batch.column("vec").to_pylist(), strict=True):
                row: tuple = (None,) * 5
                if label is not None and vec and None not in vec:
                    x = np.asarray(vec, np.float64) + 0.0  # no negative zero
                    if np.isfinite(x).all() and x.any():
                        d1, d2 = np.frombuffer(xxh3_128_digest(label.to_bytes(8, "little", signed=True) + x.tobytes()), "<i8").tolist()
                        row = (label, len(x), d1, d2, x.tobytes())
                for name, value in zip(CLASS.names, row, strict=True):
                    out[name].append(value)
            found = record(CLASS, out)
            yield pa.RecordBatch.from_arrays([ids, *found.columns], ["id", *CLASS.names])

    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vec"),
    )
    return rows.mapInArrow(emit, "id bigint, label bigint, dim int, d1 bigint, d2 bigint, vec binary")


LINK = pa.schema([("a", pa.int64()), ("root", pa.int64()), ("others", pa.int64())])


def least_reached(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the least row that is reached from it, itself included."""
    least = np.arange(len(linked))
    while True:
        found = np.minimum(least, np.where(linked, least[None, :], len(linked)).min(axis=1, initial=len(linked)))
        found = found[found]
        if (found == least).all():
            return least
        least = found


def vector_links(classes: DataFrame, cosine: float, bits: int, tables: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(a, root, others) of classes that share a bucket with ones of at least that cosine.

    ``classes`` has cid, label, dim, members and vec. A bucket of more than ``block`` classes is cut into blocks, and
    every pair of blocks is a group of its own. A pair counts in the first table alone that it meets in: a class has one
    row per group with such partners, ``others`` the members of these, ``root`` the least class its links reach within
    the group. So all ``others`` of a class add up to its links, all roots join what links join, and no pair is a row.
    """

    def hashed(batches):
        for batch in batches:
            for dim in np.unique(np.asarray(batch.column("dim"))).tolist():
                part = batch.filter(pc.equal(batch.column("dim"), dim))
                x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in part.column("vec")])
                # components are scaled by the largest first, so that squares neither overflow nor vanish
                x = x / np.abs(x).max(axis=1, keepdims=True)
                units = x / np.linalg.norm(x, axis=1, keepdims=True)
                found = codes(units, bits, tables, seed)
                yield pa.RecordBatch.from_arrays([
                    part.column("cid"), part.column("label"), part.column("dim"), part.column("members"),
                    pa.ListArray.from_arrays(np.arange(0, found.size + 1, tables, dtype=np.int32), found.ravel()),
                    pa.array([u.tobytes() for u in units], pa.binary()),
                ], ["cid", "label", "dim", "members", "codes", "unit"])

    units = stored(
        classes.mapInArrow(hashed, "cid bigint, label bigint, dim int, members bigint, codes array<bigint>, unit binary"), "units"
    )
    met = units.select("cid", "label", "dim", F.posexplode("codes").alias("table", "code"))
    bucket = ["label", "dim", "table", "code"]
    sizes = met.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    dealt = (
        met.join(sizes, bucket).withColumn("blocks", F.ceil(F.col("size") / block))
        .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select("cid", *bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    )
    groups = (
        dealt.join(units.select("cid", "members", "codes", "unit"), "cid")
        .groupBy(*bucket, "i", "j").agg(F.collect_list(F.struct("cid", "own", "members", "codes", "unit")).alias("rows"))
        .select("table", "i", "j", "rows")
    )

    def compare(batches):
        for batch in batches:
            out: dict[str, list[np.ndarray]] = {name: [] for name in LINK.names}
            for g in range(batch.num_rows):
                table, i, j = (batch.column(c)[g].as_py() for c in ("table", "i", "j"))
                rows = batch.column("rows")[g].values
                ids, own, members = (rows.field(c).to_numpy() for c in ("cid", "own", "members"))
                found = np.stack([x.values.to_numpy() for x in rows.field("codes")])
                unit = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in rows.field("unit")])
                good = np.triu(unit @ unit.T >= cosine, 1)
                if i != j:
                    good &= own[:, None] != own[None, :]
                a, b = np.nonzero(good)
                first = ~(found[a, :table] == found[b, :table]).any(axis=1)
                a, b = a[first], b[first]
                if not len(a):
                    continue
                some = np.unique(np.concatenate([a, b]))
                some = some[np.argsort(ids[some], kind="stable")]
                place = np.empty(len(ids), np.int64)
                place[some] = np.arange(len(some))
                linked = np.zeros((len(some), len(some)), bool)
                linked[place[a], place[b]] = linked[place[b], place[a]] = True
                out["a"].append(ids[some])
                out["root"].append(ids[some][least_reached(linked)])
                out["others"].append(linked @ members[some])
            yield record(LINK, {name: np.concatenate(v) if v else np.empty(0, np.int64) for name, v in out.items()})

    return groups.mapInArrow(compare, "a bigint, root bigint, others bigint")


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, bits: int = BITS, tables: int = TABLES, seed: int = 1,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Vectors of equal, non-null label and equal length are linked if their cosine in double precision is at least
    ``cosine``; equal vectors are one class, compared once, and count for one another. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing: no links, a component of their own. Repeated rows
    are copies of each other. A row without an id takes its copies' component but is no component and not kept; an
    empty table gives none. Other columns are not read.
    """
    rows = stored(usable(vectors, id_col, vector_col, label_col), "vectors")
    classes = stored(
        rows.where("d1 is not null").groupBy("d1", "d2").agg(
            F.min("id").alias("cid"), F.count("*").alias("members"), F.first("label").alias("label"),
            F.first("dim").alias("dim"), F.first("vec").alias("vec"),
        ).where("cid is not null"), "classes",
    )
    links = stored(vector_links(classes.select("cid", "label", "dim", "members", "vec"), cosine, bits, tables, seed), "links")
    met = links.groupBy(F.col("a").alias("cid")).agg(F.sum("others").alias("others"))
    joins = links.where(F.col("a") != F.col("root")).select("a", F.col("root").alias("b"))
    roots = components(joins).withColumnRenamed("id", "cid")
    known = classes.select("d1", "d2", "cid", "members").join(met, "cid", "left").join(roots, "cid", "left").select(
        "d1", "d2", F.coalesce("root", "cid").alias("root"),
        (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"),
    )
    out = rows.select("id", "d1", "d2").join(known, ["d1", "d2"], "left")
    component = F.when(F.col("d1").isNull(), F.col("id")).otherwise(F.col("root"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
