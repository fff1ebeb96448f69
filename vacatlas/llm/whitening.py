"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X (one row per vector) are reduced to an upper bidiagonal matrix B = UᵀXV by products Xv and Xᵀu in
turn. Each step reads the rows once: a task forms its rows of p = Xv - βu', its share of Xᵀp, and its share of Uᵀp
against all earlier left vectors, whose rows it forms too. Uᵀp is what rounding has left of the earlier vectors in p;
it is taken out of p, |p| and Xᵀp alike, so every left vector is orthogonal to all before it, and right vectors are
made so in full. A left vector is as long as the table; it is never stored, as it is X times a vector of the width of
the embeddings, which is. What leaves a task is a few numbers per dimension and step.

The singular values of B are those of X, and its right singular vectors give the components.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Components returned, bytes of numbers in a block, and the part of the largest singular value that counts as nothing.
COMPONENTS, BLOCK_BYTES, NOTHING = 8, 2 << 20, 1e-12


def whole_numbers(vector: str | Column, scale: int = 1024, shift: int = 100_000) -> Column:
    """floor(scale * c) + shift of each entry of a vector, as long; null for vectors that hold null or non-finite entries."""
    entries = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~odd, F.transform(entries, lambda c: F.floor(c * scale).cast("bigint") + shift))


BLOCKS = pa.schema([("ids", pa.binary()), ("rows", pa.int64()), ("x", pa.binary())])


def packed(vectors: DataFrame, dim: int) -> DataFrame:
    """(ids, rows, x), stored: blocks of rows, their ids in an Arrow stream and their numbers as one matrix."""
    most = max(1, BLOCK_BYTES // (8 * dim))

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                x = np.asarray(part.column("x").flatten(), np.int64)
                small = x.astype("<i4")
                x = small if (small == x).all() else x.astype("<i8")
                out = pa.BufferOutputStream()
                ids = part.select(["id"])
                with pa.ipc.new_stream(out, ids.schema) as writer:
                    writer.write_batch(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array([out.getvalue().to_pybytes()], pa.binary()), pa.array([part.num_rows]), pa.array([x.tobytes()], pa.binary()),
                ], schema=BLOCKS)

    return stored(vectors.mapInArrow(pack, "ids binary, rows bigint, x binary"), "vector-blocks")


def _matrix(x: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(x, "<i4" if len(x) == 4 * rows * dim else "<i8").reshape(rows, dim)


@dataclass
class Rows:
    """Blocks of centred rows: X is (n * x - sums) / n, its numerator exact."""

    blocks: DataFrame
    n: int
    sums: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    def summed(self, function: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all blocks of ``function(X)``, ``size`` numbers: added up in tasks, then by place."""
        n, sums, dim = self.n, self.sums, self.dim

        def add(batches):
            total = np.zeros(size)
            for batch in batches:
                for rows, x in zip(batch.column("rows").to_pylist(), batch.column("x"), strict=True):
                    total += function((n * _matrix(x.as_buffer(), rows, dim).astype(np.int64) - sums) / n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["place", "value"])

        parts = self.blocks.select("rows", "x").mapInArrow(add, "place bigint, value double")
        found = parts.groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        out = np.zeros(size)
        out[found["place"].to_numpy()] = found["value"].to_numpy()
        return out


def _orthogonal(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in basis:
            vector = vector - (other @ vector) * other
    return vector


@dataclass
class Bidiagonal:
    """Right vectors, the vectors whose products with X are the left ones, and the columns of B from the top.

    A column ends with beta and alpha. What stands above is rounding, except after a new start, where it is what the
    residual left behind has in common with the new vector.
    """

    right: list[np.ndarray]
    left: list[np.ndarray]
    columns: list[np.ndarray]

    def singular(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.zeros((len(self.columns),) * 2)
        for j, column in enumerate(self.columns):
            b[:j + 1, j] = column
        p, values, q = np.linalg.svd(b)
        return values, np.array(self.right).T @ q.T, p


def bidiagonalise(rows: Rows, components: int, seed: int = 1, tolerance: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """Falling singular values of X and unit right vectors as columns: the leading ones, ``components`` where X has them.

    Steps go on until the leading triplets are exact to ``tolerance`` of the largest. One start meets each of several
    equal values once, so as many steps follow from a vector outside all before, until those do not change the values.
    """
    dim, rng = rows.dim, np.random.default_rng(seed)
    found, images, largest = Bidiagonal([], [], []), [], 0.0  # images: Xᵀu of each left vector

    def fresh() -> np.ndarray:
        vector = _orthogonal(rng.standard_normal(dim), found.right)
        return vector / np.linalg.norm(vector)

    v, beta, settled, needed, since = fresh(), 0.0, None, 0, 0
    while True:
        w = v - beta * found.left[-1] if beta else v
        known = np.array(found.left).reshape(-1, dim).T

        def step(x, w=w, known=known):
            p = x @ w
            return np.concatenate([x.T @ p, p @ (x @ known), [p @ p]])

        k = known.shape[1]
        result = rows.summed(step, dim + k + 1)
        image, overlap, square = result[:dim], result[dim:dim + k], result[-1]
        w = w - known @ overlap
        image = image - np.array(images).reshape(-1, dim).T @ overlap
        alpha = float(np.sqrt(max(square - overlap @ overlap, 0.0)))
        largest = max(largest, alpha, beta)
        if alpha <= NOTHING * largest:
            alpha, w, image = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            w, image = w / alpha, image / alpha
        column = np.append(overlap, alpha)
        if beta:
            column[-2] += beta
        found.right.append(v)
        found.left.append(w)
        found.columns.append(column)
        images.append(image)
        rest = _orthogonal(image - alpha * v, found.right)
        beta = float(np.linalg.norm(rest))
        since += 1
        values, vectors, p = found.singular()
        if len(found.right) == dim:
            return values, vectors
        small = beta <= NOTHING * largest
        if len(values) >= components and beta * np.abs(p[-1, :components]).max() <= tolerance * values[0] and since >= needed:
            now = values[:components]
            if settled is not None and np.allclose(now, settled, rtol=1e-9, atol=NOTHING * now[0]):
                return values, vectors
            settled, needed, since, small = now, len(values), 0, True
        v, beta = (fresh(), 0.0) if small else (rest / beta, beta)


@dataclass
class Whitening:
    """Fitted to all rows: exact sums, components by falling variance, and what is left of a unit covariance."""

    rows: Rows
    components: np.ndarray
    variances: np.ndarray
    trace: float
    error: float


def fit(vectors: DataFrame, components: int = COMPONENTS, seed: int = 1) -> Whitening | None:
    """``vectors`` has id and x, an array of longs. None if there are no rows, or no entries in them."""
    widths = vectors.agg(F.max(F.size("x")).alias("dim")).first()
    if not widths["dim"] or widths["dim"] < 1:
        return None
    dim = widths["dim"]
    blocks = packed(vectors.where(F.size("x") == dim), dim)

    def add(batches):
        n, total = 0, np.zeros(dim, np.int64)
        for batch in batches:
            for rows, x in zip(batch.column("rows").to_pylist(), batch.column("x"), strict=True):
                n += rows
                total += _matrix(x.as_buffer(), rows, dim).sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array([n, *total.tolist()])], ["place", "value"])

    added = blocks.select("rows", "x").mapInArrow(add, "place bigint, value bigint").groupBy("place").agg(F.sum("value").alias("value"))
    found = dict(added.toPandas().itertuples(index=False))
    rows = Rows(blocks, int(found[0]), np.array([found[j + 1] for j in range(dim)], np.int64))
    trace = float(rows.summed(lambda x: np.array([(x * x).sum()]), 1)[0]) / rows.n
    if trace == 0:
        return Whitening(rows, np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0)
    values, vectors_ = bidiagonalise(rows, min(components, dim), seed)
    number = int((values[:components] > NOTHING * values[0]).sum())
    chosen, variances = vectors_[:, :number], values[:number] ** 2 / rows.n

    def covariance(x):
        white = x @ chosen / np.sqrt(variances)
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    sums = rows.summed(covariance, number + number * number)
    mean = sums[:number] / rows.n
    unit = sums[number:].reshape(number, number) / rows.n - np.outer(mean, mean)
    return Whitening(rows, chosen, variances, trace, float(np.abs(unit - np.eye(number)).max()))


def _squares(x: np.ndarray, n: int, sums: np.ndarray) -> list[Decimal]:
    """The exact sum of (n * x - sums)² of each row; high and low halves are squared apart where sums could overflow."""
    apart = np.abs(n * x.astype(np.int64) - sums)
    if int(apart.max(initial=0)) ** 2 * len(sums) < 1 << 63:
        return [Decimal(s) for s in (apart * apart).sum(axis=1).tolist()]
    high, low = apart >> 31, apart & ((1 << 31) - 1)
    parts = [(a * b).astype(object).sum(axis=1) for a, b in ((high, high), (high, low), (low, low))]
    return [Decimal((int(a) << 62) + (int(b) << 32) + int(c)) for a, b, c in zip(*parts, strict=True)]


def whitened(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and each of the leading components.

    Entries are whole numbers, see ``whole_numbers``. Vectors that are null or hold null or non-finite entries are left
    out, and so are those shorter than the longest one; entries beyond the range of long are an error. Components without
    variance, which cannot be scaled, are left out: a table of equal vectors, of empty ones, or without rows gives no
    rows. Repeated rows count and are returned as often as they stand. ``deviation`` is decimal(38, 0). A null id stays
    null; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), whole_numbers(vector_col).alias("x")).where(F.col("x").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
    model = fit(rows, components, seed)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, dim = model.rows.n, model.rows.sums, model.rows.dim
    scaled = model.components / np.sqrt(model.variances)
    explained, error, number = model.variances / model.trace, model.error, len(model.variances)

    def project(batches):
        for batch in batches:
            for ids, length, x in zip(batch.column("ids"), batch.column("rows").to_pylist(), batch.column("x"), strict=True):
                own = _matrix(x.as_buffer(), length, dim)
                with pa.ipc.open_stream(ids.as_buffer()) as stream:
                    names = stream.read_all().column("id").combine_chunks()
                deviation = pa.array(_squares(own, n, sums), pa.decimal128(38, 0))
                white = ((n * own.astype(np.int64) - sums) / n) @ scaled
                place = pa.array(np.repeat(np.arange(length), number))
                yield pa.RecordBatch.from_arrays([
                    pc.take(names, place), pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), length)),
                    pa.array(np.full(length * number, n)), pc.take(deviation, place), pa.array(white.ravel()),
                    pa.array(np.tile(explained, length)), pa.array(np.full(length * number, error)),
                ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return model.rows.blocks.mapInArrow(project, schema)
