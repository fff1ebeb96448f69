import math

import numpy as np
import pytest

from vacatlas.llm import queries, whitening


def frame(spark, vectors, ids=None, parts=3):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "own", 3) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x string, rows int").repartition(parts)


def plain(vectors):
    """x, deviations, falling eigenvalues and eigenvectors by numpy, in whole numbers where they are exact."""
    kept = [v for v in vectors if v is not None and None not in v and all(map(math.isfinite, v))]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, values[::-1], vectors[:, ::-1]


def check(found, vectors, ids=None, unique=True, tolerance=1e-9):
    n, deviation, centred, values, axes = plain(vectors)
    number = min(8, int((values > 1e-12 * values[0]).sum()))
    assert len(found) == n * number and {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1
    assert found[0].identity_error <= 1e-9
    kept = [i for i, v in zip(ids or range(len(vectors)), vectors, strict=True) if v is not None and None not in v and all(map(math.isfinite, v))]
    own = {(r.vec_id, r.component): r for r in found}
    for j in range(number):
        rows = [own[i, j + 1] for i in kept]
        assert [r.deviation for r in rows] == deviation
        assert np.allclose([r.explained for r in rows], values[j] / values.sum(), rtol=1e-10, atol=0)
        white = np.array([r.whitened for r in rows])
        assert abs((white * white).mean() - 1) < 1e-9 and abs(white.mean()) < 1e-9
        if unique:
            expected = centred @ axes[:, j] / np.sqrt(values[j])
            assert min(np.abs(white - expected).max(), np.abs(white + expected).max()) < tolerance * max(1, np.abs(expected).max())


def run(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return queries.op13_whitening(spark, str(tmp_path)).collect()


def test_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(0)
    vectors = (rng.standard_normal((300, 24)) * np.linspace(3, 0.3, 24)).tolist()
    vectors += [None, [None] * 24, [math.nan] * 24, [math.inf] + [0.0] * 23, [-math.inf] * 24]
    vectors += vectors[:3]
    check(run(spark, tmp_path, frame(spark, vectors)), vectors, unique=True)


def test_wide_spectrum_needs_no_full_basis(spark, monkeypatch):
    rng = np.random.default_rng(1)
    scale = np.concatenate([2.0 ** -np.arange(10), np.full(190, 1e-2)])
    x = np.floor(1000 * rng.standard_normal((400, 200)) * scale).astype(np.int64)
    steps, summed = [], whitening.Rows.summed
    monkeypatch.setattr(whitening.Rows, "summed", lambda self, f, size: steps.append(size) or summed(self, f, size))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, x array<bigint>")
    model = whitening.fit(rows)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    assert np.allclose(model.variances, values[::-1][:8], rtol=1e-11)
    assert np.allclose(np.abs((model.components * axes[:, ::-1][:, :8]).sum(axis=0)), 1, atol=1e-11)
    assert np.allclose(model.components.T @ model.components, np.eye(8), atol=1e-13) and model.error < 1e-10
    assert len(steps) < 150


def test_equal_values_and_missing_ranks(spark, tmp_path):
    """Every value stands several times, and dimensions without variance are left out."""
    base = np.concatenate([np.eye(6) * 2, -np.eye(6) * 2, np.zeros((1, 6))])
    vectors = np.concatenate([base, np.full((13, 4), 0.5)], axis=1).tolist()
    check(run(spark, tmp_path, frame(spark, vectors)), vectors, unique=False)
    narrow = [[1.0, 2.0], [3.0, 5.0], [0.0, 1.5]]
    found = run(spark, tmp_path / "narrow", frame(spark, narrow))
    check(found, narrow)
    assert {r.component for r in found} == {1, 2}


def test_equal_values_beyond_the_first_start(spark):
    """Three copies of the largest variance among fifty distinct ones: one start finds one copy only."""
    side = np.concatenate([[50, 50, 50], np.arange(40, 0, -1)])
    x = np.concatenate([np.diag(side), -np.diag(side)]) * 100
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, x array<bigint>")
    model = whitening.fit(rows, 4)
    expected = np.sort(2 * (side * 100.0) ** 2 / len(x))[::-1][:4]
    assert np.allclose(model.variances, expected, rtol=1e-11) and model.error < 1e-10


@pytest.mark.parametrize("vectors", [[], [None, [None]], [[]], [[1.0, 2.0]] * 4, [[3.0, 1.0]]])
def test_nothing_to_scale(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    out = whitening.whitened(df)
    assert out.collect() == [] and out.columns[0] == "id"


def test_shorter_vectors_and_null_ids(spark):
    vectors = [[1.0, 2.0], [3.0, 5.0], [0.0, 1.5], [7.0], []]
    out = whitening.whitened(frame(spark, vectors, [1, None, 3, 4, 5])).collect()
    assert sorted((r.id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 2), (3, 1), (3, 2)] and out[0].n == 3


def test_deviations_beyond_long_are_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(-1 << 40, 1 << 40, (5, 7))
    n, sums = 1 << 20, rng.integers(-1 << 59, 1 << 59, 7)
    expected = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert list(map(int, whitening._squares(x, n, sums))) == expected
