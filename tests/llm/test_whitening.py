"""Whitening against plain arithmetic in whole numbers; exactness, edge cases."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from awardlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors):
    """Whole vectors, exact deviations, covariance of exact fractions."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = [[a - Fraction(s, n) for a, s in zip(row, sums)] for row in x]
    cov = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(width)] for i in range(width)])
    return np.array([[float(c) for c in row] for row in centred]), deviation, cov


def test_matches_plain_arithmetic(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 6)).astype(np.float32) @ rng.normal(size=(6, 6)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), components=4).toPandas()
    centred, deviation, cov = plain(vectors)
    assert len(found) == 240 and set(found.n) == {60} and found.identity_error.max() < 1e-9
    assert dict(zip(found.vec_id, found.deviation)) == dict(enumerate(deviation))
    assert [int(d) for d in found.deviation_exact] == found.deviation.tolist()
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    wide = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = centred @ axes[:, :4] / np.sqrt(values[:4])
    want *= np.sign((want * wide).sum(axis=0))
    assert np.allclose(wide, want, rtol=1e-9, atol=1e-9)
    assert np.allclose(found.groupby("component").explained.first(), values[:4] / np.trace(cov), rtol=1e-12)


def test_covariance_is_rounded_once_from_polarised_sums():
    rng = np.random.default_rng(4)
    y = rng.integers(-50, 50, (40, 5))
    squares, sums = whitening.pair_squares(y), [int(s) for s in y.sum(axis=0)]
    matrix, trace = whitening.covariance(40, [int(s) for s in squares], sums)
    exact = [[Fraction(int((y[:, i] * y[:, j]).sum()), 40) - Fraction(sums[i] * sums[j], 1600) for j in range(5)] for i in range(5)]
    assert (matrix == np.array([[float(v) for v in row] for row in exact])).all()
    assert trace == float(sum(exact[i][i] for i in range(5)))


@pytest.mark.parametrize("size", [1.0, 1e9, 3e14])
def test_large_entries_stay_exact(spark, size):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(30, 3)) * size).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    _, deviation, _ = plain(vectors)
    exact = dict(zip(found.vec_id, found.deviation_exact))
    for i, want in enumerate(deviation):
        assert pd.isna(exact[i]) if want >= 10**38 else int(exact[i]) == want
    longs = dict(zip(found.vec_id, found.deviation))
    assert all(pd.isna(longs[i]) == (want >= 1 << 63) for i, want in enumerate(deviation))
    assert found.identity_error.max() < 1e-6


def test_unusable_vectors_constant_directions_repeats_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, 2.0]), (1, [0.5, 1.0, 2.0]), (None, [1.5, 1.0, -2.0]), (3, [0.0, 1.0, 7.0]), (4, [2.0, 1.0, 1.0])]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, []), (10, [1.0, 2.0])]
    schema = "vec_id long, embedding array<float>, component int, n string"
    rows = spark.createDataFrame([(i, v, 9, "x") for i, v in good + bad], schema)
    found = whitening.whiten(rows).toPandas()
    # the second dimension is constant: two components, five vectors
    assert len(found) == 10 and set(found.component) == {1, 2} and set(found.n) == {5}
    assert found.vec_id.isna().sum() == 2 and found.identity_error.max() < 1e-9
    same = found[found.vec_id == 1].groupby("component").whitened.nunique()
    assert same.tolist() == [1, 1] and len(found[found.vec_id == 1]) == 4
    assert whitening.whiten(rows.limit(0)).collect() == []
    assert whitening.whiten(rows.where("vec_id > 4")).collect() == []
    assert whitening.whiten(rows.where("vec_id = 1")).collect() == []


def test_few_rows_of_many_dimensions(spark):
    vectors = np.random.default_rng(6).normal(size=(5, 20)).astype(np.float32)
    found = whitening.whiten(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA)).toPandas()
    assert set(found.component) == {1, 2, 3, 4} and found.identity_error.max() < 1e-9
