"""Whitening against a direct eigendecomposition of the covariance."""

import numpy as np
import pytest

from muster.llm import whitening as W


def direct(vectors):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    far = [sum((int(n) * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return centred, values[::-1], axes[:, ::-1], np.trace(cov), far


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("d,n", [(3, 40), (20, 200), (40, 90)])
def test_components_are_the_covariances(spark, d, n):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(n, d)) * np.linspace(3, 0.2, d)).tolist()
    centred, values, axes, trace, far = direct(vectors)
    p = W.whiten(frame(spark, vectors)).toPandas().sort_values(["vec_id", "component"])
    k = min(8, d)
    assert len(p) == n * k and p.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = p["whitened"].to_numpy().reshape(n, k)
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-9
    assert np.allclose(p["explained"].to_numpy()[:k], values[:k] / trace, rtol=1e-9) and p["identity_error"].max() < 1e-10
    assert p["deviation"].to_numpy().reshape(n, k)[:, 0].tolist() == far and set(p["n"]) == {n}


def test_equal_and_missing_deviations(spark):
    rng = np.random.default_rng(2)
    square = [[float(a), float(b), 7.0] for a in (0, 1) for b in (0, 1)]  # two equal values, one without deviation
    p = W.whiten(frame(spark, square)).toPandas()
    assert sorted(set(p["component"])) == [1, 2] and p["identity_error"].max() < 1e-12
    many = rng.choice([-1.0, 1.0], (600, 24)).tolist()
    p = W.whiten(frame(spark, many)).toPandas()
    _, values, _, trace, _ = direct(many)
    assert np.allclose(sorted(set(p["explained"]), reverse=True), values[:8] / trace, rtol=1e-9)


def test_odd_rows_and_tables(spark):
    good = [[1.0, 2.0], [3.0, 1.0], [3.0, 1.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [2.0**40, 1.0]]
    df = frame(spark, [*good, *bad], [5, None, None, *range(10, 17)]).withColumnsRenamed({}).selectExpr("*", "1 AS x", "2 AS n", "3 AS component")
    p = W.whiten(df).toPandas()
    assert len(p) == 3 * 1 and p["vec_id"].isna().sum() == 2 and set(p["n"]) == {3}
    for empty in (frame(spark, good).limit(0), frame(spark, [None, []]), frame(spark, [[1.0, 2.0]]), frame(spark, [[1.0, 2.0]] * 3)):
        assert W.whiten(empty).count() == 0


def test_deviations_are_exact_beyond_64_bits_inside():
    x = np.array([[2**43, 100_000], [100_001, 2**42]], np.int64)
    n, sums = 10**9, [3 * 10**20, 10**19 + 7]
    got = W.squared_distances(x, n, sums)
    assert got == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]


def test_the_registered_query(spark):
    p = W.op12_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert p["identity_error"].max() < 1e-4 and p.groupby("vec_id")["component"].max().eq(8).all()
