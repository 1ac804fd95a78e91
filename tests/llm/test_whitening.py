"""Whitening against numpy's eigenvectors of exact covariances, and awkward rows."""

from fractions import Fraction

import numpy as np
import pytest

from barlake.llm import queries, whitening


def exact_covariance(x):
    """The covariance of rows of whole numbers, in fractions until the end, and each row's deviation."""
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    c = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in c), n**3)) for j in range(d)] for i in range(d)])
    return v, c, [sum(a * a for a in r) for r in c]


def test_query_equals_eigenvectors_of_the_exact_covariance(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in r["embedding"]] for r in rows]
    v, centred, deviations = exact_covariance(x)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = {}
    out = queries.op12_whitening(spark, sf_dir)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    for r in out.collect():
        got[r["vec_id"], r["component"]] = r
    assert len(got) == 32 * len(rows)
    n = len(rows)
    w = np.array([[got[r["vec_id"], k]["whitened"] for k in range(1, 33)] for r in rows])
    want = np.array(centred, float) / n @ vectors[:, :32] / np.sqrt(values[:32])
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-8
    for r, deviation in zip(rows, deviations, strict=True):
        one = got[r["vec_id"], 1]
        assert (one["n"], one["deviation"]) == (n, deviation) and one["identity_error"] < 1e-12
    assert [got[rows[0]["vec_id"], k]["explained"] for k in range(1, 33)] == pytest.approx(list(values[:32] / values.sum()), rel=1e-10)


def test_factor_gives_the_scatter_and_its_eigenvalues():
    rng = np.random.default_rng(5)
    for shape in [(40, 7), (5, 9), (300, 24)]:
        x = rng.normal(size=shape) * np.logspace(0, 3, shape[1])
        a = x.T @ x
        low = whitening.pivoted_cholesky(a)
        assert low.shape[1] == min(shape) and np.allclose(low @ low.T, a, rtol=1e-12, atol=1e-9 * a.max())
        turned = whitening.orthogonalised(low)
        norms = (turned**2).sum(axis=0)
        assert np.allclose(norms, np.linalg.eigvalsh(a)[::-1][: min(shape)], rtol=1e-9)
        unit = turned / np.sqrt(norms)
        assert np.abs(unit.T @ unit - np.eye(len(norms))).max() < 1e-12
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_exact_sums_of_any_size():
    rng = np.random.default_rng(6)
    for most in (10, 1 << 30, 1 << 60):
        y = rng.integers(-most, most, size=(20_000 if most == 10 else 50, 5))
        plain = [[int(v) for v in r] for r in y]
        assert whitening.exact_sums(y).tolist() == [sum(c) for c in zip(*plain, strict=True)]
        assert whitening.exact_products(y).tolist() == [[sum(r[i] * r[j] for r in plain) for j in range(5)] for i in range(5)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, -2.0]), (1, [0.5, 1.0, -2.0]), (None, [1.5, 0.0, 0.25]), (2, None), (3, [1.0, None, 1.0]), (4, [nan, 1.0, 1.0]), (5, [1.0, inf, 1.0]), (6, []), (7, [1.0, 2.0]), (8, [0.0, 3.0, 1000.0]), (9, [-7.25, 0.125, 3.0])]
    df = spark.createDataFrame([(i, v, "a", 2.0) for i, v in rows], "vec_id long, embedding array<float>, whitened string, deviation double")
    model = whitening.fit(df)
    out = whitening.whitened(df, model).collect()
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for i, v in rows if v and len(v) == 3 and all(c is not None and np.isfinite(c) for c in v)]
    v, centred, deviations = exact_covariance(x)
    assert model.n == 5 and sorted(r["deviation"] for r in out) == sorted(deviations)
    assert np.allclose(model.eigenvalues, np.linalg.eigvalsh(v)[::-1])
    w = np.array([r["whitened"] for r in out])
    assert np.abs(w.T @ w / 5 - np.eye(3)).max() < 1e-9
    assert whitening.identity_error(whitening.whitened(df, model)) < 1e-9
    same = whitening.fit(df.limit(2))
    assert len(same.eigenvalues) == 0 and [r["whitened"] for r in whitening.whitened(df.limit(2), same).collect()] == [[], []]
    empty = whitening.fit(df.limit(0))
    assert empty.n == 0 and whitening.whitened(df.limit(0), empty).collect() == [] and whitening.identity_error(whitening.whitened(df.limit(0), empty)) == 0
    dealt = whitening.fit(df.repartition(7))
    assert np.array_equal(dealt.components, model.components)
    with pytest.raises(Exception, match="too large"):
        whitening.fit(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"))
