import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import whitening as w
from storelens.llm.common import table

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(matrix, k):
    """(n, exact deviations, whitened up to sign, explained) by one dense solve."""
    x = np.floor(64 * matrix.astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    y = off / n
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, (off * off).sum(axis=1), y @ vectors / np.sqrt(values), values / np.trace(v)


def spectrum(values, rng):
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(0.1, 1, 40),
        np.r_[[1.0] * 5, 1 + 1e-9, 1 + 1e-12, np.linspace(0.1, 0.9, 30)],  # clusters
        10.0 ** -np.linspace(0, 12, 40),
        np.r_[np.zeros(20), np.linspace(0.1, 1, 12)],
        np.ones(16),
        np.array([3.0]),
    ],
)
def test_refined_vectors_reach_double_precision(values):
    a = spectrum(values, np.random.default_rng(1))
    found, x = w.eigen(a)
    assert np.max(np.abs(np.sort(values)[::-1] - found)) < 2e-15 * np.max(values)
    assert np.max(np.abs(x.T @ x - np.eye(len(a)))) < 5e-15
    assert np.max(np.abs(w.precise_product(a, x) - x * found)) < 1e-15 * np.max(values) * 4


def test_float32_start_alone_would_not_do():
    a = spectrum(np.linspace(0.1, 1, 40), np.random.default_rng(2))
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    errors = []
    for _ in range(4):
        errors.append(np.max(np.abs(x.T @ a @ x - np.diag(np.diagonal(x.T @ a @ x)))))
        x = w.refine_step(a, x)[0]
    assert errors[0] > 1e-8 and errors[1] < 1e-10 and errors[3] < 1e-15


def test_precise_product_is_beyond_double():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(6, 50)), rng.normal(size=(50, 6))
    b[0] += 1e12  # what a plain product rounds away
    a[:, 0] = 1.0
    exact = a.astype(np.longdouble) @ b.astype(np.longdouble)
    assert np.max(np.abs(w.precise_product(a, b) - exact)) < np.max(np.abs(a @ b - exact)) / 20


def test_whole_table_against_a_dense_solve(spark):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = df.orderBy("vec_id").collect()
    n, deviation, white, explained = plain(np.array([r["embedding"] for r in rows]), 32)
    found = w.whiten(df).orderBy("vec_id").collect()
    assert [r["deviation"] for r in found] == deviation.tolist() and {r["n"] for r in found} == {n}
    got = np.array([r["whitened"] for r in found])
    signs = np.sign(np.sum(got * white, axis=0))
    assert np.max(np.abs(got - white * signs)) < 1e-8
    assert np.allclose(found[0]["explained"], explained, rtol=1e-10)
    covariance = np.cov(got.T, bias=True)
    assert np.max(np.abs(covariance - np.eye(32))) < 1e-10 and {r["identity_error"] < 1e-10 for r in found} == {True}


def test_odd_rows_and_clashing_names(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=3).tolist(), 1) for i in range(20)]
    bad = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [1.0, float("nan"), 2.0], 1), (103, [1.0, float("inf"), 2.0], 1)]
    more = [good[0], (None, good[1][1], None), (104, [], 1)]  # a repeated row, a null id, an empty vector
    df = spark.createDataFrame(good + bad + more, VECTORS).withColumns({"n": F.lit("x"), "d": F.lit(1), "whitened": F.lit(2)})
    out = w.components(w.whiten(df))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert len(rows) == 3 * 22 and {r["n"] for r in rows} == {22} and {r["component"] for r in rows} == {1, 2, 3}
    assert sum(r["vec_id"] is None for r in rows) == 3 and sum(r["vec_id"] == 0 for r in rows) == 6
    assert {r["identity_error"] < 1e-12 for r in rows} == {True}
    assert sum(r["explained"] for r in rows) == pytest.approx(22)


def test_lengths_are_whitened_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3 + i % 2).tolist(), 1) for i in range(40)]
    found = w.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(len(r["whitened"]), r["n"]) for r in found} == {(3, 20), (4, 20)}
    even = [r for r in found if len(r["whitened"]) == 3]
    _, _, white, _ = plain(np.array([v for _, v, _ in rows if len(v) == 3], np.float32), 3)
    assert np.allclose(np.abs([r["whitened"] for r in sorted(even, key=lambda r: r["vec_id"])]), np.abs(white), atol=1e-9)


def test_dimensions_without_variance(spark):
    rows = [(i, [float(i % 5), 2.0, float(i % 5)], 1) for i in range(10)]
    found = w.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in found)
    assert found[0]["explained"][0] == pytest.approx(1.0) and found[0]["identity_error"] < 1e-12
    same = w.whiten(spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(4)], VECTORS)).collect()
    assert all(r["whitened"] == [None, None] and r["explained"] == [None, None] and r["identity_error"] is None and r["deviation"] == 0 for r in same)


def test_very_large_entries_stay_exact(spark):
    rows = [(0, [1e30, 0.0], 1), (1, [-1e30, 1.0], 1), (2, [1e12, 2.0], 1)]
    found = {r["vec_id"]: r for r in w.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    assert found[0]["deviation"] is None and found[0]["identity_error"] < 1e-6
    x = np.array([[2**20, 3], [5, 2**20]])
    n, sums = 2**50, (7, 11)
    assert (w.deviations(x, n, sums) == [[a * n - s for a, s in zip(row, sums, strict=True)] for row in x.tolist()]).all()


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1)]):
        assert w.components(w.whiten(spark.createDataFrame(rows, VECTORS))).collect() == []
