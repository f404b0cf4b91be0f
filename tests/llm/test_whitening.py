"""Whitening: eigenvectors against known ones, the query against exact fractions and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tablewright.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def _orthogonal(d, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    q = q.astype(np.longdouble)
    for _ in range(3):                                     # Newton's iteration for the nearest orthogonal matrix, in long double
        q = q @ (3 * np.eye(d, dtype=np.longdouble) - q.T @ q) / 2
    return q


@pytest.mark.parametrize("values", [
    np.linspace(10, 1, 12), 2.0 ** -np.arange(20), [5, 5 - 1e-7, 5 - 2e-7, 3, 3 - 1e-9, 1, 1e-6], [4, 4, 4, 2, 2, 1], [1, 0, 0], [7.0],
    [1, 1 - 1e-12, 1 - 2e-12, 0.5, 0.5 - 1e-10]])
def test_eigenvectors_of_known_matrices(values):
    values = np.array(values, np.longdouble)
    q = _orthogonal(len(values), len(values))
    a = (q * values) @ q.T
    got, x = whitening.eigenvectors((a + a.T) / 2)
    assert np.abs(got - values).max() < 1e-17 * 50 and np.abs(x.T @ x - np.eye(len(x))).max() < 1e-17
    assert np.abs(a @ x - x * got).max() < 1e-17
    for i, v in enumerate(values):                         # the own vector wherever the eigenvalue stands alone in long double
        if np.sum(np.abs(values - v) < 1e-13) == 1:
            gap = float(min((abs(values - v)[np.arange(len(values)) != i]), default=1))
            assert abs(abs(float(x[:, i] @ q[:, i])) - 1) < 1e-15
            assert np.abs(np.abs(x[:, i]) - np.abs(q[:, i])).max() < max(1e-16, 1e-17 / gap)


def account(rows):
    """n, sums and deviations exactly, by fractions; covariance of the distinct integer vectors."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {k: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for k, (_, v) in enumerate(good)}
    fit = sorted(set(x.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    dev = [(good[k][0], sum((n * a - b) ** 2 for a, b in zip(v, s))) for k, v in x.items()]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s)] for v in fit])
    return n, dev, centred.T @ centred / n, {v: c for v, c in zip(fit, centred)}, x, good


def _check(got, rows, k=16):
    n, dev, cov, centred, x, good = account(rows)
    d = len(cov)
    k = min(k, d)
    assert len(got) == len(good) * k and (got["n"] == n).all()
    assert sorted(set(zip(got["vec_id"].fillna(-1), got["deviation"].astype(object))), key=str) == sorted({(-1 if i is None else i, v) for i, v in dev}, key=str)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    first = got.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    some = {i: x[j] for j, (i, _) in enumerate(good) if i is not None}
    for c in range(k):
        alone = min(np.abs(np.delete(np.linalg.eigvalsh(cov), d - 1 - c) - values[c]), default=1) > 1e-6 * max(values[0], 1)
        mine = np.array([first.loc[i, c + 1] for i in some])
        if values[c] < 1e-9 * max(values[0], 1):
            assert not mine.any()
        elif alone:
            want = np.array([centred[v] @ vectors[:, c] / math.sqrt(values[c]) for v in some.values()])
            assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7
        assert abs(got[got["component"] == c + 1]["explained"].iloc[0] - max(values[c], 0) / max(np.trace(cov), 1e-300)) < 1e-9
    assert (got["identity_error"] <= 1e-9).all()


def test_query_equals_the_account(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.QUERIES["op13_embedding_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    _check(got.toPandas(), rows)


def _frame(spark, data):
    return spark.createDataFrame([(*r, [9], "y") for r in data], "vec_id long, embedding array<float>, x array<int>, component string").repartition(3)


R = np.random.default_rng(3)
SOME = [(i, R.normal(size=5).astype(np.float32).tolist()) for i in range(40)]
ODD = [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0]), (52, [math.nan] * 5), (53, [math.inf, 0.0, 0.0, 0.0, 0.0]), (54, []), (55, [1.0, 2.0])]


def test_odd_rows_copies_and_extra_columns(spark):
    data = SOME + [(200 + i, SOME[0][1]) for i in range(30)] + [(None, SOME[1][1]), (3, SOME[3][1])]
    _check(whitening.whitening_report(_frame(spark, data + ODD)).toPandas(), data)


@pytest.mark.parametrize("data", [[(1, [1.0, 2.0, 3.0])], [(i, [float(i), 1.0, float(-i)]) for i in range(6)]])
def test_components_without_variance(spark, data):
    _check(whitening.whitening_report(_frame(spark, data)).toPandas(), data)


def test_empty_tables(spark):
    for data in ([], ODD[:4], [(1, []), (2, [])]):
        got = whitening.whitening_report(_frame(spark, data))
        assert got.collect() == [] and len(got.columns) == 7


def test_huge_entries_stay_exact(spark):
    data = SOME + [(90, [3e9, -2e12, 0.5, 0.25, 1e15])]
    got = whitening.whitening_report(_frame(spark, data)).toPandas()
    _, dev, _, _, _, _ = account(data)
    want = {i: v if v < 1 << 63 else None for i, v in dev}
    assert {r.vec_id: None if r.deviation != r.deviation or r.deviation is None else int(r.deviation) for r in got.itertuples()}.keys() == want.keys()
    assert got[got["vec_id"] == 90]["deviation"].isna().all() and (got["identity_error"] < 1e-4).all()
    assert whitening.whitening_report(_frame(spark, SOME + [(91, [1e38] * 5)])).count() == 41 * 5
