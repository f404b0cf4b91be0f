"""Embedding whitening with mixed-precision refinement of the eigenvectors.

1. Entries become integers x = floor(64 * c) + 1000000.  The fit list is every
   distinct x vector once (a grouped aggregate, folded map-side), so copies of
   one vector weigh as one, however many there are.
2. Sums and the matrix of products are exact: tasks centre x on the integer
   next to each mean, multiply in numpy (in float64 where that is exact, in
   integers else) and Spark adds the parts as decimals.  The driver gets d sums
   and d * (d + 1) / 2 products for dimension d, never a row.
3. The eigenvectors start from a float32 solve and are corrected by
   Ogita-Aishima iterations, which are matrix products only: first in float64,
   then in long double.  Eigenvalues nearer than the error bound are clusters;
   the shifted matrix is projected on a cluster, solved there, and the
   iterations go on, until corrections vanish.
4. Rows are projected without a shuffle.  ``identity_error`` comes from the
   whitened fit list itself, in another pass.

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped, and so are vectors of another length than the most frequent one
(of equally frequent ones the longest).  |64 * c| beyond 2**61 counts as 2**61.
Null or repeated vec_ids are rows like others.  A component without variance
(fewer different vectors than components, constant entries) has whitened and
explained 0 and no part in ``identity_error``.  ``deviation`` is null where it
exceeds a long.  An empty table, or one with only empty vectors, gives no rows.
Other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

#: Fixed values of the integer vectors.
SCALE, OFFSET = 64, 1_000_000
_LIMB = 1 << 60
_LONG = np.longdouble


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x array<bigint>) of the rows that take part, all of one length."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    level = F.lit(float(1 << 61))
    x = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, level), -level)) + F.lit(OFFSET))
    kept = rows.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size("x") == (lengths["d"] if lengths else -1))


def _matrix(batch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


# ---------------------------------------------------------------- exact sums

def _sums(d: int):
    def run(batches):
        import pyarrow as pa
        n, total = 0, np.zeros(d, object)
        for b in batches:
            x = _matrix(b, d)
            n += len(x)
            if len(x):
                small = np.abs(x).max() < (1 << 62) // len(x)
                total = total + (x.sum(0) if small else x.astype(object).sum(0)).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(t) for t in total])], ["i", "n", "s"])
    return run


def _products(d: int, centre: np.ndarray):
    def run(batches):
        import pyarrow as pa
        total, seen = np.zeros((d, d), object), False
        for b in batches:
            y = _matrix(b, d) - centre
            for a in range(0, len(y), 4096):
                part, seen = y[a:a + 4096], True
                size = int(np.abs(part).max()) ** 2 * len(part)
                if size < 1 << 53:                         # every partial sum is an integer that float64 holds
                    f = part.astype(np.float64)
                    total = total + (f.T @ f).astype(np.int64).astype(object)
                else:
                    part = part if size < 1 << 63 else part.astype(object)
                    total = total + (part.T @ part).astype(object)
        if seen:
            i, j = np.triu_indices(d)
            high, low = zip(*(divmod(int(v), _LIMB) for v in total[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in high]),
                                              pa.array([str(v) for v in low])], ["i", "j", "high", "low"])
    return run


# ---------------------------------------------------------------- eigenvectors

def _correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step: corrected vectors, eigenvalues, size of the correction and bound of nearness."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2                    # rounding that is not symmetric would cost orthogonality
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    bound = 2 * (np.sqrt((off * off).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > bound
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, float(np.abs(e).max()), float(bound)


def _solve_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, bound: float) -> np.ndarray:
    """Sub-solves: vectors of neighbouring eigenvalues within ``bound`` are turned by the eigenvectors of the shifted, projected matrix."""
    order = np.argsort(-values)
    x, values = x[:, order].copy(), values[order]
    first = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k - 1] - values[k] > bound:
            if k - first > 1:
                own = x[:, first:k]
                shifted = a - np.eye(len(a), dtype=a.dtype) * values[first:k].mean()
                t = own.T @ (shifted @ own)
                size = np.abs(t).max()
                if size > 0:
                    _, turn = np.linalg.eigh(((t + t.T) / (2 * size)).astype(np.float64))
                    x[:, first:k] = own @ turn[:, ::-1].astype(a.dtype)
            first = k
    return x


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of symmetric ``a`` in its own precision from approximate vectors ``x``; falling values.

    Ends when a correction is at the rounding error of the type, or when
    corrections no longer fall after a sub-solve.
    """
    least, best = float(np.finfo(a.dtype).eps) * len(a), np.inf
    x = x.astype(a.dtype)
    for _ in range(rounds):
        x, values, size, bound = _correct(a, x)
        falling = np.sort(values)[::-1]
        near = len(values) > 1 and bool((falling[:-1] - falling[1:] <= bound).any())
        if near:
            x = _solve_clusters(a, x, values, bound)
        if size <= least or (size >= best / 2 and size < 1e-3 and not near):
            break
        best = min(best, size)
    x, values, _, _ = _correct(a, x)
    for _ in range(2):                                     # turns inside a tight cluster cost orthogonality in second order
        r = np.eye(len(a), dtype=a.dtype) - x.T @ x
        x = x + x @ (r + r.T) / 4
    order = np.argsort(-values)
    return values[order], x[:, order]


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric long double matrix: float32, then float64, then long double."""
    size = np.abs(v).max() if v.size else 0
    if not size:
        return np.zeros(len(v), v.dtype), np.eye(len(v), dtype=v.dtype)
    a = v / size
    _, x = np.linalg.eigh(a.astype(np.float32))
    for kind in (np.float64, v.dtype):
        values, x = refine(a.astype(kind), x[:, ::-1] if kind is np.float64 else x)
    x = x / np.sqrt((x * x).sum(0))
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(len(x))] < 0, -1, 1)
    return values * size, x


# ---------------------------------------------------------------- model

@dataclass
class Whitening:
    """What rows need: ``weights`` turn x - ``centre`` - ``rest`` into whitened components."""
    n: int
    centre: np.ndarray                                     # integers next to the means
    surplus: list[int]                                     # exact sums of x - centre
    rest: np.ndarray                                       # surplus / n
    components: np.ndarray                                 # unit vectors in columns
    values: np.ndarray
    explained: np.ndarray
    weights: np.ndarray

    @property
    def d(self) -> int:
        return len(self.centre)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.rest) @ self.weights

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n * x - S)**2; None beyond a long."""
        y = x - self.centre
        most = (int(np.abs(y).max()) if y.size else 0) * self.n + max(map(abs, self.surplus), default=0)
        if most ** 2 * max(1, self.d) < 1 << 63:
            z = y * self.n - np.array(self.surplus, np.int64)
            return (z * z).sum(1).tolist()
        z = y.astype(object) * self.n - np.array(self.surplus, object)
        return [s if s < 1 << 63 else None for s in (z * z).sum(1)]


def fit_whitening(vectors: DataFrame, components: int = 16) -> tuple[Whitening | None, DataFrame]:
    """The model and its fit list, of rows of :func:`integer_vectors`; None for no vectors or empty ones."""
    fit = cut_lineage(vectors.select("x").distinct())
    one = fit.select(F.size("x").alias("d")).first()
    if one is None or not one["d"]:
        return None, fit
    d = one["d"]
    sums = (fit.mapInArrow(_sums(d), "i int, n long, s string").groupBy("i")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    n, total = sums[0]["n"], [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]
    centre = [(2 * s + n) // (2 * n) for s in total]
    surplus = [s - n * c for s, c in zip(total, centre)]
    products = (fit.mapInArrow(_products(d, np.array(centre, np.int64)), "i int, j int, high string, low string").groupBy("i", "j")
                .agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect())
    v = np.zeros((d, d), _LONG)
    for r in products:                                     # n * n * covariance, an integer, then one rounding
        exact = n * (int(r["high"]) * _LIMB + int(r["low"])) - surplus[r["i"]] * surplus[r["j"]]
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = _LONG(exact) / _LONG(n * n)
    values, x = eigenvectors(v)
    k = min(components, d)
    values, x, trace = values[:k], x[:, :k], np.trace(v)
    varies = values > np.abs(v).max() * d * 2.0 ** -60
    values = np.where(varies, values, 0)
    weights = np.where(varies, x / np.sqrt(np.where(varies, values, 1)), 0)
    explained = values / trace if trace > 0 else np.zeros(k)
    model = Whitening(n, np.array(centre, np.int64), surplus, np.array([float(Fraction(s, n)) for s in surplus]), x.astype(np.float64),
                      values.astype(np.float64), explained.astype(np.float64), weights.astype(np.float64))
    return model, fit


def _moments(model: Whitening):
    def run(batches):
        import pyarrow as pa
        k, seen = model.weights.shape[1], False
        total = np.zeros((k + 1, k))
        for b in batches:
            w = model.whiten(_matrix(b, model.d))
            total[0] += w.sum(0)
            total[1:] += w.T @ w
            seen = seen or len(w) > 0
        if seen:
            i, j = (x.ravel() for x in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(i - 1, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])
    return run


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = model.weights.shape[1]
    sums = np.zeros((k + 1, k))
    for r in fit.mapInArrow(_moments(model), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r["i"] + 1, r["j"]] = r["v"]
    mean = sums[0] / model.n
    left = sums[1:] / model.n - np.outer(mean, mean) - np.diag((model.values > 0).astype(float))
    return float(np.abs(left).max())


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, whitened array<double>, deviation) of every row."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            x = _matrix(b, model.d)
            w = model.whiten(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), flat, pa.array(model.deviation(x), pa.int64())], ["vec_id", "whitened", "deviation"])

    return vectors.mapInArrow(run, "vec_id long, whitened array<double>, deviation long")


_REPORT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening_report(rows: DataFrame, components: int = 16) -> DataFrame:
    """A row for each vector and component."""
    vectors = integer_vectors(rows)
    model, fit = fit_whitening(vectors, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], _REPORT)
    error = identity_error(fit, model)
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    return (whiten(vectors, model).select("vec_id", F.posexplode("whitened").alias("p", "whitened"), "deviation")
            .select("vec_id", (F.col("p") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(explained, F.col("p") + 1).alias("explained"), F.lit(error).alias("identity_error")))
