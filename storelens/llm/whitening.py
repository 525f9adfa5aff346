"""Embedding whitening: float32 eigenvectors of a distributed covariance, refined in mixed precision.

Entries are put on an integer grid, so counts, sums and squared deviations are exact at any size.
Two scans fit the model: one adds up the sums, one the covariance of what lies around them, centred
before it is multiplied. Tasks send a matrix each, added up in a shuffle keyed by matrix entry; the
driver holds matrices of the vectors' dimension only.

The covariance's eigenvectors are first taken in float32. Ogita-Aishima iterations then correct
them by matrix multiplications alone: the residuals I - X'X and X'AX are worked out in higher
precision, from products of slices that a double holds exactly, and each iteration about doubles
the right digits. Eigenvalues too close to be told apart at the present accuracy form a cluster; a
sub-solve inside the cluster's subspace, shifted by its mean, separates them for the next iteration.

Defined results: a row whose vector is null or holds a null or non-finite entry takes no part.
Vectors of different lengths are whitened apart, each length with a fit of its own; empty ones have
no component and give no row. Repeated rows and null ids count as rows of their own. Entries whose
grid value lies beyond 2^53 are held there. A deviation beyond a long is null. Components without
variance (below the rounding of the largest eigenvalue) have null ``whitened`` values and take no
part in ``identity_error``; without any variance ``explained`` is null too. Of equal eigenvalues
any orthonormal vectors serve. A component's largest entry is positive. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import list_column, matrices, on_grid

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
LIMIT = 2.0**53
EPS = np.finfo(np.float64).eps
#: A sum is sent in two parts of so many low and the remaining high bits.
LOW_BITS = 26
MAX_ITERATIONS = 30


# --- refinement of eigenvectors ---------------------------------------------------------------


def _slices(a: np.ndarray, axis: int, bits: int, count: int) -> list[np.ndarray]:
    """``a`` as a sum of matrices whose entries are integers of ``bits`` bits times one unit per line."""
    rest, out = a.astype(np.longdouble), []
    for _ in range(count):
        _, exponent = np.frexp(np.max(np.abs(rest), axis=axis, keepdims=True))
        unit = np.ldexp(np.longdouble(1), exponent - bits)
        part = np.rint(rest / unit) * unit
        out.append(part.astype(np.float64))
        rest = rest - part
    return out


def precise_product(a: np.ndarray, b: np.ndarray, count: int = 3) -> np.ndarray:
    """The matrix product beyond double precision: products of slices are exact in double arithmetic."""
    bits = (53 - int(np.ceil(np.log2(max(2, a.shape[1]))))) // 2
    left, right = _slices(a, 1, bits, count), _slices(b, 0, bits, count)
    total = np.zeros((a.shape[0], b.shape[1]), np.longdouble)
    for order in reversed(range(count)):  # small terms first
        for i in range(order + 1):
            total += left[i] @ right[order - i]
    return total


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Positions of values that are chained by distances of at most ``gap``, where there are several."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [group for group in np.split(order, cuts) if len(group) > 1]


def refine_step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima iteration with sub-solves: (vectors, eigenvalues, size of the correction)."""
    ax = precise_product(a, x)
    r = np.eye(len(x)) - precise_product(x.T, x)
    s = precise_product(x.T, ax)
    # Close eigenvalues magnify what is not symmetric, which would cost orthogonality.
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diagonal(s) / (1 - np.diagonal(r))
    off = (s - np.diag(np.diagonal(s))).astype(np.float64)
    gap = 2 * (np.linalg.norm(off) + np.linalg.norm(r.astype(np.float64)) * float(np.max(np.abs(values))))
    distance = values[None, :] - values[:, None]
    apart = np.abs(distance) > gap
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, distance, 1), r / 2).astype(np.float64)
    x = x + x @ e
    size = float(np.max(np.abs(e), initial=0.0))
    for group in _clusters(values.astype(np.float64), gap):
        sub = x[:, group]
        middle = float(values[group].mean())
        inside = precise_product(sub.T, precise_product(a, sub) - middle * sub.astype(np.longdouble)).astype(np.float64)
        top = np.max(np.abs(inside))
        if top > 0:
            _, turn = np.linalg.eigh((inside + inside.T) / (2 * top))
            x[:, group] = sub @ turn
            # What the turn mixes within the cluster; a diagonal block needs none.
            size = max(size, float(np.max(np.abs(inside - np.diag(np.diagonal(inside))))) / float(np.max(np.abs(values))))
    return x, values.astype(np.float64), size


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix, to double precision."""
    size = len(a)
    scale = float(np.max(np.abs(a), initial=0.0))
    if scale == 0:
        return np.zeros(size), np.eye(size)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    best, still = np.inf, 0
    for _ in range(MAX_ITERATIONS):
        x, values, change = refine_step(a, x)
        still = 0 if change < best / 2 else still + 1
        best = min(best, change)
        if change <= 4 * EPS or still > 2:
            break
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x / np.sqrt(np.sum(x * x, axis=0))
    lead = x[np.argmax(np.abs(x), axis=0), np.arange(size)]
    return values[order] * scale, x * np.where(lead < 0, -1.0, 1.0)


# --- sums over all rows -----------------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    """The fit list of one vector length: its count, sums per dimension, eigenvalues and vectors."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def kept(self, k: int) -> int:
        """How many of the first ``k`` components have variance."""
        first = self.values[:k]
        return int(np.sum(first > len(self.values) * EPS * self.values[0])) if len(first) and self.values[0] > 0 else 0

    def projection(self, k: int) -> np.ndarray:
        count = self.kept(k)
        return self.vectors[:, :count] / np.sqrt(self.values[:count])


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly: as longs where they fit, else as Python's integers."""
    largest = max(int(np.max(np.abs(x), initial=0)), -(-max(map(abs, sums), default=0) // n))
    if n * largest < 2**61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _grid(matrix: np.ndarray) -> np.ndarray:
    return on_grid(matrix, SCALE, LIMIT) + SHIFT


def _added(df: DataFrame, task, fields: str, keys: list[str]) -> pa.Table:
    """What ``task`` finds over a partition's batches, added up by ``keys``; a row per key comes to the driver."""
    spark = df.sparkSession
    # One matrix a task: as many tasks as a shuffle has, however many files there are.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = df.coalesce(tasks).mapInArrow(task, fields)
    others = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in others]).toArrow()


def _sums(df: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """(n, S) by vector length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for rows, matrix in matrices(batch.column(0)):
                x = _grid(matrix)
                mine = found.setdefault(x.shape[1], [0, 0, 0])
                mine[0] += len(rows)
                mine[1] += (x >> LOW_BITS).sum(axis=0)
                mine[2] += (x & (2**LOW_BITS - 1)).sum(axis=0)
        for d, (n, high, low) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)],
                ["d", "i", "n", "high", "low"],
            )

    out: dict[int, list] = {}
    for r in _added(df, task, "d long, i long, n long, high long, low long", ["d", "i"]).to_pylist():
        n, sums = out.setdefault(r["d"], [r["n"], [0] * r["d"]])
        sums[r["i"]] = (r["high"] << LOW_BITS) + r["low"]
    return {d: (n, tuple(sums)) for d, (n, sums) in out.items()}


def _gram(df: DataFrame, widths: dict[int, int], rows_of) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(sum of y, sum of y y') by vector length, where ``rows_of(x)`` gives rows y of ``widths`` entries."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, matrix in matrices(batch.column(0)):
                if matrix.shape[1] not in widths:
                    continue
                y = rows_of(_grid(matrix))
                mine = found.setdefault(matrix.shape[1], [0.0, 0.0])
                mine[0] += y.sum(axis=0)
                mine[1] += y.T @ y
        for d, (first, second) in found.items():
            # The sums are one more line under the matrix; of the matrix only the upper half is sent.
            i, j = np.triu_indices(len(first))
            i, j = np.concatenate([i, np.full(len(first), len(first))]), np.concatenate([j, np.arange(len(first))])
            v = np.vstack([second, first])[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), d)), pa.array(i), pa.array(j), pa.array(v)], ["d", "i", "j", "v"])

    table = _added(df, task, "d long, i long, j long, v double", ["d", "i", "j"])
    d, i, j, v = (table[c].to_numpy() for c in ("d", "i", "j", "v"))
    out = {}
    for size, width in widths.items():
        whole = np.zeros((width + 1, width))
        mine = d == size
        whole[i[mine], j[mine]] = v[mine]
        upper = whole[:width]
        out[size] = whole[width], upper + np.triu(upper, 1).T
    return out


def fit(df: DataFrame) -> dict[int, Fit]:
    """The fit of each vector length among the rows of ``df``'s one column."""
    sums = {d: found for d, found in _sums(df).items() if d}

    def centred(x: np.ndarray) -> np.ndarray:
        n, s = sums[x.shape[1]]
        return deviations(x, n, s).astype(np.float64) / n

    out = {}
    for d, (_, gram) in _gram(df, {d: d for d in sums}, centred).items() if sums else ():
        n, s = sums[d]
        covariance = gram / n
        values, vectors = eigen(covariance)
        out[d] = Fit(n, s, values, vectors, float(np.trace(covariance)))
    return out


def identity_errors(df: DataFrame, fits: dict[int, Fit], k: int) -> dict[int, float | None]:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    widths = {d: f.kept(k) for d, f in fits.items()}
    if not any(widths.values()):
        return dict.fromkeys(fits)

    def whitened(x: np.ndarray) -> np.ndarray:
        f = fits[x.shape[1]]
        return (deviations(x, f.n, f.sums).astype(np.float64) / f.n) @ f.projection(k)

    out: dict[int, float | None] = {}
    for d, (first, second) in _gram(df, widths, whitened).items():
        n = fits[d].n
        covariance = second / n - np.outer(first / n, first / n)
        out[d] = float(np.max(np.abs(covariance - np.eye(len(first))))) if len(first) else None
    return out


def whiten(df: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``key``, n, deviation, whitened and explained (arrays by component), identity_error: a row per usable vector."""
    spark = df.sparkSession
    vectors = df.select(df[column].alias("_v"))
    fits = fit(vectors)
    errors = identity_errors(vectors, fits, k)
    longest = np.iinfo(np.int64).max

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in matrices(batch.column(1)):
                f = fits.get(matrix.shape[1])
                if f is None:
                    continue
                off = deviations(_grid(matrix), f.n, f.sums)
                if off.dtype != object and np.max(np.abs(off), initial=0) ** 2.0 * matrix.shape[1] < 2.0**62:
                    squares = pa.array((off * off).sum(axis=1))
                else:
                    exact = (off.astype(object) ** 2).sum(axis=1)
                    squares = pa.array([int(v) if v <= longest else None for v in exact], pa.int64())
                width = min(k, matrix.shape[1])
                z = np.full((len(rows), width), np.nan)
                z[:, : f.kept(k)] = (off.astype(np.float64) / f.n) @ f.projection(k)
                every = list_column(np.arange(len(rows)), len(rows), z, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), matrix.shape[1], np.int32)), squares, every],
                    ["key", "d", "deviation", "whitened"],
                )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[column].alias("_v")).mapInArrow(task, f"key {kind}, d int, deviation long, whitened array<double>")
    shares = [
        (d, f.n, [float(v) / f.trace if f.trace > 0 else None for v in np.maximum(f.values[:k], 0.0)], errors[d])
        for d, f in fits.items()
    ]
    model = spark.createDataFrame(shares, "d int, n long, explained array<double>, identity_error double")
    # A row for each vector length, which the driver held before.
    joined = rows.join(F.broadcast(model), "d")
    return joined.select(F.col("key").alias(key), "n", "deviation", "whitened", "explained", "identity_error")


def components(whitened: DataFrame, key: str = "vec_id") -> DataFrame:
    """``whiten``'s rows taken apart: a row per vector and component, numbered from 1."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_c")
    return whitened.select(key, "n", "deviation", "identity_error", each).select(
        key,
        (F.col("_at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("_c.whitened").alias("whitened"),
        F.col("_c.explained").alias("explained"),
        "identity_error",
    )
