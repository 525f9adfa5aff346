"""K-Means customer segments on standardised recency, frequency and order value.

All restarts advance together: one pass over the stored points gives every restart's sums per cluster,
and restarts that have converged drop out of the next pass. The driver holds centres only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.exprs import PLACES
from storelens.operators.customers import PERSON
from storelens.session import materialize

INPUTS = ("recency_days", "frequency", "monetary")
# Fixed value: far above what the fits need, which stop when centres hardly move.
MAX_ITER = 300
#: A restart has converged when its centres' squared moves add up to no more, in squared standard deviations.
TOLERANCE = 1e-4
#: About so many points at most are drawn for the starts.
START_ROWS = 20_000


def _standardised(df: DataFrame, inputs: Sequence[str]) -> list[Column]:
    """The inputs in standard deviations from their mean; a constant one is 0."""
    doubles = {c: F.col(c).cast("double") for c in inputs}
    row = df.agg(*[f(x).alias(f"{n}_{c}") for c, x in doubles.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))]).head()
    return [((x - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"]) if row[f"s_{c}"] else x * 0.0) for c, x in doubles.items()]


def _squared(x: Sequence[Column], centre: Sequence[Column | float]) -> Column:
    return sum(((a - b) * (a - b) for a, b in zip(x, centre, strict=True)), F.lit(0.0))


def _nearest(x: Sequence[Column], centres: Sequence[Sequence[Column | float]]) -> Column:
    """(squared distance, number) of the nearest centre; of equally near ones the first."""
    each = [F.struct(_squared(x, c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]
    return F.least(*each) if len(each) > 1 else each[0]


def _plain_lloyd(x: np.ndarray, centres: np.ndarray, tolerance: float) -> np.ndarray:
    for _ in range(MAX_ITER):
        near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        sizes = np.bincount(near, minlength=len(centres))[:, None]
        sums = np.stack([np.bincount(near, column, len(centres)) for column in x.T], axis=1)
        moved = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
        shift = ((moved - centres) ** 2).sum()
        centres = moved
        if shift <= tolerance:
            break
    return centres


def starts(points: DataFrame, key: str, columns: Sequence[str], k: int, seeds: Sequence[int], rows: int = START_ROWS) -> np.ndarray:
    """Starting centres of every seed, shape (seeds, k, columns), from at most about ``rows`` points.

    The points, chosen by a hash of the id, are few enough for the driver. Each seed spreads its centres over
    them (a next centre is drawn with a chance in proportion to its squared distance from those so far)
    and refines them there, so that few passes over all points remain.
    """
    total = points.count()
    some = points if total <= rows else points.where(F.pmod(F.xxhash64(key), F.lit(total)) < rows)
    x = np.array([r[1:] for r in some.orderBy(key, *columns).select(key, *columns).collect()], float)
    out = []
    for seed in seeds:
        draw = np.random.default_rng(seed)
        centres = [x[draw.integers(len(x))]]
        while len(centres) < k:
            far = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
            chance = far / far.sum() if far.sum() > 0 else None
            centres.append(x[draw.choice(len(x), p=chance)])
        out.append(_plain_lloyd(x, np.array(centres), TOLERANCE))
    return np.array(out)


def _pass(points: DataFrame, columns: Sequence[str], centres: dict[int, np.ndarray]) -> dict[int, dict[int, tuple[int, float, list[float]]]]:
    """By restart and cluster: rows, sum of squared distances, sums of coordinates.

    Each task sends a row per restart and cluster; its batches meet all restarts at once.
    """
    d, numbers = len(columns), sorted(centres)
    k = len(centres[numbers[0]])
    every = np.concatenate([centres[r] for r in numbers])
    names = ["r", "k", "rows", "cost", *[f"s{i}" for i in range(d)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(numbers), k, 2 + d))
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)], axis=1)
            squared = sum((x[:, i : i + 1] - every[:, i]) ** 2 for i in range(d)).reshape(len(x), len(numbers), k)
            near = squared.argmin(axis=2)
            for n in range(len(numbers)):
                least = squared[np.arange(len(x)), n, near[:, n]]
                for column, weights in enumerate([None, least, *x.T]):
                    sums[n, :, column] += np.bincount(near[:, n], weights, k)
        flat = sums.reshape(-1, 2 + d)
        arrays = [pa.array(np.repeat(numbers, k)), pa.array(np.tile(np.arange(k), len(numbers))), pa.array(flat[:, 0].astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(flat[:, 1 + i].copy()) for i in range(1 + d)]], names)

    found = points.select(*columns).mapInArrow(run, f"r long, k long, rows long, {', '.join(f'{n} double' for n in names[3:])}")
    out: dict[int, dict[int, tuple[int, float, list[float]]]] = {r: {} for r in centres}
    for row in found.groupBy("r", "k").agg(*[F.sum(n).alias(n) for n in names[2:]]).collect():  # restarts x clusters
        if row["rows"]:
            out[row["r"]][row["k"]] = (row["rows"], row["cost"], [row[f"s{i}"] for i in range(d)])
    return out


def lloyd(points: DataFrame, columns: Sequence[str], first: np.ndarray, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, cost, iterations) of every restart; a cluster that loses its points keeps its centre."""
    centres = {r: c.copy() for r, c in enumerate(first)}
    live, iterations = set(centres), np.zeros(len(first), int)
    for _ in range(max_iter):
        if not live:
            break
        sums = _pass(points, columns, {r: centres[r] for r in sorted(live)})
        for r in sorted(live):
            old = centres[r].copy()
            for k, (rows, _, total) in sums[r].items():
                centres[r][k] = np.array(total) / rows
            iterations[r] += 1
            if np.sum((centres[r] - old) ** 2) <= tolerance:
                live.discard(r)
    cost = _pass(points, columns, centres)
    return np.stack([centres[r] for r in range(len(first))]), np.array([sum(c for _, c, _ in cost[r].values()) for r in range(len(first))]), iterations


def kmeans_segments(
    rfm: DataFrame, k: int = 4, seeds: Sequence[int] = tuple(range(42, 52)), max_iter: int = MAX_ITER, key: str = PERSON
) -> DataFrame:
    """``rfm`` with its ``cluster``; of several seeded fits the tightest one is kept.

    Customers lacking one of the inputs take no part and have no cluster.
    """
    complete = rfm.dropna(subset=list(INPUTS))
    scaled = _standardised(complete, INPUTS)
    columns = [f"x{i}" for i in range(len(INPUTS))]
    points = materialize(complete.select(key, *[x.alias(c) for x, c in zip(scaled, columns, strict=True)]))
    if points.isEmpty():
        return rfm.withColumn("cluster", F.lit(None).cast("int"))
    centres, cost, iterations = lloyd(points, columns, starts(points, key, columns, k, seeds), max_iter)
    best = int(np.argmin(cost))
    if iterations[best] >= max_iter:
        raise RuntimeError(f"no convergence within {max_iter} iterations")
    cluster = _nearest(scaled, centres[best].tolist())["k"]
    return rfm.withColumn("cluster", F.when(F.concat(*[F.col(c).cast("string") for c in INPUTS]).isNotNull(), cluster))


def cluster_summary(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("recency_days").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("monetary").alias("avg_monetary"),
    )


def name_clusters(summary: DataFrame) -> DataFrame:
    """Add ``segment`` to the few summary rows.

    Highest order value first, then the highest frequency among the rest. If two are left
    they are told apart by recency; any other remainder is numbered.
    """
    by_value = Window.orderBy(F.desc("avg_monetary"), "cluster")
    ranked = summary.withColumn("_value", F.row_number().over(by_value)).withColumn(
        "_clusters", F.count(F.lit(1)).over(Window.partitionBy())
    )
    rest_first = (F.col("_value") == 1).cast("int")
    ranked = ranked.withColumn(
        "_often", F.row_number().over(Window.orderBy(rest_first, F.desc("avg_frequency"), "cluster"))
    )
    tail = ((F.col("_value") == 1) | (F.col("_often") == 1)).cast("int")
    ranked = ranked.withColumn("_old", F.row_number().over(Window.orderBy(tail, F.desc("avg_recency"), "cluster")))
    segment = (
        # The names of segments.
        F.when(F.col("_value") == 1, "High value buyers")
        .when(F.col("_often") == 1, "Repeat buyers")
        .when((F.col("_clusters") == 4) & (F.col("_old") == 1), "Dormant one-time buyers")
        .when((F.col("_clusters") == 4) & (F.col("_old") == 2), "Recent one-time buyers")
        .otherwise(F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    )
    return ranked.withColumn("segment", segment).drop("_value", "_often", "_old", "_clusters")


def named_segments(clustered: DataFrame) -> DataFrame:
    """Every customer with the name of its cluster."""
    names = name_clusters(cluster_summary(clustered)).select("cluster", "segment")
    return clustered.join(F.broadcast(names), "cluster")


def cluster_profile(clustered: DataFrame) -> DataFrame:
    averages = ("avg_recency", "avg_frequency", "avg_monetary")
    return (
        name_clusters(cluster_summary(clustered))
        .select("segment", "customers", *[F.round(c, PLACES).alias(c) for c in averages])
        .orderBy(F.desc("customers"), "segment")
    )


def sample_n(df: DataFrame, key: str, n: int = 5000, seed: int = 42) -> DataFrame:
    """A repeatable random sample of at most ``n`` rows."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
