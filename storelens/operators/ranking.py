"""Global order without a single-task window.

A rank, ntile or running total over all customers has no PARTITION BY, which Spark would
run in one task. Here rows are range-partitioned on the full sort key, sorted inside
their partition and written once; the range bucket and the position inside it are stored
with the row. Per-bucket sizes, at most one row per shuffle partition, then turn local
positions into global ones. Where only some positions are wanted, such as those of quantiles or the
first rows of tiles, one such table serves several columns, and the rest of the rows never moves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from storelens.functions.exprs import bin_by_cuts
from storelens.session import materialize

# monotonically_increasing_id() holds the partition above bit 33 and the row below it.
_ROW_BITS = 33


def _range_stored(df: DataFrame, keys: Sequence[Column], buckets: int | None) -> DataFrame:
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    return (
        materialize(placed)
        .withColumn("_bucket", F.shiftright("_pos", _ROW_BITS).cast("int"))
        .withColumn("_row", F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_pos")
    )


def _with_prefix(sizes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums and totals over the bucket table (one row per bucket)."""
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    columns = [F.col("_bucket")]
    for name in names:
        zero = F.lit(0).cast(sizes.schema[name].dataType)
        columns.append(F.coalesce(F.sum(name).over(before), zero).alias(f"{name}_before"))
        columns.append(F.sum(name).over(every).alias(f"{name}_total"))
    return sizes.select(columns)


def global_rank(
    df: DataFrame,
    order_cols: Sequence[Column],
    unique_tiebreak: str,
    buckets: int | None = None,
) -> DataFrame:
    """``df`` with ``rn`` (1-based position in the given order) and ``n`` (row count).

    The unique tie-break is part of the range key, so one very frequent value is spread
    over several buckets.
    """
    stored = _range_stored(df, [*order_cols, F.col(unique_tiebreak)], buckets)
    sizes = stored.groupBy("_bucket").agg(F.count(F.lit(1)).alias("rows"))
    prefix = _with_prefix(sizes, ["rows"])
    return stored.join(F.broadcast(prefix), "_bucket").select(
        *df.columns,
        (F.col("rows_before") + F.col("_row") + 1).cast("long").alias("rn"),
        F.col("rows_total").cast("long").alias("n"),
    )


def ntile_of(rn: Column, n: Column, k: int) -> Column:
    """SQL ``NTILE(k)`` from a global position: the first ``n mod k`` tiles get one row more."""
    small = F.floor(n / k)
    extra = n % k
    in_large = extra * (small + 1)
    large_tile = F.floor((rn - 1) / (small + 1)) + 1
    small_tile = extra + F.floor((rn - 1 - in_large) / F.nullif(small, F.lit(0))) + 1
    return F.when(rn <= in_large, large_tile).otherwise(small_tile).cast("int")


def _value_counts(df: DataFrame, value: str) -> DataFrame:
    """Distinct non-null values with their row counts: a value shared by many rows becomes a single row."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def running_sums(df: DataFrame, key: Column, names: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``df``, whose ``key`` is unique, with ``<name>_cum`` (running sum in key order) and ``<name>_total``."""
    stored = _range_stored(df, [key], buckets)
    prefix = _with_prefix(stored.groupBy("_bucket").agg(*[F.sum(n).alias(n) for n in names]), names)
    running = Window.partitionBy("_bucket").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = stored.select("*", *[F.sum(n).over(running).alias(f"{n}_inside") for n in names])
    return local.join(F.broadcast(prefix), "_bucket").select(
        *df.columns,
        *[(F.col(f"{n}_before") + F.col(f"{n}_inside")).alias(f"{n}_cum") for n in names],
        *[f"{n}_total" for n in names],
    )


def cumulative_values(
    df: DataFrame, value: str, descending: bool = False, buckets: int | None = None
) -> DataFrame:
    """One row per distinct value: ``value, rows, cum_rows, cum_sum, n, total``.

    ``cum_sum`` includes every row sharing the value, as an ordered SQL window with the
    default RANGE frame does.
    """
    counts = _value_counts(df, value).withColumn("amount", F.col("value") * F.col("rows"))
    key = F.col("value").desc() if descending else F.col("value").asc()
    return running_sums(counts, key, ["rows", "amount"], buckets).select(
        "value",
        "rows",
        F.col("rows_cum").cast("long").alias("cum_rows"),
        F.col("amount_cum").alias("cum_sum"),
        F.col("rows_total").cast("long").alias("n"),
        F.col("amount_total").alias("total"),
    )


def entries_at(
    entries: DataFrame, order: Sequence[str], wanted: Callable[[int], Sequence[int]], buckets: int | None = None
) -> tuple[dict[int, int], Callable[[int, int], Row]]:
    """Row counts of several columns, and the entries at the positions ``wanted`` of so many rows.

    ``entries`` holds (c, <order>, rows): the number of a column, what it is sorted by, and how many rows
    the entry stands for. One range partitioning sorts all columns. The driver sees the sizes of
    (column, bucket) parts and one entry per position; only the parts that hold one are read again.
    """
    stored = _range_stored(entries, [F.col(c) for c in ("c", *order)], buckets)
    sizes = sorted(tuple(r) for r in stored.groupBy("c", "_bucket").agg(F.sum("rows").alias("rows")).collect())
    counts: dict[int, int] = {}
    parts = []
    for c, bucket, rows in sizes:
        parts.append((c, bucket, counts.get(c, 0), rows))
        counts[c] = counts.get(c, 0) + rows
    hits = []
    for c, bucket, before, rows in parts:
        inside = [p for p in sorted(set(wanted(counts[c]))) if before <= p < before + rows]
        if inside:
            hits.append((c, bucket, before, inside))
    schema = "c int, _bucket int, _before long, _wanted array<long>"
    running = Window.partitionBy("c", "_bucket").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("_before") + F.sum("rows").over(running)
    found = (
        # One row per wanted position at most.
        stored.join(F.broadcast(entries.sparkSession.createDataFrame(hits, schema)), ["c", "_bucket"])
        .withColumn("_last", last)
        .withColumn("_first", F.col("_last") - F.col("rows"))
        .filter(F.exists("_wanted", lambda p: (p >= F.col("_first")) & (p < F.col("_last"))))
        .select("c", *order, "_first", "_last")
        .collect()
    )

    def at(c: int, position: int) -> Row:
        return next(r for r in found if r["c"] == c and r["_first"] <= position < r["_last"])

    return counts, at


def _unpivoted(df: DataFrame, columns: Sequence[Column], *others: str) -> DataFrame:
    """(c, value, others): a row per non-null value of each column, as doubles."""
    each = F.array(*[F.struct(F.lit(i).alias("c"), c.cast("double").alias("value")) for i, c in enumerate(columns)])
    return df.select(F.explode(each).alias("_e"), *others).select("_e.c", "_e.value", *others).filter(F.col("value").isNotNull())


def quantiles_of(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], buckets: int | None = None
) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns with linear interpolation, nulls left out, from one sort.

    Equal values are grouped first, so a value shared by many rows is a single entry.
    """
    entries = _unpivoted(df, [F.col(c) for c in columns]).groupBy("c", "value").agg(F.count(F.lit(1)).alias("rows"))

    def spots(n: int) -> list[int]:
        return [f(p * (n - 1)) for p in probabilities for f in (math.floor, math.ceil)]

    counts, at = entries_at(entries, ["value"], spots, buckets)

    def quantile_at(c: int, p: float) -> float:
        spot = p * (counts[c] - 1)
        low, high = at(c, math.floor(spot))["value"], at(c, math.ceil(spot))["value"]
        return low + (high - low) * (spot - math.floor(spot))

    return {
        name: [quantile_at(c, p) for p in probabilities] if c in counts else [None] * len(probabilities)
        for c, name in enumerate(columns)
    }


def quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], buckets: int | None = None
) -> list[float | None]:
    return quantiles_of(df, [column], probabilities, buckets)[column]


def quantile(df: DataFrame, column: str, p: float) -> float | None:
    return quantiles(df, column, [p])[0]


def qcut(df: DataFrame, column: str, k: int, name: str, descending: bool = False) -> DataFrame:
    """Score 1..k by quantile bins, right-closed; bins that coincide are merged."""
    return qcuts(df, {name: (column, descending)}, k)


def qcuts(df: DataFrame, scores: Mapping[str, tuple[str, bool]], k: int, buckets: int | None = None) -> DataFrame:
    """``qcut`` of several (column, descending) at once, from one sort."""
    columns = list(dict.fromkeys(c for c, _ in scores.values()))
    cuts = quantiles_of(df, columns, [i / k for i in range(1, k)], buckets)
    binned = {
        name: bin_by_cuts(F.col(column).cast("double"), [c for c in cuts[column] if c is not None], descending)
        for name, (column, descending) in scores.items()
    }
    return df.withColumns(binned)


def ntiles(
    df: DataFrame, scores: Mapping[str, tuple[str, bool]], unique_tiebreak: str, k: int, buckets: int | None = None
) -> DataFrame:
    """SQL ``NTILE(k)`` over all rows by several (column, descending) orders, ties in order of the id.

    The first (value, id) of each tile is all it takes: one narrow table of (column, value, id) is sorted
    and stored, the k - 1 boundaries of every score are read from it, and each row compares itself
    with them. Nothing is joined back. Rows with a null value have a null tile and don't count. Values are
    compared as doubles.
    """
    value = lambda column, descending: (-1 if descending else 1) * F.col(column).cast("double")
    entries = _unpivoted(df, [value(*s) for s in scores.values()], unique_tiebreak).withColumn("rows", F.lit(1).cast("long"))

    def starts(n: int) -> list[int]:
        small, extra = divmod(n, k)
        return [t * small + min(t, extra) for t in range(1, min(k, n))]

    counts, at = entries_at(entries, ["value", unique_tiebreak], starts, buckets)
    tiles = {}
    for c, (name, score) in enumerate(scores.items()):
        mine, ident, tile = value(*score), F.col(unique_tiebreak), F.lit(1)
        for position in starts(counts.get(c, 0)):
            first = at(c, position)
            later = (mine > first["value"]) | ((mine == first["value"]) & (ident >= F.lit(first[unique_tiebreak])))
            tile = tile + later.cast("int")
        tiles[name] = F.when(mine.isNotNull(), tile)
    return df.withColumns(tiles)


def centred_mean(
    value: Column,
    order: Column,
    before: int,
    after: int,
    full_frames_only: bool = False,
) -> Column:
    """Moving average over an aggregate of a few hundred rows, such as months."""
    frame = Window.orderBy(order).rowsBetween(-before, after)
    mean = F.avg(value).over(frame)
    if not full_frames_only:
        return mean
    return F.when(F.count(value).over(frame) == before + after + 1, mean)
