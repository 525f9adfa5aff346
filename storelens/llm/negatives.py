"""Hard-negative mining by segment summaries.

A vector is stored with the mean and the deviation (length of what lies around the mean) of each of
its segments. For two vectors, each segment's part of the inner product lies within the means'
product times the segment's width, plus or minus the product of the deviations. Bounds start with
one segment for the whole vector and are refined for the pairs that remain, with segments a quarter
as wide each time; what is left is scored exactly, in integers. So results are exact.

Anchors meet all rows in cells: a block of anchors and a slice of the rows. A task holds its block and
streams its slice, keeping the best rows of each anchor so far, whose least score prunes
the next ones. Cells are formed by position and hash, never by label, so a hot label is no hot task.
A first pass finds positives, a second one negatives within the positives' score ranges; each
sends at most ``positives`` (times ``negatives``) rows per anchor and slice to the last ranking.

Defined results: rows with a null label, a null vector or a null or non-finite component take no
part. Scores exist between vectors of equal length only; others don't meet. Components are held
within 2^25 on the integer grid. A null id can be found, comes last among ties and is null in the
result; whether it is an anchor the condition says. Rows of equal id are rows of their own: each
anchor row has results of its own and may find its copies. Anchors without positives, and positives
without negatives, give no row. A positive below zero has no range, hence none either. Other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .vectors import list_column, matrices, on_grid

SCALE = 256.0
LIMIT = 2.0**25
POSITIVES, NEGATIVES = 5, 5
#: The least score of a negative, as a share of the positive's.
LOW = (80, 100)
#: Segments at the finest level; each level before has a quarter of them.
SEGMENTS = 16
NARROWER = 4
#: Anchors of a cell, held by its task; rows of a cell at most, which are streamed.
BLOCK, SLICE = 4096, 2**20
#: Pairs looked at in one matrix, or gathered one by one.
PAIRS = 2**21
#: Below this share of pairs left, they are gathered in place of whole matrices.
SPARSE = 0.1
NO_SCORE = np.iinfo(np.int64).min

STORED = "row long, id long, label long, anchor boolean, x array<int>, mean array<double>, spread array<double>"


# --- summaries and bounds -----------------------------------------------------------------------


def edges(d: int) -> np.ndarray:
    """Where the finest segments of a vector of length ``d`` begin, and its end."""
    count = max(1, min(d, SEGMENTS))
    return np.arange(count + 1) * d // count


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the finest segments, a row for each vector."""
    cuts = edges(x.shape[1])
    widths = np.diff(cuts)
    if not x.shape[1]:
        return np.zeros((len(x), 1)), np.zeros((len(x), 1))
    values = x.astype(np.float64)
    mean = np.add.reduceat(values, cuts[:-1], axis=1) / widths
    rest = values - np.repeat(mean, widths, axis=1)
    return mean, np.sqrt(np.add.reduceat(rest * rest, cuts[:-1], axis=1))


def levels(d: int, mean: np.ndarray, spread: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(widths, means, deviations) from one segment to the finest ones; wider ones follow from narrower ones."""
    fine = np.diff(edges(d)).astype(np.float64)
    out, count = [], 1
    while count < len(fine):
        first = -(-np.arange(count) * len(fine) // count)
        width = np.add.reduceat(fine, first)
        middle = np.add.reduceat(fine * mean, first, axis=1) / width
        around = mean - np.repeat(middle, np.diff([*first, len(fine)]), axis=1)
        out.append((width, middle, np.sqrt(np.add.reduceat(spread**2 + fine * around**2, first, axis=1))))
        count *= NARROWER
    return [*out, (fine, mean, spread)]


class Block:
    """Vectors of one length with their summaries at every level."""

    def __init__(self, row, ident, none, label, x, mean, spread):
        self.row, self.id, self.none, self.label, self.x = row, ident, none, label, x
        self.levels = levels(x.shape[1], mean, spread)
        self.norm = np.sqrt(np.sum(self.levels[0][0] * self.levels[0][1] ** 2 + self.levels[0][2] ** 2, axis=1))

    def __len__(self) -> int:
        return len(self.row)

    def part(self, lo: int, hi: int) -> Block:
        fine = self.levels[-1]
        return Block(self.row[lo:hi], self.id[lo:hi], self.none[lo:hi], self.label[lo:hi], self.x[lo:hi], fine[1][lo:hi], fine[2][lo:hi])


#: (upper bounds, lower bounds, anchor numbers) -> which pairs may count.
Wanted = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def bounds(a: Block, b: Block, level: int, i: np.ndarray | None = None, j: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of scores: of all pairs as matrices, or of the pairs (i, j)."""
    width, mean_a, spread_a = a.levels[level]
    _, mean_b, spread_b = b.levels[level]
    if i is None:
        middle, off = (mean_a * width) @ mean_b.T, spread_a @ spread_b.T
        slack = 1e-9 * np.outer(a.norm, b.norm) + 1e-3
    else:
        middle = np.einsum("ps,ps->p", mean_a[i] * width, mean_b[j])
        off = np.einsum("ps,ps->p", spread_a[i], spread_b[j])
        slack = 1e-9 * a.norm[i] * b.norm[j] + 1e-3
    off = off + slack  # for what rounding may hide
    return middle + off, middle - off


def exact(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer scores of the pairs (i, j)."""
    d = a.x.shape[1]
    top = max(float(np.max(np.abs(a.x), initial=0)), 1.0) * max(float(np.max(np.abs(b.x), initial=0)), 1.0)
    if len(i) > SPARSE * len(a) * len(b) and top * d < 2.0**53:
        return (a.x.astype(np.float64) @ b.x.astype(np.float64).T)[i, j].astype(np.int64)
    step = max(1, PAIRS // max(1, d))
    parts = [np.einsum("pd,pd->p", a.x[i[k : k + step]].astype(np.int64), b.x[j[k : k + step]].astype(np.int64)) for k in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def scored_pairs(a: Block, b: Block, allowed: np.ndarray, wanted: Wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the allowed pairs that no bound rules out."""
    every = np.arange(len(a))[:, None]
    i = j = None
    for level in range(len(a.levels)):
        if i is None and np.count_nonzero(allowed) < SPARSE * allowed.size:
            i, j = np.nonzero(allowed)
        if i is None:
            allowed &= wanted(*bounds(a, b, level), every)
        else:
            step = max(1, PAIRS // SEGMENTS)
            keep = [wanted(*bounds(a, b, level, i[k : k + step], j[k : k + step]), i[k : k + step]) for k in range(0, len(i), step)]
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            i, j = i[keep], j[keep]
    if i is None:
        i, j = np.nonzero(allowed)
    return i, j, exact(a, b, i, j)


class Best:
    """The best ``k`` rows of each of ``n`` lists so far: highest score, then least id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NO_SCORE)
        self.id = np.zeros((n, k), np.int64)
        self.none = np.zeros((n, k), bool)

    @property
    def least(self) -> np.ndarray:
        """The score a row must reach; below any score while a list isn't full."""
        return self.score[:, -1].astype(np.float64)

    def add(self, at: np.ndarray, score: np.ndarray, ident: np.ndarray, none: np.ndarray) -> None:
        if not len(at):
            return
        old = np.unique(at)
        at = np.concatenate([np.repeat(old, self.k), at])
        score = np.concatenate([self.score[old].ravel(), score])
        ident = np.concatenate([self.id[old].ravel(), ident])
        none = np.concatenate([self.none[old].ravel(), none])
        order = np.lexsort((ident, none, -np.maximum(score, NO_SCORE + 1), at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        first = place < self.k
        at, place, order = at[first], place[first], order[first]
        self.score[at, place], self.id[at, place], self.none[at, place] = score[order], ident[order], none[order]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id, whether the id is null) of everything held."""
        at, place = np.nonzero(self.score != NO_SCORE)
        return at, self.score[at, place], self.id[at, place], self.none[at, place]


# --- tables --------------------------------------------------------------------------------------


def _column(values: np.ndarray, none: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=none)


def stored(df: DataFrame, ident: str, label: str, vector: str, anchor: Column, ws: Workspace) -> DataFrame:
    """The usable rows, numbered, with their grid vectors and summaries; written once."""
    rows = df.select(
        F.monotonically_increasing_id().alias("row"),
        df[ident].cast("long").alias("id"),
        df[label].cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        df[vector].alias("v"),
    ).where(F.col("label").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in matrices(batch.column(4)):
                x = on_grid(matrix, SCALE, LIMIT)
                mean, spread = summaries(x)
                here, every = pa.array(at), np.arange(len(at))
                lists = [list_column(every, len(at), m, t) for m, t in ((x, pa.int32()), (mean, pa.float64()), (spread, pa.float64()))]
                columns = [batch.column(c).take(here) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, *lists], ["row", "id", "label", "anchor", "x", "mean", "spread"])

    return ws.keep(rows.mapInArrow(run, STORED))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), len(values) // max(1, len(column)))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[Block, pa.RecordBatch]]:
    """The rows of a batch as blocks of equal vector length."""
    lengths = pc.list_value_length(batch["x"]).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        some = batch.filter(pa.array(lengths == d))
        row, label = (some[name].to_numpy(zero_copy_only=False) for name in ("row", "label"))
        ident, none = some["id"].fill_null(0).to_numpy(zero_copy_only=False), some["id"].is_null().to_numpy(zero_copy_only=False)
        yield Block(row, ident, none, label, _matrix(some["x"], np.int64), _matrix(some["mean"], np.float64), _matrix(some["spread"], np.float64)), some


class Cell:
    """One block of anchors: takes rows batch by batch, then gives what it found."""

    def __init__(self, anchors: list[pa.RecordBatch], make):
        table = pa.Table.from_batches(anchors).combine_chunks().to_batches()
        self.blocks = [(block, make(block, some)) for batch in table for block, some in _blocks(batch)]

    def rows(self, batch: pa.RecordBatch) -> None:
        for b, _ in _blocks(batch):
            for a, search in self.blocks:
                if a.x.shape[1] == b.x.shape[1]:
                    step = max(1, PAIRS // len(a))
                    for lo in range(0, len(b), step):
                        search.look(a, b.part(lo, lo + step))

    def found(self) -> Iterator[pa.RecordBatch]:
        for a, search in self.blocks:
            yield search.found(a)


class Positives:
    """Search for rows of the anchor's label."""

    schema = "anchor_row long, id long, score long"

    def __init__(self, a: Block, some: pa.RecordBatch, k: int):
        self.best = Best(len(a), k)

    def look(self, a: Block, b: Block) -> None:
        allowed = (a.label[:, None] == b.label) & (a.row[:, None] != b.row)
        least = self.best.least
        i, j, score = scored_pairs(a, b, allowed, lambda upper, lower, at: upper >= least[at])
        self.best.add(i, score, b.id[j], b.none[j])

    def found(self, a: Block) -> pa.RecordBatch:
        at, score, ident, none = self.best.found()
        return pa.RecordBatch.from_arrays([pa.array(a.row[at]), _column(ident, none), pa.array(score)], ["anchor_row", "id", "score"])


class Negatives:
    """Search for rows of other labels in the score range of each positive."""

    schema = "anchor_row long, nth int, positive_score long, id long, score long"

    def __init__(self, a: Block, some: pa.RecordBatch, k: int, low: tuple[int, int]):
        scores = some["positive_scores"].to_pylist()
        width = max(map(len, scores), default=0)
        self.top = np.array([s + [NO_SCORE] * (width - len(s)) for s in scores], np.int64).reshape(len(a), width)
        # The least whole score of the range; no range below zero.
        floor = [[-((-p * low[0]) // low[1]) for p in s] + [0] * (width - len(s)) for s in scores]
        self.floor = np.array(floor, np.int64).reshape(len(a), width)
        self.best = [Best(len(a), k) for _ in range(width)]

    def look(self, a: Block, b: Block) -> None:
        least = [np.maximum(best.least, self.floor[:, n]) for n, best in enumerate(self.best)]
        most = [self.top[:, n].astype(np.float64) for n in range(len(self.best))]

        def wanted(upper: np.ndarray, lower: np.ndarray, at: np.ndarray) -> np.ndarray:
            hit = np.zeros(upper.shape, bool)
            for lo, hi in zip(least, most, strict=True):
                hit |= (upper >= lo[at]) & (lower <= hi[at])
            return hit

        i, j, score = scored_pairs(a, b, a.label[:, None] != b.label, wanted)
        for n, best in enumerate(self.best):
            fits = (score >= self.floor[i, n]) & (score <= self.top[i, n])
            best.add(i[fits], score[fits], b.id[j[fits]], b.none[j[fits]])

    def found(self, a: Block) -> pa.RecordBatch:
        empty = np.zeros(0, np.int64)
        parts = [(np.full(len(f[0]), n), *f) for n, f in enumerate(best.found() for best in self.best)]
        nth, at, score, ident, none = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (*[empty] * 4, empty.astype(bool))
        columns = [pa.array(a.row[at]), pa.array((nth + 1).astype(np.int32)), pa.array(self.top[at, nth] if parts else empty), _column(ident, none), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, ["anchor_row", "nth", "positive_score", "id", "score"])


def _search(anchors: DataFrame, rows: DataFrame, blocks: int, slices: int, make, schema: str) -> DataFrame:
    """What ``make``'s searches find in every cell of anchor blocks and row slices."""
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    piece = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(slices)).cast("int")
    kinds = anchors.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: block * slices + s)).alias("cell"), F.lit(0).alias("kind"), "*")
    others = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * slices + piece)).alias("cell"), F.lit(1).alias("kind"), "*")
    dealt = kinds.unionByName(others, allowMissingColumns=True)
    dealt = dealt.repartitionById(blocks * slices, F.col("cell")).sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, cell = None, [], None
        for batch in batches:
            cells = batch["cell"].to_numpy(zero_copy_only=False)
            kind = batch["kind"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if cells[lo] != number:
                    if cell:
                        yield from cell.found()
                    number, held, cell = cells[lo], [], None
                if kind[lo] == 0:
                    held.append(part)
                elif held:
                    cell = cell or Cell(held, make)
                    cell.rows(part)
        if cell:
            yield from cell.found()

    return dealt.mapInArrow(run, schema)


def mine(
    df: DataFrame,
    anchor: Column,
    ident: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: tuple[int, int] = LOW,
    block: int = BLOCK,
    slice_rows: int = SLICE,
    workspace: Workspace | None = None,
) -> DataFrame:
    """anchor_row, anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on ``df``'s columns; ``anchor_row`` tells anchors of equal or null ids apart.
    """
    spark = df.sparkSession
    ws = Workspace.of(spark, workspace)
    rows = stored(df, ident, label, vector, anchor, ws)
    anchors = rows.where("anchor")
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).head()
    blocks = max(1, -(-counted["a"] // block))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-counted["n"] // slice_rows), -(-wanted // blocks))

    found = _search(anchors, rows.drop("anchor"), blocks, slices, lambda a, some: Positives(a, some, positives), Positives.schema)
    by_score = Window.partitionBy("anchor_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    near = ws.keep(found.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= positives))
    # At most ``positives`` rows for each anchor.
    lists = near.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("nth", "score"))).alias("_p"))
    lists = lists.select("anchor_row", F.transform("_p", lambda p: p["score"]).alias("positive_scores"))
    ready = anchors.join(lists, F.col("row") == F.col("anchor_row")).drop("anchor_row", "anchor")

    found = _search(ready, rows.drop("anchor"), blocks, slices, lambda a, some: Negatives(a, some, negatives, low), Negatives.schema)
    by_score = Window.partitionBy("anchor_row", "nth").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
    named = near.select("anchor_row", "nth", F.col("id").alias("positive_id"))
    ids = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return best.join(named, ["anchor_row", "nth"]).join(ids, "anchor_row").select(
        "anchor_row", "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
