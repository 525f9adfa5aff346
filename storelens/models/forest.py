"""Random forests grown tree by tree, whose one growth serves a whole tuning grid.

A tree depends on the training rows, the seed and its own number only, and its levels are grown from
the root downwards. So the first 200 trees of a forest of 400 are the forest of 200, and a forest cut
at depth 10 is the one grown to depth 10: for every leaf size and fold a single growth of the most and
deepest trees has all the smaller forests in it, which are scored while rows walk down.

Every tree learns from a bootstrap sample of all training rows. Spark puts these in the order of their
ids, a byte a feature, and deals the trees out in blocks; a task gets the rows once and grows its trees one
after another, level by level. Large arrays lie in files, so what a task holds in memory are the nodes of a
tree. Scoring covers every row.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators.ranking import entries_at
from storelens.session import materialize

MAX_BINS = 32
#: Rows and nodes worked on at once while a tree grows, rows drawn at once, and bytes above which an array lies in a file.
PIECE, NODES_EACH, DRAWN, IN_MEMORY = 1 << 16, 1 << 11, 1 << 20, 1 << 28
#: Rows, votes and nodes that are stored and sent as one value.
ROWS_EACH, VOTES_EACH, STORED_NODES = 512, 1 << 13, 1 << 12
#: Nodes of a forest that is held on the driver and sent whole; of a larger one those of the trees that a task scores with.
HELD_NODES, TASK_NODES = 1 << 23, 1 << 22
SEED = 42
NODES = "tree int, feature binary, threshold binary, left binary, value binary, gain binary, level binary, piece int"
_TYPES = {"feature": np.int16, "threshold": np.float32, "left": np.int32, "value": np.float32, "gain": np.float64, "level": np.int16}


# --- one tree ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Nodes in level order: a node's children are ``left`` and ``left + 1``; leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    level: np.ndarray

    def walk(self, x: np.ndarray, depths: Sequence[int | None]) -> list[np.ndarray]:
        """The value of each row's node at each of the rising ``depths``; None is the leaf."""
        at, out, depth = np.zeros(len(x), np.int64), [], 0
        rows = np.arange(len(x))
        deepest = int(self.level[-1])
        for wanted in depths:
            while depth < (deepest if wanted is None else min(wanted, deepest)):
                f = self.feature[at[rows]]
                rows, f = rows[f >= 0], f[f >= 0]
                here = at[rows]
                at[rows] = self.left[here] + (x[rows, f] > self.threshold[here])
                depth += 1
            out.append(self.value[at].astype(np.float64))
        return out

    def cut(self, depth: int | None) -> Tree:
        """The tree grown to ``depth`` only."""
        if depth is None or depth >= self.level[-1]:
            return self
        keep = self.level <= depth
        last = self.level[keep] == depth
        feature, threshold, left, gain = (getattr(self, name)[keep] for name in ("feature", "threshold", "left", "gain"))
        feature[last], threshold[last], left[last], gain[last] = -1, 0.0, 0, 0.0
        return Tree(feature, threshold, left, self.value[keep], gain, self.level[keep])


def bin_edges(x: np.ndarray, bins: int = MAX_BINS) -> list[np.ndarray]:
    """Thresholds of each feature: at most ``bins - 1``, between neighbouring values."""
    out = []
    for column in x.T:
        values = np.sort(column)
        picks = values[(np.arange(1, bins) * len(values)) // bins] if len(values) else values
        distinct = np.unique(values)
        at = np.unique(np.searchsorted(distinct, picks))
        at = at[at > 0] if len(distinct) > bins else np.arange(1, len(distinct))
        out.append(np.unique(((distinct[at - 1] + distinct[at]) / 2).astype(np.float32)))
    return out


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)


def bootstrap(n: int, tree: int, seed: int = SEED) -> np.ndarray:
    """How often each of ``n`` rows is drawn for a tree."""
    rng, counts = np.random.default_rng([seed, tree]), _space(n, np.uint8)
    counts[:] = 0
    for lo in range(0, n, DRAWN):
        np.add.at(counts, rng.integers(0, n, min(DRAWN, n - lo)), np.uint8(1))
    return counts


def _space(shape: int | tuple[int, ...], dtype: type) -> np.ndarray:
    """An array; a large one lies in a file without a name, which goes with the array."""
    if int(np.prod(shape)) * np.dtype(dtype).itemsize <= IN_MEMORY:
        return np.empty(shape, dtype)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, dtype, "w+", shape=shape).view(np.ndarray)


def _sampled(rows: np.ndarray, features: int, counts: np.ndarray) -> np.ndarray:
    """The drawn ones of ``rows``: their bins, their label and how often they were drawn, side by side."""
    out, at = _space((int(np.count_nonzero(counts)), features + 2), np.uint8), 0
    for lo in range(0, len(rows), DRAWN):
        drawn = lo + np.flatnonzero(counts[lo : lo + DRAWN])
        part = out[at : at + len(drawn)]
        part[:, : features + 1], part[:, features + 1] = rows[drawn, : features + 1], counts[drawn]
        at += len(drawn)
    return out


def _balanced(zeros: int, ones: int) -> np.ndarray:
    """Weights of the two labels, by which both count the same; 0 for one without rows."""
    return np.array([(zeros + ones) / (2.0 * k) if k else 0.0 for k in (zeros, ones)])


def _added(rows: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """By label, then node, chosen feature and bin: draws; and with ``counted`` different rows, of both labels."""
    nodes, width = chosen.shape
    features, size = rows.shape[1] - 2, nodes * width * MAX_BINS
    flat, base = rows.reshape(-1), np.arange(0, rows.size, rows.shape[1])
    place, label = np.repeat(np.arange(0, size, width * MAX_BINS), sizes), rows[:, features].astype(np.int64) * size
    places = np.empty((width, len(rows)), np.int64)
    for s in range(width):
        at = np.repeat(chosen[:, s], sizes)
        at += base
        np.add(flat.take(at), place, out=places[s])
        place += MAX_BINS
    each = np.bincount(places.ravel(), minlength=size) if counted else None
    places += label
    draws = np.tile(rows[:, features + 1].astype(np.float64), width)
    return np.bincount(places.ravel(), draws, 2 * size).reshape(2, size), each


def _best_splits(rows, sizes, totals, chosen, weights, min_leaf):
    """(gain, feature, bin, draws of either label on the left) of the best split of each node among its ``chosen`` features; gain 0 for none.

    The nodes' rows follow each other, ``sizes`` of each; ``totals`` are their draws of either label.
    """
    nodes, width = chosen.shape
    sums, each = _added(rows[:PIECE], np.minimum(sizes, PIECE), chosen, min_leaf > 1)
    for lo in range(PIECE, len(rows), PIECE):  # the rows of one node
        more, some = _added(rows[lo : lo + PIECE], np.minimum(sizes - lo, PIECE), chosen, min_leaf > 1)
        sums += more
        each = each if each is None else each + some
    # After an empty bin the split is that before it, and after the last one with rows it is none.
    bins = np.flatnonzero(sums[0] + sums[1])
    part = bins // MAX_BINS
    inner = np.flatnonzero(part[1:] == part[:-1])
    begins = np.flatnonzero(np.diff(part, prepend=-1))
    spans = np.diff(begins, append=len(bins))

    def left_of(counts: np.ndarray) -> np.ndarray:
        """Running sums within a node and feature."""
        here = counts[bins]
        up_to = here.cumsum()
        return (up_to - np.repeat(up_to[begins] - here[begins], spans))[inner]

    drawn, node = np.stack([left_of(sums[0]), left_of(sums[1])]), part[inner] // width
    all0, all1 = totals[0] * weights[0], totals[1] * weights[1]
    left0, left1 = drawn[0] * weights[0], drawn[1] * weights[1]
    right0, right1 = all0[node] - left0, all1[node] - left1
    gain = (left0 * left0 + left1 * left1) / (left0 + left1) + (right0 * right0 + right1 * right1) / (right0 + right1)
    gain -= ((all0 * all0 + all1 * all1) / (all0 + all1))[node]
    # A split without gain still leads on; it counts as the least.
    np.maximum(gain, 1e-12, out=gain)
    if each is not None:
        left = left_of(each)
        gain[(left < min_leaf) | (sizes[node] - left < min_leaf)] = 0.0
    found, feature, at_bin, on_left = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros((2, nodes))
    if len(inner):
        begins = np.flatnonzero(np.diff(node, prepend=-1))
        most = np.maximum.reduceat(gain, begins)
        ties = np.flatnonzero(gain == np.repeat(most, np.diff(begins, append=len(node))))
        best = ties[np.flatnonzero(np.diff(node[ties], prepend=-1))]
        mine, at = node[best], bins[inner[best]]
        found[mine], feature[mine], at_bin[mine], on_left[:, mine] = most, chosen[mine, at // MAX_BINS % width], at % MAX_BINS, drawn[:, best]
    return found, feature, at_bin, on_left


def _parted(rows: np.ndarray, out: np.ndarray, sizes: np.ndarray, feature: np.ndarray, at_bin: np.ndarray, kept: Callable[[np.ndarray], np.ndarray]) -> tuple[int, np.ndarray]:
    """Moves the ``rows`` to the front of ``out`` by child; how many, and how many of each child there were.

    ``out`` begins at or before ``rows`` in the same array. Children whose number of rows ``kept`` says no to, and
    rows of nodes without a split, are left out.
    """
    flat, width, nodes = rows.reshape(-1), rows.shape[1], len(feature)
    if nodes > 1 or len(rows) <= PIECE:
        at = np.repeat(np.maximum(feature, 0), sizes)
        at += np.arange(0, rows.size, width)
        child = np.repeat(np.arange(0, 2 * nodes, 2), sizes)
        child += flat.take(at) > np.repeat(at_bin, sizes)
        each = np.bincount(child, minlength=2 * nodes)
        going = np.flatnonzero((kept(each) & np.repeat(feature >= 0, 2)).take(child))
        moved = rows.take(going[np.argsort(child.take(going).astype(np.uint16), kind="stable")], axis=0)
        out[: len(moved)] = moved
        return len(moved), each
    right = np.concatenate([rows[lo : lo + PIECE, feature[0]] > at_bin[0] for lo in range(0, len(rows), PIECE)])
    each = np.array([len(rows) - np.count_nonzero(right), np.count_nonzero(right)])
    lefts, rights = kept(each) & (feature[0] >= 0)
    later = _space((int(each[1]) if rights else 0, width), np.uint8)
    at, after = 0, 0
    for lo in range(0, len(rows), PIECE):
        part, here = rows[lo : lo + PIECE].copy(), right[lo : lo + PIECE]
        if rights:
            more = part[here]
            later[after : after + len(more)], after = more, after + len(more)
        if lefts:
            more = part[~here]
            out[at : at + len(more)], at = more, at + len(more)
    for lo in range(0, after, PIECE):
        out[at + lo : at + min(after, lo + PIECE)] = later[lo : lo + PIECE]
    return at + after, each


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of nodes with few enough rows and nodes to work on at once, or of one node."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        last = max(first + 1, min(int(np.searchsorted(ends, before + PIECE, side="right")), first + NODES_EACH))
        yield first, last
        first = last


def grow_tree(x: np.ndarray, y: np.ndarray, edges: Sequence[np.ndarray], tree: int, *, min_leaf: int = 1, max_depth: int | None = None, seed: int = SEED) -> Tree:
    """A tree on a bootstrap sample of binned rows, both classes of equal weight over all rows.

    Each node looks at the square root of the number of features, drawn at random; where none of
    these splits it, at all of them.
    """
    n, features = x.shape
    rows, ones = np.concatenate([x, y[:, None]], axis=1).astype(np.uint8), int(np.count_nonzero(y))
    return _unbinned(_grown(_sampled(rows, features, bootstrap(n, tree, seed)), _balanced(n - ones, ones), tree, min_leaf, max_depth, seed), edges)


def _unbinned(tree: Tree, edges: Sequence[np.ndarray]) -> Tree:
    """A tree with edges in place of its bins."""
    limits = np.zeros((max(1, len(edges)), MAX_BINS), np.float32)
    for f, e in enumerate(edges):
        limits[f, : len(e)] = e
    return replace(tree, threshold=np.where(tree.feature >= 0, limits[tree.feature, tree.threshold.astype(np.int64)], np.float32(0)))


def _grown(rows: np.ndarray, weights: np.ndarray, tree: int, min_leaf: int, max_depth: int | None, seed: int) -> Tree:
    """A tree with bins for thresholds, on the drawn ``rows``, which are put in the order of their nodes level by level.

    Rows of a finished node are dropped, and nodes next to each other are worked on a few at a time, so beside the
    rows only the nodes take memory, and what is worked on stays in the processor's cache.
    """
    features = rows.shape[1] - 2
    width = max(1, int(np.sqrt(features)))
    totals = np.zeros((2, 1))
    for lo in range(0, len(rows), PIECE):
        part = rows[lo : lo + PIECE]
        totals += np.bincount(part[:, features], part[:, features + 1], 2)[:, None]
    parts: dict[str, list[np.ndarray]] = {name: [] for name in _TYPES}
    first, level, sizes = 0, 0, np.array([len(rows)])
    # The nodes that may be split, in order; ``rows`` are theirs.
    more = lambda totals, sizes, level: (totals > 0).all(axis=0) & (sizes >= 2 * min_leaf) & (max_depth is None or level < max_depth)
    mixed = np.flatnonzero(more(totals, sizes, 0))
    while True:
        count = totals.shape[1]
        zeros, ones = totals[0] * weights[0], totals[1] * weights[1]
        value = ones / np.maximum(zeros + ones, 1e-300)
        feature, at_bin, gain = np.full(count, -1), np.zeros(count, np.int64), np.zeros(count)
        rng, drawn = np.random.default_rng([seed, tree, level + 1]), 0
        read, written, below, held = 0, 0, [np.zeros((2, 0))], [np.zeros(0, np.int64)]
        sizes = sizes[mixed]
        for lo, hi in _chunks(sizes):
            mine = mixed[lo:hi]
            draw = np.concatenate([rng.random((min(NODES_EACH, mine[-1] + 1 - k), features))[mine[(mine >= k) & (mine < k + NODES_EACH)] - k] for k in range(drawn, mine[-1] + 1, NODES_EACH)])
            drawn = mine[-1] + 1
            here = rows[read : read + int(sizes[lo:hi].sum())]
            chosen = np.argpartition(draw, min(width, features - 1), axis=1)[:, :width]
            found, f, at, left = _best_splits(here, sizes[lo:hi], totals[:, mine], chosen, weights, min_leaf)
            none = found == 0
            if none.any():
                some = here if none.all() else here[np.repeat(none, sizes[lo:hi])]
                every = np.broadcast_to(np.arange(features), (np.count_nonzero(none), features))
                found[none], f[none], at[none], left[:, none] = _best_splits(some, sizes[lo:hi][none], totals[:, mine[none]], every, weights, min_leaf)
            f[found == 0] = -1
            feature[mine], at_bin[mine], gain[mine] = f, at, found
            halves = np.stack([left, totals[:, mine] - left], axis=2).reshape(2, -1)
            moved, each = _parted(here, rows[written:], sizes[lo:hi], f, at, lambda each, halves=halves: more(halves, each, level + 1))
            split = np.repeat(f >= 0, 2)
            below.append(halves[:, split])
            held.append(each[split])
            read, written = read + len(here), written + moved
        split = feature >= 0
        order = np.cumsum(split) - 1
        parts["feature"].append(feature)
        parts["threshold"].append(np.where(split, at_bin, 0))
        parts["left"].append(np.where(split, first + count + 2 * order, 0))
        parts["value"].append(value)
        parts["gain"].append(gain)
        parts["level"].append(np.full(count, level))
        for name, kind in _TYPES.items():
            parts[name][-1] = parts[name][-1].astype(kind)
        if not split.any():
            return Tree(**{name: np.concatenate(p) for name, p in parts.items()})
        totals, sizes = np.concatenate(below, axis=1), np.concatenate(held)
        first, level, rows = first + count, level + 1, rows[:written]
        mixed = np.flatnonzero(more(totals, sizes, level))


#: Rows that walk down a tree together, and levels after which those in a leaf are left out.
WALKERS, LEVELS_EACH = 10_000, 5


@dataclass(frozen=True)
class Walk:
    """Trees with one number a node, ``left << bits | test``, to send to the tasks that score.

    Tests are the different pairs of feature and threshold of all trees, in order, and a last one that no row
    passes. A row takes them once for all trees; a leaf leads to itself by the last one.
    """

    edges: tuple[np.ndarray, ...]
    bits: int
    nodes: tuple[np.ndarray, ...]
    values: tuple[np.ndarray, ...]

    @classmethod
    def of(cls, trees: Sequence[Tree], features: int) -> Walk:
        known = [np.zeros(0, np.float32)]
        edges = [np.unique(np.concatenate(known + [t.threshold[t.feature == f] for t in trees])) for f in range(features)]
        first = np.cumsum([0] + [len(e) for e in edges])
        bits, nodes = int(first[-1]).bit_length(), []
        for t in trees:
            test, left = np.full(len(t.feature), first[-1]), np.arange(len(t.feature))
            for f, e in enumerate(edges):
                mine = t.feature == f
                test[mine], left[mine] = first[f] + np.searchsorted(e, t.threshold[mine]), t.left[mine]
            nodes.append(left << bits | test)
        return cls(tuple(edges), bits, tuple(nodes), tuple(t.value for t in trees))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over trees of the values of the rows' leaves."""
        return self.total(x) / max(1, len(self.nodes))

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sum over trees of the values of the rows' leaves."""
        total = np.zeros(len(x))
        for lo in range(0, len(x), WALKERS):
            self._add(x[lo : lo + WALKERS], total[lo : lo + WALKERS])
        return total

    def _add(self, x: np.ndarray, total: np.ndarray) -> None:
        passed = np.concatenate([c[:, None] > e for c, e in zip(x.T, self.edges, strict=True)] + [np.zeros((len(x), 1), bool)], axis=1)
        tests = passed.shape[1]
        flat, mask = passed.ravel().view(np.int8), (1 << self.bits) - 1
        for nodes, values in zip(self.nodes, self.values, strict=True):
            leaf, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            at, base = leaf.copy(), rows * tests
            while len(rows):
                for _ in range(LEVELS_EACH):
                    here = nodes.take(at, mode="clip")
                    place = here & mask
                    place += base
                    here >>= self.bits
                    here += flat.take(place, mode="clip")
                    at = here
                leaf[rows] = at
                on = np.flatnonzero(nodes.take(at) & mask != tests - 1)
                rows, at, base = rows.take(on), at.take(on), base.take(on)
            total += values.take(leaf)


# --- forests over tables ------------------------------------------------------------------------


@dataclass(frozen=True)
class Packed:
    """Training rows in the order of their ids, stored in pieces: the first one's place, and the rows' bytes.

    A row is a byte for the bin of each feature, one for the label and one for the fold.
    """

    pieces: DataFrame
    rows: int
    edges: tuple[np.ndarray, ...]

    @property
    def features(self) -> int:
        return len(self.edges)

    def dealt(self, trees: int) -> tuple[DataFrame, int]:
        """All pieces once for each block of trees; and how many trees a block has, two blocks for each core."""
        each = -(-trees // (2 * self.pieces.sparkSession.sparkContext.defaultParallelism))
        blocks = -(-trees // each)
        return self.pieces.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).repartitionById(blocks, F.col("block")), each


def _read(batches: Iterator[pa.RecordBatch], count: int, width: int) -> tuple[int, np.ndarray]:
    """The block of a task and all rows; -1 and none without any."""
    block, rows = -1, None
    for b in batches:
        if not b.num_rows:
            continue
        if rows is None:
            block, rows = b["block"][0].as_py(), _space((count, width), np.uint8)
        for first, data in zip(b["first"].to_pylist(), b["data"], strict=True):
            part = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, width)
            rows[first : first + len(part)] = part
    return block, np.zeros((0, width), np.uint8) if rows is None else rows


def table_edges(df: DataFrame, features: str) -> list[np.ndarray]:
    """``bin_edges`` of a column of arrays, exact, from the different values of each feature."""
    entries = materialize(df.select(F.posexplode(features).alias("c", "value")).groupBy("c", "value").agg(F.count(F.lit(1)).alias("rows")))
    different = {r["c"]: r["n"] for r in entries.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = lambda n: [k * n // MAX_BINS for k in range(1, MAX_BINS)]
    counts, at = entries_at(entries, ["value"], places)
    # The values the edges are below: those at the quantiles, or all where they are few.
    few = [c for c, n in different.items() if n <= MAX_BINS]
    picks = {c: sorted({at(c, p)["value"] for p in places(n)}) for c, n in counts.items()}
    for r in entries.where(F.col("c").isin(few)).groupBy("c").agg(F.sort_array(F.collect_list("value")).alias("values")).collect():
        picks[r["c"]] = r["values"]
    known = df.sparkSession.createDataFrame(list(picks.items()), "c int, picks array<double>")
    reached = F.size(F.filter("picks", lambda p: p <= F.col("value")))
    spans = entries.join(F.broadcast(known), "c").groupBy("c", reached.alias("k")).agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    ends = {(r["c"], r["k"]): r for r in spans}
    out = []
    for c in range(len(picks)):
        pairs = [(ends[c, k - 1]["high"], ends[c, k]["low"]) for k in range(1, len(picks[c]) + 1) if (c, k - 1) in ends]
        out.append(np.unique(np.array([(a + b) / 2 for a, b in pairs], np.float64).astype(np.float32)))
    return out


def packed(train: DataFrame, features: Column, label: str, key: str, rows: int | None = None) -> Packed:
    """All rows of ``train``, or with ``rows`` about so many, chosen by a hash of the id."""
    total = train.count()
    some = train if rows is None or total <= rows else train.where(F.pmod(F.xxhash64(key), F.lit(total)) < rows)
    fold = F.col("fold") if "fold" in train.columns else F.lit(0)
    plain = some.select(F.col(key).alias("key"), features.alias("features"), F.col(label).cast("long").alias("label"), fold.cast("long").alias("fold"))
    edges = table_edges(plain, "features")
    width = len(edges) + 2

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b["features"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                last = [b[c].to_numpy(zero_copy_only=False)[:, None].astype(np.uint8) for c in ("label", "fold")]
                yield pa.RecordBatch.from_arrays([b["key"], _binary(np.concatenate([binned(x, edges), *last], axis=1))], ["key", "row"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            if b.num_rows:
                data, n = b"".join(b["row"].to_pylist()), b.num_rows
                starts = range(0, n, ROWS_EACH)
                arrays = [pa.array([b["part"][0].as_py()] * len(starts), pa.int32()), pa.array([done + k for k in starts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([data[k * width : (k + ROWS_EACH) * width] for k in starts], pa.binary())], ["part", "inside", "data"])
                done += n

    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "row"]
    narrowed = plain.mapInArrow(narrow, f"key {plain.schema['key'].dataType.simpleString()}, row binary")
    sorted_rows = narrowed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "row")
    pieces = materialize(sorted_rows.mapInArrow(joined, "part int, inside long, data binary"))
    # One row per partition.
    sizes = dict(sorted(tuple(r) for r in pieces.groupBy("part").agg(F.sum(F.length("data")).alias("bytes")).collect()))
    ends = np.cumsum([size // width for size in sizes.values()])
    before = [(part, int(end) - size // width) for (part, size), end in zip(sizes.items(), ends, strict=True)]
    first = pieces.join(F.broadcast(train.sparkSession.createDataFrame(before, "part int, before long")), "part")
    return Packed(first.select((F.col("before") + F.col("inside")).alias("first"), "data"), int(ends[-1]) if len(ends) else 0, tuple(edges))


def _binary(rows: np.ndarray) -> pa.Array:
    """One value for each row of a table of bytes."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def grow(train: Packed, *, trees: int, min_leaf: int = 1, max_depth: int | None = None, seed: int = SEED) -> DataFrame:
    """The nodes of every tree, in pieces of at most ``STORED_NODES``."""
    dealt, each = train.dealt(trees)
    count, features, edges = train.rows, train.features, train.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = _read(batches, count, features + 2)
        ones = int(np.count_nonzero(rows[:, features]))
        for tree in range(block * each, min(trees, (block + 1) * each)) if len(rows) else ():
            grown = _grown(_sampled(rows, features, bootstrap(count, tree, seed)), _balanced(count - ones, ones), tree, min_leaf, max_depth, seed)
            t = _unbinned(grown, edges)
            for piece, lo in enumerate(range(0, len(t.feature), STORED_NODES)):
                arrays = [pa.array([getattr(t, name)[lo : lo + STORED_NODES].tobytes()], pa.binary()) for name in _TYPES]
                yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), *arrays, pa.array([piece], pa.int32())], ["tree", *_TYPES, "piece"])

    return dealt.mapInArrow(run, NODES)


@dataclass(frozen=True)
class Forest:
    """Trees on the driver, 24 bytes a node."""

    trees: tuple[Tree, ...]
    features: int
    _sent: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def collect(cls, nodes: DataFrame, features: int, depth: int | None = None) -> Forest:
        found: dict[int, dict[str, list[np.ndarray]]] = {}
        # Models saved before trees were stored in pieces have none.
        for r in nodes.orderBy("tree", "piece").toLocalIterator():
            parts = found.setdefault(r["tree"], {name: [] for name in _TYPES})
            for name, kind in _TYPES.items():
                parts[name].append(np.frombuffer(r[name], kind))
        trees = [Tree(**{name: np.concatenate(p) for name, p in parts.items()}).cut(depth) for parts in found.values()]
        return cls(tuple(trees), features)

    def first(self, trees: int, depth: int | None = None) -> Forest:
        """The forest of the first ``trees`` trees, grown to ``depth``."""
        return Forest(tuple(t.cut(depth) for t in self.trees[:trees]), self.features)

    def importances(self) -> np.ndarray:
        """Impurity decrease by feature, each tree's shares first, then the mean; sums to 1."""
        total = np.zeros(self.features)
        for t in self.trees:
            inner = t.feature >= 0
            mine = np.bincount(t.feature[inner], t.gain[inner], self.features)
            total += mine / mine.sum() if mine.sum() > 0 else 0.0
        return total / total.sum() if total.sum() > 0 else total

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over trees of the weighted share of label 1 in a row's leaf."""
        return Walk.of(self.trees, self.features).predict(x)

    def probability(self, spark: SparkSession, features: Column) -> Column:
        """``predict`` as a column of an array of doubles."""
        context = spark.sparkContext
        if context.applicationId not in self._sent:
            self._sent[context.applicationId] = context.broadcast(Walk.of(self.trees, self.features))
        sent, width = self._sent[context.applicationId], self.features

        @F.arrow_udf("double")
        def score(rows: pa.Array) -> pa.Array:
            return pa.array(sent.value.predict(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)))

        return score(features)

    def scored(self, df: DataFrame, features: Column, name: str) -> DataFrame:
        return df.withColumn(name, self.probability(df.sparkSession, features))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.to_rows(), NODES)

    def to_rows(self) -> list[tuple]:
        return [(i, *[getattr(t, name).tobytes() for name in _TYPES], 0) for i, t in enumerate(self.trees)]


@dataclass(frozen=True)
class StoredForest:
    """Trees in a stored table, for forests too large to hold: each task scores rows with a few of the trees."""

    nodes: DataFrame
    features: int

    def table(self, spark: SparkSession) -> DataFrame:
        return self.nodes

    def importances(self) -> np.ndarray:
        """As those of ``Forest``."""
        features = self.features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for tree, feature, gain in zip(b["tree"], b["feature"], b["gain"], strict=True):
                    feature, gain = np.frombuffer(feature.as_py(), _TYPES["feature"]), np.frombuffer(gain.as_py(), _TYPES["gain"])
                    sums = np.bincount(feature[feature >= 0], gain[feature >= 0], features).astype(np.float64)
                    arrays = [pa.array([tree.as_py()] * features, pa.int32()), pa.array([*range(features)], pa.int32()), pa.array(sums)]
                    yield pa.RecordBatch.from_arrays(arrays, ["tree", "feature", "gain"])

        sums = self.nodes.select("tree", "feature", "gain").mapInArrow(run, "tree int, feature int, gain double")
        of_tree: dict[int, np.ndarray] = {}
        # One row per tree and feature.
        for r in sums.groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect():
            of_tree.setdefault(r["tree"], np.zeros(features))[r["feature"]] = r["gain"]
        total = sum((of_tree[t] / of_tree[t].sum() for t in sorted(of_tree) if of_tree[t].sum() > 0), np.zeros(features))
        return total / total.sum() if total.sum() > 0 else total

    def edges(self) -> list[np.ndarray]:
        """The thresholds of each feature, at most ``MAX_BINS - 1``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for feature, threshold in zip(b["feature"], b["threshold"], strict=True):
                    pairs = np.unique(np.stack([np.frombuffer(feature.as_py(), _TYPES["feature"]), np.frombuffer(threshold.as_py(), _TYPES["threshold"])], axis=1, dtype=np.float64), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1])], ["feature", "threshold"])

        pairs = self.nodes.select("feature", "threshold").mapInArrow(run, "feature int, threshold double").where("feature >= 0").distinct().collect()
        return [np.array(sorted(r["threshold"] for r in pairs if r["feature"] == f), np.float32) for f in range(self.features)]

    def scored(self, df: DataFrame, features: Column, name: str) -> DataFrame:
        """``df``, stored, with the mean over trees of the weighted share of label 1 in a row's leaf.

        Rows are a byte a feature, a few hundred in one value, and go once to each block of trees.
        """
        spark, width, edges, row = df.sparkSession, self.features, self.edges(), "_forest_row"
        kept = materialize(df.withColumn(row, F.monotonically_increasing_id()))

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, ids = b["features"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width), b[row].to_numpy()
                    # No edge is below what is not a number.
                    bins, starts = binned(np.where(np.isnan(x), -np.inf, x), edges), range(0, b.num_rows, ROWS_EACH)
                    values = [[v[k : k + ROWS_EACH].tobytes() for k in starts] for v in (ids, bins)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(ids[k]) for k in starts], pa.int64()), *[pa.array(v, pa.binary()) for v in values]], ["place", "ids", "data"])

        rows = materialize(kept.select(row, features.alias("features")).mapInArrow(narrow, "place long, ids binary, data binary"))
        sizes = sorted(tuple(r) for r in self.nodes.groupBy("tree").agg(F.sum(F.length("feature")).alias("bytes")).collect())
        block_of, block, inside = [], 0, 0
        for tree, size in sizes:
            nodes = size // 2
            if inside and inside + nodes > TASK_NODES:
                block, inside = block + 1, 0
            block_of.append((tree, block))
            inside += nodes
        known = ["feature", "threshold", "left", "value"]
        placed = self.nodes.join(F.broadcast(spark.createDataFrame(block_of, "tree int, block int")), "tree")
        trees = placed.select("block", F.lit(-1).cast("long").alias("place"), "tree", F.coalesce("piece", F.lit(0)).alias("piece"), *known, F.lit(None).cast("binary").alias("data"))
        none = [F.lit(None).cast("int").alias(c) for c in ("tree", "piece")] + [F.lit(None).cast("binary").alias(c) for c in known]
        every = rows.select(F.explode(F.sequence(F.lit(0), F.lit(block))).alias("block"), "place", *none, "data")
        dealt = trees.unionByName(every).repartitionById(block + 1, F.col("block")).sortWithinPartitions("block", "place", "tree", "piece")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, dict[str, list[np.ndarray]]] = {}
            walk = None
            for b in batches:
                first = int(np.count_nonzero(b["place"].to_numpy() < 0))
                for i in range(first):
                    mine = parts.setdefault(b["tree"][i].as_py(), {c: [] for c in known})
                    for c in known:
                        mine[c].append(np.frombuffer(b[c][i].as_py(), _TYPES[c]))
                data = b["data"].slice(first).to_pylist()
                if data:
                    if walk is None:
                        walk = Walk.of([_binned_tree(**{c: np.concatenate(p) for c, p in parts[t].items()}, edges=edges) for t in sorted(parts)], width)
                        parts.clear()
                    total = walk.total(np.frombuffer(b"".join(data), np.uint8).reshape(-1, width))
                    ends = np.cumsum([len(d) // width for d in data])[:-1]
                    votes = pa.array([v.tobytes() for v in np.split(total, ends)], pa.binary())
                    yield pa.RecordBatch.from_arrays([b["block"].slice(first), b["place"].slice(first), votes], ["block", "place", "votes"])

        count = len(sizes)

        def added(table: pa.Table) -> pa.Table:
            found = sorted(zip(table["block"].to_pylist(), table["votes"].to_pylist(), strict=True))
            mean = sum(np.frombuffer(v) for _, v in found) / count
            return pa.table({"place": table["place"].slice(0, 1), "votes": pa.array([mean.tobytes()], pa.binary())})

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                values = [np.frombuffer(b"".join(b[c].to_pylist()), kind) for c, kind in (("ids", np.int64), ("votes", np.float64))]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], [row, name])

        votes = dealt.mapInArrow(run, "block int, place long, votes binary").groupBy("place").applyInArrow(added, "place long, votes binary")
        scores = votes.join(rows.select("place", "ids"), "place").select("ids", "votes").mapInArrow(listed, f"{row} long, {name} double")
        return kept.join(scores, row).select(*df.columns, name)


def _binned_tree(feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, value: np.ndarray, edges: Sequence[np.ndarray]) -> Tree:
    """A tree to walk down with bins of ``edges``, among which its thresholds are."""
    bins = np.zeros(len(feature), np.float32)
    for f, e in enumerate(edges):
        mine = feature == f
        bins[mine] = np.searchsorted(e, threshold[mine])
    return Tree(feature, bins, left, value, np.zeros(0), np.zeros(0, np.int16))


def finished(nodes: DataFrame, features: int) -> Forest | StoredForest:
    """A stored table of trees as a forest: on the driver, if it has not too many nodes."""
    size = nodes.agg(F.coalesce(F.sum(F.length("feature")), F.lit(0)).alias("bytes")).head()["bytes"]
    return Forest.collect(nodes, features) if size // 2 <= HELD_NODES else StoredForest(nodes, features)


# --- the grid -------------------------------------------------------------------------------------


def grid_hits(train: Packed, *, trees: Sequence[int], depths: Sequence[int | None], leaves: Sequence[int], folds: int, seed: int = SEED) -> DataFrame:
    """trees, depth (-1: no limit), leaf, fold, rows, hits: held-out rows of label 1, and those found, some at a time.

    For each leaf size and fold the largest forest is grown on all rows of the other folds, once. Recall knows
    no rows of label 0, so the held-out ones of these are not scored.
    """
    order = sorted(depths, key=lambda d: (d is None, d or 0))
    marks = sorted(trees)
    dealt, each = train.dealt(marks[-1])
    count, features = train.rows, train.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = _read(batches, count, features + 2)
        for leaf in leaves:
            for out in range(folds):
                rest, ones = rows[:, features + 1] != out, rows[:, features] == 1
                learnt, positive = int(np.count_nonzero(rest)), int(np.count_nonzero(rest & ones))
                if learnt == len(rows):
                    continue
                weights, seen = _balanced(learnt - positive, positive), rows[np.flatnonzero(~rest & ones), :features]
                # By which forest sizes a tree belongs to: votes are added up between marks.
                sums: dict[int, np.ndarray] = {}
                for tree in range(block * each, min(marks[-1], (block + 1) * each)):
                    counts = _space(count, np.uint8)
                    counts[:] = 0
                    counts[rest] = bootstrap(learnt, tree, seed)
                    grown = _grown(_sampled(rows, features, counts), weights, tree, leaf, None, seed)
                    votes = sums.setdefault(sum(tree >= m for m in marks), np.zeros((len(order), len(seen))))
                    for lo in range(0, len(seen), PIECE):
                        votes[:, lo : lo + PIECE] += grown.walk(seen[lo : lo + PIECE], order)
                for part, votes in sums.items():
                    for d, v in zip(order, votes, strict=True):
                        starts = range(0, max(1, len(v)), VOTES_EACH)
                        fixed = [leaf, -1 if d is None else d, out, part, block]
                        arrays = [pa.array([k] * len(starts), pa.int32()) for k in fixed]
                        arrays += [pa.array([*range(len(starts))], pa.int32()), pa.array([v[k : k + VOTES_EACH].tobytes() for k in starts], pa.binary())]
                        yield pa.RecordBatch.from_arrays(arrays, ["leaf", "depth", "fold", "part", "block", "piece", "votes"])

    def counted(table: pa.Table) -> pa.Table:
        """Rows above one half, of one piece of the held-out rows, for each number of trees."""
        found = sorted(zip(*(table[c].to_pylist() for c in ("part", "block", "votes")), strict=True))
        total, out = np.zeros(len(found[0][2]) // 8), []
        for i, mark in enumerate(marks):
            for part, _, votes in found:
                if part == i:
                    total += np.frombuffer(votes)
            out.append((mark, *(table[c][0].as_py() for c in ("depth", "leaf", "fold")), len(total), int(np.count_nonzero(total / mark > 0.5))))
        names = ["trees", "depth", "leaf", "fold", "rows", "hits"]
        return pa.table({n: pa.array(c, pa.int32() if n in names[:4] else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)})

    votes = dealt.mapInArrow(run, "leaf int, depth int, fold int, part int, block int, piece int, votes binary")
    return votes.groupBy("leaf", "depth", "fold", "piece").applyInArrow(counted, "trees int, depth int, leaf int, fold int, rows long, hits long")


def recalls(hits: DataFrame) -> DataFrame:
    """trees, depth (-1: no limit), leaf, cv_recall: the mean over folds of the recall of label 1."""
    recall = F.coalesce(F.try_divide(F.sum("hits"), F.sum("rows")), F.lit(0.0))
    per_fold = hits.groupBy("trees", "depth", "leaf", "fold").agg(recall.alias("recall"))
    return per_fold.groupBy("trees", "depth", "leaf").agg(F.avg("recall").alias("cv_recall"))
