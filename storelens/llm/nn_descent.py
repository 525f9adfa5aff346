"""Embedding near-dedup by NN-descent.

Every vector holds a list of its nearest neighbours so far. Lists begin with the neighbours in a few tables of
random hyperplane hashes. In each round the neighbours of a vector, forward and reverse, are compared with each
other (neighbours-of-neighbours join), and what they find improves their lists. Links are the pairs at or above
the threshold, checked in double precision, that any list ever held. Where pairs compared in a bucket or a join link
vectors that lists leave apart, a spanning forest of them is kept beside the lists.

A list full of links is saturated: it may hide more. Components with saturated lists are compared with each other:
balls around them that are too far apart to link are left out, by the angles of their centres and radii. Each merged component is then
compared with itself, block by block, so its lists grow to all their links; only their numbers are kept.
An audit compares a sample of vectors with all others. The sample grows until enough of its vectors have a few
links, to a bound; the least recall of the group sizes counts. While it is below what is wanted, or the sample shows too few links to tell, the
lists are doubled and the rounds go on; if the last lists fall short too, each label is compared with itself, block by
block. The number of hash tables follows the number of hash bits.

Vectors link within one label and dimension only. Equal vectors of a label are one node with a multiplicity.
All rows move through Spark; numpy works on groups of bounded size.

Defined results: vectors that are null, empty, zero, or hold null or non-finite parts, and those without a label, have
no links and are components of their own. Equal rows link with each other like other equal vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, runs
from .components import components

THRESHOLD = 0.93
NEIGHBOURS = 12
TABLES = 4
ROUNDS = 3
RECALL = 0.98
ENLARGEMENTS = 3
#: Rows compared at once: in a hash bucket, among the neighbours of one vector, in a component.
CHUNK, LOCAL, BLOCK = 96, 64, 2048
#: Chance of a pair at the threshold to meet in some hash table.
MEET = 0.9
#: Vectors in the audit, at first and at most; it wants so many with one to FEW links. A group size counts from SEEN vectors.
AUDIT, AUDIT_MOST, EVIDENCE, FEW, SEEN = 256, 16_384, 100, 15, 10
SEED = 5
#: float32 candidates this close below the threshold are checked too.
SLACK = 1e-4

_EDGES = "src long, dst long, sim float, tie boolean"
_BALL = "label {label}, dim int, comp long, own int, centre binary, radius double"


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _stack(column: pa.Array, dtype: str) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype).reshape(len(parts), -1)


def nodes_of(rows: DataFrame, ws: Workspace) -> DataFrame:
    """node, label, dim, times, least, vec (unit, double, as bytes): one row per different vector of a label."""
    groups = rows.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"))
    groups = ws.keep(groups.withColumn("node", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = [_unit(np.array([v], np.float64))[0].tobytes() for v in batch["embedding"].to_pylist()]
            yield pa.record_batch([batch["node"], pa.array(unit, pa.binary())], names=["node", "vec"])

    unit = groups.select("node", "embedding").mapInArrow(run, "node long, vec binary")
    return ws.keep(groups.withColumn("dim", F.size("embedding")).join(unit, "node"))


def _ties(sim: np.ndarray, part: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join the parts of a group wherever its links do: a forest, and all pairs too close to the threshold to tell."""
    part, a, b = part.copy(), [], []
    sure = sim >= threshold + SLACK
    while (cross := sure & (part[:, None] != part[None, :])).any():
        i = int(cross.any(axis=1).argmax())
        others = np.flatnonzero(cross[i])
        met, one = np.unique(part[others], return_index=True)
        a += [i] * len(met)
        b += others[one].tolist()
        part[np.isin(part, met)] = part[i]
    i, j = np.nonzero(np.triu((sim >= threshold - SLACK) & ~sure & (part[:, None] != part[None, :]), 1))
    return np.concatenate([np.array(a, np.int64), i]), np.concatenate([np.array(b, np.int64), j])


def _hash_tables(nodes: DataFrame, tables: int, first: int, threshold: float) -> DataFrame:
    """Candidate edges from buckets of random hyperplane hashes, about sixteen vectors each."""
    sizes = nodes.groupBy("label", "dim").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / 16))).cast("int").alias("bits"))
    sized = nodes.join(sizes, ["label", "dim"]).select("node", "label", "dim", F.least("bits", F.lit(24)).alias("bits"), "vec")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim in set(batch["dim"].to_pylist()):
                own = batch.filter(pa.compute.equal(batch["dim"], dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim, first]).normal(size=(dim, tables * 24))
                v = _stack(own["vec"], "<f8")
                sign = (v @ planes[dim] > 0).reshape(len(v), tables, 24)
                used = np.arange(24)[None, :] < own["bits"].to_numpy()[:, None]
                codes = ((sign & used[:, None, :]) << np.arange(24)).sum(axis=2)
                small = [x.astype("<f4").tobytes() for x in v]
                for t in range(tables):
                    yield pa.record_batch(
                        [own["node"], own["label"], own["dim"], pa.array(codes[:, t] * tables + t), pa.array(small, pa.binary())], names=["node", "label", "dim", "bucket", "vec"]
                    )

    label_type = nodes.schema["label"].dataType.simpleString()
    coded = sized.mapInArrow(code, f"node long, label {label_type}, dim int, bucket long, vec binary")
    bucket = ["label", "dim", "bucket"]
    # A bucket of many like vectors is split by chance.
    splits = coded.select(*bucket).groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("splits"))
    dealt = coded.join(splits, bucket).withColumn("split", F.pmod(F.xxhash64("node", "bucket"), F.col("splits")))
    dealt = dealt.select(F.xxhash64(*bucket, "split").alias("key"), "dim", "node", "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "dim"]):
            v, ids = _stack(group["vec"], "<f4"), group["node"].to_numpy()
            if len(ids) < 2:
                continue
            sim = v @ v.T
            np.fill_diagonal(sim, -2)
            k = min(NEIGHBOURS, len(ids) - 1)
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            i, j = _ties(sim, np.arange(len(ids)), threshold)
            src, dst = np.concatenate([np.repeat(ids, k), ids[i]]), np.concatenate([ids[near].ravel(), ids[j]])
            sims = np.concatenate([np.take_along_axis(sim, near, 1).ravel(), sim[i, j]])
            yield pa.record_batch([pa.array(src), pa.array(dst), pa.array(sims), pa.array(np.arange(len(src)) >= len(ids) * k)], names=["src", "dst", "sim", "tie"])

    grouped = dealt.repartition("key", "dim").sortWithinPartitions("key", "dim")
    # Two labels that share a hash key may meet; such pairs are dropped.
    edges = grouped.mapInArrow(compare, _EDGES)
    return edges


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each list, and the ties: src, dst, sim, fresh, listed."""
    one = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.max("tie").alias("tie"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    one = one.withColumn("listed", rank <= k).where(F.col("listed") | F.col("tie"))
    return one.select("src", "dst", "sim", "fresh", "listed")


def _local_join(graph: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """What the neighbours of each vector are to each other, where it improves a list or ties what lists leave apart."""
    worst = graph.groupBy("src").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    linked = (F.col("sim") >= threshold + SLACK).alias("linked")
    both = graph.select(F.col("src").alias("at"), F.col("dst").alias("node"), "fresh", linked)
    both = both.union(graph.select("dst", "src", "fresh", linked)).groupBy("at", "node").agg(F.max("fresh").alias("fresh"), F.max("linked").alias("linked"))
    # Reverse lists of popular vectors are compared in parts.
    splits = both.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / LOCAL).cast("int").alias("splits"), F.max("fresh").alias("any")).where("any")
    both = both.join(splits, "at").withColumn("split", F.pmod(F.xxhash64("node", "at"), F.col("splits")).cast("int"))
    known = nodes.select("node", "vec", "label", "dim").join(worst.withColumnRenamed("src", "node"), "node", "left")
    rows = both.join(known, "node").select("at", "split", "dim", "node", "fresh", "linked", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"), "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, sims, ties, held = [], [], [], [], 0
        for group in runs(batches, ["at", "split", "dim"]):
            ids = group["node"].to_numpy()
            if len(ids) < 2:
                continue
            v = _stack(group["vec"], "<f8").astype("<f4")
            fresh, worst = group["fresh"].to_numpy(zero_copy_only=False), group["worst"].to_numpy()
            sim = v @ v.T
            good = (sim > worst[:, None]) & (fresh[:, None] | fresh[None, :])
            np.fill_diagonal(good, False)
            # What links to the vector in the middle hangs together by its list.
            part = np.where(group["linked"].to_numpy(zero_copy_only=False), 0, np.arange(1, len(ids) + 1))
            for (i, j), tie in ((np.nonzero(good), False), (_ties(sim, part, threshold), True)):
                src.append(ids[i])
                dst.append(ids[j])
                sims.append(sim[i, j])
                ties.append(np.full(len(i), tie))
                held += len(i)
            if held > 50_000:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (src, dst, sims, ties)], names=["src", "dst", "sim", "tie"])
                src, dst, sims, ties, held = [], [], [], [], 0
        if src:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (src, dst, sims, ties)], names=["src", "dst", "sim", "tie"])

    return rows.repartition("at", "split").sortWithinPartitions("at", "split", "dim").mapInArrow(compare, _EDGES)


def descend(nodes: DataFrame, start: DataFrame, k: int, rounds: int, threshold: float, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Rounds of neighbours-of-neighbours joins: the last lists, and every close pair that lists or ties ever held.

    Stops when a round changes under a hundredth of the lists' places.
    """
    every = ws.keep(_nearest(start, k))
    graph, close = every.where("listed"), every.where(F.col("sim") >= threshold - SLACK)
    places = max(1, graph.count())
    for _ in range(rounds):
        found = _local_join(graph, nodes, k, threshold).withColumn("fresh", F.lit(True))
        old = graph.select("src", "dst", "sim", F.lit(False).alias("tie"), F.lit(False).alias("fresh"))
        every = ws.keep(_nearest(old.unionByName(found), k))
        graph, close = every.where("listed"), close.unionByName(every.where(F.col("sim") >= threshold - SLACK))
        if graph.where("fresh").count() < places / 100:
            break
    return graph, close.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def exact_links(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of ``pairs`` whose cosine reaches the threshold in double precision, within one label."""
    a = nodes.select(F.col("node").alias("a"), F.col("vec").alias("va"), F.col("label").alias("la"), F.col("dim").alias("da"))
    b = nodes.select(F.col("node").alias("b"), F.col("vec").alias("vb"), F.col("label").alias("lb"), F.col("dim").alias("db"))
    rows = pairs.join(a, "a").join(b, "b").where((F.col("la") == F.col("lb")) & (F.col("da") == F.col("db")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch["va"].to_pylist(), batch["vb"].to_pylist()
            cosine = np.array([np.frombuffer(p, "<f8") @ np.frombuffer(q, "<f8") for p, q in zip(x, y, strict=True)])
            good = pa.array(cosine >= threshold, pa.bool_())
            yield pa.record_batch([batch["a"].filter(good), batch["b"].filter(good)], names=["a", "b"])

    return rows.select("a", "b", "va", "vb").mapInArrow(check, "a long, b long")


def _between(members: DataFrame, threshold: float, ws: Workspace) -> DataFrame:
    """(a, b): one link of any two of the components (comp, label, dim, node, vec) that link, or more.

    A component is one or several balls, a centre and the largest angle from it. Members are compared where the balls are close enough to hold a link.
    """
    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    m = members.join(sizes, "comp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    m = ws.keep(m.select("comp", "own", "label", "dim", "node", "vec"))
    label_type = m.schema["label"].dataType.simpleString()

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["comp", "own"]):
            v = _stack(group["vec"], "<f8")
            mean = v.mean(axis=0)
            centre = _unit(mean[None, :])[0] if np.abs(mean).max() > 1e-9 else v[0]
            radius = float(np.arccos(np.clip(v @ centre, -1, 1)).max())
            one = group.slice(0, 1)
            yield pa.record_batch(
                [*(pa.array(one[c].to_pylist(), group.schema.field(c).type) for c in ("label", "dim", "comp", "own")), pa.array([centre.tobytes()], pa.binary()), pa.array([radius])],
                names=["label", "dim", "comp", "own", "centre", "radius"],
            )

    dealt = m.repartition("comp", "own").sortWithinPartitions("comp", "own")
    balls = ws.keep(dealt.mapInArrow(wrap, _BALL.format(label=label_type)))
    groups = balls.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    b = balls.join(groups, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("comp", "own"), F.col("n")).cast("int"))
    b = b.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    b = b.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    reach = float(np.arccos(np.clip(threshold, -1, 1)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["label", "dim", "i", "j"]):
            v, r = _stack(group["centre"], "<f8"), group["radius"].to_numpy()
            comp, own, block = (group[c].to_numpy() for c in ("comp", "own", "block"))
            here, there = np.flatnonzero(block == group["i"].to_numpy()), np.flatnonzero(block == group["j"].to_numpy())
            for at in range(0, len(here), 256):
                part = here[at : at + 256]
                angle = np.arccos(np.clip(v[part] @ v[there].T, -1, 1))
                x, y = np.nonzero((angle <= r[part][:, None] + r[there][None, :] + reach + 1e-6) & (comp[part][:, None] != comp[there][None, :]))
                x, y = part[x], there[y]
                # A pair inside one block is seen from both sides.
                once = (block[x] != block[y]) | (comp[x] < comp[y])
                x, y = x[once], y[once]
                yield pa.record_batch([pa.array(z) for z in (comp[x], own[x], comp[y], own[y])], names=["c0", "o0", "c1", "o1"])

    near = b.select("label", "dim", "i", "j", "block", "comp", "own", "centre", "radius").repartition("label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j")
    near = ws.keep(near.mapInArrow(meet, "c0 long, o0 int, c1 long, o1 int").withColumn("pair", F.monotonically_increasing_id()))
    side = lambda k: near.select("pair", F.lit(k).alias("side"), F.col(f"c{k}").alias("comp"), F.col(f"o{k}").alias("own"))
    rows = side(0).unionByName(side(1)).join(m, ["comp", "own"]).select("pair", "side", "node", "vec")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["pair"]):
            v, ids, first = _stack(group["vec"], "<f8"), group["node"].to_numpy(), group["side"].to_numpy() == 0
            here, there = np.flatnonzero(first), np.flatnonzero(~first)
            for at in range(0, len(here), 256):
                x, y = np.nonzero(v[here[at : at + 256]] @ v[there].T >= threshold)
                if len(x):
                    yield pa.record_batch([pa.array(ids[here[at + x[:1]]]), pa.array(ids[there[y[:1]]])], names=["a", "b"])
                    break

    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(link, "a long, b long")


def _block_pairs(members: DataFrame) -> DataFrame:
    """comp, i, j, block, node, times, vec: the members of each component in blocks, a copy for each block they meet, pairs together."""
    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    m = members.join(sizes, "comp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # Blocks meet in ordered pairs, and a row says which side of its pair it is on.
    m = m.select("comp", "own", "node", "times", "vec", other.alias("other"))
    least, most = F.least("own", "other"), F.greatest("own", "other")
    m = m.select("comp", least.alias("i"), most.alias("j"), F.col("own").alias("block"), "node", "times", "vec")
    return m.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")


def _inside(members: DataFrame, threshold: float) -> DataFrame:
    """node, links: of the members (comp, dim, node, times, vec) of each component with each other, block by block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["comp", "i", "j"]):
            v, ids, times = _stack(group["vec"], "<f8"), group["node"].to_numpy(), group["times"].to_numpy()
            first = group["block"].to_numpy() == group["i"].to_numpy()
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            links = np.zeros(len(ids), np.int64)
            here = np.flatnonzero(first)
            there = here if i == j else np.flatnonzero(~first)
            for at in range(0, len(here), 256):
                part = here[at : at + 256]
                near = v[part] @ v[there].T >= threshold
                if i == j:
                    near[np.arange(len(part)), np.arange(at, at + len(part))] = False
                    links[part] += near @ times[there]
                else:
                    links[part] += near @ times[there]
                    links[there] += times[part] @ near
            yield pa.record_batch([pa.array(ids), pa.array(links)], names=["node", "links"])

    counted = _block_pairs(members).mapInArrow(count, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric link matrix: one tree per component, breadth first."""
    left, a, b = np.ones(len(near), bool), [], []
    for start in range(len(near)):
        front = np.array([start]) if left[start] else np.array([], np.int64)
        left[start] = False
        while len(front):
            rows = near[front] & left
            new = np.flatnonzero(rows.any(axis=0))
            a.append(front[rows[:, new].argmax(axis=0)])
            b.append(new)
            left[new] = False
            front = new
    none = [np.array([], np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def every_link(nodes: DataFrame, threshold: float, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(a, b) joining whatever links join, and (node, links): exact, by comparing each label with itself block by block.

    The work grows with the square of a label's vectors; a task holds two blocks and sends counts and a forest, not the pairs.
    """
    comp = nodes.groupBy("label", "dim").agg(F.min("node").alias("comp"))
    members = nodes.join(comp, ["label", "dim"]).select("comp", "node", "times", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["comp", "i", "j"]):
            v, ids, times = _stack(group["vec"], "<f8"), group["node"].to_numpy(), group["times"].to_numpy()
            # Pairs inside a block belong to the group in which it meets itself.
            block, own = group["block"].to_numpy(), group["i"][0].as_py() == group["j"][0].as_py()
            near = np.empty((len(v), len(v)), bool)
            for at in range(0, len(v), 256):
                near[at : at + 256] = v[at : at + 256] @ v.T >= threshold
                if not own:
                    near[at : at + 256] &= block[at : at + 256, None] != block[None, :]
            np.fill_diagonal(near, False)
            # Rounding may differ by the side a pair is seen from.
            near |= near.T
            links = np.array([row @ times for row in near], np.int64)
            a, b = _forest(near)
            nothing = pa.nulls(len(a), pa.int64())
            yield pa.record_batch([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(links)], names=["node", "other", "links"])
            yield pa.record_batch([pa.array(ids[a]), pa.array(ids[b]), nothing], names=["node", "other", "links"])

    found = ws.keep(_block_pairs(members).mapInArrow(run, "node long, other long, links long"))
    pairs = found.where(F.col("other").isNotNull()).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    return pairs, found.where(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("links"))


def tables_for(nodes: DataFrame, tables: int, threshold: float) -> int:
    """``tables``, or more where the labels' hashes are so long that a pair at the threshold would often miss."""
    most = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits = min(24, max(0, int(np.ceil(np.log2(max(most, 1) / 16)))))
    meets = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return tables if meets >= MEET else max(tables, int(np.ceil(np.log(1 - MEET) / np.log1p(-meets))))


def _true_links(nodes: DataFrame, threshold: float, sample: int) -> DataFrame:
    """node, n: true links of a sample of vectors, with those of equal ones."""
    picked = nodes.orderBy(F.xxhash64("node", F.lit(SEED))).limit(sample).select("node", "label", "dim", "vec").toArrow()
    held: dict[tuple, list] = {}
    for r in picked.to_pylist():
        held.setdefault((r["label"], r["dim"]), []).append((r["node"], np.frombuffer(r["vec"], "<f8")))
    queries = {key: (np.array([n for n, _ in rows]), np.stack([v for _, v in rows])) for key, rows in held.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        queries = shared.value
        for batch in batches:
            keys = list(zip(batch["label"].to_pylist(), batch["dim"].to_pylist(), strict=True))
            for key in set(keys) & set(queries):
                own = np.flatnonzero([k == key for k in keys])
                v = _stack(batch["vec"].take(pa.array(own)), "<f8")
                times = batch["times"].to_numpy()[own]
                ids, q = queries[key]
                n = sum((q @ v[at : at + 512].T >= threshold) @ times[at : at + 512] for at in range(0, len(v), 512))
                for i, x in zip(ids.tolist(), n.tolist(), strict=True):
                    total[i] = total.get(i, 0) + x
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "n"])

    return nodes.select("label", "dim", "times", "vec").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def audit(nodes: DataFrame, links: DataFrame, threshold: float, sample: int = AUDIT) -> float | None:
    """Least share, over all links and those of each group size, of the true links of a sample that ``links`` (node, links) has.

    None where a sample of the greatest size shows too few vectors with few links. A sample of all vectors is never too small.
    """
    every = nodes.count()
    while True:
        both = _true_links(nodes, threshold, sample).join(nodes.select("node", "times"), "node").join(links, "node", "left")
        real = (F.col("n") - F.col("times")).alias("real")
        both = both.select(real, F.coalesce("links", F.lit(0)).alias("links")).where(F.col("real") > 0)
        # Group sizes by powers of four.
        size = F.floor(F.log2("real") / 2).alias("size")
        sums = both.groupBy(size).agg(
            F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("real") <= FEW).alias("few"), F.sum("real").alias("real"), F.sum(F.least("links", "real")).alias("found")
        ).collect()
        if sample >= every or sum(r["few"] for r in sums) >= EVIDENCE:
            break
        if sample >= AUDIT_MOST:
            return None
        sample = min(4 * sample, AUDIT_MOST)
    if not sums:
        return 1.0
    pooled = sum(r["found"] for r in sums) / sum(r["real"] for r in sums)
    return min([pooled, *(r["found"] / r["real"] for r in sums if r["vectors"] >= SEEN)])


def near_duplicates(
    rows: DataFrame,
    threshold: float = THRESHOLD,
    *,
    neighbours: int = NEIGHBOURS,
    tables: int = TABLES,
    rounds: int = ROUNDS,
    recall: float = RECALL,
    exact: bool = True,
    workspace: Workspace | None = None,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label); ``audited_recall`` as well.

    Where the audit still finds less than ``recall``, or too few links to tell, after the last enlargement, each label is
    compared with itself (recall 1). With ``exact=False`` the lists' result stands then, its recall low or null.
    """
    ws = Workspace.of(rows.sparkSession, workspace)
    rows = rows.select("vec_id", "embedding", "label").withColumn("good", usable(F.col("embedding")) & F.col("label").isNotNull())
    nodes = nodes_of(rows.where("good"), ws)
    tables = tables_for(nodes, tables, threshold)
    k, graph, pairs, reached, links, named = neighbours, None, None, 0.0, None, None
    for attempt in range(ENLARGEMENTS + 1):
        found = _hash_tables(nodes, tables, attempt, threshold).withColumn("fresh", F.lit(True))
        old = None if graph is None else graph.select("src", "dst", "sim", F.lit(False).alias("tie"), F.lit(True).alias("fresh"))
        graph, close = descend(nodes, found if old is None else old.unionByName(found), k, rounds, threshold, ws)
        # Links of earlier attempts stay.
        new = exact_links(close if pairs is None else close.join(pairs, ["a", "b"], "left_anti"), nodes, threshold)
        pairs = ws.keep(new if pairs is None else pairs.unionByName(new))
        named = ws.keep(components(pairs, ws))
        saturated = graph.where(F.col("sim") >= threshold - SLACK).groupBy("src").count().where(F.col("count") >= k).select(F.col("src").alias("node"))
        hidden = named.join(saturated, "node").select("root").distinct()
        members = named.join(hidden, "root").join(nodes, "node").select(F.col("root").alias("comp"), "label", "dim", "node", "vec")
        more = ws.keep(_between(members, threshold, ws))
        if not more.isEmpty():
            pairs = ws.keep(pairs.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
            named = ws.keep(components(pairs, ws))
            hidden = named.join(saturated, "node").select("root").distinct()
        inside = named.join(hidden, "root").join(nodes, "node").select(F.col("root").alias("comp"), "node", "times", "vec")
        both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
        listed = both.join(nodes.select(F.col("node").alias("other"), "times"), "other").groupBy("node").agg(F.sum("times").alias("listed"))
        counted = _inside(inside, threshold).withColumnRenamed("links", "counted")
        links = ws.keep(listed.join(counted, "node", "left").select("node", F.coalesce("counted", "listed").alias("links")))
        reached = audit(nodes, links, threshold)
        if reached is not None and reached >= recall:
            break
        k *= 2
    else:
        if exact:
            pairs, links = every_link(nodes, threshold, ws)
            named, reached = ws.keep(components(pairs, ws)), 1.0
    least = named.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    classes = named.join(least, "root").select("node", "component")
    known = nodes.select("node", "label", "embedding", "times", "least").join(links, "node", "left").join(classes, "node", "left")
    known = known.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "least").alias("c"))
    out = rows.join(known, F.col("good") & (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left")
    component = F.when(F.col("good"), F.col("c")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(reached).cast("double").alias("audited_recall"))


def brute_force(vectors: Sequence[Sequence[float]], threshold: float = THRESHOLD) -> np.ndarray:
    """Link matrix of a small set of usable vectors, for tests."""
    v = _unit(np.asarray(vectors, np.float64))
    links = v @ v.T >= threshold
    np.fill_diagonal(links, False)
    return links
