"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits. Two within four differing bits differ in at most one bit of one of three
parts (22, 21 and 21 bits). Each part has a covering code: its code words are the anchors. A part is
made of blocks, and a block is either perfectly covered (seven bits by the Hamming code: every value
lies within one bit of exactly one code word) or covered by all its values (radius 0). A fingerprint
is at home at the nearest anchor of each part, and is replicated to every anchor within the radius plus one
bit that can be the home of a fingerprint one bit away. So two linked fingerprints meet at the home
anchor of either. At an anchor the fingerprints at home are held and compared
with all that are there, which pass by in chunks.

How many blocks use the Hamming code follows from the number of different fingerprints: more
fingerprints take finer codes, so anchors stay small. All choices give the same links.

Equal fingerprints are one before the covering. An anchor with more than ``block`` homes is split: homes by
salt, with the replicas sent to every split. An anchor returns a spanning forest of the links it found,
not its pairs.

Defined results: a text with fewer words than a shingle is one shingle of all its words, one without
words (null, empty) has fingerprint zero, which links like any other. Equal rows each get a row. A null
doc_id counts as no id: it isn't the least of its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, pack, unpack
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Most fingerprints at home that one task compares at an anchor.
BLOCK = 16_384
#: Shingles whose hashes are held at once.
CHUNK = 1 << 16
#: (first bit, blocks of seven bits, single bits) of the parts; each is allowed one differing bit.
PARTS = ((0, 3, 1), (22, 3, 0), (43, 3, 0))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in more than half of the shingles' XXH64 hashes."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    first = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()
    n = max(1, len(parts) - shingle + 1)
    stops = last[shingle - 1 :] if len(parts) >= shingle else last[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + CHUNK], stops[at : at + CHUNK], strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * counts > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _add_fingerprint(rows: DataFrame, shingle: int, seed: int, keep_text: bool) -> DataFrame:
    """Column fp, a signed 64-bit integer, in place of or beside the text."""
    kept = [c for c in rows.columns if c != "text" or keep_text]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(found)], names=[*kept, "fp"])

    return rows.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp."""
    return _add_fingerprint(docs.select("doc_id", "text"), shingle, seed, False)


def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """Home code word of each seven-bit value, and up to three other homes of values one bit away (else the own home)."""
    syndrome = lambda v: np.bitwise_xor.reduce(np.where((v[:, None] >> np.arange(7)) & 1, np.arange(1, 8), 0), axis=1)
    v = np.arange(128)
    s = syndrome(v)
    home = np.where(s > 0, v ^ (1 << np.maximum(s - 1, 0)), v)
    near = np.empty((128, 3), np.int64)
    for x in range(128):
        others = sorted({int(home[x ^ (1 << b)]) for b in range(7)} - {int(home[x])})
        near[x] = [*others, *[home[x]] * (3 - len(others))]
    return home, near


HOME, NEAR = _hamming()


def anchors(fps: np.ndarray, coded: int, parts=PARTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) of every replica. ``coded``: how many seven-bit blocks of a part use the Hamming code."""
    rows, keys, homes = [], [], []
    each = np.arange(len(fps))
    for number, (low, blocks, singles) in enumerate(parts):
        width = 7 * blocks + singles
        value = (fps >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
        home = value.copy()
        for b in range(min(coded, blocks)):
            own = (value >> 7 * b) & 127
            home ^= (own ^ HOME[own]) << 7 * b

        def emit(key: np.ndarray, at_home: bool, where: np.ndarray, number: int = number) -> None:
            rows.append(where)
            keys.append(key | (number << 32))
            homes.append(np.full(len(key), at_home))

        emit(home, True, each)
        for b in range(blocks):
            own = (value >> 7 * b) & 127
            if b < coded:
                for k in range(3):
                    there = NEAR[own, k] != HOME[own]
                    emit((home ^ ((HOME[own] ^ NEAR[own, k]) << 7 * b))[there], False, each[there])
            else:
                for bit in range(7):
                    emit(home ^ (1 << (7 * b + bit)), False, each)
        for bit in range(7 * blocks, width):
            emit(home ^ (1 << bit), False, each)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def choose_code(n: int) -> int:
    """Coded blocks per part (3, 2, 1 or 0) with the least work for ``n`` fingerprints, counted as replicas and comparisons."""

    def work(coded: int) -> float:
        replicas = 3 * (1 + 2.6 * coded + 7 * (3 - coded))
        comparisons = 3 * (replicas / 3) * n / 2 ** (4 * coded + 7 * (3 - coded))
        return replicas * 500 + comparisons  # a shuffled row costs some 500 comparisons

    return min((3, 2, 1, 0), key=work)


class Anchor:
    """Links at one anchor. Fingerprints at home are held, all others pass by in chunks."""

    def __init__(self, max_bits: int):
        self.max_bits = max_bits
        self.homes, self.label = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, fps: np.ndarray, home: bool) -> list[tuple[int, int]]:
        """Links that join what was apart: at most one per fingerprint and one per group it joins."""
        if home:
            self.label = np.concatenate([self.label, np.arange(len(self.homes), len(self.homes) + len(fps))])
            self.homes = np.concatenate([self.homes, fps])
        out = []
        step = max(1, (1 << 21) // max(1, len(self.homes)))
        for at in range(0, len(fps), step):
            part = fps[at : at + step]
            near = np.bitwise_count(part[:, None] ^ self.homes[None, :]) <= self.max_bits
            for i in np.flatnonzero(near.sum(axis=1) > int(home)):
                found = np.flatnonzero(near[i])
                groups, first = np.unique(self.label[found], return_index=True)
                if home and len(groups) == 1:
                    continue
                out += [(part[i], self.homes[k]) for k in found[first]]
                if len(groups) > 1:
                    self.label[np.isin(self.label, groups[1:])] = groups[0]
        return out


def near_edges(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, workspace: Workspace | None = None) -> DataFrame:
    """(a, b): fingerprints whose links join the same groups as all links of at most ``max_bits`` bits. ``distinct`` holds fp once each."""
    if max_bits >= 2 * len(PARTS):
        raise ValueError(f"{len(PARTS)} parts with one bit each cover at most {2 * len(PARTS) - 1} bits")
    ws = Workspace.of(distinct.sparkSession, workspace)
    coded = choose_code(distinct.count())

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                row, key, home = anchors(part := fps[at : at + 4096], coded)
                yield pa.record_batch([pa.array(key), pa.array(part[row].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    spread = ws.keep(distinct.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean"))
    # Anchors with one fingerprint link nothing; those with too many are split.
    sizes = spread.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("homes"))
    sizes = sizes.where((F.col("n") > 1) & (F.col("homes") > 0)).select("anchor", F.ceil(F.col("homes") / block).cast("int").alias("splits"))
    rows = spread.join(sizes, "anchor")
    salt = F.pmod(F.xxhash64("fp"), F.col("splits")).cast("int")
    dealt = rows.select("anchor", "fp", F.col("home"), salt.alias("own"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"))
    dealt = dealt.select("anchor", "salt", "fp", (F.col("home") & (F.col("own") == F.col("salt"))).alias("home"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of an anchor lie together, those at home first, maybe over several batches."""
        key, anchor = None, Anchor(max_bits)
        for batch in batches:
            columns = [batch[n].to_numpy(zero_copy_only=False) for n in ("anchor", "salt", "home")]
            fps = batch["fp"].to_numpy().view(np.uint64)
            change = np.zeros(max(0, len(fps) - 1), bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(fps)]
            out = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                here = (columns[0][lo], columns[1][lo])
                if here != key:
                    key, anchor = here, Anchor(max_bits)
                out += anchor.add(fps[lo:hi], bool(columns[2][lo]))
            ends = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    sorted_rows = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.col("home").desc())
    return sorted_rows.mapInArrow(compare, "a long, b long")


def _roots(distinct: DataFrame, max_bits: int, ws: Workspace) -> DataFrame:
    """fp, root of every fingerprint: equal roots are one group."""
    joined = components(near_edges(distinct, max_bits, workspace=ws), ws)
    return distinct.select("fp").join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED, *, workspace: Workspace | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id of the group)."""
    ws = Workspace.of(docs.sparkSession, workspace)
    marked = ws.keep(fingerprints(docs, shingle, seed))
    distinct = ws.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = ws.keep(_roots(distinct, max_bits, ws).join(distinct, "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    out = marked.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED, *, workspace: Workspace | None = None) -> DataFrame:
    """One row of ``docs`` for each group, with all columns: that of the least doc_id."""
    ws = Workspace.of(docs.sparkSession, workspace)
    packed = pack(docs, "doc_id", "text").withColumnRenamed("doc_id", "_id")
    marked = ws.keep(_add_fingerprint(packed, shingle, seed, True).withColumn("_number", F.monotonically_increasing_id()))
    best = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_number"))).alias("best")
    distinct = ws.keep(marked.groupBy("fp").agg(best))
    stays = _roots(distinct, max_bits, ws).join(distinct, "fp").groupBy("root").agg(F.min("best").alias("best"))
    chosen = marked.join(stays.select(F.col("best._number").alias("_number")), "_number", "left_semi")
    return unpack(chosen.withColumnRenamed("_id", "doc_id"), docs.columns, "doc_id", "text")
