"""Sharding by a Feistel permutation: a reproducible shuffle with computable places.

Rows get global numbers in the order of their key, and a keyed permutation of 0 .. n-1 turns a
number into a position: shard is the position modulo the number of shards, slot is the quotient. So
shards differ by at most one row, slots have no gaps, and nothing but n, the seed and the number of
shards is needed to say where row i lies (``Permutation.forward``) or which row lies in a slot
(``Permutation.backward``).

The permutation is a Feistel network over the least power of two that holds n; a value that leaves
0 .. n-1 is sent through again until it is back (cycle walking), twice on average at most.

Numbers come from a range partitioning by (key, hash of the other columns, input position), written
once, and the sizes of its partitions. The last part of the key splits any number of equal rows; as
such rows are interchangeable and lie together, the result doesn't depend on the input's layout.

Defined results: null keys come first; rows of equal key are ordered by the hash of their other
columns, maps and variants left out. Equal rows are rows of their own, so copies of one text may lie
in different shards; the law is ``rows`` and groups play no part. An empty table gives an empty one.
Other columns are carried along; ``law, shard, slot`` follow them, and a column of the table that has
one of these names gives way to them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

SHARDS = 16
SEED = 12
#: An even number, so that halves of unequal width are back in their places.
ROUNDS = 8
# Odd multipliers and shifts of the round function, on 32 bits.
MULTIPLY = (2654435761, 2246822519)
SHIFTS = (15, 13)
WORD = 2**32 - 1
#: monotonically_increasing_id() holds the partition above so many bits and the row below them.
ROW_BITS = 33


def round_keys(seed: int) -> list[int]:
    return [zlib.crc32(f"{seed}:{r}".encode()) for r in range(ROUNDS)]


class Permutation:
    """A keyed permutation of 0 .. n-1 and its inverse, on arrays."""

    def __init__(self, n: int, seed: int = SEED):
        bits = max(2, (n - 1).bit_length())
        self.n, self.keys = n, round_keys(seed)
        self.widths = (bits - bits // 2, bits // 2)

    @staticmethod
    def _mix(half: np.ndarray, key: int) -> np.ndarray:
        h = ((half ^ np.uint64(key)) * np.uint64(MULTIPLY[0])) & np.uint64(WORD)
        h = ((h ^ (h >> np.uint64(SHIFTS[0]))) * np.uint64(MULTIPLY[1])) & np.uint64(WORD)
        return h ^ (h >> np.uint64(SHIFTS[1]))

    def _once(self, value: np.ndarray, back: bool) -> np.ndarray:
        high, low = self.widths
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            # Before an even round the left half has ``high`` bits, before an odd one ``low`` bits.
            a, b = (high, low) if r % 2 == 0 else (low, high)
            if back:
                left, right = value >> np.uint64(a), value & np.uint64((1 << a) - 1)
                value = ((right ^ (self._mix(left, self.keys[r]) & np.uint64((1 << a) - 1))) << np.uint64(b)) | left
            else:
                left, right = value >> np.uint64(b), value & np.uint64((1 << b) - 1)
                value = (right << np.uint64(a)) | (left ^ (self._mix(right, self.keys[r]) & np.uint64((1 << a) - 1)))
        return value

    def _walk(self, values: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(values).astype(np.uint64), back)
        outside = np.flatnonzero(out >= self.n)
        while len(outside):
            out[outside] = self._once(out[outside], back)
            outside = outside[out[outside] >= self.n]
        return out.astype(np.int64)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """Positions of row numbers."""
        return self._walk(rows, False)

    def backward(self, positions: np.ndarray) -> np.ndarray:
        """Row numbers at positions; position = slot * shards + shard."""
        return self._walk(positions, True)


def numbered(df: DataFrame, key: str, ws: Workspace) -> tuple[DataFrame, int]:
    """Rows of ``df`` as one struct ``_all``, with their global ``_number`` from 0; and how many there are."""
    spark = df.sparkSession
    plain = [df[c] for c in df.columns if c != key and not any(t in df.schema[c].dataType.simpleString() for t in ("map<", "variant"))]
    tie = F.xxhash64(*plain) if plain else F.lit(0).cast("long")
    whole = F.struct(*[df[c].alias(f"_{i}") for i, c in enumerate(df.columns)])
    packed = df.select(df[key].alias("_key"), tie.alias("_tie"), F.monotonically_increasing_id().alias("_salt"), whole.alias("_all"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["_key", "_tie", "_salt"]
    stored = ws.keep(packed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_all", F.monotonically_increasing_id().alias("_at")))
    stored = stored.withColumn("_part", F.shiftright("_at", ROW_BITS))
    # A row for each partition of the sort.
    sizes = sorted((r["_part"], r["count"]) for r in stored.groupBy("_part").count().collect())
    total, before = 0, []
    for part, size in sizes:
        before.append((part, total))
        total += size
    starts = spark.createDataFrame(before, "_part long, _before long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return stored.join(F.broadcast(starts), "_part").select("_all", (F.col("_before") + inside).alias("_number")), total


def shard(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, seed: int = SEED, *, workspace: Workspace | None = None) -> DataFrame:
    """The columns of ``df``, then law, shard and slot."""
    df = df.drop("law", "shard", "slot")
    rows, n = numbered(df, key, Workspace.of(df.sparkSession, workspace))
    permutation = Permutation(n, seed)

    @F.arrow_udf("long")
    def position(numbers: pa.Array) -> pa.Array:
        return pa.array(permutation.forward(numbers.to_numpy(zero_copy_only=False)))

    at = F.col("_position")
    return rows.withColumn("_position", position("_number")).select(
        *[F.col(f"_all._{i}").alias(c) for i, c in enumerate(df.columns)],
        F.lit("rows").alias("law"),
        (at % shards).cast("int").alias("shard"),
        F.expr(f"_position div {int(shards)}").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str, parts: int | None = None) -> None:
    """Whole rows as parquet under ``path/shard=<number>``, each file a run of slots in order."""
    count = parts or int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded.repartitionByRange(count, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
