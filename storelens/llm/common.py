"""Shared helpers: word splitting, tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.session import configure, shared_folder

# White space between words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"{NOT_SPACE}+")).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def pack(docs: DataFrame, *apart: str) -> DataFrame:
    """``apart`` as columns, and all other columns in a struct ``_row``: their names can't clash with an operator's own."""
    others = [c for c in docs.columns if c not in apart]
    row = F.struct(F.lit(0).alias("_"), *[docs[c].alias(f"_{k}") for k, c in enumerate(others)])
    return docs.select(*[docs[c] for c in apart], row.alias("_row"))


def unpack(rows: DataFrame, columns: list[str], *apart: str) -> DataFrame:
    """The columns of the table that ``pack`` took, in their order."""
    others = [c for c in columns if c not in apart]
    place = {c: F.col(f"_row._{k}") for k, c in enumerate(others)} | {c: F.col(c) for c in apart}
    return rows.select(*[place[c].alias(c) for c in columns])


class Workspace:
    """A folder of stored tables under ``spark.checkpoint.dir``, and their owner.

    ``close()`` or leaving the ``with`` block deletes them. A workspace that an operator
    made for itself lives as long as the Python process, since its result reads it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.name = f"llm-{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{self.name}"
        self._count = 0

    @classmethod
    def of(cls, spark: SparkSession, given: Workspace | None) -> Workspace:
        if given is not None:
            return given
        own = cls(spark)
        atexit.register(own.close)
        return own

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and read it back: cuts lineage, and fixes what was decided at write time."""
        self._count += 1
        path = f"{self.path}/{self._count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @property
    def last(self) -> str:
        """Where the table kept last lies."""
        return f"{self.path}/{self._count}"

    def drop(self, path: str) -> None:
        """Delete one table, which nothing reads any more."""
        context = self.spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            return
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)

    def close(self) -> None:
        self.drop(self.path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of equal ``names``, which must lie together, as one batch each. For groups of bounded size."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[n].to_numpy(zero_copy_only=False) for n in names]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


class Numbering(dict):
    """Numbers its keys in the order in which they are first looked up."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number
