"""Session settings, and tables written to the cluster's shared folder."""

from __future__ import annotations

import time
import uuid
import weakref
from collections.abc import Callable, Hashable
from contextvars import ContextVar
from threading import Lock
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Else merged partitions grow with the tables, up to 64 MB or millions of keys in one task's hash table or sort.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}

def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on; ANSI mode is left as it is."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; without a setting, one in a local session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if not folder:
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored"
    if not local and folder.startswith(("file:", "/")):
        _probe(spark, folder.rstrip("/"))
    return folder.rstrip("/")


_probed: set[tuple[str, str]] = set()


def _probe(spark: SparkSession, folder: str) -> None:
    """A path of the local file system must be mounted everywhere: what executors write, the driver must see."""
    key = (spark.sparkContext.applicationId, folder)
    if key in _probed:
        return
    path, parts = f"{folder}/probe-{uuid.uuid4().hex}", 2 * max(2, spark.sparkContext.defaultParallelism)
    try:
        spark.range(0, parts, 1, parts).write.parquet(path)
        seen = spark.read.parquet(path).count()
    except Exception as error:
        raise ValueError(f"{folder} is not shared by all executors") from error
    finally:
        _delete(spark, path)
    if seen != parts:
        raise ValueError(f"{folder} is not shared by all executors")
    _probed.add(key)


def _delete(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True))


class Store:
    """Owner of stored tables, and of what was computed from them. ``close`` deletes both."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/storelens-{uuid.uuid4().hex}"
        self.tables = 0
        self._lock = Lock()
        self._cache: dict[Hashable, Any] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once to the store's folder and read it back."""
        with self._lock:
            path = f"{self.folder}/{self.tables}"
            self.tables += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def cached(self, key: Hashable, build: Callable[[], Any]) -> Any:
        """What ``build`` returned for ``key`` the first time; forgotten with the tables it reads."""
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    def close(self) -> int:
        """Delete the tables; how many there were."""
        count, self.tables = self.tables, 0
        self._cache.clear()
        if count:
            _delete(self.spark, self.folder)
        return count


_current: ContextVar[Store | None] = ContextVar("storelens_store", default=None)
_defaults: weakref.WeakKeyDictionary[SparkSession, Store] = weakref.WeakKeyDictionary()


class stored:  # noqa: N801 - used like a function
    """``with stored(spark) as s``: tables stored inside belong to ``s`` and go when the block ends."""

    def __init__(self, spark: SparkSession):
        self._store = Store(spark)

    def __enter__(self) -> Store:
        self._token = _current.set(self._store)
        return self._store

    def __exit__(self, *_: object) -> None:
        _current.reset(self._token)
        self._store.close()


def store_of(spark: SparkSession) -> Store:
    """The store of the surrounding ``with`` block, else the session's own."""
    inside = _current.get()
    if inside is not None and inside.spark is spark:
        return inside
    if spark not in _defaults:
        _defaults[spark] = Store(spark)
    return _defaults[spark]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the current store and read it back.

    Used where several passes follow an expensive plan, or where a value fixed at
    write time (a row's range bucket) must not change if an executor is lost.
    """
    return store_of(df.sparkSession).keep(df)


def release(spark: SparkSession) -> int:
    """Close the session's own store; tables of ``with`` blocks stay."""
    own = _defaults.pop(spark, None)
    return own.close() if own else 0


class CachedFrame:
    """One persisted DataFrame shared by several analyses.

    Rebuilt when older than ``ttl_seconds`` or after ``refresh()``.
    """

    def __init__(self, build: Callable[[], DataFrame], ttl_seconds: float = 3600.0):
        self._build = build
        self._ttl = ttl_seconds
        self._frame: DataFrame | None = None
        self._built_at = 0.0

    def get(self) -> DataFrame:
        if self._frame is not None and time.monotonic() - self._built_at > self._ttl:
            self.refresh()
        if self._frame is None:
            self._frame = self._build().persist(StorageLevel.MEMORY_AND_DISK)
            self._built_at = time.monotonic()
        return self._frame

    def refresh(self) -> None:
        if self._frame is not None:
            self._frame.unpersist()
            self._frame = None
