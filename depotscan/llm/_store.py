"""Tables in the shared folder, and joins whose key side is broadcast only when its counted size allows."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotscan import storage
from depotscan.storage import discard, new_path

__all__ = ["BATCH", "BROADCAST_KEYS", "bounded", "discard", "new_path", "release", "semi", "small", "store"]

#: Bytes of a batch that goes to Python within bounded(), so while a table is stored: batches are held by the JVM and the worker, several times over.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

#: Keys that may be broadcast: as a hash table about 110 MB on each executor for 8-byte keys, 250 MB for digests.
BROADCAST_KEYS = 2_000_000


def semi(rows: DataFrame, keys: DataFrame, on: list[str], n_keys: int, how: str = "left_semi") -> DataFrame:
    """rows whose key is in keys (left_anti: is not). The keys are broadcast only when n_keys, their counted number, is within BROADCAST_KEYS; else both sides shuffle."""
    return rows.join(small(keys, n_keys), on, how)


def small(keys: DataFrame, n_keys: int) -> DataFrame:
    return F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """Queries that run within send batches of bounded size to Python."""
    before = spark.conf.get(BATCH[0], None)
    spark.conf.set(*BATCH)
    try:
        yield
    finally:
        spark.conf.unset(BATCH[0]) if before is None else spark.conf.set(BATCH[0], before)


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back, with batches of bounded size on the way through Python."""
    with bounded(df.sparkSession):
        return storage.store(df, tag)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more: it does so when the driver's garbage is collected, which may else be hours later."""
    gc.collect()
    spark._jvm.System.gc()
