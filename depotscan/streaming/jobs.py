"""Incremental counterparts of the batch operators as Structured Streaming jobs, with state on executors' disks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depotscan import storage
from depotscan.operators.sets import latest_per_name_arch

#: State is held by RocksDB on local disks, so it may be larger than memory; each micro-batch sends its changes to the checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state on disk."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_intern(stream: DataFrame, digest: str = "digest", ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Each digest once. Without a delay none is ever forgotten, as in the batch operator; with one, state for a digest goes after it, so later copies come again."""
    if delay is None:
        return stream.dropDuplicates([digest])
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([digest])


def stream_latest(stream: DataFrame, state_path: str, checkpoint: str, every: int = 10) -> StreamingQuery:
    """Keeps the newest row of each (name, arch) in keyed state, which has no watermark and so never lets a name go.

    Each micro-batch writes the rows that changed to state_path/batch=n, and run again overwrites only its own. After
    every so many, they are merged with the last snapshot into state_path/snapshot=n, a row for each key. What a snapshot
    has taken in is deleted when the next one is complete, so a reader that began before it can end."""
    spark = stream.sparkSession

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{state_path}/batch={epoch}")
        if (epoch + 1) % every == 0 and epoch not in storage.parts(spark, state_path, "snapshot"):
            older = storage.parts(spark, state_path, "snapshot")
            latest_state(spark, state_path, epoch).write.mode("overwrite").parquet(f"{state_path}/snapshot={epoch}")
            if older:
                for n in older[:-1]:
                    storage.remove(spark, f"{state_path}/snapshot={n}")
                for n in storage.parts(spark, state_path, "batch"):
                    if n <= older[-1]:
                        storage.remove(spark, f"{state_path}/batch={n}")

    with disk_state(spark):
        return latest_per_name_arch(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, state_path: str, upto: int | None = None) -> DataFrame:
    """The newest rows of what stream_latest has written (up to a micro-batch): the last snapshot and the changes since, of
    which the last one of a key counts, by an aggregate that tasks combine."""
    fits = lambda kind: [n for n in storage.parts(spark, state_path, kind) if upto is None or n <= upto]
    base = [n for n in fits("snapshot") if upto is None or n < upto][-1:]
    paths = [f"{state_path}/snapshot={n}" for n in base] + [f"{state_path}/batch={n}" for n in fits("batch") if not base or n > base[0]]
    return latest_per_name_arch(spark.read.parquet(*paths))


def stream_cache_activity(stream: DataFrame, key: str = "url", ts: str = "ts", gap: str = "3 days", delay: str = "1 hour") -> DataFrame:
    """(key, first, last, n) of each key's periods of use: a period ends after a gap without any."""
    periods = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key)
    return periods.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("w")


def run_available(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and leave the result as Parquet: appended, or the last complete one."""
    sink: Callable[[DataFrame, int], None] = lambda rows, epoch: rows.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/epoch={epoch}")
    with disk_state(out.sparkSession):
        query = out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
