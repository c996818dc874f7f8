"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A local one is made only where the setting is absent, in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="depotscan-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def parts(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers n of the complete tables path/kind=n, ascending; a table that is still being written, or whose writer was lost, isn't one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = [f.getPath().getName() for f in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(name[len(kind) + 1 :]) for name in done if name.startswith(f"{kind}="))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path, if it is there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    return kept


def measured(df: DataFrame, tag: str, **totals: Column) -> tuple[DataFrame, Row]:
    """store, and totals of the rows that were written, taken on the way; n is their number unless it is given."""
    found = Observation()
    kept = store(df.observe(found, *(v.alias(k) for k, v in ({"n": F.count(F.lit(1))} | totals).items())), tag)
    return kept, Row(**found.get)


def discard(*stored: DataFrame) -> None:
    """Delete what store has written, once nothing that is still to run reads it."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
