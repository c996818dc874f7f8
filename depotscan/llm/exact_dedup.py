"""Exact deduplication as a stream with disk-backed keyed state that never expires.

A batch pass writes a slim fingerprint row per document (digest, identifier, content locator). A Structured
Streaming job folds those rows into RocksDB state keyed by digest: smallest identifier, locator, count. Spark
combines rows of one digest inside each map task before they meet the state, so a digest that a third of all rows
share costs one row per task. Digests hit twice are then checked on their full bytes, again combined per task;
texts that share a digest but differ in a byte are told apart.

Nulls and edge cases: null text counts as empty; a null identifier sorts after every other one; rows that repeat
both identifier and text are members of one group and, if their identifier is kept, all marked kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store

#: State on each executor's disk; changes alone go to the shared folder, and many small stores reserve no space.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def dedup_stream(fingerprints: DataFrame, path: str, checkpoint: str) -> None:
    """Fold a stream of (digest, id, locator) into keyed state and write the changed keys of each micro-batch to path.

    The aggregation has no watermark, so no key ever leaves the state; a later run with the same checkpoint goes on
    where this one ended. Rewriting a micro-batch after a failure replaces its folder.
    """
    spark = fingerprints.sparkSession
    state = fingerprints.groupBy("digest").agg(F.min("id").alias("keep_id"), F.min_by("locator", "id").alias("locator"), F.count("*").alias("group_size"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}"))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 10_000, locator: Column | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, locator), one row per input row; locator is the kept row's, its file unless another column is given (docs of several sources need one)."""
    spark = docs.sparkSession
    text = normalised(F.col(text_col))
    prints = _store.new_path(spark, "dedup-prints")
    docs.select(F.col(id_col).alias("id"), text.alias("t"), (F.input_file_name() if locator is None else locator).alias("locator")).select("id", digest(F.col("t")).alias("digest"), F.sha2("t", 256).alias("text_sha256"), "locator").write.parquet(prints)
    table = spark.read.parquet(prints)

    out, checkpoint = _store.new_path(spark, "dedup-state"), _store.new_path(spark, "dedup-stream")
    dedup_stream(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch).parquet(prints).select("digest", "id", "locator"), out, checkpoint)
    schema = f"digest binary, keep_id {dict(table.dtypes)['id']}, locator string, group_size long, epoch int"
    # A key appears once per micro-batch that touched it; identifiers only fall and counts only grow.
    state = spark.read.schema(schema).parquet(out).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.min_by("locator", "keep_id").alias("locator"), F.max("group_size").alias("group_size"))
    state = _store.store(state, "dedup-keys")

    hits = state.where("group_size > 1").select("digest")
    n_hits = hits.count()
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("digest", digest(F.col("t")))
    classes = _store.semi(rows, hits, ["digest"], n_hits).groupBy("digest", "t").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    clashes = _store.store(classes.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-clashes")
    n_clashes = clashes.count()

    result = table.drop("locator").join(state, "digest")
    if n_clashes:
        plain = result.join(clashes, "digest", "left_anti")
        mixed = _store.semi(rows, clashes, ["digest"], n_clashes)
        apart = mixed.join(_store.semi(classes, clashes, ["digest"], n_clashes), ["digest", "t"])
        result = plain.select("id", "keep_id", "group_size", "text_sha256", "locator").unionByName(apart.select("id", "keep_id", "group_size", F.sha2("t", 256).alias("text_sha256"), F.lit(None).cast("string").alias("locator")))
    return result.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "locator")
