"""Importance resampling towards a target distribution, by hashed n-gram features.

A text's features are its runs of 1 to n consecutive words. Each falls into one of a fixed number of buckets; how full
the buckets are in the corpus and in the target gives each bucket a gain, the log ratio of its smoothed shares. A text's
weight is the mean gain of its features; a Gumbel variate drawn from its identifier makes the highest scores a sample
without replacement whose odds follow the weights.

Texts become features in Arrow kernels: ascii_lower, split_pattern_regex, list_flatten and dictionary_encode give each
word its index; shifted indices name the n-grams, so a checksum is made once for each distinct n-gram of a block; take
turns buckets into gains, and a difference of running sums adds them up for each text. Counts and gains are tables of as
many rows as buckets. Scores are whole numbers of a few hundred thousand values at most, so their counts tell the score
from which rows can be drawn; only rows from there on are sorted, in ranges that Spark samples, and a rank is a place in
a range plus the sizes of the ranges before it. No window or task holds more than a range.

Nulls and edge cases: null and empty texts, and those of separators alone, have no feature and weight 0 and aren't drawn;
a null identifier is drawn as the empty string and comes last among ties; repeated rows are counted and scored each, and
rows that tie in score and identifier take their ranks in any order; very long texts are read whole, a block of words at a
time; with an empty target all gains are finite, from the smoothing; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from ._text import pieces

#: What parts words: every character below U+0080 but digits and letters, which are lower case by then.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words whose n-grams are told apart at a time; bounds memory and changes no result.
BLOCK = 1 << 18


def word_indices(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(index of each word, row of each word, the word of each index) of texts; null as empty."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(column, "")), SEPARATORS)
    words = pc.list_flatten(lists).dictionary_encode()
    index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    names = words.dictionary.cast(pa.binary()).to_pylist()
    if b"" in names:  # a separator at an end of a text leaves an empty word
        real = index != names.index(b"")
        index, row = index[real], row[real]
    return index, row, names


def feature_buckets(column: pa.Array, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the texts' runs of 1 to n words, a block of runs at a time; rows of a block ascend."""
    index, row, names = word_indices(column)
    spaced = [b" " + x for x in names]
    for at in range(0, len(index), BLOCK):
        place = np.arange(at, min(at + BLOCK, len(index)))
        distinct, code = np.unique(index[place], return_inverse=True)
        crcs = [zlib.crc32(names[w]) for w in distinct.tolist()]
        for k in range(1, n + 1):
            if k > 1:
                inside = place + k - 1 < len(index)
                inside[inside] = row[place[inside] + k - 1] == row[place[inside]]
                place, code = place[inside], code[inside]
                distinct, code = np.unique(code * len(names) + index[place + k - 1], return_inverse=True)
                crcs = [zlib.crc32(spaced[w], crcs[b]) for b, w in zip((distinct // len(names)).tolist(), (distinct % len(names)).tolist(), strict=True)]
            yield row[place], (np.array(crcs, np.int64) % buckets)[code]


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of a column of texts fall into each bucket; tasks send a row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                for _, bucket in feature_buckets(part.column(0), n, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares, rounded down."""
    ratio = (target + 1.0) * float(corpus.sum() + len(corpus)) / ((corpus + 1.0) * float(target.sum() + len(target)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(key: Column) -> Column:
    """1000 times a Gumbel variate that the key decides, rounded down."""
    h = F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank), one row per document; of those with least_words words the given percentage is drawn, in order of score, and has a rank."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(slim.select("text"), n, buckets), bucket_counts(target.select(F.col(target_col).alias("text")), n, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(gain)
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = np.arange(part.num_rows)
                number, total, words = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for i, (row, bucket) in enumerate(feature_buckets(part.column(1), n, buckets)):
                    start, end = np.searchsorted(row, rows), np.searchsorted(row, rows, side="right")
                    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values.take(pa.array(bucket)).to_numpy(zero_copy_only=False))])
                    number += end - start
                    total += sums[end] - sums[start]
                    if i % n == 0:  # runs of one word come first in each block
                        words += end - start
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in (number, words, total // np.maximum(number, 1)))], names=["id", "n_features", "n_words", "weight"])

    weighed = slim.mapInArrow(weigh, f"id {dict(slim.dtypes)['id']}, n_features long, n_words long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    scored = _store.store(weighed.withColumn("score", F.col("weight") + gumbel(key)), "resample-scores")

    fit = F.col("n_words") >= least_words
    by_score = scored.where(fit).groupBy("score").agg(F.count("*").alias("c")).collect()  # gains and variates are logarithms: some 100,000 values, whatever the corpus
    quota = sum(r["c"] for r in by_score) * percent // 100
    least, seen = None, 0
    for r in sorted(by_score, key=lambda r: -r["score"]):
        if seen >= quota:
            break
        least, seen = r["score"], seen + r["c"]
    names = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    if least is None:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))

    # A running number tells rows apart that tie in all else, so that a range never has to hold them all.
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    near = scored.where(fit & (F.col("score") >= least)).withColumn("row", F.monotonically_increasing_id())
    placed = near.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = _store.store(placed.select("id", "n_features", "weight", "score", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")), "resample-places")
    sizes = placed.groupBy("range").agg(F.count("*").alias("c"))  # a row for each range
    before = sizes.select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("before"))
    rank = F.col("before") + F.col("at") + 1
    drawn = placed.join(F.broadcast(before), "range").select(*names, F.when(rank <= quota, rank).alias("rank"))
    return scored.where(~(fit & (F.col("score") >= least))).select(*names, F.lit(None).cast("long").alias("rank")).unionByName(drawn)
