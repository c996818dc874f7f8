"""Jaccard similarity join on word n-grams with filters under several global orders.

A text is its set of distinct word n-grams. Two sets that are similar enough share a token among the first few of
each under any global order, so a pair is a candidate only if its prefixes meet under every order used. The orders
put rare n-grams first, by a sketch of document frequencies of fixed size, and differ in how they arrange n-grams
of like frequency. The first order's prefixes are joined, with size and position bounds; the other orders'
prefixes must then intersect; what is left is verified on whole sets.

Tokens whose lists have the same members (a passage that the same texts share has many) say the same about every
pair, so only the first of them under the order keeps its list: any pair's first common token has the same members
as a kept one that is not later.

No pair of copies, and no pair inside a known component, needs to be looked at to find the components:
1. texts with equal sets are one class, represented by its smallest identifier;
2. in each prefix token's list, classes are verified against the list's most central member only, a star;
3. of the pairs left, only those between different components are generated: in each list, members outside the
   list's largest component against the whole list.
So the components are those of all links, while a group of n near copies costs about n verified pairs.

Nulls and edge cases: null or blank texts have no n-gram, link with nothing and are their own component; a text
with fewer words than n is one n-gram, its whole sequence; repeated rows are copies; rows without an identifier
take the component of their copies, if any, and are in no other link; an empty table gives an empty result; texts
are read whole; other columns are ignored. A-Z is lower-cased, other letters are not.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import LOWER, give_back, mix, pieces, raw, run_hashes, word_hashes, words
from .components import components

#: The sketch has 2**SKETCH_BITS counters; its size doesn't depend on the data.
SKETCH_BITS, SKETCH_CHUNK = 22, 1 << 16
#: N-grams that a task counts at a time; bounds memory.
COUNTED = 1 << 19
#: Longer lists are joined by size class as well; changes cost, not results.
LONG_LIST = 64
#: One salt for each global order.
ORDERS = (0x51ED270B, 0x2545F491, 0x6C078965)


def ngram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    data, rows = raw(column)
    data = LOWER[data]
    start, end, row = words(data, rows)
    word = word_hashes(data, start, end)
    runs = run_hashes(word, n)
    inside = row[: len(runs)] == row[n - 1 :] if len(runs) else np.zeros(0, bool)
    runs, owner = runs[inside], row[: len(inside)][inside]
    at = np.searchsorted(owner, np.arange(len(column) + 1))
    first = np.searchsorted(row, np.arange(len(column) + 1))
    for i in range(len(column)):
        if at[i] < at[i + 1]:
            yield np.unique(runs[at[i] : at[i + 1]])
        else:
            short = word[first[i] : first[i + 1]]
            yield run_hashes(short, len(short), salt=len(short)) if len(short) else short


def document_frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """A count of texts for each of the sketch's buckets of n-grams, over all texts."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        sets: list[np.ndarray] = []

        def add_up() -> None:
            bucket, times = np.unique((np.concatenate(sets) & np.uint64(size - 1)).astype(np.int32), return_counts=True)
            total[bucket] += times
            sets.clear()

        for batch in batches:
            for part in pieces(batch, "text"):
                sets.extend(ngram_sets(part.column(0), n))
                if sum(map(len, sets)) > COUNTED:
                    add_up()
            give_back()
        if sets:
            add_up()
        chunks = [zlib.compress(x.tobytes(), 1) for x in total.reshape(-1, SKETCH_CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in rows["counts"])
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    tasks = docs.select("text").mapInArrow(count, "chunk int, counts binary").withColumn("part", F.floor(F.spark_partition_id() / 500))
    some = tasks.groupBy("chunk", "part").applyInPandas(add, "chunk int, counts binary")  # at most 500 tasks each
    chunks = some.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()
    total = np.zeros((size // SKETCH_CHUNK, SKETCH_CHUNK), np.int64)
    for r in chunks:
        total[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return total.reshape(-1)


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """Half powers of two of a bucket's excess over its usual load, from twice the load's deviation on: a common n-gram stands out as soon as the noise allows."""
    load = float(np.median(counts))
    return np.clip(np.round(2 * np.log2(np.maximum((counts - load) / (2 * np.sqrt(load) + 1), 1))), 0, 100).astype(np.uint8)


def _similar(overlap: Column, a: Column, b: Column, num: int, den: int) -> Column:
    return overlap * (num + den) >= (a + b) * num


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, n_copies, component_id), one row per input row: texts link when den * |A and B| >= num * |A or B|.

    n_copies counts the rows with the same set; component_id is the smallest identifier reachable by links.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    id_type = dict(slim.dtypes)["id"]
    classes = spark.sparkContext.broadcast(frequency_classes(document_frequencies(slim, n)))  # 2**SKETCH_BITS bytes

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last = classes.value, np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            for part in pieces(batch, "text"):
                size, low, high, prefix = [], [], [], [[] for _ in ORDERS]
                for found in ngram_sets(part.column(0), n):
                    size.append(len(found))
                    low.append(np.sum(mix(found)))
                    high.append(np.bitwise_xor.reduce(mix(found + np.uint64(7))) if len(found) else np.uint64(0))
                    length = len(found) + -num * len(found) // den + 1 if len(found) else 0
                    rank = table[(found & last).astype(np.int64)].astype(np.uint64) << np.uint64(56)
                    for order, salt in zip(prefix, ORDERS, strict=True):
                        key = rank | mix(found ^ np.uint64(salt)) >> np.uint64(8)
                        order.append(np.sort(np.partition(key, length - 1)[:length] if length < len(key) else key))
                orders = []
                for i, order in enumerate(prefix):
                    flat = np.concatenate(order) if order else np.zeros(0, np.uint64)
                    flat = pa.array(flat.view(np.int64)) if i == 0 else pa.array((flat & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
                    orders.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in order])]), pa.int32()), flat))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(size, pa.int64()), pa.array(np.array(low, np.uint64).view(np.int64)), pa.array(np.array(high, np.uint64).view(np.int64)), *orders], names=["id", "size", "low", "high", "p0", "p1", "p2"])
            give_back()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                good = []
                for x, y in zip(ngram_sets(part.column(2), n), ngram_sets(part.column(3), n), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(den * both >= num * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))
            give_back()

    rows = _store.store(slim.mapInArrow(prefixes, f"id {id_type}, size long, low long, high long, p0 array<long>, p1 array<int>, p2 array<int>"), "join-sets")
    # Stored, so that the join below is between plain exchanges and a hot class can be split.
    copies = rows.where("size > 0").groupBy("size", "low", "high").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"))
    copies = _store.store(copies, "join-copies")
    members = rows.select("id", "size", "low", "high").join(copies, ["size", "low", "high"], "left").select("id", "low", F.col("size").alias("n_shingles"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("rep", "id").alias("rep"))
    members = _store.store(members, "join-members")
    later = members.where("id <> rep").select("id", "low")
    reps = _store.semi(rows.where("size > 0 and id is not null"), later, ["id", "low"], later.count(), "left_anti")

    lists = reps.select("id", "size", F.posexplode("p0").alias("pos", "token"))
    tokens = _store.store(lists.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "join-tokens")
    shared = _store.store(_store.semi(lists, tokens, ["token"], tokens.count()), "join-shared")
    # A list's members are told by their number and two combinable hashes; of tokens with the same members one stays.
    # Its centre is the member whose token comes earliest: it has the fewest rarer n-grams, so is the copy with the fewest changes.
    stats = shared.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.min(F.struct("pos", "size", "id")).alias("centre"))
    first = stats.groupBy("c", "x", "y").agg(F.min(F.struct("token", "centre")).alias("l"))
    first = _store.store(first.select("l.token", "c", F.col("l.centre.id").alias("a"), F.col("l.centre.pos").alias("a_pos"), F.col("l.centre.size").alias("a_size")), "join-first")
    n_first = first.count()
    shared_all, shared = shared, _store.store(_store.semi(shared, first.select("token"), ["token"], n_first), "join-lists")
    _store.discard(tokens, shared_all)

    def bounded(pairs: DataFrame) -> DataFrame:
        """Only pairs whose first common token could still begin a large enough overlap; the first one of every similar pair passes."""
        rest = F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos"))
        return pairs.where(_similar(rest, F.col("a_size"), F.col("b_size"), num, den))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that pass the other orders' filters and link."""
        pairs = _store.store(pairs, "join-pairs")
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        n_ids = ids.count()
        other = _store.semi(reps.select("id", "p1", "p2"), ids, ["id"], n_ids)
        a, b = (other.select(F.col("id").alias(x), F.col("p1").alias(f"{x}1"), F.col("p2").alias(f"{x}2")) for x in "ab")
        met = pairs.join(a, "a").join(b, "b").where(F.arrays_overlap("a1", "b1") & F.arrays_overlap("a2", "b2")).select("a", "b").distinct()
        met = _store.store(met, "join-met")
        # Each pair goes to its first member with the second one's text: compressed, that is less than half of its set.
        second = slim.join(_store.small(met.withColumnRenamed("b", "id"), met.count()), "id").select("a", F.col("id").alias("b"), "text")
        centres = met.select(F.col("a").alias("id")).distinct()
        first = _store.semi(slim, centres, ["id"], centres.count()).select(F.col("id").alias("a"), F.col("text").alias("other"))
        linked = second.join(first, "a").select("a", "b", "text", "other").mapInArrow(judge, f"a {id_type}, b {id_type}")
        found = _store.store(linked.select("a", "b").distinct(), "join-links")
        _store.discard(pairs, met)
        return found

    star = bounded(shared.select("token", F.col("id").alias("b"), F.col("pos").alias("b_pos"), F.col("size").alias("b_size")).join(_store.small(first, n_first), "token").where("a <> b"))
    star = _store.store(star.groupBy("b").agg(F.min(F.struct("a_pos", "a")).alias("c")).select(F.col("c.a").alias("a"), "b"), "join-star")
    links = verified(star)

    known = components(links, "a", "b").select(F.col("node").alias("id"), "component")
    labelled = _store.store(shared.join(known, "id", "left").withColumn("component", F.coalesce("component", "id")), "join-known")
    largest = labelled.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts"), F.sum("c").alias("n")).where("parts > 1").select("token", "main", "n")
    largest = _store.store(largest, "join-largest")  # as above: plain exchanges, so that a hot list can be split
    # Sets that link are in the same or in neighbouring size classes; that is part of the key of long lists.
    step = 1.001 * math.log(den / num) if num < den else 1.0  # a little over, so that rounding parts no pair
    level = F.when(F.col("n") > LONG_LIST, F.floor(F.log(F.col("size")) / step)).otherwise(0).cast("int")
    several = labelled.join(_store.small(largest, largest.count()), "token").withColumn("level", level)
    whole, labelled = labelled, _store.store(several, "join-labels")
    _store.discard(whole, largest)
    few = labelled.where("component <> main").select("token", "level", F.col("id").alias("a"), F.col("pos").alias("a_pos"), F.col("size").alias("a_size"), F.col("component").alias("a_part"))
    near = F.when(F.col("n") > LONG_LIST, F.array(*(F.col("level") + i for i in (-1, 0, 1)))).otherwise(F.array("level"))
    all_ = labelled.select("token", F.explode(near).alias("level"), F.col("id").alias("b"), F.col("pos").alias("b_pos"), F.col("size").alias("b_size"), F.col("component").alias("b_part"), "main")
    across = bounded(few.join(all_, ["token", "level"]).where((F.col("a_part") != F.col("b_part")) & ((F.col("b_part") == F.col("main")) | (F.col("a") < F.col("b")))))
    judged = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(judged, ["a", "b"], "left_anti")
    links = links.unionByName(verified(across))

    final = components(links, "a", "b")
    _store.discard(rows, copies, first, shared, star, labelled)
    final = final.select(F.col("node").alias("rep"), "component")
    return members.join(final, "rep", "left").select(F.col("id").alias(id_col), "n_shingles", "n_copies", F.coalesce("component", "rep").alias("component_id"))
