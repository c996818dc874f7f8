"""Substring deduplication by seed and extend.

Seeds: in every window of `window` words the word k-gram with the smallest hash is the window's anchor, so equal
windows have equal anchors (winnowing). Consecutive windows with one anchor form a segment; the hash of a segment's
words stands for the anchor extended both ways, as far as its windows reach.

1. Anchors that occur once in the corpus are dropped: nothing repeats there.
2. Segments are grouped by their extension. All but the first one repeat wholly; inside a passage shared by many
   documents that is every segment, so the group costs one minimum and no pairs.
3. First segments whose anchor has several extensions (edges of passages, short common runs) are compared window
   by window: a window repeats unless it is the first with its words.
4. Repeats on one diagonal of a text and its source are joined to maximal ones, and of those that overlap as many stay
   as cover the same words. Their words are then compared with the source's, in blocks of BLOCK words that travel to the
   texts that repeat them (none do within one text), and only equal words go.
   Should two different runs share a hash of 128 bits, that comparison shows it and all is done again under another
   hash; so the result is that of words.
The removed ranges are the unions of repeated windows, that is the maximal repeats of at least `window` words.

Nulls and edge cases: null texts have no words; texts with fewer words than `window` lose none; a null identifier
comes after every other one; rows that share both identifier and text are one row and lose the same words, none to
each other; rows that share only an identifier, or have none, are rows of their own, in the order of a digest of
their texts; of repeats within a text the first stays; an empty table gives an empty result; texts are read whole;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from ._text import STEP, mix, pieces, powers, raw, run_hashes, word_hashes, words

LAST = (1 << 63) - 1
#: Words of a source that are compared at a time.
BLOCK = 32
SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall


@lru_cache(maxsize=8)
def letters(attempt: int) -> np.ndarray:
    """Two tables of letters for each attempt."""
    return np.random.default_rng(71 + attempt).integers(0, 1 << 64, (2, 256), np.uint64)


def two_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, attempt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    return tuple(word_hashes(data, start, end, table) for table in letters(attempt))


def segments(column: pa.Array, window: int, k: int, attempt: int, bits: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, the two hashes of the extension, first window, windows) of each segment of the texts; bits of each hash are kept."""
    data, rows = raw(column)
    start, end, row = words(data, rows)
    word, second = two_hashes(data, start, end, attempt)
    n = max(0, len(word) - window + 1)
    gram, width = run_hashes(word, k), window - k + 1
    least, reach = np.arange(len(gram)), 1
    while reach < width:  # leftmost smallest gram of `reach` grams, doubled up to `width`
        step = min(reach, width - reach)
        a, b = least[: len(least) - step], least[step:]
        least, reach = np.where(gram[a] <= gram[b], a, b), reach + step
    at = np.flatnonzero(row[:n] == row[window - 1 :]) if n else np.zeros(0, np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    anchor = least[at]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    begin, stop = at[first], at[last] + window
    up, down = powers(len(word) + 1)
    extension = []
    for h in (word, second):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(word)])])
        extension.append(mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64) * STEP) >> np.uint64(64 - bits))
    base = np.searchsorted(row, np.arange(len(column)))
    owner = row[begin]
    return owner, gram[anchor[first]], *extension, begin - base[owner], at[last] - at[first] + 1


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def repeats(docs: DataFrame, window: int, k: int, attempt: int, bits: int) -> DataFrame:
    """(id, key, start, stop, src_id, src_key, src_start) of docs (id, key, text), each (id, key) once: word ranges and the earlier ranges that have the same hashes, as long as can be."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([longs(segments(part.column("text"), window, k, attempt, bits)[1])], names=["anchor"])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                owner, anchor, one, two, at, n = segments(part.column("text"), window, k, attempt, bits)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner)), part.column("key").take(pa.array(owner)), longs(anchor), longs(one), longs(two), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "key", "anchor", "one", "two", "at", "n"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, rows = raw(part.column("text"))
                start, end, row = words(data, rows)
                one, two = (run_hashes(h, window) >> np.uint64(64 - bits) for h in two_hashes(data, start, end, attempt))
                base = np.searchsorted(row, np.arange(part.num_rows))
                spans = part.column("spans")
                owner = np.repeat(np.arange(part.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
                flat = spans.flatten()
                at, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                owner, at = np.repeat(owner, n), np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner)), part.column("key").take(pa.array(owner)), longs(one[base[owner] + at]), longs(two[base[owner] + at]), pa.array(at.astype(np.int32))], names=["id", "key", "one", "two", "at"])

    found = docs.select("text").mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    found = _store.store(found, "repeat-anchors")
    seeded = docs.select("id", "key", "text").mapInArrow(seeds, "id long, key long, anchor long, one long, two long, at int, n int")
    seeded = _store.store(_store.semi(seeded, found, ["anchor"], found.count()), "repeat-seeds")

    # Minima are stored, so that the joins with them are between plain exchanges and a hot key can be split.
    place = F.struct("id", "key", "at")
    earliest = lambda rows: rows.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("one", "two", "first")
    repeated = _store.store(earliest(seeded), "repeat-firsts")
    judged = seeded.join(repeated, ["one", "two"], "left")
    judged = _store.store(judged.select("id", "key", "anchor", "at", "n", F.when(place > F.col("first"), F.col("first")).alias("source")), "repeat-judged")
    match = lambda rows, n: rows.select("id", "key", F.col("at").alias("start"), (F.col("at") + n).alias("stop"), F.col("source.id").alias("src_id"), F.col("source.key").alias("src_key"), (F.col("at") - F.col("source.at")).alias("shift"))
    whole = match(judged.where("source is not null"), F.col("n") + window - 1)

    firsts = judged.where("source is null")
    several = firsts.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    edges = _store.store(firsts.join(several, "anchor", "left_semi").groupBy("id", "key").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "repeat-edges")  # bounded by the text's length
    touched = _store.semi(docs.select("id", "key", "text"), edges.select("id", "key"), ["id", "key"], edges.count())
    single = _store.store(touched.join(edges, ["id", "key"]).select("id", "key", "text", "spans").mapInArrow(windows, "id long, key long, one long, two long, at int"), "repeat-windows")
    least = _store.store(earliest(single), "repeat-least")
    part = match(single.join(least, ["one", "two"]).where(place > F.col("first")).withColumnRenamed("first", "source"), F.lit(window))

    # Matches of one diagonal that touch are one: a row's matches are bounded by its length.
    line = Window.partitionBy("id", "key", "src_id", "src_key", "shift").orderBy("start", "stop")
    before = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    matches = whole.unionByName(part).repartition("id", "key").withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    matches = matches.withColumn("island", F.sum("new").over(line)).groupBy("id", "key", "src_id", "src_key", "shift", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    matches = _store.store(cover(matches.select("id", "key", "start", "stop", "src_id", "src_key", (F.col("start") - F.col("shift")).alias("src_start")), window), "repeat-matches")
    _store.discard(found, seeded, repeated, judged, edges, single, least)
    return matches


def cover(matches: DataFrame, window: int) -> DataFrame:
    """Of each text's matches as many as cover the same words, cut to at most three times these words in all.

    Of the matches that start within `window` words the first to start and the last to stop cover what all of them do, for
    each has `window` words at least. Then each begins where those before it have stopped, or where it has `window` words."""
    whole = F.struct("start", "stop", "src_id", "src_key", "src_start")
    ends = matches.groupBy("id", "key", F.floor(F.col("start") / window).alias("cell")).agg(F.min_by(whole, whole).alias("a"), F.max_by(whole, F.struct("stop", whole)).alias("b"))
    some = ends.select("id", "key", F.explode(F.array_distinct(F.array("a", "b"))).alias("m")).select("id", "key", "m.*")
    before = F.max("stop").over(Window.partitionBy("id", "key").orderBy("start", "stop", "src_id", "src_key", "src_start").rowsBetween(Window.unboundedPreceding, -1))
    cut = some.withColumn("before", F.coalesce(before, F.lit(0))).where("stop > before").withColumn("skip", F.greatest(F.lit(0), F.least(F.col("before"), F.col("stop") - window) - F.col("start")))
    return cut.select("id", "key", (F.col("start") + F.col("skip")).alias("start"), "stop", "src_id", "src_key", (F.col("src_start") + F.col("skip")).alias("src_start"))


def with_sources(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, key, sources): for each text the blocks of words that its ranges repeat, as (start, first word of the block, words, the block); of a range of the text itself, its first word and no block. Rows without a match are left out."""
    inside = (F.col("id") == F.col("src_id")) & (F.col("key") == F.col("src_key"))
    own = matches.where(inside).select("id", "key", F.struct(F.col("start").cast("int").alias("start"), F.col("src_start").cast("int").alias("at"), (F.col("stop") - F.col("start")).cast("int").alias("n"), F.lit(None).cast("string").alias("words")).alias("s"))
    matches = matches.where(~inside)
    begin, end = F.col("src_start"), F.col("src_start") + F.col("stop") - F.col("start")
    asked = matches.withColumn("block", F.explode(F.sequence(F.floor(begin / BLOCK), F.floor((end - 1) / BLOCK))))
    lo, hi = F.greatest(begin, F.col("block") * BLOCK), F.least(end, F.col("block") * BLOCK + BLOCK)
    asked = asked.select("id", "key", "src_id", "src_key", "block", (F.col("start") + lo - begin).cast("int").alias("start"), (lo - F.col("block") * BLOCK).cast("int").alias("at"), (hi - lo).cast("int").alias("n"))
    asked = _store.store(asked, "repeat-asked")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                owner, block, found = [], [], []
                for i, (text, sought) in enumerate(zip(part.column("text"), part.column("blocks"), strict=True)):
                    all_words = SPLIT(text.as_py())
                    for b in sought.as_py():
                        owner.append(i)
                        block.append(b)
                        found.append(" ".join(all_words[BLOCK * b : BLOCK * b + BLOCK]))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner, pa.int32())), part.column("key").take(pa.array(owner, pa.int32())), pa.array(block, pa.int64()), pa.array(found, pa.string())], names=["src_id", "src_key", "block", "words"])

    wanted = asked.groupBy("src_id", "src_key").agg(F.collect_set("block").alias("blocks"))  # a text's blocks, however many ask for them
    wanted = _store.store(wanted.select(F.col("src_id").alias("id"), F.col("src_key").alias("key"), "blocks"), "repeat-wanted")
    texts = _store.semi(docs.select("id", "key", "text"), wanted.select("id", "key"), ["id", "key"], wanted.count())
    sources = _store.store(texts.join(wanted, ["id", "key"]).select("id", "key", "text", "blocks").mapInArrow(blocks, "src_id long, src_key long, block long, words string"), "repeat-sources")
    others = asked.join(sources, ["src_id", "src_key", "block"]).select("id", "key", F.struct("start", "at", "n", "words").alias("s"))
    known = others.unionByName(own).groupBy("id", "key").agg(F.collect_list("s").alias("sources"))  # by the cover, at most some times the text
    known = _store.store(known, "repeat-known")
    _store.discard(asked, wanted, sources)
    return known


def substring_dedup(docs: DataFrame, window: int = 20, k: int = 8, id_col: str = "doc_id", text_col: str = "text", bits: tuple[int, ...] = ()) -> DataFrame:
    """(id, n_words, n_removed, kept, removed): kept words joined by a blank, and the removed word ranges.

    bits, for tests, are those kept of the hashes in the first attempts."""
    keyed = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).cast("long").alias("id"), F.col(id_col).alias("given"), F.col(text_col).alias("text"))
    # Rows are told apart by (id, key). An identifier of one row needs no key; rows of the others are made distinct.
    reused = _store.store(keyed.where("given is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id", F.lit(True).alias("again")), "repeat-ids")
    n_reused = reused.count()
    keyed = keyed.join(_store.small(reused, n_reused), "id", "left") if n_reused else keyed.withColumn("again", F.lit(None).cast("boolean"))
    digest = F.xxhash64(F.col("given").isNull(), F.coalesce("text", F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    keyed = keyed.withColumn("key", F.when(F.col("given").isNull() | F.col("again"), F.when(digest == 0, 1).otherwise(digest)).otherwise(F.lit(0).cast("long")))
    several = _store.store(keyed.where("key <> 0").groupBy("id", "key").agg(F.first("text").alias("text")), "repeat-rows")
    rows = keyed.where("key = 0").select("id", "key", "text").unionByName(several)

    clean = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), r"^ | \z", "")
    plain = keyed.select("id", "key", "given", clean.alias("kept"))
    n_words = F.when(F.col("kept") == "", 0).otherwise(F.length("kept") - F.length(F.replace("kept", F.lit(" "))) + 1).cast("long")
    given = dict(keyed.dtypes)["given"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, kept, spans, other = [], [], [], [], []
            for text, sources in zip(batch.column("kept"), batch.column("sources"), strict=True):
                all_words = text.as_py().split(" ")
                stay, unlike = np.ones(len(all_words), bool), 0
                for i in range(0, len(sources.values), 4096):
                    for s in sources.values.slice(i, 4096).to_pylist():
                        source = all_words if s["words"] is None else s["words"].split(" ")
                        same = all_words[s["start"] : s["start"] + s["n"]] == source[s["at"] : s["at"] + s["n"]]
                        stay[s["start"] : s["start"] + s["n"]] &= not same
                        unlike += not same
                size.append(len(all_words))
                gone.append(len(all_words) - int(stay.sum()))
                kept.append(" ".join(compress(all_words, stay)))
                edge = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]])))
                spans.append([{"start": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)])
                other.append(unlike)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("given"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind), pa.array(other, pa.int64())], names=["given", "n_words", "n_removed", "kept", "removed", "unlike"])

    attempt = unlike = 0
    while not attempt or unlike:
        matches = repeats(rows, window, k, attempt, bits[attempt] if attempt < len(bits) else 64)
        known = with_sources(rows, matches)
        n_known = known.count()
        touched = _store.semi(plain, known.select("id", "key"), ["id", "key"], n_known).join(known, ["id", "key"]).select("given", "kept", "sources")
        touched = touched.mapInArrow(cut, f"given {given}, n_words long, n_removed long, kept string, removed array<struct<start:int,stop:int>>, unlike long")
        touched = _store.store(touched, "repeat-cut")
        unlike = touched.agg(F.sum("unlike")).first()[0] or 0
        attempt += 1
        _store.discard(matches)
    _store.discard(several)
    rest = _store.semi(plain, known.select("id", "key"), ["id", "key"], n_known, "left_anti").select("given", n_words.alias("n_words"), F.lit(0).cast("long").alias("n_removed"), "kept", F.array().cast("array<struct<start:int,stop:int>>").alias("removed"))
    return touched.drop("unlike").unionByName(rest).withColumnRenamed("given", id_col)
