"""Phrase collocations, mined by partitioning (Savasere, Omiecinski and Navathe, 1995).

A phrase with `least` occurrences in a language has, in at least one of a few shards of its texts, its proportional share
of them: least x (the shard's words) / (all words). So each shard is mined completely at that lowered support, level by
level: a run of k words is counted in all shards where both runs of k - 1 words inside it are candidates. Candidates are
the union of what is frequent in some shard, less what all shards' counts together show to be too rare; they hold every
frequent phrase, and a last pass counts them exactly, by their words.

Shards are hashed parts of the texts and each is counted by many tasks, which add up what they have read before anything
is shuffled, so a frequent phrase costs a row per task. Mining works on 64-bit hashes, and a shard's frequent runs are
kept as bits of a bitmap of fixed size that tasks get by broadcast: a clash, or a bit set by another run, can only add
a candidate, which the exact count then judges. With a corpus that fills the bitmap less is pruned, and results stay the same.

Counts of parts are found by joins with the table of frequent phrases, since no part is rarer than the whole. Scores are
computed in decimals of 38 digits: exact for counts to 10**15, an error beyond that.

Nulls and edge cases: null text has no word; null language reads as `und`; repeated rows count each; texts of any length
are read whole; a word is any run of bytes but blanks and piece marks, marks and digits included; phrases that tie in
score and count are in the order of their UTF-8 bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from ._text import LOWER, STEP, mix, pieces, raw, word_hashes

BREAK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
BLANK[[9, 32]] = True
MARK = re.compile(r"[.,;:!?\x0A-\x0D]")
#: The bitmap has 2**BITS bits, 16 MB; its size doesn't depend on the data.
BITS = 27
#: Spark's bitmap functions number bits in buckets of this size.
BUCKET = 32_768
#: Rows of the first cut of a ranking: each of SALTS parts of a language keeps its best ones.
SALTS = 256
_square = "(cast({} as decimal(18,0)) * cast({} as decimal(18,0)))".format
SCORE = f"(cast(1000000 as decimal(7,0)) * {_square('a', 'a')}) div {_square('l', 'r')}"


def piece_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, piece, row) of each word of lower-cased texts; words of one piece have its number."""
    data, rows = raw(column)
    data = LOWER[data]
    solid = ~(BREAK | BLANK)[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = rows[(rows > 0) & (rows < len(data))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    start = np.flatnonzero(first)
    row = np.searchsorted(rows, start, side="right") - 1
    # Marks and text ends before a word, counted together, number its piece.
    return data, start, np.flatnonzero(last) + 1, np.cumsum(BREAK[data], dtype=np.int64)[start] + row, row


def has(bitmap: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Whether the bits of runs of words are set."""
    bit = (run & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1


def levels(word: np.ndarray, piece: np.ndarray, longest: int, known: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the runs of 1, 2, ... words within a piece; from two words on, of those whose shorter runs known(places, hashes) holds."""
    place, run = np.arange(len(word)), mix(word + np.uint64(1))
    yield place, run
    for size in range(2, longest + 1):
        good, full = np.zeros(len(word) + 1, bool), np.zeros(len(word), np.uint64)
        good[place[known(place, run)]] = True
        full[place] = run
        place = np.flatnonzero(good[:-1] & good[1:])
        place = place[: np.searchsorted(place, len(word) - size + 1)]
        place = place[piece[place] == piece[place + size - 1]]
        run = mix((full[place] + np.uint64(size)) * STEP + word[place + size - 1])
        yield place, run


def bounded(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Row slices of about `most` text bytes; a longer text is cut after a mark, where no phrase goes on."""
    for part in pieces(batch, "text", most):
        text = (part.column("text")[0].as_py() if part.num_rows == 1 else None) or ""
        at = 0
        while len(text) - at > most:
            mark = MARK.search(text, at + most)
            end = mark.end() if mark else len(text)
            yield pa.RecordBatch.from_arrays([pa.array([text[at:end]]), *part.columns[1:]], names=part.schema.names)
            at = end
        yield pa.RecordBatch.from_arrays([pa.array([text[at:]]), *part.columns[1:]], names=part.schema.names) if at else part


def shard_counts(docs: DataFrame, k: int, shards: int, bitmap: Broadcast | None) -> DataFrame:
    """(lang, run, n_0, n_1, ...): how often each run of k words occurs in each shard's texts, where its shorter runs are in the bitmap."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap else None
        for batch in batches:
            for part in bounded(batch):
                langs = part.column(1).dictionary_encode()
                group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * shards + part.column(2).to_numpy(zero_copy_only=False)
                order = np.argsort(group, kind="stable")  # a group's texts, and so its runs, lie together
                data, start, end, piece, row = piece_words(part.column(0).take(pa.array(order)))
                group = group[order][row]
                *_, (place, run) = levels(word_hashes(data, start, end), piece, k, lambda _, h: has(bits, h))
                for g in np.unique(group[place]).tolist():
                    at, to = np.searchsorted(group[place], [g, g + 1])
                    found, n = np.unique(run[at:to], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.repeat(langs.dictionary[g // shards], len(found)), pa.repeat(pa.scalar(g % shards, pa.int32()), len(found)), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "shard", "run", "n"])

    each = docs.mapInArrow(count, "lang string, shard int, run long, n long")
    return each.groupBy("lang", "run").agg(*(F.sum(F.when(F.col("shard") == i, F.col("n")).otherwise(0)).alias(f"n_{i}") for i in range(shards)))


def set_bits(runs: DataFrame) -> np.ndarray:
    """The bitmap with the bits of (run) set; what is collected has a fixed size."""
    bit = F.col("run").bitwiseAND((1 << BITS) - 1)
    maps = runs.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % BUCKET).alias("bits"))
    found = np.zeros(1 << BITS - 3, np.uint8)
    for r in maps.collect():
        found[r["bucket"] * (BUCKET // 8) :][: BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    return found


def phrases(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): all words with one space after each; a run of words is the bytes between two offsets, less the last one."""
    size = end - start
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + 1)])
    text = np.full(at[-1], 32, np.uint8)
    where = np.ones(at[-1], bool)
    where[at[1:] - 1] = False
    text[where] = data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
    return text, at


def exact_counts(docs: DataFrame, longest: int, bitmap: Broadcast) -> DataFrame:
    """(lang, phrase, words, n) of the runs of 1 to `longest` words that are frequent in some shard, counted over all texts by their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value

        def known(place: np.ndarray, run: np.ndarray) -> np.ndarray:
            return has(bits, run)

        for batch in batches:
            for part in bounded(batch):
                langs = part.column(1).dictionary_encode()
                lang, n_langs = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(langs.dictionary), 1)
                data, start, end, piece, row = piece_words(part.column(0))
                text, at = phrases(data, start, end)
                for k, (place, run) in enumerate(levels(word_hashes(data, start, end), piece, longest, known), 1):
                    place = place[known(place, run)]
                    size = at[place + k] - 1 - at[place]
                    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
                    flat = text[np.repeat(at[place] - to[:-1], size) + np.arange(to[-1])]
                    found = pa.LargeStringArray.from_buffers(len(place), pa.py_buffer(to), pa.py_buffer(flat)).dictionary_encode()
                    pair, n = np.unique(found.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_langs + lang[row[place]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(pair % n_langs)), found.dictionary.take(pa.array(pair // n_langs)).cast(pa.string()), pa.repeat(pa.scalar(k, pa.int32()), len(pair)), pa.array(n)], names=["lang", "phrase", "words", "n"])

    return docs.mapInArrow(count, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, longest: int, least: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of all phrases of 1 to `longest` words with `least` occurrences, (lang, n) words of each language); docs has text, lang, shard."""
    context, own = docs.sparkSession.sparkContext, range(shards)
    words = _store.store(shard_counts(docs, 1, shards, None), "phrase-words")
    total = sum((F.sum(f"n_{i}") for i in own), F.lit(0))
    sizes = words.groupBy("lang").agg(*(F.sum(f"n_{i}").alias(f"t_{i}") for i in own), total.alias("total"))
    sizes = _store.store(sizes, "phrase-totals")
    n_sizes, found, bitmap = sizes.count(), None, None
    for k in range(1, longest + 1):
        counts = words if k == 1 else shard_counts(docs, k, shards, bitmap)
        # In some shard its share of the support, and enough in all together.
        share = [(F.col(f"n_{i}") > 0) & (F.col(f"n_{i}") >= F.expr(f"({least} * t_{i} + total - 1) div total")) for i in own]
        enough = counts.where(sum((F.col(f"n_{i}") for i in own), F.lit(0)) >= least).join(_store.small(sizes, n_sizes), "lang").where(reduce(Column.__or__, share))
        runs = _store.store(enough.select("run"), "phrase-runs")
        bits = set_bits(runs)
        found = bits if found is None else found | bits
        bitmap = context.broadcast(found)
        _store.discard(runs, *([words] if k == 1 else []))
        del counts, enough, runs
        _store.release(docs.sparkSession)
    exact = _store.store(exact_counts(docs, longest, bitmap).where(F.col("n") >= least), "phrase-counts")
    return exact, sizes.select("lang", F.col("total").alias("n"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000, shards: int = 2, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by score.

    a, l and r count the phrase and the two parts of its lowest-scoring cut; score is 10**6 a**2 / (l r), rounded down. A
    phrase inside a longer one that has `covered` percent of its occurrences goes.
    """
    slim = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.pmod(F.xxhash64(text_col), F.lit(shards)).cast("int").alias("shard"))
    counts, totals = frequent_phrases(slim, longest, least, shards)
    word = F.split("phrase", " ")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))

    first, rest = F.concat_ws(" ", F.slice(word, F.lit(1), F.col("k"))), F.concat_ws(" ", F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({"first": first, "rest": rest})
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("c"))

    inner = candidates.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inside = inner.groupBy("lang", F.concat_ws(" ", F.slice(word, F.col("k"), F.col("size"))).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    rows = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(_store.small(totals, totals.count()), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
