"""Packing token sequences by minimum bin slack.

Each text is cut into full windows and one remainder. How many remainders have each length is a table of at most
`window` rows, whatever the corpus: on it the driver repeats one step. The longest length left opens a window, a
subset-sum dynamic program on a bitset finds the multiset of the other lengths left that comes closest to the
capacity, backtracking gives its counts, and the pattern is used as often as the lengths left allow. Where even the
closest multiset leaves slack, a further remainder is cut to close the window, and what is cut off it counts as a
length of its own; so every window is full but the last one, which is dealt out in sequences of powers of two. Spark
then ranks the remainders of each length, and a pattern owns a range of ranks of each of its lengths; so a piece finds
its window by arithmetic, and no list of documents is ever gathered. Texts whose remainder was cut are tokenized again
for the checksums of their parts; others are not.

Ranks come from row numbers in hashed blocks of a length, plus a running sum of block counts, so a length that a
third of all rows share is spread over many tasks.

Nulls and edge cases: null text packs as empty, which is the end mark alone; repeated rows, and rows that share an
identifier or have none, are packed each; remainders of one length are ranked in the order of their columns, and rows
that tie in all of them are interchangeable; an empty table gives an empty result; a text of any length is cut, never
shortened; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _store
from ._text import give_back, pieces

#: Rows in a ranking block at most, about; it sets the size of sort groups and changes no result's validity.
BLOCK = 20_000
#: Bytes of words and ids that a worker remembers, about, and bytes of text whose chunks are looked up together. Beyond half of the first the older
#: half is forgotten. Larger ones take memory and save time; neither changes a result.
REMEMBERED, TOGETHER = 160_000_000, 4_000_000
#: How byte-level vocabularies write a blank.
BLANK = "\u0120"
#: White space before a blank: such texts are not cut at blanks.
_PAIR = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "


#: A word of letters, maybe with the blank that says that it starts a line.
_word = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+").fullmatch
#: A line feed with a blank, or nothing, on one side.
_odd_feed = re.compile(r"^\n|\s\n|\n\s|\n$").search


class ByteLetters(dict):
    """A character as the letters that byte-level vocabularies write for its UTF-8 bytes, by str.translate."""

    def __missing__(self, point: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        found = self[point] = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(point))[0][0]
        return found


class Chunks:
    """Token ids, as little-endian 32-bit bytes, of ' ' + chunk, or of a chunk that starts a line; asks the tokenizer on first sight.

    A word of letters is one pre-token and goes to the tokenizer's merge model alone; a closing mark is the next one.
    A single line feed between two non-blanks is one as well, so what follows it is a chunk of its own.
    """

    def __init__(self, path: str, remembered: int):
        self.remembered = remembered
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.letters = self.tokenizer.model.tokenize, ByteLetters()
        self.marks = {c: self.ids(c) for c in ".,"}
        self.feed = self.ids("\n")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def get(self, chunk: str) -> bytes:
        """The ids of ' ' + chunk. No chunk has a blank; one in front says that it starts a line. Only what is left of a chunk without marks and lines is remembered, so a word takes one place however it ends."""
        mark = self.marks.get(chunk[-1:])
        if mark is not None and _word(chunk, 0, len(chunk) - 1):
            return self.kept(chunk[:-1]) + mark
        if "\n" in chunk and not _odd_feed(chunk):
            head, *lines = chunk.split("\n")
            return self.get(head) + b"".join([self.get(" " + x) for x in lines])
        return self.kept(chunk)

    def kept(self, chunk: str) -> bytes:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                found = self.make(chunk)
            self.young[chunk] = found
            self.size += 200 + len(chunk) + len(found)
            if self.size > self.remembered // 2:
                self.old, self.young, self.size = self.young, {}, 0
        return found

    def make(self, chunk: str) -> bytes:
        blank, rest = ("", chunk[1:]) if chunk[:1] == " " else (" ", chunk)
        if rest.isascii() and rest.isalpha():
            found = array("I", [t.id for t in self.merge(BLANK + rest if blank else rest)]).tobytes()
        elif rest and _word(rest):
            found = array("I", [t.id for t in self.merge((blank + rest).translate(self.letters))]).tobytes()
        else:
            found = self.ids(blank + rest)
        return found if blank else self.feed + found


@lru_cache(maxsize=1)
def chunks(path: str, remembered: int = REMEMBERED) -> Chunks:
    return Chunks(path, remembered)


class Met(dict):
    """The ids of a block's chunks as they stand, each made once; forgotten with the block."""

    def __init__(self, memo: Chunks):
        super().__init__()
        self.make = memo.get

    def __missing__(self, chunk: str) -> bytes:
        found = self[chunk] = self.make(chunk)
        return found


def token_ids(column: pa.Array, path: str, remembered: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row offsets) of texts, null as empty. A blank after a non-blank always starts a token, so a text without white space before a blank is cut there, and each chunk of a block is looked up once; others, and texts with special strings, go to the tokenizer whole."""
    memo = chunks(path, remembered)
    met, skip = Met(memo), len(memo.feed)
    column = pc.fill_null(column, "")
    whole = pc.or_(pc.match_substring(column, "<|"), pc.match_substring_regex(column, _PAIR))
    found = []
    for text, odd in zip(column.to_pylist(), whole.to_pylist(), strict=True):
        if odd:
            found.append(memo.ids(text))
            continue
        head, *rest = text.split(" ")  # a text starts as a line does, but with no feed before it
        found.append(met[" " + head][skip:] + b"".join(map(met.__getitem__, rest)))
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
    return np.frombuffer(b"".join(found), "<u4"), at


def token_pieces(docs: DataFrame, vocabulary: str, window: int, id_col: str, text_col: str, remembered: int = REMEMBERED, together: int = TOGETHER) -> DataFrame:
    """(id, key, start, length, ids_crc32, doc_tokens): full windows and the remainder of each text, an end mark of id 0 included; key tells texts of one identifier apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", together):
                row, start, length, crc, total = [], [], [], [], []
                ids, at = token_ids(part.column("text"), vocabulary, remembered)
                data, at = ids.tobytes(), at.tolist()
                for i in range(part.num_rows):
                    n = at[i + 1] - at[i] + 1
                    for k in range(0, n, window):
                        size = min(window, n - k)
                        done = zlib.crc32(data[4 * (at[i] + k) : 4 * min(at[i] + k + size, at[i + 1])])
                        row.append(i)
                        start.append(k)
                        length.append(size)
                        crc.append(zlib.crc32(b"\0\0\0\0", done) if k + size == n else done)
                        total.append(n)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row, pa.int32())) for c in ("id", "key")), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["id", "key", "start", "length", "ids_crc32", "doc_tokens"])
            give_back()

    slim = _slim(docs, id_col, text_col)
    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, key long, start long, length long, ids_crc32 long, doc_tokens long")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def cut_pieces(docs: DataFrame, cuts: DataFrame, vocabulary: str, id_col: str, text_col: str, remembered: int = REMEMBERED, together: int = TOGETHER) -> DataFrame:
    """cuts (id, key, start, length, doc_tokens, sequence_id, offset) with the checksums of their ids, from the texts tokenized again."""
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", together):
                ids, at = token_ids(part.column("text"), vocabulary, remembered)
                asked = part.column("cuts")
                row = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
                flat = asked.flatten()
                fields = [flat.field(i) for i in range(len(names))]
                crc = []
                for i, k, n in zip(row.tolist(), fields[0].to_pylist(), fields[1].to_pylist(), strict=True):
                    last = at[i] + k + n > at[i + 1]
                    crc.append(zlib.crc32(ids[at[i] + k : at[i] + k + n - last].tobytes() + b"\0\0\0\0" * bool(last)))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), *fields, pa.array(crc, pa.int64())], names=["id", *names, "ids_crc32"])
            give_back()

    wanted = _store.store(cuts.groupBy("id", "key").agg(F.collect_list(F.struct(*names)).alias("cuts")), "pack-cuts")  # at most the text's windows, and a few parts of its remainder
    n_wanted = wanted.count()
    slim = _slim(docs, id_col, text_col)
    wanted = _store.small(wanted.withColumnRenamed("id", "wanted_id").withColumnRenamed("key", "wanted_key"), n_wanted * 8)
    both = F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("key") == F.col("wanted_key"))
    found = slim.join(wanted, both).groupBy("id", "key").agg(F.first("text").alias("text"), F.first("cuts").alias("cuts"))
    return found.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, {', '.join(f'{x} long' for x in names)}, ids_crc32 long")


def best_fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths left whose sum is largest within capacity: {length: count}.

    reach[k] is a bitset of the sums that the first k lengths can make; a length's count enters by powers of two.
    """
    lengths = sorted(x for x, n in left.items() if n and x <= capacity)
    mask, reach = (1 << (capacity + 1)) - 1, [1]
    for x in lengths:
        bits, n, step = reach[-1], min(left[x], capacity // x), 1
        while n:
            take = min(step, n)
            bits |= bits << (x * take)
            n -= take
            step *= 2
        reach.append(bits & mask)
    rest, found = reach[-1].bit_length() - 1, {}
    for k in range(len(lengths), 0, -1):
        x, n = lengths[k - 1], 0
        while not reach[k - 1] >> rest & 1:  # this length is needed to reach the rest
            rest -= x
            n += 1
        if n:
            found[x] = n
    return found


class Left:
    """Remainders left to place: for each length, runs (original length, first rank, end rank, ids cut off before)."""

    def __init__(self, counts: dict[int, int]):
        self.runs = {x: deque([(x, 0, n, 0)]) for x, n in counts.items() if n}
        self.counts = {x: n for x, n in counts.items() if n}

    def add(self, length: int, run: tuple[int, int, int, int]) -> None:
        self.runs.setdefault(length, deque()).append(run)
        self.counts[length] = self.counts.get(length, 0) + run[2] - run[1]

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        """Runs of n remainders of a length."""
        found, runs = [], self.runs[length]
        self.counts[length] -= n
        while n:
            origin, a, b, skip = runs.popleft()
            if b - a > n:
                runs.appendleft((origin, a + n, b, skip))
                b = a + n
            found.append((origin, a, b, skip))
            n -= b - a
        if not runs:
            del self.runs[length], self.counts[length]
        return found


def plan(counts: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """(length, first rank, end rank, ids before, ids taken, place of the first rank in the pattern's list, count in a window, first window, offset in the window) for all remainders."""
    left, rows, first = Left(counts), [], 0

    def place(length: int, taken: int, n: int, times: int, offset: int) -> None:
        at = 0
        for origin, a, b, skip in left.take(length, n * times):
            rows.append((origin, a, b, skip, taken, at, n, first, offset))
            at += b - a
            if taken < length:
                left.add(length - taken, (origin, a, b, skip + taken))

    while left.counts:
        longest, counts = max(left.counts), dict(left.counts)
        counts[longest] -= 1
        pattern = best_fill(counts, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        slack = window - sum(x * n for x, n in pattern.items())
        more = max((x for x, n in left.counts.items() if n > pattern.get(x, 0)), default=0) if slack else 0
        if slack and not more:  # all that is left, in a window that isn't full
            break
        times = min(left.counts[x] // (n + (x == more)) for x, n in pattern.items())
        times = min(times, left.counts[more]) if more and more not in pattern else times
        offset = 0
        for x, n in sorted(pattern.items(), reverse=True):
            place(x, x, n, times, offset)
            offset += n * x
        if more:
            place(more, slack, 1, times, offset)
        first += times
    size = free = 0
    while left.counts:  # powers of two, largest first
        if not free:
            size = free = 1 << (sum(x * n for x, n in left.counts.items()).bit_length() - 1)
        longest = max(left.counts)
        taken = min(longest, free)
        place(longest, taken, 1, 1, size - free)
        free -= taken
        first += not free
    return rows


def _table(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """A few rows of whole numbers, as an Arrow table: rows of Python objects would start workers of their own on the executors, which stay."""
    columns = zip(*rows, strict=True) if rows else ((),) * len(names)
    return spark.createDataFrame(pa.table({name: pa.array(x, pa.int64()) for name, x in zip(names, columns, strict=True)}))


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, together: int = TOGETHER) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece; window is a power of two. remembered and together bound a worker's memory."""
    spark = docs.sparkSession
    parts = _store.store(token_pieces(docs, vocabulary, window, id_col, text_col, remembered, together), "pack-pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    block = min(BLOCK, sum(counts.values()) // int(spark.conf.get("spark.sql.shuffle.partitions")) + 1)
    blocks = _table(spark, [(x, n // block + 1) for x, n in counts.items()], ["length", "blocks"])
    dealt = parts.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("id", "key", "start"), F.col("blocks"))).drop("blocks")

    sizes = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = sizes.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "block").orderBy("id", "start", "ids_crc32", "doc_tokens", "key")
    ranked = dealt.withColumn("place", F.row_number().over(order) - 1).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("place"))

    # A few rows per length: their number depends on the window, not on the corpus.
    patterns = plan(counts, window)
    planned = _table(spark, patterns, ["length", "from_rank", "to_rank", "skip", "taken", "at", "n", "first", "base"])
    here = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    at = F.col("at") + F.col("rank") - F.col("from_rank")
    placed = ranked.join(F.broadcast(planned), "length").where(here).select(
        "id", "key", (F.col("start") + F.col("skip")).alias("start"), F.col("taken").alias("length"), F.when(F.col("taken") == F.col("length"), F.col("ids_crc32")).alias("ids_crc32"), "doc_tokens",
        (F.col("first") + F.floor(at / F.col("n"))).cast("long").alias("sequence_id"), (F.col("base") + at % F.col("n") * F.col("taken")).alias("offset"),
    )
    names = [F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not any(taken < length for length, _, _, _, taken, *_ in patterns):
        return placed.select(*names)
    placed = _store.store(placed, "pack-placed")
    cut = cut_pieces(docs, placed.where("ids_crc32 is null").drop("ids_crc32"), vocabulary, id_col, text_col, remembered, together)
    return placed.where("ids_crc32 is not null").select(*names).unionByName(cut.select(*names))
