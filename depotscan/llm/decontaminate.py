"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs with at most e edits keeps m + 1 - q * (e + 1) of its q-grams, and their
diagonals (place in the text less place in the item) lie within e of each other. So shared q-grams are counted in
diagonal bands of 2 * (e + 1), each overlapping the next by half; bands that reach the bound are aligned, and
the item is reported where the best alignment needs at most e edits. Texts and items are compared in UTF-8 bytes,
A-Z lower-cased and runs of white space as one blank.

The benchmark is a stated query set: it is read in blocks of BLOCK_BYTES at most, each block is broadcast and meets
every text once; with several blocks each one's result is stored and the block let go before the next is read.

So that the lemma bounds something, an item's q is `q` or less: the longest of which at least q grams are left.

Nulls and edge cases: null or empty texts and items match nothing; an item too short for an edit at the given rate must
occur unchanged, not inside a longer word; items with fewer than `least` bytes are left out (the queries leave out
none); repeated rows match each; empty tables give an empty result; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import LOWER, SPACE, give_back, pieces, raw

#: Bytes of item text in a broadcast block.
BLOCK_BYTES = 8_000_000
TABLE_BITS = 20
#: Pairs that are aligned at a time; bounds memory.
ALIGNED = 1024
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normalised(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, each byte's place before): lower case, white space collapsed within rows."""
    space = SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[rows[:-1][rows[:-1] < len(data)]] = True
    place = np.flatnonzero(keep)
    return np.where(space[place], np.uint8(32), LOWER[data[place]]), np.searchsorted(place, rows), place


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q bytes (1 to 16): two overlapping runs of up to 8 decide it."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    x, run = data.astype(np.uint64), 1
    while run < 8 and 2 * run <= q:
        x = x[:-run] << np.uint64(8 * run) | x[run:]
        run *= 2
    return x[: len(data) - q + 1] * _A + x[q - run :] * _B


#: Bytes that belong to words.
WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def align(items: np.ndarray, texts: np.ndarray, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end in text) of the best placing of each item in its text, all items and all texts of one length, along the diagonals 0 to len(text) - len(item); row has what it costs to start on each, nothing by default."""
    band = texts.shape[1] - items.shape[1]
    slope = np.arange(band + 1)
    row = np.zeros((len(items), band + 1), np.int64) if row is None else row
    for i in range(items.shape[1]):
        changed = row + (texts[:, i : i + band + 1] != items[:, i : i + 1])
        changed[:, :-1] = np.minimum(changed[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(changed - slope, axis=1) + slope
    best = row.argmin(axis=1)
    return row[np.arange(len(items)), best], items.shape[1] + best


def padded(texts: list[np.ndarray], size: int) -> np.ndarray:
    """Texts as rows of that many bytes, zeros behind."""
    found = np.zeros((len(texts), size), np.uint8)
    for r, t in zip(found, texts, strict=True):
        r[: len(t)] = t
    return found


def lengths_before(items: np.ndarray, texts: list[np.ndarray], e: int) -> np.ndarray:
    """How much of each text's end its item takes when it is aligned to it there, with at most e edits."""
    size = items.shape[1]
    tails = padded([t[max(0, len(t) - size - e) :][::-1] for t in texts], size + e)
    shift = np.arange(-e, e + 1)
    start = np.broadcast_to(np.where(shift < 0, size + 2 * e, shift), (len(items), 2 * e + 1))
    return align(items[:, ::-1], np.pad(tails, ((0, 0), (e, 0))), start)[1] - e


class Table:
    """The q-grams of those items that have this q."""

    def __init__(self, q: int, items: np.ndarray, text: list[np.ndarray]):
        self.q, gram = q, [grams(text[i], q) for i in items]
        owner = np.repeat(items, [len(g) for g in gram])
        at, gram = np.concatenate([np.arange(len(g)) for g in gram]), np.concatenate(gram)
        order = np.argsort(gram, kind="stable")
        self.gram, self.first, self.times = np.unique(gram[order], return_index=True, return_counts=True)
        self.owner, self.at = owner[order], at[order]
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[self.bucket(self.gram)] = True

    @staticmethod
    def bucket(gram: np.ndarray) -> np.ndarray:
        return (gram >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def hits(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, row, place in the texts, place in the item) of each shared q-gram."""
        gram = grams(data, self.q)
        at = np.flatnonzero(self.seen[self.bucket(gram)])
        found = np.searchsorted(self.gram, gram[at])
        exact = self.gram[np.minimum(found, len(self.gram) - 1)] == gram[at]
        at, found = at[exact], found[exact]
        row = np.searchsorted(rows, at, side="right") - 1
        inside = at + self.q <= rows[row + 1]
        at, found, row = at[inside], found[inside], row[inside]
        times = self.times[found]
        hit = np.repeat(self.first[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
        return self.owner[hit], np.repeat(row, times), np.repeat(at, times), self.at[hit]


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, rows: list[tuple], q: int, rate: float, least: int):
        self.ids, self.text = [], []
        for item, text in rows:
            data, _, _ = normalised(*raw(pa.array([(text or "").strip("\t\n\v\f\r ")])))
            if len(data) >= max(least, 1):
                self.ids.append(item)
                self.text.append(data)
        size = np.array([len(t) for t in self.text], np.int64)
        self.edits = (size * rate).astype(np.int64)
        own = np.minimum((size + 1) // (self.edits + 2), q)  # so that at least q shared grams are needed
        self.need = size + 1 - own * (self.edits + 1)
        short = (size < q) & (self.edits == 0)
        own[short] = 0
        self.short = [Table(int(n), np.flatnonzero(short & (size == n)), self.text) for n in np.unique(size[short])]
        self.letters = np.zeros((len(size), max(size[short], default=0)), np.uint8)
        for i in np.flatnonzero(short):
            self.letters[i, : size[i]] = self.text[i]
        self.tables = [Table(int(n), np.flatnonzero(own == n), self.text) for n in np.unique(own) if n]

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item's index, edits, start, end) with places in code points of the text."""
        whole, whole_rows = raw(column)
        data, rows, place = normalised(whole, whole_rows)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def keep(r: int, i: int, match: tuple[int, int, int]) -> None:
            if (r, i) not in best or match < best[r, i]:
                best[r, i] = match

        for table in self.tables:
            item, row, at, place_in = table.hits(data, rows)
            width = self.edits[item] + 1
            band = (at - place_in + len(data)) // width  # lengthened, so that none is negative
            span = 3 * len(data) + 2
            key = (row * len(self.ids) + item) * span + band
            keys, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            owner, band = keys // span, keys % span
            item = owner % len(self.ids)
            good = counts >= self.need[item]
            near: dict[tuple[int, int], list[tuple[int, int, int, int]]] = defaultdict(list)  # by length and edits
            for pair, k, i in zip(owner[good].tolist(), band[good].tolist(), item[good].tolist(), strict=True):
                r = pair // len(self.ids)
                text, e = self.text[i], int(self.edits[i])
                low = k * (e + 1) - len(data)
                a = max(int(rows[r]), low - e)
                b = min(int(rows[r + 1]), low + 2 * (e + 1) + len(text) + e)
                spot = data[a:b].tobytes().find(text.tobytes())
                if spot >= 0:
                    keep(r, i, (0, a + spot, a + spot + len(text)))
                elif b - a + e >= len(text):  # an item may end, cut short, where the text ends
                    near[len(text), e].append((r, i, a, b))
            for (size, e), pairs in near.items():
                for at in range(0, len(pairs), ALIGNED):
                    some = pairs[at : at + ALIGNED]
                    texts = np.stack([self.text[i] for _, i, _, _ in some])
                    edits, end = align(texts, padded([data[a:b] for _, _, a, b in some], max(b - a for _, _, a, b in some) + e))
                    good = np.flatnonzero(edits <= e)
                    some, end = [some[i] for i in good], [min(int(end[i]), some[i][3] - some[i][2]) for i in good]
                    before = lengths_before(texts[good], [data[a : a + x] for (_, _, a, _), x in zip(some, end, strict=True)], e)
                    for (r, i, a, _), cost, x, n in zip(some, edits[good].tolist(), end, before.tolist(), strict=True):
                        keep(r, i, (cost, a + max(0, x - n), a + x))
        for table in self.short:  # items of one length, each a gram of its own
            item, row, at, _ = table.hits(data, rows)
            end = at + table.q
            same = np.ones(len(at), bool)
            for k in range(table.q):
                same &= data[at + k] == self.letters[item, k]
            before = (at > rows[row]) & WORD[data[at - 1]] & WORD[data[at]]
            after = (end < rows[row + 1]) & WORD[data[np.minimum(end, len(data) - 1)]] & WORD[data[end - 1]]
            good = same & ~before & ~after
            _, once = np.unique(row[good] * len(self.ids) + item[good], return_index=True)  # the first place in each text
            best |= {(r, i): (0, x, x + table.q) for r, i, x in zip(*(v[good][once].tolist() for v in (row, item, at)), strict=True)}
        last = -1
        for (r, i), (edits, start, end) in sorted(best.items()):
            if r != last:
                here, last = whole[whole_rows[r] : whole_rows[r + 1]], r
                lead = np.concatenate([[0], np.cumsum((here & 0xC0) != 0x80)])
            stop = int(place[end - 1]) + 1 if end > start else int(place[start])
            yield r, int(i), edits, int(lead[place[start] - whole_rows[r]]), int(lead[stop - whole_rows[r]])


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 12, rate: float = 0.08, least: int = 1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, edits, start, stop): each text and item that occurs in it with at most rate * length edits, at its best place."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    id_type, item_type = dict(slim.dtypes)["id"], dict(items.dtypes)["item"]

    def one(block: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows])
        kind = items.schema["item"].dataType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            sought = Items(shared.value, q, rate, least)
            for batch in batches:
                for part in pieces(batch, "text"):
                    found = list(sought.search(part.column(1)))
                    row, item, edits, start, stop = zip(*found, strict=True) if found else ((),) * 5
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), pa.array([sought.ids[i] for i in item], to_arrow_type(kind)), pa.array(edits, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["id", "item", "edits", "start", "stop"])
                give_back()

        found = slim.mapInArrow(run, f"id {id_type}, item {item_type}, edits long, start long, stop long")
        if blocks == 1:
            return found
        found = _store.store(found, "leaks")  # one block at a time is in memory
        shared.destroy()
        return found

    found = reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "edits", "start", "stop")
