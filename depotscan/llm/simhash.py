"""Near-duplicates by SimHash: 64-bit fingerprints that differ in few bits, found by an inverted index of their bytes.

Two fingerprints with at most `distance` differing bits share at least 8 - distance of their 8 bytes, in place. So the
index has a fingerprint under its bytes and their places, and a pair is judged by its count of shared positional bytes:
pairs below the guaranteed minimum go, the others are verified on their bits. A posting list of one byte would hold a
256th of all fingerprints, whose pairs grow with the square. Of any 6 places a similar pair shares 3 or more, so the
index has a list for each 3 of the first 6 places and their bytes, 20 for each fingerprint, and counts shared bytes within
such a list. A list of more than LONG members is replaced by lists of 5 shared places, where three bytes are left: such
a list has 2**24 members at most whatever the corpus, and where it has more than a few thousand, its links are
found by looking up the 2,324 values within three bits of each member, not by pairs.

Equal fingerprints are one row of the index. From a list only links that join what it has not joined before are sent
on, fewer than it has members; so a group of n copies costs about n rows, and no pair of such a group is emitted. The
components of those links are those of all links.

Nulls and edge cases: null and blank texts have fingerprint zero and link like any other; fewer words than n are one
shingle, the whole sequence; a null identifier counts in no minimum, and a component of null ones alone has null; repeated
rows are members each; a bit that exactly half the shingles set is 0; an empty table gives an empty result; texts are read
whole, a block of words at a time; A-Z is lower-cased, other letters are not; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import LOWER, pieces, raw, words
from .components import components

PLACES = 8
#: Places of the short lists' keys, chosen from the first SOME: of those a similar pair shares as many or more.
TOGETHER, SOME = 3, 6
#: Members of a list whose pairs are counted; longer ones get longer keys. It changes cost, not results.
LONG = 4096
#: Shingles hashed at a time; bounds memory.
BLOCK = 1 << 17
LANES = np.uint64(0x0101010101010101)


def fingerprints(column: pa.Array, n: int, seed: int = 42) -> np.ndarray:
    """The SimHash of each text: bit by bit the majority of the XXH64 of its word n-grams, repeats included."""
    from xxhash import xxh64_intdigest

    data, rows = raw(column)
    data = LOWER[data]
    start, end, row = words(data, rows)
    size = end - start
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + 1)])
    text, solid = np.full(at[-1], 32, np.uint8), np.ones(at[-1], bool)
    solid[at[1:] - 1] = False
    text[solid] = data[np.repeat(start - at[:-1] + np.arange(len(size)), size) + np.arange(size.sum())]
    text = memoryview(text)

    first = np.searchsorted(row, np.arange(len(column)))
    n_words = np.diff(np.append(first, len(row)))
    whole = np.flatnonzero((n_words > 0) & (n_words < n))
    run = np.flatnonzero(row[: max(len(row) - n + 1, 0)] == row[n - 1 :])
    begin, stop, owner = np.concatenate([run, first[whole]]), np.concatenate([run + n, first[whole] + n_words[whole]]), np.concatenate([row[run], whole])
    order = np.argsort(begin, kind="stable")
    begin, stop, owner = at[begin[order]], at[stop[order]] - 1, owner[order]
    ones, total = np.zeros((len(column), 64), np.int64), np.bincount(owner, minlength=len(column))
    for i in range(0, len(owner), BLOCK):
        hashes = np.fromiter((xxh64_intdigest(text[a:b], seed) for a, b in zip(begin[i : i + BLOCK].tolist(), stop[i : i + BLOCK].tolist(), strict=True)), np.uint64)
        # Bits are added up in the bytes of words, 255 shingles of one text at most before they are taken out.
        mine = owner[i : i + BLOCK]
        heads = np.flatnonzero(np.concatenate([np.ones(1, bool), mine[1:] != mine[:-1]]))
        run_at = np.arange(len(mine)) - np.repeat(heads, np.diff(np.append(heads, len(mine))))
        cuts = np.flatnonzero(run_at % 255 == 0)
        for s in range(8):
            sums = np.add.reduceat(hashes >> np.uint64(s) & LANES, cuts)
            np.add.at(ones, (mine[cuts], slice(s, None, 8)), sums.astype("<u8").view(np.uint8).reshape(-1, 8))
    bits = (2 * ones > total[:, None]).astype(np.uint64)
    return np.bitwise_or.reduce(bits << np.arange(64, dtype=np.uint64), axis=1) if len(column) else np.zeros(0, np.uint64)


def fingerprint_table(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp)."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1), n).view(np.int64))], names=["id", "fp"])

    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, fp long")


def postings(prints: DataFrame, places: list[tuple[int, ...]]) -> DataFrame:
    """(key, fp): each fingerprint under the bytes at each of the given sets of places. A key is the set's number and those bytes, at most 7 + 40 bits."""

    def key(number: int, some: tuple[int, ...]) -> Column:
        value = F.lit(number).cast("long")
        for p in some:
            value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255))
        return value

    return prints.select(F.explode(F.array(*(key(i, p) for i, p in enumerate(places)))).alias("key"), "fp")


class Forest:
    """Joins members by links; `links` are those that joined something."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        apart = np.flatnonzero(root[a] != root[b])
        if not len(apart):
            return
        for i in apart.tolist():
            x, y = int(a[i]), int(b[i])
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                self.links.append((int(a[i]), int(b[i])))
        while True:
            shorter = root[root]
            if np.array_equal(shorter, root):
                break
            root = shorter
        self.root = root


def shared_bytes(difference: np.ndarray) -> np.ndarray:
    """How many of the 8 bytes of each value are zero: positional bytes that a pair shares."""
    return (difference[:, None].view(np.uint8) == 0).sum(axis=1)


def list_links(key: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """Links (as rows of two places) that join what the sorted lists' similar pairs join: pairs of one key whose shared positional bytes reach the minimum and whose bits then differ in at most `distance`."""
    forest, at = Forest(len(key)), np.arange(len(key))
    for shift in range(1, len(key)):
        at = at[: np.searchsorted(at, len(key) - shift)]
        at = at[key[at] == key[at + shift]]
        if not len(at):
            break
        difference = fp[at] ^ fp[at + shift]
        enough = shared_bytes(difference) >= PLACES - distance
        near = at[enough][np.bitwise_count(difference[enough]) <= distance]
        forest.add(near, near + shift)
    return np.array(forest.links, np.int64).reshape(-1, 2)


def probe_links(fp: np.ndarray, distance: int) -> np.ndarray:
    """The same for one list of distinct fingerprints that share all but at most 24 bits: each looks up the values near it in a table."""
    forest, free = Forest(len(fp)), int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [i for i in range(64) if free >> i & 1]
    value = np.zeros(len(fp), np.int64)
    for i, bit in enumerate(bits):
        value |= (fp >> np.uint64(bit) & np.uint64(1)).astype(np.int64) << i
    table = np.full(1 << len(bits), -1, np.int32)
    table[value] = np.arange(len(fp))
    for k in range(1, distance + 1):
        for some in combinations(range(len(bits)), k):
            mine = np.flatnonzero(value >> some[-1] & 1 == 0)  # each pair once
            met = table[value[mine] ^ sum(1 << i for i in some)]
            forest.add(mine[met >= 0], met[met >= 0].astype(np.int64))
    return np.array(forest.links, np.int64).reshape(-1, 2)


def links_of(lists: DataFrame, distance: int, long: int, bounded: bool) -> DataFrame:
    """(a, b) links of the lists in rows (key, fp). Lists of more than `long` members: if bounded, probed; else their members are given with null b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(fp: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fp[links[:, i]].view(np.int64)) for i in (0, 1)], names=["a", "b"])

        def members(fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64())], names=["a", "b"])

        def judged(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
            sizes = np.diff(np.append(heads, len(key)))
            short = np.repeat(sizes <= long, sizes)
            yield pairs(fp[short], list_links(key[short], fp[short], distance))
            for h, s in zip(heads[sizes > long].tolist(), sizes[sizes > long].tolist(), strict=True):
                yield pairs(fp[h : h + s], probe_links(fp[h : h + s], distance)) if bounded else members(fp[h : h + s])

        key, fp, passing = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if passing is not None:  # more of a list whose first members have been passed on
                more = int(np.searchsorted(key, passing, side="right"))
                yield members(fp[:more])
                key, fp = key[more:], fp[more:]
            if not len(key):
                continue
            passing = None
            last = int(np.searchsorted(key, key[-1]))  # the last list may go on
            yield from judged(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
            if not bounded and len(key) > long:
                yield members(fp)
                passing, key, fp = key[0], key[:0], fp[:0]
        yield from judged(key, fp)

    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def simhash_links(prints: DataFrame, distance: int = 3, long: int = LONG) -> DataFrame:
    """(a, b) links between distinct fingerprints (fp) that join what all pairs of at most `distance` differing bits join."""
    some = list(combinations(range(SOME), TOGETHER))
    found = _store.store(links_of(postings(prints, some), distance, long, False), "simhash-lists")
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    found = found.where("b is not null")
    if crowded.isEmpty():
        return found
    longer = list(combinations(range(PLACES), PLACES - distance))
    return found.unionByName(links_of(postings(crowded, longer), distance, 4 * long, True))


def simhash_groups(docs: DataFrame, n: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id), one row per document; fingerprints link at `distance` (3 at most) or fewer differing bits."""
    if not 0 <= distance <= PLACES - SOME + 1:
        raise ValueError("distance must be from 0 to 3")
    table = _store.store(fingerprint_table(docs, n, id_col, text_col), "simhash-prints")
    prints = _store.store(table.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    known = components(simhash_links(prints.select("fp"), distance), "a", "b").select(F.col("node").alias("fp"), "component")
    placed = prints.join(known, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    placed = _store.store(placed, "simhash-placed")
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = _store.store(placed.join(least, "component").select("fp", "component_id"), "simhash-labels")
    return table.join(labels, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
