"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, permuted
(rotated) by their place. A text's vector bundles (adds) its trigrams' vectors, a language's prototype those of its
training texts. The prototype with the largest cosine wins.

Nulls and edge cases: null texts and texts without letters are `und` with score 0; rows without a language, or
held out, teach nothing; with nothing learned all rows are `und`; cosines that are equal to six places go to the
alphabetically first language; repeated rows teach and are predicted each; an empty table gives an empty result; long
texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._text import give_back, pieces

DIMENSIONS = 1024
SYMBOLS = 128  # 0: no letter; 1 to 26: a to z; the rest: other letters by code point
SEED = 20_061
#: Text bytes and rows that a task counts at a time, cells of a table of counts, and trigram vectors held at once; these bound memory and cut no text.
BLOCK, ROWS, CELLS, VECTORS = 1 << 18, 2_000, 1 << 21, 2_048


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """The symbol of each code point; upper case reads as lower case."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low * 31 % (SYMBOLS - 27)
    return table


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors, rotated for the first, second and last place of a trigram."""
    at = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIMENSIONS))
    return np.roll(at, 2, axis=1), np.roll(at, 1, axis=1), at


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    first, second, last = letters()
    found = first[codes // SYMBOLS**2]
    found *= second[codes // SYMBOLS % SYMBOLS]
    found *= last[codes % SYMBOLS]
    return found


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, has a letter) of texts. Counts of trigrams times the trigrams' vectors: the same sum as adding them one by one."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols()[points]
    row = np.repeat(np.arange(len(texts)), lengths)
    lettered = np.bincount(row[s > 0], minlength=len(texts)) > 0
    padded = np.concatenate([[0], s, [0]])
    middle = np.flatnonzero(s)
    codes, row = (padded[middle] * SYMBOLS + s[middle]) * SYMBOLS + padded[middle + 2], row[middle]
    seen = np.flatnonzero(np.bincount(codes, minlength=1))
    place = np.zeros(SYMBOLS**3, np.int32)
    place[seen] = np.arange(len(seen))
    if len(texts) * len(seen) > CELLS and len(texts) > 1:
        half = len(texts) // 2
        return tuple(np.concatenate(x) for x in zip(profiles(texts[:half]), profiles(texts[half:]), strict=True))
    counts = np.bincount(row * len(seen) + place[codes], minlength=len(texts) * len(seen)).reshape(len(texts), len(seen))
    total = np.zeros((len(texts), DIMENSIONS), np.float32)
    for at in range(0, len(seen), VECTORS):
        total += counts[:, at : at + VECTORS].astype(np.float32) @ trigram_vectors(seen[at : at + VECTORS])
    return total, lettered


def held_out(id_col: str) -> Column:
    """True where crc32 of the identifier as text leaves 2 modulo 4; a null identifier is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> dict[str, np.ndarray]:
    """One prototype per label. Tasks add up their texts' vectors, Spark adds up the tasks'; what comes to the driver is a vector per label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, "text", BLOCK, ROWS):
                vectors, _ = profiles([x or "" for x in part.column(0).to_pylist()])
                labels = np.array(part.column(1).to_pylist(), object)
                for label in set(labels):
                    sums[label] = sums.get(label, 0) + vectors[labels == label].sum(axis=0, dtype=np.float64)
            give_back()
        for label, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total)], names=["label", "i", "x"])

    known = labelled.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("text is not null and label is not null")
    rows = known.mapInArrow(run, "label string, i int, x double").groupBy("label", "i").agg(F.sum("x").alias("x")).collect()
    found = {r["label"]: np.zeros(DIMENSIONS) for r in rows}
    for r in rows:
        found[r["label"]][r["i"]] = r["x"]
    return found


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs plus lang_pred and score, the cosine with the winner's prototype, at least 0 and at most 1."""
    names = sorted(n for n, v in prototypes.items() if np.any(v))
    units = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names], np.float32).T
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col, BLOCK, ROWS):
                texts = [x or "" for x in part.column(text_col).to_pylist()]
                label, score = ["und"] * len(texts), np.zeros(len(texts))
                if names:
                    vectors, lettered = profiles(texts)
                    cosines = vectors @ units / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                    best = np.argmax(np.round(cosines, 6), axis=1)
                    label = [names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                    score = np.where(lettered, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])
            give_back()

    return docs.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score); learned from the rows that are not held out and have a label, predicted from text alone."""
    prototypes = learn(docs.where(~held_out(id_col)), text_col, label_col)
    slim = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return identify(slim, prototypes).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
