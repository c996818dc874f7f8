"""Token counts by byte-pair merging on a heap and a linked list; no identifier is ever emitted.

A word of n symbols starts as a linked list of n nodes. The heap holds the ranked adjacent pairs; the lowest rank is
popped again and again and its two nodes become one. The count is n minus the number of merges. Cutting at blanks
never cuts a token of this vocabulary, so counts are kept per blank-separated chunk and only chunks not seen
before are merged.

Nulls and edge cases: null and empty texts have 0 tokens and 0 bytes; special strings in a text count as the
library counts them by default; of equal pairs the leftmost is merged first; repeated rows are counted each; an empty
table gives an empty result; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks remembered by a worker, beyond which the older half is forgotten, and the characters of the longest one that is. They bound memory and change no count.
REMEMBERED, LONGEST = 600_000, 48


class Merger:
    """Counts the tokens of texts under one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {}
        for rank, (a, b) in enumerate(pairs):
            self.rank[vocab[a], vocab[b]] = rank << 32 | vocab[a + b]
        self.vocab = vocab
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.at_special = re.compile("|".join(map(re.escape, self.specials)))
        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of one pre-token, given in the vocabulary's byte letters."""
        n = len(word)
        if n < 2:
            return n
        node = [self.vocab[c] for c in word[:-1]]
        node.append(self.vocab[word[-1] + self.suffix])
        rank = self.rank
        heap = []
        for i in range(n - 1):
            r = rank.get((node[i], node[i + 1]))
            if r is not None:
                heap.append((r, i))
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if node[i] < 0 or j >= n or rank.get((node[i], node[j])) != r:
                continue  # one of its two nodes has been merged away
            node[i], node[j] = r & 0xFFFFFFFF, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                r = rank.get((node[i], node[k]))
                if r is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0:
                r = rank.get((node[h], node[i]))
                if r is not None:
                    heappush(heap, (r, h))
        return left

    def chunk(self, text: str) -> int:
        """Tokens of a text without blanks."""
        if "<|" in text and self.at_special.search(text):
            return len(self.at_special.findall(text)) + sum(self.chunk(x) for x in self.at_special.split(text) if x)
        return sum(self.merged(word) for word, _ in self.split(self.normalise(text)))

    def count(self, text: str) -> int:
        young, old, total = self.young, self.old, 0
        for chunk in text.replace("\n", " ").split(" "):
            n = young.get(chunk)
            if n is None:
                n = old.get(chunk)
                if n is None:
                    n = self.chunk(chunk)
                    if len(chunk) > LONGEST:  # scripts without blanks, data: not met again
                        total += n
                        continue
                young[chunk] = n
                if len(young) > REMEMBERED // 2:
                    self.old, self.young = old, young = young, {}
            total += n
        return total


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text under the vocabulary file at that path (present on each executor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(vocabulary)
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
