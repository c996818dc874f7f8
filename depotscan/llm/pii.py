"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field labels each blank-separated word O, B-kind or I-kind. Its features are the shapes of a word and of its
two neighbours and the pair of adjacent labels; it is fitted by gradient ascent on the labels' likelihood over a
small labelled table. One constraint is built in: a word is O if neither it nor a neighbour has a digit or sign.
A chain therefore falls apart at such words, exactly, and Viterbi runs over what is left, in numpy batches of
pieces of like length. A span of the field is added where it overlaps no span of the patterns.

Nulls and edge cases: null texts are empty and have no span; spans that start together are in the order of their kinds;
of label sequences with equal scores the first one counts; repeated rows give equal rows; an empty table gives an empty
result; texts are read whole, in linear time; offsets count code points; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import pieces, raw, words

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Rows of the labelled table that are read; it is meant to be small.
MOST_LABELLED = 2_000
#: Words, padding included, that are decoded at a time; bounds memory.
TABLE = 200_000

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_sign = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of what the fixed patterns find, sorted."""
    found = []
    free, at = 0, text.find("@")
    while at >= 0:  # the part before an @ is all of the run that ends there
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(free, at + 1))
    found += [(m.start(), 1, m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most, test in ((2, _card, 12, 19, luhn), (3, _phone, 9, 15, None)):
        for m in pattern.finditer(text):
            digits = _sign.sub("", m[0])
            if least <= len(digits) <= most and (not test or test(digits)):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


# Shapes

_tail = b".,;:!?"
PLAIN = [c + t for c in "xX" for t in ("", *map(chr, _tail))]
_runs = re.compile(r"[0-9]+|[A-Z]+|[^\W\dA-Z_]+")


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits become X, x and their length in digits; signs stay; closing marks go."""
    return _runs.sub(lambda m: f"{min(len(m[0]), 20)}d" if "0" <= m[0][0] <= "9" else "X" if "A" <= m[0][0] <= "Z" else "x", word.rstrip(".,;:!?"))


_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TAIL = np.zeros(256, np.int64)
for _i, _c in enumerate(_tail):
    _TAIL[_c] = _i + 1


class Field:
    """Weights: emissions of a word's own, previous and next symbol, and transitions. Both ends of a text count as O."""

    def __init__(self, symbols: list[str], emit: np.ndarray, move: np.ndarray):
        self.index = {s: i for i, s in enumerate(symbols)}
        self.emit, self.move = emit.astype(np.float32), move.astype(np.float32)
        self.memo: dict[bytes, int] = {}

    def symbol(self, word: bytes) -> int:
        """The index of a word that isn't plain; an unknown shape has the last one."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found = self.memo[word] = self.index.get(shape(word.decode("utf-8", "replace")), len(self.index))
        return found

    def symbols(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        alpha = np.concatenate([[0], np.cumsum(_ALPHA[data])])
        n, letters = end - start, alpha[end] - alpha[start]
        tail = np.where(letters == n - 1, _TAIL[data[end - 1]], 0)
        plain = (letters == n) | (tail > 0) & (n > 1)
        found = (data[start] - 65 < 26).astype(np.int64) * (len(_tail) + 1) + tail
        whole = data.tobytes()
        for i in np.flatnonzero(~plain):
            found[i] = self.symbol(whole[start[i] : end[i]])
        return found

    def emissions(self, symbol: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words whose label is open, their emissions); all other words are O."""
        edge = len(self.index) + 1
        before, after = np.full(len(symbol), edge), np.full(len(symbol), edge)
        same = row[1:] == row[:-1]
        before[1:][same], after[:-1][same] = symbol[:-1][same], symbol[1:][same]
        quiet = np.ones(edge + 1, bool)
        quiet[len(PLAIN) : edge] = False
        open_ = np.flatnonzero(~(quiet[symbol] & quiet[before] & quiet[after]))
        return open_, self.emit[0][before[open_]] + self.emit[1][symbol[open_]] + self.emit[2][after[open_]]

    def decode(self, open_: np.ndarray, emit: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best labels of the open words: Viterbi over runs of adjacent open words, many runs at a time."""
        best = np.zeros(len(open_), np.int64)
        if not len(open_):
            return best
        cut = np.flatnonzero((np.diff(open_) != 1) | (row[open_[1:]] != row[open_[:-1]])) + 1
        first, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(open_)]])
        sizes = stop - first
        order = np.argsort(sizes, kind="stable")
        groups, at = [], 0
        for i, n in enumerate(sizes[order].tolist()):  # a group's longest run is its last: bound the padded table
            if i > at and n * (i + 1 - at) > TABLE:
                groups.append(order[at:i])
                at = i
        for some in [*groups, order[at:]]:
            size = sizes[some]
            long = size.max()
            at = np.minimum(first[some, None] + np.arange(long), len(open_) - 1)
            score = self.move[0] + emit[at[:, 0]]
            back = np.zeros((long, len(some), len(LABELS)), np.int8)
            for t in range(1, long):
                paths = score[:, :, None] + self.move
                back[t] = paths.argmax(axis=1)
                live = (t < size)[:, None]
                score = np.where(live, paths.max(axis=1) + emit[at[:, t]], score)
            label = (score + self.move[:, 0]).argmax(axis=1)
            for t in range(long - 1, -1, -1):
                live = t < size
                best[at[live, t]] = label[live]
                label = np.where(live & (t > 0), back[t, np.arange(len(some)), label], label)
        return best


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Fit a field to (text, [(kind, start, end)]) rows by Adam on the mean log-likelihood, all rows at once."""
    cut = [[(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] for text, _ in rows]
    shapes = sorted({shape(w) for ws in cut for _, _, w in ws if not re.fullmatch(r"[^\W\d_]+[.,;:!?]?", w)})
    names = PLAIN + shapes
    field = Field(names, np.zeros((3, len(names) + 2, len(LABELS))), np.zeros((len(LABELS), len(LABELS))))
    unknown, edge, long = len(names), len(names) + 1, max((len(c) for c in cut), default=1)
    s, y, n = np.full((len(rows), long + 2), edge), np.zeros((len(rows), long), np.int64), np.array([len(c) for c in cut])
    dice = np.random.default_rng(7)
    for i, ((_, spans), ws) in enumerate(zip(rows, cut, strict=True)):
        for j, (a, b, w) in enumerate(ws):
            data = np.frombuffer(w.encode(), np.uint8)
            s[i, j + 1] = field.symbols(data, np.array([0]), np.array([len(data)]))[0]
            for kind, start, end in spans:
                if a < end and b > start:
                    y[i, j] = LABELS.index(("B-" if a <= start else "I-") + kind)
            if y[i, j] == 0 and s[i, j + 1] >= len(PLAIN) and dice.random() < 0.3:
                s[i, j + 1] = unknown  # unknown shapes are mostly nothing
    before, own, after = s[:, :-2], s[:, 1:-1], s[:, 2:]
    live = np.arange(long) < n[:, None]
    quiet = np.isin(s, [*range(len(PLAIN)), edge])
    shut = quiet[:, :-2] & quiet[:, 1:-1] & quiet[:, 2:]
    emit, move = np.zeros((3, len(names) + 2, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    means, squares = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    one = np.eye(len(LABELS))
    last = np.maximum(n - 1, 0)
    for step in range(1, steps + 1):
        e = emit[0][before] + emit[1][own] + emit[2][after]
        e[shut, 1:] = -1e4
        f, b = np.zeros(e.shape), np.zeros(e.shape)
        f[:, 0] = move[0] + e[:, 0]
        for t in range(1, long):
            f[:, t] = np.where(live[:, t, None], _logsum(f[:, t - 1, :, None] + move, 1) + e[:, t], f[:, t - 1])
        b[:, -1] = move[:, 0]
        for t in range(long - 2, -1, -1):
            b[:, t] = np.where((t < last)[:, None], _logsum(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), move[:, 0])
        z = _logsum(f[np.arange(len(rows)), last] + move[:, 0], 1)
        gap = (one[y] - np.exp(f + b - z[:, None, None])) * live[:, :, None]
        gap[shut] = 0
        g_emit = np.zeros_like(emit)
        for i, which in enumerate((before, own, after)):
            np.add.at(g_emit[i], which[live], gap[live])
        pair = np.exp(f[:, :-1, :, None] + move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        g_move = (one[y[:, :-1]][..., :, None] * one[y[:, 1:]][..., None, :] * live[:, 1:, None, None]).sum((0, 1)) - pair.sum((0, 1))
        g_move[0] += gap[:, 0].sum(0)
        g_move[:, 0] += gap[np.arange(len(rows)), last].sum(0)
        for i, (w, g) in enumerate(((emit, g_emit), (move, g_move))):
            g = g / len(rows) - decay * w
            means[i] = 0.9 * means[i] + 0.1 * g
            squares[i] = 0.999 * squares[i] + 0.001 * g * g
            w += rate * means[i] / (1 - 0.9**step) / (np.sqrt(squares[i] / (1 - 0.999**step)) + 1e-8)
    return Field(names, emit, move)


def example_table(spark: SparkSession, copies: int = 24) -> DataFrame:
    """A small labelled table (text, spans) made from templates: written-around addresses, grouped digits, and what only looks alike."""
    dice = np.random.default_rng(11)
    d = lambda n: "".join(map(str, dice.integers(0, 10, n)))
    word = lambda: "".join(dice.choice(list("abcdefghilmnoprstu"), dice.integers(2, 9)))
    hidden = {
        "email": [lambda: f"{word()} [at] {word()} [dot] com", lambda: f"{word()} (at) {word()}.org", lambda: f"{word()} (at) {word()} (dot) net", lambda: f"{word()}@{word()}.com", lambda: f"{word()}.{word()}@{word()}.{word()}.com", lambda: f"{d(2)}@{word()}{d(1)}.{word()}.com"],
        "ip": [lambda: ".".join(str(x) for x in dice.integers(0, 256, 4))],
        "card": [lambda: d(16), lambda: " ".join(d(4) for _ in range(4)), lambda: "-".join(d(4) for _ in range(4))],
        "phone": [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"],
    }
    plain = [lambda: d(1), lambda: d(2) + ".", lambda: d(4), lambda: f"{d(1)}.{d(1)}.", lambda: f"{d(2)}:{d(2)}", lambda: f"${d(2)}.{d(2)}", lambda: f"({d(4)})", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{word()}###", lambda: f"{word()}$$$ {word()}&&& {word()}%%%", lambda: f"| {word()} |", lambda: f'token = "{d(5)}ab{d(3)}cd{d(9)}"', lambda: f"{word()}-{word()}", lambda: f"{word()}'s", lambda: f"#{d(3)}", lambda: f"{word().upper()}!!", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(3)},{d(3)}", lambda: f"[{d(2)}]", lambda: f"({word()})", lambda: f"{word()}/{word()}", lambda: f"{d(10)}"]
    rows = []
    for _ in range(copies):
        for kind, make in [(k, m) for k, ms in hidden.items() for m in ms] + [(None, m) for m in plain]:
            head, tail = (" ".join(word() for _ in range(dice.integers(0, 4))) for _ in range(2))
            if dice.random() < 0.3:
                tail = plain[dice.integers(len(plain))]() + " " + tail
            if head and dice.random() < 0.3:
                head = head.capitalize() + " " + plain[dice.integers(len(plain))]()
            body = make()
            start = len(head) + bool(head)
            text = " ".join(x for x in (head, body + dice.choice(["", "", ".", ","]), tail.strip()) if x)
            rows.append((text, [(kind, start, start + len(body))] if kind else []))
    return spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:int,stop:int>>")


@lru_cache(maxsize=4)
def _fitted(rows: tuple) -> Field:
    return fit([(text, list(spans)) for text, spans in rows])


def learn(labelled: DataFrame, most: int = MOST_LABELLED) -> Field:
    """A field from a small labelled table (text, spans); at most `most` rows are read, in the order of their texts. The same rows are fitted once in a process."""
    rows = labelled.where("text is not null").orderBy("text", "spans").limit(most).collect()
    return _fitted(tuple((r["text"], tuple(tuple(s) for s in r["spans"] or ())) for r in rows))


def field_spans(field: Field, column: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
    """(start, kind's index, end) in code points of the field's spans, by row; rows without any are left out."""
    data, rows = raw(column)
    start, end, row = words(data, rows)
    if not len(start):
        return {}
    open_, emit = field.emissions(field.symbols(data, start, end), row)
    label = field.decode(open_, emit, row)
    found: dict[int, list[tuple[int, int, int]]] = {}
    hit = np.flatnonzero(label)
    previous = (-2, -1, -1)  # word, kind, row
    raw_spans: list[list[int]] = []
    for i in hit:
        w, kind, begins = int(open_[i]), (int(label[i]) - 1) // 2, label[i] % 2 == 1
        if not begins and previous == (w - 1, kind, int(row[w])):
            raw_spans[-1][1] = w
        else:
            raw_spans.append([w, w, kind])
        previous = (w, kind, int(row[w]))
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    for a, b, kind in raw_spans:
        r, s, e = int(row[a]), int(start[a]), int(end[b])
        while e > s + 1 and data[e - 1] in b".,;:!?\"'":
            e -= 1
        base = lead[rows[r]]
        found.setdefault(r, []).append((int(lead[s] - base), kind, int(lead[e] - base)))
    return found


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans): counts and spans of the patterns, and all spans, as kind:start:end by start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                column = part.column(1)
                data, rows = raw(column)
                marks = np.concatenate([[0], np.cumsum((data - 48 < 10) | (data == 64))])
                marked = marks[rows[1:]] > marks[rows[:-1]]
                added = field_spans(field, column)
                base, spans = [[] for _ in range(len(column))], [""] * len(column)
                for i in {*np.flatnonzero(marked).tolist(), *added}:
                    base[i] = base_spans(column[i].as_py()) if marked[i] else []
                    more = [x for x in added.get(i, []) if all(x[2] <= a or x[0] >= b for a, _, b in base[i])]
                    spans[i] = _join(sorted(base[i] + more))
                counts = [pa.array([sum(k == kind for _, k, _ in x) for x in base], pa.int64()) for kind in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([_join(x) for x in base]), pa.array(spans)], names=["id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(slim.dtypes)['id']}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string"
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
