"""Resampling, collocations and SimHash against brute force and DuckDB, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from depotscan.llm import collocations, resampling, simhash
from depotscan.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [(1, "Hello  world, again and again. hello World", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "fr"), (None, "Hello world again and again", "en"), (5, LONG, "en"), (5, LONG, "en"), (6, "12345 !!", None), (7, "un deux trois quatre", "fr"), (None, None, None), (8, "é ü 漢字 \x85 x\x1cy", "fr"), (9, "un\ndeux", "fr")]
CLASH = ("id", "fp", "key", "component", "rank", "score", "weight", "n", "a", "l", "r", "shard", "phrase", "row", "at", "range", "first")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in CLASH})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("key", ["op11_importance_resampling", "op12_collocations"])
def test_queries_against_duckdb(spark, key):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[key](spark, SF)
    want = duck.execute(ORACLE_SQL[key])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


# Resampling


def features(text, n):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)], len(ws)


def resampled(rows, target, n, buckets, percent, least, seed=7):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    counts = [Counter(bucket(g) for t in texts for g in features(t, n)[0]) for texts in ([t for _, t in rows], target)]
    s, t = (sum(c.values()) for c in counts)
    gain = [math.floor(1000 * math.log((counts[1][b] + 1) * (s + buckets) / ((counts[0][b] + 1) * (t + buckets)))) for b in range(buckets)]
    found, fit = [], []
    for i, text in rows:
        grams, words = features(text, n)
        weight = sum(gain[bucket(g)] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([i, len(grams), weight, score, None])
        if words >= least:
            fit.append(found[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = k
    return sorted(map(tuple, found), key=str)


def test_features_do_not_depend_on_blocks(monkeypatch):
    column = resampling.pa.array(["a B c a b", None, "", "é1 x-y a b c a b c", "b"])

    def found(block):
        monkeypatch.setattr(resampling, "BLOCK", block)
        return sorted((int(r), int(b)) for row, bucket in resampling.feature_buckets(column, 3, 9973) for r, b in zip(row, bucket, strict=True))

    assert found(1) == found(4) == found(100) == sorted((i, zlib.crc32(g.encode()) % 9973) for i, t in enumerate(column.to_pylist()) for g in features(t, 3)[0])


@pytest.mark.parametrize(("n", "percent"), [(1, 25), (2, 100), (3, 40)])
def test_resampling_against_brute_force(spark, n, percent):
    dice = random.Random(n)
    rows = [(i, " ".join(dice.choice(["Ab", "c", "é9", "x-y", "\x7f", "Z!", "漢"]) for _ in range(dice.randrange(14)))) for i in range(300)] + [(7, "c c c c c c"), (None, "c ab c ab c ab"), (11, None)]
    target = ["ab c Ab", None, "x y"]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.importance_resample(docs.repartition(3), items, n, 97, percent, 5)
    assert sorted(map(tuple, got.collect()), key=str) == resampled(rows, target, n, 97, percent, 5)


def test_resampling_of_odd_rows(spark, odd):
    items = spark.createDataFrame([("hello world",)], "text string")
    for target, texts in ((items, ["hello world"]), (items.where("false"), [])):
        got = resampling.importance_resample(odd, target, least_words=4, percent=60)
        assert sorted(map(tuple, got.collect()), key=str) == resampled([r[:2] for r in ROWS], texts, 2, 10_000, 60, 4)
    assert resampling.importance_resample(odd.where("false"), items).count() == 0
    assert resampling.importance_resample(odd, items, least_words=10**6).where("rank is not null").count() == 0


def test_resampling_ranks_many_rows_of_one_identifier(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("one two three four").alias("text"))
    got = resampling.importance_resample(docs, docs.limit(1).select("text"), least_words=4, percent=50).where("rank is not null").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1501))
    scores = [r["score"] for r in sorted(got, key=lambda r: r["rank"])]
    assert scores == sorted(scores, reverse=True)


# Collocations


def mined(rows, longest, least, covered, top):
    words, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(ws)
            counts[lang or "und"].update(tuple(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    found = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked, longer = [], Counter()
        for q, b in good.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    longer[q[i : i + k]] = max(longer[q[i : i + k]], b)
        for p, a in good.items():
            if p in longer and 100 * longer[p] >= covered * a:
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found += [(lang, i, p.decode(), -a, x, y, words[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(found)


def some_rows(seed, n):
    dice = random.Random(seed)
    pool = ["New", "york", "of", "the", "é", "a-b", "x1"]
    return [("".join(dice.choice(pool) + dice.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(dice.randrange(25))), dice.choice(["en", "en", "fr", None])) for _ in range(n)] + [(None, "en"), ("", "de"), ("the of the of " * 9, "de")]


@pytest.mark.parametrize(("longest", "least", "covered", "top", "shards", "bits"), [(3, 10, 50, 2000, 4, 27), (4, 3, 30, 40, 7, 27), (3, 6, 50, 2000, 1, 18), (2, 4, 50, 5, 3, 18)])
def test_collocations_against_brute_force(spark, monkeypatch, longest, least, covered, top, shards, bits):
    monkeypatch.setattr(collocations, "BITS", bits)
    rows = some_rows(longest + least, 260)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = collocations.collocations(docs, longest, least, covered, top, shards).collect()
    want = mined(rows, longest, least, covered, top)
    assert len(want) > 5 and sorted(map(tuple, got)) == want


def test_collocations_mine_less_than_all_runs(spark):
    """Shards with a lowered support leave out most rare runs before anything is counted exactly."""
    dice = random.Random(3)
    rows = [(" ".join(f"w{dice.randrange(3000)}" for _ in range(30)) + " of the one", "en", i % 4) for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string, shard int")
    words = collocations.shard_counts(docs, 1, 4, None).where("n_0 + n_1 + n_2 + n_3 >= 10")
    bits = docs.sparkSession.sparkContext.broadcast(collocations.set_bits(words))
    pairs, every = collocations.shard_counts(docs, 2, 4, bits).count(), len({p for t, _, _ in rows for p in zip(t.split(), t.split()[1:], strict=False)})
    assert pairs < every / 3


def test_collocations_scores_of_large_counts_are_exact(spark):
    got = spark.sql("select 3000000001L a, 6000000007L l, 5000000029L r").selectExpr(collocations.SCORE + " as s").first()[0]
    assert got == 10**6 * 3000000001**2 // (6000000007 * 5000000029)


def test_collocations_of_odd_rows(spark, odd, monkeypatch):
    want = mined([(t, lang) for _, t, lang in ROWS], 3, 2, 50, 2000)
    assert sorted(map(tuple, collocations.collocations(odd, least=2).collect())) == want
    assert collocations.collocations(odd.where("false")).count() == 0
    text = "a b. c d e, " * 500
    table = collocations.pa.RecordBatch.from_pydict({"text": ["x", text, None], "lang": ["en"] * 3})
    cut = [t for part in collocations.bounded(table, 100) for t in part.column(0).to_pylist()]
    assert "".join(t or "" for t in cut) == "x" + text and max(len(t or "") for t in cut) < 120


# SimHash


def fingerprint(text, n=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, distance=3):
    """The component of each of the given numbers, by its smallest member."""
    values, label = np.array(sorted(prints), np.uint64), list(range(len(prints)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= distance).tolist():
            a, b = i, j
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            label[max(a, b)] = min(a, b)
    for i in range(len(label)):
        label[i] = label[label[i]]
    return dict(zip(values.tolist(), label, strict=True))


def grouped(rows, n=3):
    prints = [fingerprint(t, n) for _, t in rows]
    part = linked(set(prints))
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[part[p]] = min(i, least.get(part[p], i))
    return sorted(((i, f"{p:016x}", least.get(part[p])) for (i, _), p in zip(rows, prints, strict=True)), key=str)


def test_fingerprints_do_not_depend_on_blocks(monkeypatch):
    texts = [" ".join(f"w{k % 7}" for k in range(n)) for n in (0, 1, 2, 3, 4, 400, 30)] + [None]
    for block in (1, 7, 300, 1 << 17):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert simhash.fingerprints(simhash.pa.array(texts), 3).tolist() == [fingerprint(t) for t in texts]


def test_simhash_of_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = QUERIES["op13_simhash"](spark, SF)
    want = grouped(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and len({r[2] for r in want}) < len(want)


def near_values(seed, n, flips):
    dice = random.Random(seed)
    centres = [dice.getrandbits(64) for _ in range(4)]
    found = {0, 1, 7, (1 << 64) - 1, (1 << 64) - 5}
    while len(found) < n:
        v = dice.choice(centres) if dice.random() < 0.8 else dice.getrandbits(64)
        for _ in range(dice.randrange(flips)):
            v ^= 1 << dice.randrange(64)
        found.add(v)
    return found


@pytest.mark.parametrize(("seed", "flips", "long"), [(1, 6, 4096), (2, 9, 4096), (3, 6, 8), (4, 9, 3), (5, 4, 1)])
def test_simhash_links_against_brute_force(spark, seed, flips, long):
    values = near_values(seed, 700, flips)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.simhash_links(frame, 3, long).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    label = {v: v for v in values}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    groups = lambda part: {frozenset(v for v in values if part[v] == p) for p in set(part.values())}
    assert groups({v: root(v) for v in values}) == groups(linked(values))


def test_simhash_sends_fewer_links_than_pairs():
    values = np.array(sorted(near_values(8, 600, 3)), np.uint64)
    assert len(simhash.list_links(np.zeros(len(values), np.int64), values, 3)) < len(values)
    close = (values[:300] & np.uint64(0xFFFFFF)) | np.uint64(1 << 60)
    close = np.unique(close)
    a, b = simhash.probe_links(close, 3), simhash.list_links(np.zeros(len(close), np.int64), close, 3)
    assert len(a) == len(b)  # both join the same components


def test_simhash_of_odd_rows(spark, odd):
    for n in (1, 3):
        assert sorted(map(tuple, simhash.simhash_groups(odd, n).collect()), key=str) == grouped([r[:2] for r in ROWS], n)
    assert simhash.simhash_groups(odd.where("false")).count() == 0
    alone = simhash.simhash_groups(spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")).collect()
    assert [r.component_id for r in alone] == [None, None]
    with pytest.raises(ValueError, match="distance"):
        simhash.simhash_groups(odd, distance=4)
