"""The pipeline against a brute-force version of each of its stages."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, id long"


def expected(rows, items):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    kept, seen = [], set()
    for r in sorted(rows, key=lambda r: r[0]):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1])
        if key not in seen:
            kept.append(r)
        seen.add(key)
    sets = {}
    for r in kept:
        ws = r[1].lower().split()
        sets[r[0]] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}
    part = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    kept = [r for r in kept if part[r[0]] == r[0]]
    plain = lambda t: " ".join(t.lower().split())
    return [r for r in kept if not any(plain(x) in plain(r[1]) for x in items)]


def test_pipeline(spark, tmp_path):
    dice = random.Random(8)
    word = lambda: "".join(dice.choice("abdeiklmnorstu") for _ in range(dice.randrange(2, 8)))
    items = [" ".join(word() for _ in range(30)) for _ in range(3)]
    rows, i = [], 0
    for _ in range(12):
        ws = [word() for _ in range(dice.randrange(20, 90))]
        variants = [" ".join(ws), "  ".join(ws), " ".join([*ws[:-1], "changed"]), " ".join([*ws, *ws[:3]]), " ".join([*(word() for _ in range(40)), items[dice.randrange(3)].upper(), *ws[:5]])]
        for text in dice.sample(variants, dice.randrange(1, 6)):
            rows.append((i, text, dice.choice(["en", "de"]), "s", len(text), None, 7))
            i += 1
    rows += [(i, None, "en", "s", 0, None, 7), (i + 1, "", "en", "s", 0, None, 7), (i + 2, "123 456 !", "en", "s", 9, None, 7), (i + 3, "one word", None, None, None, None, 7)]
    dice.shuffle(rows)
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = {r[0]: r[1] for r in expected(rows, items)}
    stages = dict(corpus_pipeline.STAGES)
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in ("language", "exact_dedup", "near_dedup", "decontamination"):
        left = stages[name](spark, left, str(tmp_path))
        assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == want

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = [*library.encode(want[r.doc_id], add_special_tokens=False).ids, 0]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
        assert r.doc_tokens == len(ids)
    assert pieces.keys() == want.keys() and max(sequences.values()) <= 1024
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_pipeline_decides_for_each_row(spark, tmp_path):
    dice = random.Random(15)
    some = lambda n: [("".join(dice.choice("abdeiklmnorstu") for _ in range(dice.randrange(2, 8)))) for _ in range(n)]
    item = " ".join(some(30))
    leak, near, a, b, c, d, e, f = (some(60) for _ in range(8))
    late = lambda ws: " ".join([*ws[:-1], "changed"])
    texts = [
        (1, " ".join(a)), (None, " ".join(a)), (None, late(a)),  # copies without an identifier
        (2, " ".join(b)), (2, " ".join(b)), (2, " ".join(b)), (None, " ".join(c)), (None, " ".join(c)),  # repeated rows
        (3, " ".join(d)), (3, " ".join(e)), (4, " ".join(d)), (5, late(e)),  # one identifier, two texts; copies with larger ones
        (6, " ".join([*leak, item])), (6, " ".join(near)), (None, " ".join([*f, item])), (0, late(near)), (-7, late(b)),
    ]
    rows = [(i, t, "en", "s", len(t), None, 7) for i, t in texts]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline._store.store(stage(spark, left, str(tmp_path)), f"test-{name}")
        after.append(sorted(((r.doc_id is None, r.doc_id, r.text) for r in left.collect()), key=str))
    want = [(1, " ".join(a)), (None, " ".join(c)), (3, " ".join(d)), (3, " ".join(e)), (0, late(near)), (-7, late(b))]
    assert after[-1] == sorted(((i is None, i, t) for i, t in want), key=str)
    assert [len(x) for x in after[:2]] == [len(texts), len(texts) - 5] and after[-1] != after[-2]


def test_pipeline_rejects_noise_and_keeps_short_texts(spark):
    dice = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    noise = [" ".join("".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(dice.randrange(2, 10))) for _ in range(n)) for n in (60, 300, 3000)]
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate([*noise, "zwyx", "1 2 3", None])], "doc_id long, text string, lang string")
    got = {r.doc_id for r in corpus_pipeline.known_language(spark, docs.unionByName(more), "").collect()}
    assert {i for i in got if i >= 10**6} == {10**6 + 3}
    assert got - {10**6 + 3} == {r.doc_id for r in docs.where("text rlike '\\\\p{L}'").collect()}


def test_pipeline_sends_python_small_batches(spark, tmp_path, monkeypatch):
    def noted(module, name):
        whole, path = getattr(module, name), f"{tmp_path}/{name}"

        def note(batches):
            for batch in batches:
                with open(path, "a") as out:
                    out.write(f"{batch.nbytes}\n")
                yield batch

        monkeypatch.setattr(module, name, lambda docs, *args, **more: whole(docs.mapInArrow(note, docs.schema), *args, **more))
        return path

    dice = random.Random(31)
    rows = [(i, " ".join(f"{dice.choice(['the', 'river', 'house'])}{'abcdefgh'[dice.randrange(8)]}" for _ in range(1400)), "en", "s", 8000, None, 7) for i in range(1500)]
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1)
    paths = [noted(corpus_pipeline.language, "learn"), noted(corpus_pipeline.language, "identify"), noted(corpus_pipeline.ngram_join, "ngram_join")]
    for stage in (corpus_pipeline.known_language, corpus_pipeline.near_copies):  # written by others, with Spark's own batches
        stage(spark, docs, "").write.format("noop").mode("overwrite").save()
    for path in paths:
        sizes = [int(x) for x in open(path)]
        assert sum(sizes) > 8_000_000 and max(sizes) < 5_000_000, path
