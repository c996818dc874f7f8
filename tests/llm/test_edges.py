"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from depotscan.llm import decontaminate, exact_dedup, language, licenses, ngram_join, packing, pii, secrets, substring, tokens

WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")

WORDS = " ".join(f"word{i}" for i in range(30_000))
ROWS = [(1, "Hello  world again and again", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "fr"), (None, "Hello world again and again", "en"), (5, WORDS, "en"), (5, WORDS, "en"), (6, "12345 !!", None), (7, "un deux trois quatre", "fr"), (None, None, None), (8, "é ü 漢字 \x85 x\x1cy", "fr")]
CLASH = ("id", "digest", "text_sha256", "size", "row", "kept", "lang_pred", "score", "start", "token", "key", "component", "value", "length", "rank", "hash")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, None) for r in ROWS], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs)
    assert got.count() == len(ROWS) and exact_dedup.exact_dedup(empty).count() == 0
    rows = by_id(got)
    assert (rows[1].group_size, rows[1].kept, rows[2].keep_id, rows[2].group_size, rows[4].group_size) == (2, True, 2, 3, 1)
    assert rows[5].group_size == 2 and rows[5].kept


def test_language(docs, empty):
    got = language.language_id(docs)
    rows = by_id(got)
    assert got.count() == len(ROWS) and language.language_id(empty).count() == 0
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (2, 3, 4, 6)) and rows[1].lang_pred == "en"
    assert language.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_pii(docs, empty, spark):
    field = pii.learn(pii.example_table(spark, copies=4))
    got = pii.find_pii(docs, field)
    assert got.count() == len(ROWS) and got.where("base <> ''").count() == 0 and pii.find_pii(empty, field).count() == 0


def test_substring(docs, empty):
    got = substring.substring_dedup(docs)
    rows = by_id(got)
    assert got.count() == len(ROWS) and substring.substring_dedup(empty).count() == 0
    assert (rows[2].n_words, rows[3].kept, rows[4].kept, rows[1].kept) == (0, "", "", "Hello world again and again")
    assert (rows[5].n_words, rows[5].n_removed) == (30_000, 0)


def test_secrets(docs, empty, spark):
    model = secrets.learn(secrets.labelled_findings(spark, copies=4), WORDS_FILE, trees=5)
    assert secrets.scan(docs, *model, WORDS_FILE).count() == 0 and secrets.scan(empty, *model, WORDS_FILE).count() == 0


def test_licenses(docs, empty):
    files = docs.withColumn("path", F.when(F.col("doc_id") < 4, F.concat(F.lit("a/b/"), F.col("doc_id").cast("string"))))
    assert licenses.licence_scan(files).count() == len(ROWS) and licenses.licence_scan(files.where("false")).count() == 0


def test_decontaminate(docs, empty, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "word7 word8"), (4, " ".join(f"word{i}" for i in range(500, 520)))], "item_id long, text string")
    got = decontaminate.contaminated(docs, items)
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got.collect()) == [(5, 3, 0)] * 2 + [(5, 4, 0)] * 2
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(docs, items.where("false")).count() == 0


def test_tokens(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = tokens.token_counts(docs, path)
    rows = by_id(got)
    assert got.count() == len(ROWS) and tokens.token_counts(empty, path).count() == 0
    assert (rows[2].n_tokens, rows[2].n_bytes, rows[4].n_tokens, rows[5].over_limit) == (0, 0, 0, True)


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path).collect()
    assert packing.pack(empty, path).count() == 0
    assert sum(r.length for r in got if r.doc_id == 2) == 1 and sum(r.length for r in got if r.doc_id == 5) == 2 * next(r.doc_tokens for r in got if r.doc_id == 5)


def test_ngram_join(docs, empty):
    got = ngram_join.ngram_join(docs, 4, 85, 100)
    rows = by_id(got)
    assert got.count() == len(ROWS) and ngram_join.ngram_join(empty).count() == 0
    assert (rows[2].n_shingles, rows[2].component_id, rows[7].n_shingles, rows[5].n_copies) == (0, 2, 1, 2)
    assert {r.component_id for r in got.collect() if r.n_shingles == 2} == {1}
