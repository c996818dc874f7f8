"""From documents to packed training sequences: language, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, for the documents that they keep. Stages decide for each row:
rows that share an identifier, or have none, get numbers of their own, so of repeated rows one stays, and of two texts
with one identifier each stays or goes by itself. Identifiers are whole numbers; rows without one come last.

Null and empty texts, and those without a letter, go in the first stage. Texts of any length are read whole. Of rows that
tie (equal texts and identifiers, or none) one stays, whichever. Other columns pass through unchanged whatever their
names, those that the operators use included. An empty table gives an empty result in every stage; an empty benchmark
drops nothing; with no labelled text to learn from, a letter is enough for the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotscan.llm import _store, decontaminate, exact_dedup, language, ngram_join, packing
from depotscan.llm.queries import table


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows (row, doc_id, text, doc) of docs with a number each, those of them whose number isn't their doc_id, or None).

    The latter are rows with a null or repeated doc_id; they are stored, so that their numbers stay."""
    slim = docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc"))
    again = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").select("doc_id")
    again = _store.store(again, "repeated-ids")
    n_again = again.count()
    if not n_again:
        return slim.withColumn("row", F.col("doc_id")), None
    keys = _store.small(again.withColumnRenamed("doc_id", "again"), n_again)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    top = docs.agg(F.max("doc_id")).first()[0]
    numbers = F.monotonically_increasing_id() + F.lit(0 if top is None else max(top + 1, 0))
    others = _store.store(slim.join(keys, same, "left_semi").withColumn("row", numbers), "numbered-rows")
    return slim.join(keys, same, "left_anti").withColumn("row", F.col("doc_id")).unionByName(others), others


def _later(groups: DataFrame, others: DataFrame | None, least: str) -> DataFrame:
    """The rows of groups (row, group) but the one with the smallest doc_id of each group; the column `least` names is its smallest row."""
    if others is None:
        return groups.where(F.col("row") != F.col(least)).select("row")
    known = others.select("row", F.col("doc_id").alias("given"), F.lit(True).alias("other"))
    value = F.when(F.col("other"), F.col("given")).otherwise(F.col("row"))
    placed = groups.join(_store.small(known, others.count()), "row", "left").select("row", "group", F.struct(value.isNull().alias("none"), value.alias("doc_id"), "row").alias("place"))
    placed = _store.store(placed, "group-places")
    first = _store.store(placed.groupBy("group").agg(F.min("place").alias("first"), F.count("*").alias("c")).where("c > 1").select("group", "first"), "group-firsts")
    return placed.join(first, "group").where(F.col("place") > F.col("first")).select("row")


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents of numbered rows that aren't among the dropped ones."""
    dropped = _store.store(dropped.select("row").distinct(), "dropped")
    return _store.semi(rows, dropped, ["row"], dropped.count(), "left_anti").select("doc.*")


#: A text of this many letters or more whose cosine with every language is below LEAST_COSINE is noise. Of labelled texts of
#: that length, a word repeated over and over included, none has less than 0.20; 20,000 random letters have up to 0.15.
ENOUGH_LETTERS, LEAST_COSINE = 100, 0.16


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language: no text, none with a letter, or one that is long enough to tell and like no language.

    Only texts go to Python, in batches of bounded size whoever writes the result; the rows to drop are stored."""
    with _store.bounded(spark):
        prototypes = language.learn(docs.where(~language.held_out("doc_id")))
    if not prototypes:  # nothing to learn from: a letter decides
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    rows, _ = _numbered(docs)
    many = F.length(F.regexp_replace("text", r"\P{L}+", "")) >= ENOUGH_LETTERS
    judged = language.identify(rows.select("row", "text"), prototypes)
    return _without(rows, judged.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_COSINE) & many))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, with the smallest doc_id."""
    rows, others = _numbered(docs)
    copies = exact_dedup.exact_dedup(rows, id_col="row", locator=F.lit("")).where("group_size > 1")
    return _without(rows, _later(copies.select("row", "keep_id", F.col("text_sha256").alias("group")), others, "keep_id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a 5-word shingle Jaccard of 0.8 or more one row stays, with the smallest doc_id."""
    rows, others = _numbered(docs)
    with _store.bounded(spark):
        found = ngram_join.ngram_join(rows, n=5, num=80, den=100, id_col="row")
    return _without(rows, _later(found.select("row", F.col("component_id").alias("group")), others, "group"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    rows, _ = _numbered(docs)
    return _without(rows, decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), least=1, id_col="row"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens. Workers that have been through four stages remember less, which changes no piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=24_000_000, together=1 << 19)


STAGES = [("language", known_language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", benchmark_leaks), ("packing", packed)]

#: SQL can't express the learned, similarity and tokenizer stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _store.store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
