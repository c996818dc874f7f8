"""The registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, exact_dedup, language, licenses, ngram_join, packing, pii, resampling, secrets, simhash, substring, tokens

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), pii.learn(pii.example_table(spark)))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = public_tokenizers.path("word_bpe_49k.json")
    found = secrets.scan(table(spark, sf_dir, "documents"), *secrets.learn(secrets.labelled_findings(spark), words), words)
    return found.select("doc_id", "start", "stop", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: source is the repository, doc_id gives a directory of 200 files and one above it. Of the files, a
    fifth are licence files: the first one of a directory is its LICENSE, the others LICENSE-<doc_id>."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    place = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 10_000).cast("string"), F.floor(F.col("doc_id") / 200).cast("string"))
    number = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 200 == 0, F.lit("LICENSE")).when(F.floor(F.col("doc_id") / 20) % 5 == 0, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt")))
    return licenses.licence_scan(docs.withColumn("path", F.concat_ws("/", place, name)))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=1)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=2, buckets=10_000, percent=25, least_words=20, seed=7)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, covered=50, top=2000)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), n=3, distance=3)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_pii, op4_substring_dedup, op5_secret_scan, op6_license_scan, op7_decontamination, op8_token_counts, op9_packing, op10_ngram_join, op11_importance_resampling, op12_collocations, op13_simhash)}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
f AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM f),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
y AS (SELECT x.doc_id, count(*) AS n_words, count(r.k) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.k) FILTER (r.k IS NULL), '') AS kept
      FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.k = r.k GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y ON d.doc_id = y.doc_id""",
    "op10_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(b) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op11_importance_resampling": r"""
WITH w AS (SELECT 0 AS kind, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, doc_id FROM documents
UNION ALL SELECT 1, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), NULL FROM benchmark),
f AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w),
tbl AS (SELECT list(v ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
x AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM f)),
y AS (SELECT g, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM x, tbl),
c AS (SELECT kind, bucket, count(*) AS n FROM f JOIN y USING (g) GROUP BY ALL),
tot AS (SELECT coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM c),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(max(n) FILTER (kind = 1), 0) + 1)::DOUBLE * (max(s) + 10000)::DOUBLE / ((coalesce(max(n) FILTER (kind = 0), 0) + 1)::DOUBLE * (max(t) + 10000)::DOUBLE)))::BIGINT AS gain FROM c, tot GROUP BY bucket),
d AS (SELECT id, count(*) AS n_features, sum(gain) AS total FROM f JOIN y USING (g) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY id),
r AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(floor(total / n_features), 0)::BIGINT AS weight, ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM w LEFT JOIN d USING (id) WHERE kind = 0),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND row_number() OVER o <= 25 * count(*) FILTER (n_words >= 20) OVER () // 100 THEN row_number() OVER o END AS rank
FROM z WINDOW o AS (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST)""",
    "op12_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
total AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS x(k))),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
cut AS (SELECT lang, phrase, w, a, unnest(range(1, k)) AS j FROM f WHERE k > 1),
scored AS (SELECT c.lang, c.phrase, c.w, c.a, j, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score FROM cut c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS b FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM f WHERE k = 3) GROUP BY ALL),
best AS (SELECT low.lang, low.phrase, a, l, r, score::BIGINT AS score, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank FROM low
  LEFT JOIN longer ON longer.lang = low.lang AND longer.phrase = low.phrase WHERE b IS NULL OR 100 * b < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN total USING (lang) WHERE rank <= 2000""",
}
