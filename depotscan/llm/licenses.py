"""Licence scan, native: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file's header is its lines that speak of licences; a licence file (by its name) is read whole, whatever its words.
A header is scored whole and by passage: its lines and its runs of 8, 16 and 32 words, 4 words apart and shorter at its
end, that speak of licences. The best score wins, so words around a notice take nothing from it. Terms are words, and those pairs of
adjacent words that templates have; they are weighted by term frequency times inverse document frequency over all
headers of the corpus, counted for every term, and joined by term with the weights of the templates (notices,
identifiers and full texts), a table whose size the templates fix. Long texts in one language are alike by their common
words, and identifiers differ in one word, so full texts and identifiers need a larger score than notices. A file
without a licence of its own takes that of the closest directory above it with a licence file: directories, not files,
are joined with their ancestors' paths, so a directory of many files counts once.

No weight is below its term's frequency, so a passage's length has a lower bound from its own terms, and its cosine an
upper one. Only passages that the bound lets reach a limit have their terms joined with the corpus counts.

Nulls and edge cases: null texts have no header; files without a path are in no directory; of equal scores the
alphabetically first licence wins; of several licence files in a directory the best score wins, then the first
licence; repeated rows are scored once and returned each; an empty table gives an empty result; texts are read whole;
other columns are ignored.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store

#: Licence identifiers and their usual notices, some with several.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD-2-Clause style license"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-3-Clause style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law the author has dedicated this work to the public domain, CC0 1.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
#: Full texts by licence. The GNU Affero text is that of GPL-3.0 with its own name and section 13; Creative Commons has no text but CC0's here.
TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
_remote = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software.

"""
_named = TEXTS["GPL-3.0"].replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public")
TEXTS["AGPL-3.0"] = _named[: _named.index("13. Use with")] + _remote + _named[_named.index("14. Revised Versions") :]
#: What an SPDX identifier's line starts with; the line is a template of each licence.
SPDX = "SPDX-License-Identifier: "
TEMPLATES += [(x, SPDX + x) for x in sorted({licence for licence, _ in TEMPLATES} | TEXTS.keys())]
TEMPLATES += sorted(TEXTS.items())
#: Templates of more words are full texts.
NOTICE_WORDS = 64
MARK = r"(?i)licen[cs]e|spdx-|copying|public domain|permission is hereby granted"
LICENCE_FILE = r"(?i)^(un)?licen[cs]e|^copying|^notice"


def terms(text: Column) -> Column:
    """Hashes of lower-case words and numbers, even ones, and of pairs of adjacent ones, odd ones; each part is evaluated once per row, not per word."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.+(?=[^0-9]|$)"), lambda w: w != "")
    more = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), more), F.slice(words, F.lit(2), more), lambda a, b: F.xxhash64(a, b).bitwiseOR(F.lit(1)))
    return F.concat(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2))), pairs)


def passages(headers: DataFrame) -> DataFrame:
    """(key, part, passage) of headers (key, header): its lines and its runs of words that speak of licences, but those that are all of it."""
    speaking = headers.where(F.col("header").rlike(MARK))
    runs = speaking.select("key", F.regexp_extract_all("header", F.lit(r"(?:\S++\s*+){1,4}+"), F.lit(0)).alias("c4"))
    for n in (8, 16, 32):  # each size joins two of the one before; a column of its own, so that it is evaluated once
        half = F.col(f"c{n // 2}")
        runs = runs.withColumn(f"c{n}", F.zip_with(half, F.slice(half, n // 8 + 1, F.greatest(F.size(half) - n // 8, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    runs = runs.select("key", F.concat("c8", "c16", "c32").alias("some")).unionByName(speaking.select("key", F.split("header", "\n").alias("some")))
    parts = runs.select("key", F.explode(F.array_distinct(F.filter("some", lambda x: x.rlike(MARK)))).alias("passage"))
    return parts.select("key", digest(F.col("passage")).alias("part"), "passage").where("part <> key")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def classify(headers: DataFrame, templates: list[tuple[str, str]], spark: SparkSession, least: float, least_full: float) -> DataFrame:
    """(key, licence, score) of headers (key, header), each key once: the template with the largest cosine of a passage, if it reaches `least`, or `least_full` for full texts and identifiers."""
    rows = [(i, licence, text, len(text.split()) > NOTICE_WORDS or text.startswith(SPDX)) for i, (licence, text) in enumerate(templates)]
    known = spark.createDataFrame(rows, "notice int, licence string, text string, full boolean").select("notice", "licence", "full", F.explode(terms(F.col("text"))).alias("term"))
    known = known.groupBy("notice", "licence", "full", "term").agg(F.count("*").alias("n"))
    vocabulary = known.select("term", F.lit(True).alias("known")).distinct()  # the templates fix its size, so it may be broadcast

    def counted(texts: DataFrame, key: str, text: str) -> DataFrame:
        """(key, term, known, n); texts dealt by key need no further shuffle."""
        found = texts.select(key, F.explode(terms(F.col(text))).alias("term")).join(F.broadcast(vocabulary), "term", "left").where("term % 2 = 0 or known")
        return found.groupBy(key, "term", "known").agg(F.count("*").alias("n"))

    total = headers.count() + 1.0
    idf = lambda df: F.log(F.lit(total) / (1 + df)) + 1
    seen = headers.select(F.explode(F.array_distinct(terms(F.col("header")))).alias("term")).join(F.broadcast(vocabulary), "term", "left").where("term % 2 = 0 or known")
    seen = _store.store(seen.groupBy("term").agg(F.count("*").alias("df")), "licence-df")
    weight = F.col("n") * idf(F.coalesce("df", F.lit(1)))  # a term of no header is in a passage across lines

    met = vocabulary.join(seen, "term", "left").select("term", F.coalesce("df", F.lit(1)).alias("df"))
    b = known.join(F.broadcast(met), "term").select("notice", "licence", "full", "term", weight.alias("v"), idf(F.col("df")).alias("idf"))
    b = b.join(b.groupBy("notice").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size")), "notice").select("notice", "licence", "full", "term", "idf", (F.col("v") / F.col("size") * F.col("idf")).alias("v"))
    b = _store.store(b, "licence-templates")

    parts = _store.store(passages(headers), "licence-passages")
    texts = headers.select(F.col("key").alias("part"), F.col("header").alias("passage")).unionByName(parts.select("part", "passage"))
    texts = texts.groupBy("part").agg(F.first("passage").alias("passage"))
    limit = F.when(F.col("full"), F.lit(least_full)).otherwise(F.lit(least))
    # The hits of a passage are at most as many as the vocabulary has terms.
    own = counted(texts, "part", "passage").join(F.broadcast(b.select("term", "idf").distinct()), "term", "left")
    lengths = F.sqrt(F.sum(F.col("n") * F.col("n") * F.coalesce(F.col("idf") * F.col("idf"), F.lit(1.0))))
    hits = own.groupBy("part").agg(lengths.alias("at_least"), F.collect_list(F.when(F.col("known"), F.struct("term", "n"))).alias("hits")).where(F.size("hits") > 0)
    dots = hits.select("part", "at_least", F.explode("hits").alias("h")).select("part", "at_least", "h.term", "h.n").join(F.broadcast(b.drop("idf")), "term").groupBy("part", "at_least", "notice", "licence", "full").agg(F.sum(F.col("n") * F.col("v")).alias("dot"))
    dots = _store.store(dots.where(F.col("dot") / F.col("at_least") >= limit - 1e-5).drop("at_least"), "licence-dots")

    near = _store.store(dots.select("part").distinct(), "licence-near")
    rest = counted(_store.semi(texts, near, ["part"], near.count()), "part", "passage").join(seen, "term", "left")
    exact = rest.groupBy("part").agg(F.sqrt(F.sum(weight * weight)).alias("length"))
    scored = dots.join(exact, "part").withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("score") >= limit)
    best = F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best")
    scored = scored.groupBy("part").agg(best).select("part", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score"))
    keys = parts.select("key", "part").unionByName(headers.select("key", F.col("key").alias("part")))
    return keys.join(scored, "part").groupBy("key").agg(best).select("key", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score"))


def directory(path: Column) -> Column:
    """The part before the last slash; empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def licence_scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.35, least_full: float = 0.8, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, path, licence, score, inherited_from), one row per file. licence is the file's own where its score reaches
    `least` (`least_full` for a full text or an identifier), else that of the nearest directory, named by inherited_from; both are null where there is none."""
    spark = files.sparkSession
    name = F.regexp_extract("path", "[^/]*$", 0)
    slim = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    named = slim.where("text is not null").withColumn("is_file", F.coalesce(name.rlike(LICENCE_FILE), F.lit(False)))
    speaks = named.where(F.col("is_file") | F.col("text").rlike(MARK))
    header = F.when(F.col("is_file"), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x: x.rlike(MARK)), "\n"))
    headers = speaks.select("id", "path", "is_file", header.alias("header"))
    # Equal headers are one: a notice that a third of all files carry is weighed once.
    headers = _store.store(headers.withColumn("key", digest(F.col("header"))), "licence-headers")
    distinct = _store.store(headers.groupBy("key").agg(F.first("header").alias("header")), "licence-distinct")
    headers = headers.drop("header")
    own = classify(distinct, templates, spark, least, least_full)
    own = _store.store(headers.select("id", "path", "is_file", "key").join(own, "key").select("id", "path", "is_file", "licence", "score"), "licence-own")

    given = own.where("is_file").withColumn("above", directory(F.col("path")))
    given = given.groupBy("above").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best")).select("above", F.col("best.licence").alias("licence"))
    places = slim.where("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    chains = places.select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = chains.join(given, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "licence")).alias("best")).select("dir", F.col("best.above").alias("inherited_from"), F.col("best.licence").alias("from_above"))

    rows = slim.select("id", "path", directory(F.col("path")).alias("dir"))
    mine = own.groupBy("id", "path").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best")).select("id", "path", F.col("best.licence").alias("own"), (-F.col("best.s")).alias("score"))
    same = [rows["id"].eqNullSafe(mine["id"]), rows["path"].eqNullSafe(mine["path"])]
    joined = rows.join(mine, same, "left").select(rows["id"], rows["path"], "dir", "own", "score").join(nearest, "dir", "left")
    return joined.select(F.col("id").alias(id_col), F.col("path").alias(path_col), F.coalesce("own", "from_above").alias("licence"), "score", F.when(F.col("own").isNull(), F.col("inherited_from")).alias("inherited_from"))
