"""Expiry of what nothing refers to any more, with cascades, and the URL cache."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotscan import storage

Catalog = Mapping[str, DataFrame]
URL_CACHE = "url string, http_time long, data binary, last_change timestamp, last_access timestamp"

PACKAGE_TABLES = ("package_digest", "package_url", "package_dependency", "package_script", "package_trigger_script", "package_trigger_condition", "file", "symlink", "directory")
CONTENTS_TABLES = ("elf_file", "elf_program_header", "elf_definition", "elf_reference", "elf_needed", "elf_rpath", "elf_runpath", "elf_dynamic", "elf_error", "java_class_contents", "java_error", "java_maven_url", "python_import", "python_attribute", "python_function_def", "python_class_def", "python_error", "xml_error")
CLASS_TABLES = ("java_interface", "java_class_reference")


def _cascade(cat: Catalog, parent: str, key: str, keep: DataFrame, children: tuple[str, ...]) -> dict[str, DataFrame]:
    kept = cat[parent].join(keep.select(key).distinct(), key, "left_semi")
    return {**cat, parent: kept} | {t: cat[t].join(kept.select(key), key, "left_semi") for t in children if t in cat}


def expire_packages(cat: Catalog) -> dict[str, DataFrame]:
    """Without packages of no set and what belongs to them; closure rows of files that went go too."""
    new = _cascade(cat, "package", "package_id", cat["package_set_member"], PACKAGE_TABLES)
    if "elf_closure" in cat and "file" in new:
        ids = new["file"].select("file_id")
        new["elf_closure"] = cat["elf_closure"].join(ids, "file_id", "left_semi").join(ids.select(F.col("file_id").alias("needed")), "needed", "left_semi")
    return new


def expire_contents(cat: Catalog) -> dict[str, DataFrame]:
    """Without contents that no file has, and their facts."""
    return _cascade(cat, "file_contents", "contents_id", cat["file"], CONTENTS_TABLES)


def expire_classes(cat: Catalog) -> dict[str, DataFrame]:
    """Without classes that no content holds."""
    return _cascade(cat, "java_class", "class_id", cat["java_class_contents"], CLASS_TABLES)


def expire_urls(cache: DataFrame, as_of: Column, days: int = 3, last_access: str = "last_access") -> tuple[DataFrame, DataFrame]:
    """(kept, expired): last used more than `days` before the midnight that begins as_of's day."""
    old = F.col(last_access) < F.date_trunc("day", as_of) - F.make_interval(days=F.lit(days))
    return cache.where(~F.coalesce(old, F.lit(False))), cache.where(old)


def expire_all(cat: Catalog, as_of: Column, cached: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """URLs, packages, contents, classes, then cached archives that nothing refers to: (catalog, stale digests)."""
    from .sets import referenced_digests, stale_cache

    new = dict(cat)
    if "url_cache" in new:
        new["url_cache"] = expire_urls(new["url_cache"], as_of)[0]
    new = expire_packages(new)
    new = expire_contents(new) if "file_contents" in new else new
    new = expire_classes(new) if "java_class" in new else new
    return new, stale_cache(cached, referenced_digests(new["package_set_member"], new["package_digest"]))


def url_cache_lookup(cache: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, misses, touches). A request with length and http_time hits only if both agree; one without hits by url.
    touches (url, last_access) are the urls hit, once each: all that a lookup has to write, see UrlCache."""
    sized = cache.select("url", F.octet_length("data").cast("long").alias("_length"), F.col("http_time").alias("_time"))
    exact = F.col("length").isNull() | ((F.col("length") == F.col("_length")) & F.col("http_time").eqNullSafe(F.col("_time")))
    marked = requests.join(sized, "url", "left").withColumn("_hit", F.col("_length").isNotNull() & exact)
    hits, misses = (marked.where(c).select(requests.columns) for c in (F.col("_hit"), ~F.col("_hit")))
    return hits, misses, hits.select("url").distinct().withColumn("last_access", now)


def url_cache_upsert(cache: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """New rows (url, http_time, data) replace cached ones of the same url; of several for a url the latest http_time stays."""
    fresh = _fresh(new, now)
    return cache.select(fresh.columns).join(fresh.select("url"), "url", "left_anti").unionByName(fresh)


def _fresh(new: DataFrame, now: Column) -> DataFrame:
    """One row for each new url."""
    rest = F.struct("http_time", "data")
    return new.groupBy("url").agg(F.max_by(rest, rest).alias("r")).select("url", "r.*", now.alias("last_change"), now.alias("last_access"))


class UrlCache:
    """A URL cache as a log in a folder of the shared store: base=n, then rows=n and touches=n, merged on reading.

    A put writes the new rows, a lookup the urls it has hit; neither reads or rewrites the others' data. A row counts over
    all of its url before it, and takes the touches after it. compact merges all into a new base; the log it has taken in goes
    when the next base is complete, so a reader that began before it can end. There is one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, df: DataFrame, kind: str) -> None:
        """The next number is above all that are there; an incomplete table of a writer that was lost is never read and is written over."""
        last = max([n for k in ("base", "rows", "touches") for n in storage.parts(self.spark, self.path, k)], default=-1)
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}={last + 1}")

    def put(self, new: DataFrame, now: Column) -> None:
        self._write(_fresh(new, now), "rows")

    def lookup(self, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
        """(hits, misses); the hit urls are logged."""
        hits, misses, touches = url_cache_lookup(self.read(), requests, now)
        self._write(touches, "touches")
        return hits, misses

    def read(self) -> DataFrame:
        """(url, http_time, data, last_change, last_access) as it is now. Data of the base is joined with keys alone."""
        bases = storage.parts(self.spark, self.path, "base")[-1:]
        table = self.spark.read.schema(URL_CACHE).parquet(f"{self.path}/base={bases[0]}") if bases else self.spark.createDataFrame([], URL_CACHE)
        log = {k: [n for n in storage.parts(self.spark, self.path, k) if not bases or n > bases[0]] for k in ("rows", "touches")}
        table = table.withColumn("_n", F.lit(-1))
        if log["rows"]:
            each = [self.spark.read.schema(URL_CACHE).parquet(f"{self.path}/rows={n}").withColumn("_n", F.lit(n)) for n in log["rows"]]
            rows = reduce(DataFrame.unionByName, each)
            last = rows.groupBy("url").agg(F.max("_n").alias("_n"))
            table = table.join(last.select("url"), "url", "left_anti").unionByName(rows.join(last, ["url", "_n"], "left_semi").select(table.columns))
        if log["touches"]:
            each = [self.spark.read.schema("url string, last_access timestamp").parquet(f"{self.path}/touches={n}").withColumn("_t", F.lit(n)) for n in log["touches"]]
            # Of a url's touches the last one counts, if it came after the row; times never go back then.
            touched = reduce(DataFrame.unionByName, each).groupBy("url").agg(F.max_by("last_access", "_t").alias("_at"), F.max("_t").alias("_t"))
            table = table.join(touched, "url", "left").withColumn("last_access", F.when(F.col("_t") > F.col("_n"), F.col("_at")).otherwise(F.col("last_access")))
        return table.select("url", "http_time", "data", "last_change", "last_access")

    def compact(self) -> None:
        older = storage.parts(self.spark, self.path, "base")
        self._write(self.read(), "base")
        for kind in ("base", "rows", "touches"):
            for n in storage.parts(self.spark, self.path, kind):
                if older and n < older[-1]:
                    storage.remove(self.spark, f"{self.path}/{kind}={n}")
