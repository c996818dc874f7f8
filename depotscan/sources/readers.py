"""Sources and sinks: repository listings and indexes (XML), binary files, expected permissions, fact tables, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotscan.functions import scalar as S

from .schemas import WHITELIST

# Every field is text: an inferred schema would turn version 1.0 into a number.
PACKAGE = "_type string, name string, arch string, version struct<_epoch:string,_ver:string,_rel:string>, checksum struct<_VALUE:string,_type:string>, size struct<_package:string>, location struct<_href:string,`_xml:base`:string>, format struct<`rpm:sourcerpm`:string>"
ENTRY = "_type string, checksum struct<_VALUE:string,_type:string>, `open-checksum` struct<_VALUE:string,_type:string>, location struct<_href:string>, size string, `open-size` string"

# What may stand between elements, and the root's start and end.
_BETWEEN = r"(?:\s++|<\?(?s:.*?)\?>|<!--(?s:.*?)-->|<!DOCTYPE[^>]*+>)*+"
_ROOT = r"""<(?:\w++:)?metadata(?:\s(?:"[^"]*+"|'[^']*+'|[^>"'])*+)?+/?>"""
_END = r"</(?:\w++:)?metadata\s*+>"
#: What stands before a package of a listing, and all that may stand in its place.
LEAD = rf"\A\x{{FEFF}}?{_BETWEEN}(?:{_ROOT})?+{_BETWEEN}"
REST = rf"\A(?:<package[\s>]|(?:{_END}{_BETWEEN})?\z)"


def primary_fields(rows: DataFrame, base_url: str = "") -> DataFrame:
    """Listing columns of parsed <package> elements. size is null if it isn't a number."""
    location = F.coalesce(F.col("location._href"), F.lit(""))
    return rows.select(
        F.col("_type").alias("type"), "name", "arch", F.col("version._epoch").alias("epoch"), F.col("version._ver").alias("version"), F.col("version._rel").alias("release"), F.col("checksum._type").alias("checksum_type"),
        F.col("checksum._VALUE").alias("checksum"), S.parse_u64(F.col("size._package")).cast("long").alias("size"), F.col("location._href").alias("href"), S.location_url(F.col("location.`_xml:base`"), F.lit(base_url), location).alias("url"), F.col("format.`rpm:sourcerpm`").alias("source"),
    )


def repo_primary_scan(spark: SparkSession, paths: str | list[str], base_url: str = "") -> DataFrame:
    """Packages of repository listings, one row for each <package>. A file whose root is another element than <metadata> is
    an error when it is read (one whose root is <package> itself reads as that package).

    Files are read once, as text that ends at </package>, so Spark splits a large one into byte ranges. Between packages
    there are comments and white space, before the first one the root's start, after the last one its end; all else is an error."""
    text = spark.read.text(paths, lineSep="</package>").select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    rest = text.withColumn("text", F.regexp_replace("text", LEAD, ""))
    fault = F.raise_error(F.concat(F.lit("not a repository listing: "), F.col("path"))).cast("string")
    package = F.when(~F.col("text").rlike(REST), fault).when(F.startswith("text", F.lit("<package")), F.concat("text", F.lit("</package>")))
    rows = rest.select(package.alias("xml")).where("xml is not null").select(F.from_xml("xml", PACKAGE, {"rowTag": "package"}).alias("p")).select("p.*")
    return primary_fields(rows, base_url)


def repo_primary_validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows with a numeric epoch, bad rows with a reason): the first required field that is missing or wrong. A blank
    epoch reads as 0; a missing one stays null, which orders as 0; a negative one or one that isn't a 32-bit number is wrong."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    text = S.strip(F.col("epoch").cast("string"))
    epoch = F.when(text == "", 0).otherwise(text.try_cast("int"))
    bad_epoch = F.col("epoch").isNotNull() & (epoch.isNull() | (epoch < 0))
    reason = F.when(F.col("type") != "rpm", "type")
    for c in ("name", "arch", "version", "href", "checksum", "size"):
        reason = reason.when(blank(c), c)
    marked = df.withColumn("reason", reason.when(bad_epoch, "epoch"))
    return marked.where("reason is null").drop("reason").withColumn("epoch", epoch), marked.where("reason is not null")


def index_fields(rows: DataFrame) -> DataFrame:
    """Index columns of parsed <data> elements: an entry without its own open checksum isn't compressed and reuses the
    other; an open size without an open checksum is an error."""
    compressed = F.col("open-checksum._VALUE").isNotNull()
    return rows.select(
        F.col("_type").alias("type"), F.col("checksum._type").alias("checksum_type"), F.col("checksum._VALUE").alias("checksum"), F.coalesce("open-checksum._VALUE", "checksum._VALUE").alias("open_checksum"), F.col("size").try_cast("long").alias("size"),
        F.when(compressed, F.col("open-size").try_cast("long")).otherwise(F.col("size").try_cast("long")).alias("open_size"), compressed.alias("compressed"), F.col("location._href").alias("href"), (F.col("open-size").isNotNull() & ~compressed).alias("error"),
    )


def repo_index_scan(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(revision rows, entries) of repository indexes; one row of the scan is an index, a few KB."""
    rows = spark.read.format("xml").schema(f"revision string, data array<struct<{ENTRY}>>").option("rowTag", "repomd").load(paths)
    return rows.where("revision is not null").select("revision"), index_fields(rows.select(F.explode("data").alias("d")).select("d.*"))


def repo_primary_pick(entries: DataFrame, base_url: str = "", keys: tuple[str, ...] = (), order: Column | None = None) -> DataFrame:
    """The first compressed listing among entries, of each repository when keys name it, with its resolved URL; each task
    keeps one before the shuffle."""
    found = entries.where((F.col("type") == "primary") & F.endswith("href", F.lit(".xml.gz")))
    first = found.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in found.columns if c not in keys)), F.col("ordinal") if order is None else order).alias("r"))
    return first.where("r is not null").select(*keys, "r.*").select(found.columns).withColumn("url", S.url_combine(F.lit(base_url), F.col("href")))


def binary_fields(df: DataFrame, data: str = "content", preview: int = 64) -> DataFrame:
    return df.withColumns({"digest": F.sha2(F.col(data), 256), "preview": F.substring(F.col(data), 1, preview)})


def binary_scan(spark: SparkSession, path: str, preview: int = 64) -> DataFrame:
    """(path, length, digest, preview) of files below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return binary_fields(rows, preview=preview).select("path", "length", "digest", "preview")


def whitelist_scan(spark: SparkSession, path: str) -> DataFrame:
    """Expected permissions from tab-separated text."""
    return spark.read.csv(path, sep="\t", schema=WHITELIST)


def bulk_fact_sink(df: DataFrame, path: str, partition: str | None = "set_id") -> None:
    """Overwrite a fact table; with a partition column only the partitions that df has are replaced."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    writer.parquet(path)


def bucketed_fact_sink(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Replace a catalog table (at a path, else in the warehouse) by df, dealt to buckets by its key and sorted in each, and
    read it back. Joins, semi joins and aggregates on the key of tables with as many buckets need no exchange of them."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def csv_export(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)
