"""Registered queries of the library's own operators over the given tables, with equivalent DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotscan import storage
from depotscan.functions import scalar as S
from depotscan.functions.versions import evr_less, version_key
from depotscan.operators import audit, closure, extract, ingest, load, quality, retention, sets
from depotscan.sources import readers, schemas
from depotscan.streaming import jobs

from .adapters import frame, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables and views below a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)


def query(key: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = with_views(sql)
        return f

    return add


def scalar(key: str, view: str, keys: list[str], sql: str, **columns: Callable[[], Column]) -> None:
    """A query that computes columns over a whole view; they are made when it runs, for columns need a session."""
    query(key, sql)(lambda t: getattr(t, view).select(*keys, *(c().alias(n) for n, c in columns.items())))


C, L = F.col, F.lit
NEVRA_SQL = "name || '-' || coalesce(CAST(epoch AS VARCHAR) || ':', '') || version || '-' || release || '.' || CASE WHEN kind = 'source' THEN 'src' ELSE arch END"
NVRA_SQL = "name || '-' || version || '-' || release || '.' || CASE WHEN kind = 'source' THEN 'src' ELSE arch END"


def utf8() -> Column:
    return F.encode(C("text"), "UTF-8")


# Scalar functions

scalar("arch_src", "a_package", ["package_id"], "SELECT package_id, CASE WHEN kind = 'source' THEN 'src' ELSE arch END AS r FROM a_package", r=lambda: S.arch_src(C("kind"), C("arch")))
scalar("nvra", "a_package", ["package_id"], f"SELECT package_id, {NVRA_SQL} AS r FROM a_package", r=lambda: S.nvra(*map(C, ("name", "version", "release", "kind", "arch"))))
scalar("nevra", "a_package", ["package_id"], f"SELECT package_id, {NEVRA_SQL} AS r FROM a_package", r=lambda: S.nevra(*map(C, ("name", "epoch", "version", "release", "kind", "arch"))))

_MODE = "CAST(p_partkey * 37 % 65536 AS INT)"
_bit = lambda e, b, ch: f"CASE WHEN ({e} & {b}) <> 0 THEN '{ch}' ELSE '-' END"
_two = lambda e, b, ch, b2, s: f"CASE WHEN ({e} & {b}) <> 0 AND ({e} & {b2}) <> 0 THEN '{s}' WHEN ({e} & {b2}) <> 0 THEN upper('{s}') WHEN ({e} & {b}) <> 0 THEN '{ch}' ELSE '-' END"


def mode_sql(e: str) -> str:
    return " || ".join([_bit(e, 256, "r"), _bit(e, 128, "w"), _two(e, 64, "x", 2048, "s"), _bit(e, 32, "r"), _bit(e, 16, "w"), _two(e, 8, "x", 1024, "s"), _bit(e, 4, "r"), _bit(e, 2, "w"), _two(e, 1, "x", 512, "t")])


def mode_full_sql(e: str) -> str:
    return f"CASE {e} >> 12 WHEN 4 THEN 'd' WHEN 8 THEN '-' WHEN 10 THEN 'l' ELSE '?' END || {mode_sql(e)}"


def flags_sql(e: str) -> str:
    return " || ".join(f"CASE WHEN ({e} & {b}) <> 0 THEN '{ch}' ELSE '' END" for ch, b in (("d", 2), ("c", 1), ("s", 32), ("m", 8), ("n", 16), ("g", 64), ("l", 128), ("r", 256)))


def op_sql(e: str) -> str:
    return " || ".join(f"CASE WHEN ({e} & {b}) <> 0 THEN '{ch}' ELSE '' END" for ch, b in (("<", 2), (">", 4), ("=", 8)))




def _mode() -> Column:
    return (C("p_partkey") * 37 % 65536).cast("int")


scalar("file_mode", "part", ["p_partkey"], f"SELECT p_partkey, {mode_sql(_MODE)} AS r FROM part", r=lambda: S.file_mode(_mode()))
scalar("file_mode_full", "part", ["p_partkey"], f"SELECT p_partkey, {mode_full_sql(_MODE)} AS r FROM part", r=lambda: S.file_mode_full(_mode()))
scalar("file_flags", "part", ["p_partkey"], f"SELECT p_partkey, {flags_sql(_MODE)} AS r FROM part", r=lambda: S.file_flags(_mode()))
scalar("version_comparison", "part", ["p_partkey"], f"SELECT p_partkey, {op_sql(_MODE)} AS r FROM part", r=lambda: S.version_comparison(_mode()))
scalar(
    "trigger_type", "part", ["p_partkey"],
    "SELECT p_partkey, CASE WHEN (f & 33554432) <> 0 THEN 'prein' WHEN (f & 65536) <> 0 THEN 'in' WHEN (f & 131072) <> 0 THEN 'un' WHEN (f & 262144) <> 0 THEN 'postun' END AS r FROM (SELECT p_partkey, CAST(p_partkey % 16 * 65536 + p_size % 2 * 33554432 AS INT) AS f FROM part)",
    r=lambda: S.trigger_type((C("p_partkey") % 16 * 65536 + C("p_size") % 2 * 33554432).cast("int")),
)
scalar("elf_visibility", "part", ["p_partkey"], "SELECT p_partkey, CASE p_size & 3 WHEN 0 THEN 'default' WHEN 1 THEN 'internal' WHEN 2 THEN 'hidden' ELSE 'protected' END AS r FROM part", r=lambda: S.elf_visibility(C("p_size")))
scalar("has_xsection", "part", ["p_partkey"], "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 65535 ELSE p_size END = 65535 AS r FROM part", r=lambda: S.has_xsection(F.when(C("p_size") % 3 == 0, 65535).otherwise(C("p_size"))))
_ARCH = {(3, 1): "i386", (2, 1): "sparc", (43, 2): "sparc64", (20, 1): "ppc", (21, 2): "ppc64", (22, 1): "s390", (22, 2): "s390x", (62, 2): "x86_64", (40, 1): "arm", (183, 2): "aarch64"}
scalar(
    "elf_arch", "part", ["p_partkey"], "SELECT p_partkey, CASE " + " ".join(f"WHEN m = {m} AND c = {c} THEN '{n}'" for (m, c), n in _ARCH.items()) + " END AS r FROM (SELECT p_partkey, p_partkey % 190 AS m, 1 + p_size % 2 AS c FROM part)",
    r=lambda: S.elf_arch(1 + C("p_size") % 2, C("p_partkey") % 190),
)
_BASE = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'http://h/' WHEN 2 THEN '/srv' ELSE 'http://h' END"
_REL = "CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END"


def _base() -> Column:
    return F.when(C("p_partkey") % 5 == 0, "").when(C("p_partkey") % 5 == 1, "http://h/").when(C("p_partkey") % 5 == 2, "/srv").otherwise("http://h")


def _rel() -> Column:
    return F.when(C("p_size") % 4 == 0, "").otherwise(C("p_brand"))


_COMBINE = "CASE WHEN b = '' THEN r WHEN r = '' THEN b WHEN b LIKE '%/' OR b LIKE '/%' THEN b || r ELSE b || '/' || r END"
scalar("url_combine", "part", ["p_partkey"], f"SELECT p_partkey, {_COMBINE} AS url FROM (SELECT p_partkey, {_BASE} AS b, {_REL} AS r FROM part)", url=lambda: S.url_combine(_base(), _rel()))
scalar("location_url", "part", ["p_partkey"], f"SELECT p_partkey, {_COMBINE} AS url FROM (SELECT p_partkey, coalesce(nullif({_BASE}, ''), 'http://repo') AS b, {_REL} AS r FROM part)", url=lambda: S.location_url(_base(), L("http://repo"), _rel()))
scalar(
    "digest", "documents", ["doc_id"], "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN md5(text) WHEN 3 THEN sha256(text) ELSE sha1(text) END AS r FROM documents",
    r=lambda: S.digest(F.element_at(F.array(*map(L, ("md5", "sha", "sha1", "sha256"))), (C("doc_id") % 4 + 1).cast("int")), utf8()),
)
scalar("hex_encode", "part", ["p_partkey"], "SELECT p_partkey, lower(hex(encode(p_name))) AS r FROM part", r=lambda: S.hex_encode(F.encode(C("p_name"), "UTF-8")))
scalar("hex_decode", "part", ["p_partkey"], "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name END AS r FROM part", r=lambda: F.decode(S.hex_decode(F.when(C("p_partkey") % 3 == 0, F.hex(F.encode(C("p_name"), "UTF-8"))).when(C("p_partkey") % 3 == 1, "abc").otherwise("zz")), "UTF-8"))
scalar(
    "is_valid_utf8", "documents", ["doc_id"], "SELECT doc_id, doc_id % 2 = 0 OR NOT regexp_matches(text, '[^\\x00-\\x7f]') AS r FROM documents",
    r=lambda: S.is_valid_utf8(F.when(C("doc_id") % 2 == 0, utf8()).otherwise(F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1"))),
)
scalar("latin1_to_utf8", "documents", ["doc_id"], "SELECT doc_id, sha256(regexp_replace(text, '[^\\x00-\\x{ff}]', '?', 'g')) AS r FROM documents", r=lambda: F.sha2(S.latin1_to_utf8(F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1")), 256))
scalar("strip", "part", ["p_partkey"], "SELECT p_partkey, p_name AS r FROM part", r=lambda: S.strip(F.concat(L("\t \n"), C("p_name"), L(" \r\n\x01"))))
scalar(
    "parse_u64", "part", ["p_partkey"],
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN '0' WHEN 3 THEN '18446744073709551615' END AS r FROM part",
    r=lambda: S.parse_u64(F.when(C("p_partkey") % 5 == 0, F.concat(L(" "), C("p_partkey").cast("string"), L("\n"))).when(C("p_partkey") % 5 == 1, "").when(C("p_partkey") % 5 == 2, "12x").when(C("p_partkey") % 5 == 3, "18446744073709551615").otherwise("18446744073709551616")).cast("string"),
)
scalar(
    "quote", "part", ["p_partkey"],
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || '\\\"\\\\\\n' || p_brand ELSE p_name || '\\xc3\\xa9\\x01' END AS r FROM part",
    r=lambda: S.quote(F.when(C("p_partkey") % 3 == 0, C("p_name")).when(C("p_partkey") % 3 == 1, F.concat(C("p_name"), L('"\\\n'), C("p_brand"))).otherwise(F.concat(C("p_name"), L("é\x01")))),
)
scalar("starts_with", "a_file", ["file_id"], "SELECT file_id, starts_with(name, '/etc/') AS r FROM a_file", r=lambda: S.starts_with(C("name"), L("/etc/")))
scalar("ends_with", "a_file", ["file_id"], "SELECT file_id, ends_with(name, '.conf') AS r FROM a_file", r=lambda: S.ends_with(C("name"), L(".conf")))
scalar("array_literal", "part", ["p_partkey"], """SELECT p_partkey, '{"' || p_name || '","a\\"b\\\\","' || p_brand || '"}' AS r FROM part""", r=lambda: S.array_literal(F.array(C("p_name"), L('a"b\\'), C("p_brand"))))
scalar("base_name", "a_file", ["file_id"], "SELECT file_id, regexp_extract(name, '[^/]*$') AS r FROM a_file", r=lambda: S.base_name(C("name")))
scalar(
    "same_directory", "a_object", ["file_id"], "SELECT file_id, name LIKE '/lib64/%' AS r FROM a_object",
    r=lambda: S.same_directory(C("name"), L("/lib64/x")),
)
scalar("epoch_to_timestamp", "orders", ["o_orderkey"], "SELECT o_orderkey, CAST(TIMESTAMP '1970-01-01' + to_seconds(o_orderkey * 86399) AS VARCHAR) AS r FROM orders", r=lambda: S.timestamp_text(S.epoch_to_timestamp(C("o_orderkey") * 86399)))
scalar("regex_match", "a_file", ["file_id"], "SELECT file_id, regexp_matches(name, '^/(etc|opt)/.*[0-9]$') AS r FROM a_file", r=lambda: S.regex_match(C("name"), "^/(etc|opt)/.*[0-9]$"))
scalar("enum_text", "part", ["p_partkey"], "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'require' WHEN 1 THEN 'provide' WHEN 2 THEN 'conflict' WHEN 3 THEN 'obsolete' END AS r FROM part", r=lambda: S.enum_text("dependency", C("p_size") % 5))

# Sources and sinks


_FILLED = ("package", "package_set", "package_set_member", "file", "elf_definition", "elf_reference")
_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {v}" for n, v in zip(_FILLED, ("a_package", "a_set", "a_set_member", "a_file", "a_definition", "a_reference"), strict=True))
_FIELDS = ", ".join(f"('{n}', {k})" for n, k in schemas.widths().items())


@query("table_catalog", f"SELECT f.table_name, n_columns, n_rows FROM (VALUES {_FIELDS}) f(table_name, n_columns) LEFT JOIN ({_COUNTS}) c ON c.table_name = f.table_name")
def _(t: Tables) -> DataFrame:
    """The contract's columns, beside how many rows the registered tables give to those that views fill."""
    filled = dict(zip(_FILLED, (t.a_package, t.a_set, t.a_set_member, t.a_file, t.a_definition, t.a_reference), strict=True))
    counts = [df.agg(F.count("*").alias("n_rows")).select(L(name).alias("table_name"), "n_rows") for name, df in filled.items()]
    rows = counts[0]
    for c in counts[1:]:
        rows = rows.unionByName(c)
    fields = t.spark.createDataFrame(list(schemas.widths().items()), "table_name string, n_columns int")
    return fields.join(rows, "table_name", "left")


def _listed(t: Tables) -> DataFrame:
    """(package_id, text) of a listing's elements."""
    attribute = lambda name, value: F.coalesce(F.concat(L(f' {name}="'), value, L('"')), L(""))
    id_ = C("package_id").cast("string")
    text = F.concat(
        L("<package"), attribute("type", F.when(C("package_id") % 50 == 7, "deb").otherwise("rpm")), L("><name>"), C("name"), L("</name><arch>"), C("arch"), L("</arch><version"), attribute("epoch", C("epoch").cast("string")), attribute("ver", C("version")), attribute("rel", C("release")),
        L('/><checksum type="sha256" pkgid="YES">'), F.sha2("name", 256), L("</checksum><size"), attribute("package", id_), L("/><location"), attribute("xml:base", F.when(C("package_id") % 2 == 0, "http://other/")), attribute("href", F.concat("name", L(".rpm"))), L("/><format><rpm:sourcerpm>"), C("name"), L("-1-1.src.rpm</rpm:sourcerpm></format></package>"),
    )
    return t.a_package.select("package_id", text.alias("text"))


@query("repo_primary_scan", """SELECT CASE WHEN package_id % 50 = 7 THEN 'deb' ELSE 'rpm' END AS type, name, arch, CAST(epoch AS VARCHAR) AS epoch, version, release, 'sha256' AS checksum_type, sha256(name) AS checksum, package_id AS size,
    name || '.rpm' AS href, CASE WHEN package_id % 2 = 0 THEN 'http://other/' ELSE 'http://repo/' END || name || '.rpm' AS url, name || '-1-1.src.rpm' AS source FROM a_package""")
def _(t: Tables) -> DataFrame:
    """Eight listings are written and scanned as files."""
    part, edge = C("package_id") % 8, t.spark.range(8)
    rows = _listed(t).select(part.alias("part"), C("package_id").alias("at"), "text")
    head, tail = (edge.select(C("id").alias("part"), L(at).cast("long").alias("at"), L(text).alias("text")) for at, text in ((-1, '<?xml version="1.0"?>\n<!-- <package> -->\n<metadata xmlns:rpm="r" packages="9">'), (1 << 60, "</metadata>")))
    path = storage.new_path(t.spark, "listings")
    rows.unionByName(head).unionByName(tail).repartition("part").sortWithinPartitions("part", "at").select("part", "text").write.partitionBy("part").text(path)
    return readers.repo_primary_scan(t.spark, f"{path}/*", "http://repo")


@query("repo_primary_validate", """SELECT package_id, CASE WHEN package_id % 50 = 7 THEN 'type' WHEN package_id % 10 = 1 THEN 'name' WHEN package_id % 10 = 2 THEN 'checksum' WHEN package_id % 10 = 3 THEN 'epoch' WHEN package_id % 10 = 4 THEN 'size' WHEN package_id % 10 = 5 THEN 'epoch' END AS reason FROM a_package""")
def _(t: Tables) -> DataFrame:
    k = C("package_id") % 10
    listing = t.a_package.select(
        "package_id", F.when(C("package_id") % 50 == 7, "deb").otherwise("rpm").alias("type"), F.when(k == 1, "").otherwise(C("name")).alias("name"), "arch", F.when(k == 3, "1x").when(k == 5, "-1").otherwise(C("epoch").cast("string")).alias("epoch"),
        "version", F.concat("name", L(".rpm")).alias("href"), F.when(k != 2, F.sha2("name", 256)).alias("checksum"), F.when(k != 4, C("package_id")).alias("size"),
    )
    good, bad = readers.repo_primary_validate(listing)
    return good.select("package_id", L(None).cast("string").alias("reason")).unionByName(bad.select("package_id", "reason"))


def _entries(t: Tables) -> DataFrame:
    """(p_partkey, p_brand, x): an index entry as XML text."""
    k = C("p_partkey") % 3
    entry = F.struct(
        F.when(C("p_size") % 2 == 0, "primary").otherwise("filelists").alias("_type"), F.struct(F.md5(C("p_name")).alias("_VALUE"), L("md5").alias("_type")).alias("checksum"), F.when(k == 0, F.struct(F.md5(C("p_brand")).alias("_VALUE"), L("md5").alias("_type"))).alias("open-checksum"),
        F.struct(F.concat(L("repodata/"), C("p_partkey").cast("string"), F.when(C("p_size") % 4 == 0, ".xml.gz").otherwise(".xml")).alias("_href")).alias("location"), C("p_size").cast("string").alias("size"), F.when(k < 2, (C("p_size") * 3).cast("string")).alias("open-size"),
    )
    return t.part.select("p_partkey", "p_brand", F.to_xml(entry, {"rowTag": "data"}).alias("x"))


@query("repo_index_scan", """SELECT CASE WHEN p_size % 2 = 0 THEN 'primary' ELSE 'filelists' END AS type, 'md5' AS checksum_type, md5(p_name) AS checksum, CASE WHEN p_partkey % 3 = 0 THEN md5(p_brand) ELSE md5(p_name) END AS open_checksum, CAST(p_size AS BIGINT) AS size,
    CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size * 3 AS BIGINT) ELSE CAST(p_size AS BIGINT) END AS open_size, p_partkey % 3 = 0 AS compressed, 'repodata/' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_size % 4 = 0 THEN '.xml.gz' ELSE '.xml' END AS href, p_partkey % 3 = 1 AS error FROM part""")
def _(t: Tables) -> DataFrame:
    """Indexes of 500 entries are written and scanned, each a file."""
    some = _entries(t).groupBy(F.floor(C("p_partkey") / 500).alias("part")).agg(F.collect_list("x").alias("x"))
    path = storage.new_path(t.spark, "indexes")
    some.select("part", F.concat(L("<repomd><revision>7</revision>"), F.array_join("x", ""), L("</repomd>"))).write.partitionBy("part").text(path)
    return readers.repo_index_scan(t.spark, f"{path}/*")[1]


@query("repo_primary_pick", """SELECT p_brand AS repo, 'http://repo/repodata/' || CAST(min(p_partkey) AS VARCHAR) || '.xml.gz' AS url FROM part WHERE p_size % 4 = 0 GROUP BY p_brand""")
def _(t: Tables) -> DataFrame:
    entries = _entries(t).select("p_partkey", "p_brand", F.from_xml("x", readers.ENTRY, {"rowTag": "data"}).alias("e")).select(C("p_brand").alias("repo"), C("p_partkey").alias("ordinal"), C("e._type").alias("type"), C("e.location._href").alias("href"))
    return readers.repo_primary_pick(entries, "http://repo", ("repo",)).select("repo", "url")


@query("binary_scan", "SELECT doc_id, sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS length, lower(hex(encode(text)[1:64])) AS preview FROM documents")
def _(t: Tables) -> DataFrame:
    rows = readers.binary_fields(t.documents.select("doc_id", utf8().alias("content")))
    return rows.select("doc_id", "digest", F.octet_length("content").cast("long").alias("length"), S.hex_encode(C("preview")).alias("preview"))


@query("whitelist_scan", f"SELECT {mode_full_sql('mode')} AS permissions, user_name, group_name, name AS path FROM a_file JOIN a_attribute USING (attribute_id)")
def _(t: Tables) -> DataFrame:
    path = storage.new_path(t.spark, "whitelist")
    rows = t.a_file.join(t.a_attribute, "attribute_id").select(S.file_mode_full(C("mode")), "user_name", "group_name", "name")
    rows.write.csv(path, sep="\t")
    return readers.whitelist_scan(t.spark, path)


@query("bulk_fact_sink", "SELECT set_id, count(*) AS n FROM a_set_member GROUP BY set_id")
def _(t: Tables) -> DataFrame:
    path = storage.new_path(t.spark, "facts")
    readers.bulk_fact_sink(t.a_old_member, path)
    readers.bulk_fact_sink(t.a_set_member, path)
    return t.spark.read.parquet(path).groupBy(C("set_id").cast("long").alias("set_id")).agg(F.count("*").alias("n"))


@query("bucketed_fact_sink", f"SELECT contents_id, count(*) AS n FROM a_reference WHERE contents_id IN (SELECT contents_id FROM a_program WHERE package_id IN (SELECT package_id FROM a_set_member)) GROUP BY contents_id")
def _(t: Tables) -> DataFrame:
    """The cascade of expiry on tables bucketed by their content: facts of the programs that sets keep."""
    sink = lambda df, what: readers.bucketed_fact_sink(df, f"{what}_{uuid.uuid4().hex}", "contents_id", 8, storage.new_path(t.spark, what))
    facts, files = sink(t.a_reference, "reference"), sink(t.a_program.join(t.a_set_member.select("package_id").distinct(), "package_id", "left_semi"), "program")
    return facts.join(files, "contents_id", "left_semi").groupBy("contents_id").agg(F.count("*").alias("n"))


@query("csv_export", "SELECT package_id, name, version FROM a_package")
def _(t: Tables) -> DataFrame:
    path = storage.new_path(t.spark, "csv")
    readers.csv_export(t.a_package.select("package_id", "name", "version"), path)
    return t.spark.read.csv(path, schema="package_id long, name string, version string")


# Ingest


def _digested(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", F.sha2("text", 256).alias("digest"), utf8().alias("data"))


@query("intern_contents", "SELECT sha256(text) AS digest, count(*) AS copies, NOT bool_or(doc_id IN (SELECT doc_id FROM labels)) AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS added FROM documents GROUP BY text")
def _(t: Tables) -> DataFrame:
    existing = _digested(t).join(t.labels, "doc_id", "left_semi").select("digest").distinct()
    return ingest.intern_contents(_digested(t), existing).mapping.select("digest", "copies", "added")


_KEEP = "(" + " OR ".join([f"starts_with(name, '{p}')" for p in ingest.KEEP_PREFIXES] + [f"ends_with(name, '{s}')" for s in ingest.KEEP_SUFFIXES]) + ")"


@query("contents_preview", f"SELECT contents_id, sha256(CASE WHEN {_KEEP} THEN encode(text) ELSE encode(text)[1:64] END) AS preview FROM a_document JOIN a_file USING (contents_id)")
def _(t: Tables) -> DataFrame:
    return ingest.contents_preview(t.a_file, t.a_document.withColumn("contents", utf8())).select("contents_id", F.sha2("preview", 256).alias("preview"))


@query("preview_upgrade", "SELECT doc_id AS contents_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text ELSE left(text, 64) END) AS preview FROM documents")
def _(t: Tables) -> DataFrame:
    old = t.documents.select(C("doc_id").alias("contents_id"), F.left("text", L(64)).alias("preview"))
    return ingest.preview_upgrade(old, t.documents.where("doc_id % 3 = 0").select(C("doc_id").alias("contents_id"), C("text").alias("preview"))).select("contents_id", F.sha2("preview", 256).alias("preview"))


@query("intern_attributes", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    dim, files = ingest.intern_attributes(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return files.groupBy("attribute_id").agg(F.count("*").alias("n")).join(dim, "attribute_id").select("l_returnflag", "l_linestatus", "l_linenumber", "n")


@query("intern_packages", "WITH f AS (SELECT md5(name || arch) AS hash, min(ordinal) AS first FROM a_package GROUP BY 1) SELECT ordinal, first, ordinal = first AND arch <> 'PROMO' AS added FROM a_package JOIN f ON hash = md5(name || arch)")
def _(t: Tables) -> DataFrame:
    rows = t.a_package.withColumn("hash", F.md5(F.concat("name", "arch")))
    return ingest.intern_packages(rows, rows.where("arch = 'PROMO'").select("hash")).mapping


@query("package_digests", "SELECT doc_id AS package_id, unnest([sha256(text), sha1(text)]) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM documents")
def _(t: Tables) -> DataFrame:
    return ingest.package_digests(t.documents.select(C("doc_id").alias("package_id"), utf8().alias("data")))


@query("package_by_digest", "WITH d AS (SELECT sha256(text) AS digest, min(doc_id) AS package_id FROM documents WHERE lang = 'en' GROUP BY 1) SELECT doc_id, package_id FROM documents LEFT JOIN d ON sha256(text) = digest")
def _(t: Tables) -> DataFrame:
    known = t.documents.where("lang = 'en'").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("package_id"))
    found = ingest.package_by_digest(_digested(t).select("doc_id", "digest"), known)
    return found.good.select("doc_id", "package_id").unionByName(found.bad.select("doc_id", L(None).cast("long").alias("package_id")))


@query("add_urls", "SELECT DISTINCT page_id % 50 AS package_id, url, NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 3 = 0 AND q.url = pages.url AND q.page_id % 50 = pages.page_id % 50) AS added FROM pages")
def _(t: Tables) -> DataFrame:
    rows = t.pages.select((C("page_id") % 50).alias("package_id"), "url")
    return ingest.add_urls(t.pages.where("page_id % 3 = 0").select((C("page_id") % 50).alias("package_id"), "url").distinct(), rows).mapping


@query("verify_checksums", "SELECT doc_id, md5(text) AS actual FROM documents WHERE doc_id % 10 = 3 OR doc_id % 10 = 5")
def _(t: Tables) -> DataFrame:
    k = C("doc_id") % 10
    rows = t.documents.select("doc_id", utf8().alias("data"), L("md5").alias("kind"), F.upper(F.md5(F.when(k == 3, F.concat("text", L("x"))).otherwise(C("text")))).alias("expected"), (F.octet_length("text") + F.when(k == 5, 1).otherwise(0)).alias("length"))
    return ingest.verify_checksums(rows, "data", "kind", "expected", "length").select("doc_id", "actual")


@query("normalize_text", "SELECT doc_id, doc_id % 2 = 1 AND regexp_matches(text, '[^\\x00-\\x7f]') AS normalized, sha256(regexp_replace(text, '[^\\x00-\\x{ff}]', '?', 'g')) AS text FROM documents")
def _(t: Tables) -> DataFrame:
    plain = F.regexp_replace("text", r"[^\x00-\xff]", "?")
    rows = t.documents.select("doc_id", F.when(C("doc_id") % 2 == 1, F.encode(plain, "ISO-8859-1")).otherwise(F.encode(plain, "UTF-8")).alias("text"))
    return ingest.normalize_text(rows, "text").withColumn("text", F.sha2("text", 256))


_LINKED = "SELECT l_orderkey AS package_id, l_linenumber % 2 AS inode, CASE WHEN l_linenumber = 5 THEN l_returnflag ELSE 'd' END AS digest, 33188 AS mode, CASE WHEN l_linenumber = 6 THEN 64 ELSE 0 END AS flags, CAST(l_quantity AS BIGINT) AS length, CASE WHEN l_linenumber = 7 THEN 1 ELSE 2 END AS nlinks"


def _linked(t: Tables) -> DataFrame:
    n = C("l_linenumber")
    return t.lineitem.select(C("l_orderkey").alias("package_id"), (n % 2).alias("inode"), F.when(n == 5, C("l_returnflag")).otherwise("d").alias("digest"), L(33188).alias("mode"), F.when(n == 6, 64).otherwise(0).alias("flags"), C("l_quantity").cast("long").alias("length"), F.when(n == 7, 1).otherwise(2).alias("nlinks"))


@query("hardlink_groups", f"SELECT package_id, inode, count(*) AS names, count(DISTINCT digest) = 1 AS agree FROM ({_LINKED} FROM lineitem) WHERE flags = 0 AND nlinks > 1 AND length > 0 GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    groups, errors = ingest.hardlink_groups(_linked(t))
    pick = lambda df, agree: df.select("package_id", "inode", "names", L(agree).alias("agree"))
    return pick(groups, True).unionByName(pick(errors, False))


@query("ghost_normalize", f"SELECT inode, length, digest, count(*) AS n FROM (SELECT CASE WHEN flags = 64 THEN 0 ELSE inode END AS inode, CASE WHEN flags = 64 THEN 0 ELSE length END AS length, CASE WHEN flags = 64 THEN '{ingest.EMPTY_SHA256}' ELSE digest END AS digest FROM ({_LINKED} FROM lineitem)) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return ingest.ghost_normalize(_linked(t)).groupBy("inode", "length", "digest").agg(F.count("*").alias("n"))


@query("entry_router", "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'file' WHEN p_size % 16 = 8 THEN 'file' WHEN p_size % 16 = 4 THEN 'directory' WHEN p_size % 16 = 10 AND p_partkey % 3 <> 0 THEN 'symlink' ELSE 'error' END AS route FROM part")
def _(t: Tables) -> DataFrame:
    routed = ingest.entry_router(t.part.select("p_partkey", (C("p_size") % 16 * 4096 + 420).alias("mode"), F.when(C("p_partkey") % 11 == 0, 2).otherwise(1).alias("nlinks"), F.when(C("p_partkey") % 3 != 0, C("p_name")).otherwise("").alias("target")))
    rows = [df.select("p_partkey", L(n).alias("route")) for df, n in zip(routed, ("file", "directory", "symlink", "error"), strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("dependency_rows", """WITH l AS (SELECT l_orderkey AS package_id, CASE WHEN l_returnflag = 'A' THEN 'provide' ELSE 'require' END AS kind, l_linenumber AS flags, l_linestatus AS capability, CAST(l_partkey AS VARCHAR) AS version, l_returnflag, CASE WHEN l_returnflag = 'A' THEN l_orderkey % 5 ELSE l_orderkey % 7 END = 0 AS odd FROM lineitem)
    SELECT package_id, kind, flags, capability, version, true AS good FROM l WHERE l_returnflag <> 'R' AND NOT odd UNION ALL SELECT DISTINCT l_orderkey, 'provide', NULL, NULL, NULL, false FROM lineitem WHERE l_orderkey % 5 = 0
    UNION ALL SELECT DISTINCT l_orderkey, 'require', NULL, NULL, NULL, false FROM lineitem WHERE l_orderkey % 7 = 0""")
def _(t: Tables) -> DataFrame:
    lists = lambda flag: [F.collect_list(F.when(C("l_returnflag") == flag, F.struct(C("l_linenumber").alias("f"), C("l_linestatus").alias("n"), C("l_partkey").cast("string").alias("v")))).alias(flag)]
    heads = t.lineitem.groupBy(C("l_orderkey").alias("package_id")).agg(*lists("N"), *lists("A"))
    none = L(None).cast("array<string>")
    cols = {"require_flags": C("N.f"), "require_name": C("N.n"), "require_version": C("N.v"), "provide_flags": C("A.f"), "provide_name": C("A.n"), "provide_version": C("A.v")}
    cols |= {f"{k}_{c}": (none.cast("array<int>") if c == "flags" else none) for k in ("conflict", "obsolete") for c in ("flags", "name", "version")}
    rows, errors = ingest.dependency_rows(heads.withColumns(cols).withColumn("provide_name", F.when(C("package_id") % 5 == 0, F.array_append("provide_name", L("x"))).otherwise(C("provide_name"))).withColumn("require_version", F.when(C("package_id") % 7 != 0, C("require_version"))))
    return rows.withColumn("good", L(True)).unionByName(errors.withColumn("good", L(False)), allowMissingColumns=True)


_KINDS = ", ".join(f"'{k}'" for k in ingest.SCRIPT_KINDS)


@query("script_rows", f"SELECT conv_id AS package_id, list_value({_KINDS})[turn % {len(ingest.SCRIPT_KINDS)} + 1] AS kind, min(sha256(text)) AS script FROM conversations GROUP BY conv_id, turn % {len(ingest.SCRIPT_KINDS)}")
def _(t: Tables) -> DataFrame:
    one = lambda n: F.min(F.when(C("turn") % len(ingest.SCRIPT_KINDS) == n, F.sha2("text", 256)))
    heads = t.conversations.groupBy(C("conv_id").alias("package_id")).agg(*(one(n).alias(f"{k}_script") for n, k in enumerate(ingest.SCRIPT_KINDS)))
    blank = {f"{k}_{c}": L(None).cast("string" if c == "script" else "array<string>") for k in ingest.SCRIPT_KINDS for c in ("script", "prog") if f"{k}_{c}" not in heads.columns}
    return ingest.script_rows(heads.withColumns(blank)).select("package_id", "kind", "script")


@query("trigger_rows", "WITH h AS (SELECT conv_id AS package_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, role FROM conversations) SELECT package_id, role AS name, CAST(turn * 2 AS INT) AS script_idx, turn * 2 < n AS good FROM h")
def _(t: Tables) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.sha2("text", 256).alias("s"))))
    heads = t.conversations.groupBy(C("conv_id").alias("package_id")).agg(turns.alias("t"))
    heads = heads.select("package_id", C("t.s").alias("scripts"), C("t.role").alias("progs"), F.transform("t.turn", lambda x: (x * 2).cast("int")).alias("indexes"), F.transform("t.turn", lambda x: L(0)).alias("flags"), C("t.role").alias("names"), C("t.role").alias("versions"))
    found = ingest.trigger_rows(heads)
    pick = lambda df, good: df.select("package_id", "name", "script_idx", L(good).alias("good"))
    return pick(found.conditions, True).unionByName(pick(found.errors, False))


# Fact extraction


@query("classify_contents", """SELECT page_id AS contents_id, CASE page_id % 5 WHEN 0 THEN 'elf' WHEN 1 THEN 'xml' WHEN 2 THEN 'python' WHEN 3 THEN 'java' END AS kind, page_id % 5 = 4 AS is_zip FROM pages""")
def _(t: Tables) -> DataFrame:
    k = C("page_id") % 5
    head = lambda h: F.unhex(L(h))
    body = F.encode("html", "UTF-8")
    data = F.when(k == 0, F.concat(head("7F454C46"), body)).when(k == 1, body).when(k == 2, F.concat(F.encode(L("#! /usr/bin/python\n"), "UTF-8"), body)).when(k == 3, F.concat(head("CAFEBABE00000032"), body)).otherwise(F.concat(head("504B0304"), body))
    return extract.classify_contents(t.pages.select(C("page_id").alias("contents_id"), data.alias("contents")), t.pages.select(C("page_id").alias("contents_id"), C("url").alias("name")))


def _pom(name: Column, key: Column) -> Column:
    n = F.concat(name, key.cast("string"))
    return F.concat(L('<project xmlns="http://maven.apache.org/POM/4.0.0"><url> http://home/'), n, L("\n</url><scm><connection>scm:"), n, L("</connection><url>http://scm/"), n, L("</url></scm><distributionManagement><repository><url>http://dist/"), n, L("</url></repository><site><url>http://site/"), n, L("</url></site></distributionManagement><repositories><repository><url>http://repo/"), n, L("</url><url> </url></repository></repositories></project>"))


@query("pom_urls", """WITH n AS (SELECT s_suppkey AS doc_id, s_name || CAST(s_suppkey AS VARCHAR) AS n FROM supplier WHERE s_suppkey % 10 <> 3)
    SELECT doc_id, 'http://home/' || n AS url, 'other' AS type FROM n UNION ALL SELECT doc_id, 'scm:' || n, 'connection' FROM n UNION ALL SELECT doc_id, 'http://scm/' || n, 'scm' FROM n UNION ALL SELECT doc_id, 'http://dist/' || n, 'distributionManagement' FROM n
    UNION ALL SELECT doc_id, 'http://site/' || n, 'site' FROM n UNION ALL SELECT doc_id, 'http://repo/' || n, 'repository' FROM n""")
def _(t: Tables) -> DataFrame:
    text = _pom(C("s_name"), C("s_suppkey"))
    return extract.pom_urls(t.supplier.select(C("s_suppkey").alias("doc_id"), F.when(C("s_suppkey") % 10 == 3, F.concat(text, L("<"))).otherwise(text).alias("xml"))).select("doc_id", "url", "type")


@query("xml_errors", "SELECT s_suppkey AS doc_id, 'entity declaration' AS message, 2 AS line, NULL AS context FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'mismatched tag', 3, right('<project>' || chr(10) || '<a>' || chr(10) || s_name || '</', 50) || '|b></project>' FROM supplier WHERE s_suppkey % 3 = 1")
def _(t: Tables) -> DataFrame:
    k = C("s_suppkey") % 3
    text = F.when(k == 0, F.concat(L("<!DOCTYPE p [\n<!ENTITY a 'b'>]>\n<project>"), C("s_name"), L("</project>"))).when(k == 1, F.concat(L("<project>\n<a>\n"), C("s_name"), L("</b></project>"))).otherwise(_pom(C("s_name"), C("s_suppkey")))
    return extract.xml_errors(t.supplier.select(C("s_suppkey").alias("doc_id"), text.alias("xml")))[1].select("doc_id", "message", "line", F.when(C("line") == 3, F.concat(C("before").cast("string"), L("|"), C("after").cast("string"))).alias("context"))


def _python(t: Tables) -> DataFrame:
    word = F.regexp_replace("p_name", " ", "_")
    good = F.concat(L("import os, "), word, L(".sub as x\nfrom ..up import "), word, L("\nclass K"), C("p_partkey").cast("string"), L(":\n    def f(self):\n        return self.v.w\n"))
    return t.part.select(C("p_partkey").alias("contents_id"), F.when(C("p_partkey") % 10 == 1, "\n\0").when(C("p_partkey") % 10 == 2, "\n=").otherwise(good).alias("contents"))


@query("python_symbols", """WITH n AS (SELECT p_partkey AS contents_id, replace(p_name, ' ', '_') AS w FROM part WHERE p_partkey % 10 NOT IN (1, 2))
    SELECT contents_id, 'import' AS kind, unnest(['os', w || '.sub', '..up.' || w]) AS name, unnest([0, 1, 2]) AS pos FROM n UNION ALL SELECT contents_id, 'attribute', unnest(['v', 'w']), unnest([0, 1]) FROM n UNION ALL SELECT contents_id, 'function', 'f', 0 FROM n UNION ALL SELECT contents_id, 'class', 'K' || CAST(contents_id AS VARCHAR), 0 FROM n""")
def _(t: Tables) -> DataFrame:
    return extract.python_symbols(_python(t))


@query("python_errors", "SELECT p_partkey AS contents_id, 2 AS line FROM part WHERE p_partkey % 10 IN (1, 2)")
def _(t: Tables) -> DataFrame:
    return extract.python_errors(_python(t)).select("contents_id", "line")


@query("python_pending", "SELECT DISTINCT contents_id FROM a_file WHERE name LIKE '%.py' AND contents_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables) -> DataFrame:
    done = t.labels.select(C("doc_id").alias("contents_id"))
    return extract.python_pending(t.a_file, [done.where("contents_id % 2 = 0"), done.where("contents_id % 2 = 1")])


@query("elf_facts_flatten", """SELECT 'definition' AS fact, l_orderkey AS contents_id, l_linestatus AS name, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL UNION ALL SELECT 'reference', l_orderkey, l_linestatus, count(*) FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL
    UNION ALL SELECT CASE l_linenumber WHEN 2 THEN 'rpath' WHEN 4 THEN 'runpath' ELSE 'needed' END, l_orderkey, l_linestatus, count(*) FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL UNION ALL SELECT 'dynamic', l_orderkey, CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem WHERE l_linenumber % 2 = 1 AND l_linenumber <> 1 GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    n = C("l_linenumber")
    symbol = F.struct(F.when(C("l_returnflag") == "N", "").otherwise(C("l_linestatus")).alias("name"), L(None).cast("string").alias("version"), (C("l_returnflag") == "R").alias("defined"), n.alias("section"), n.alias("other"))
    entry = F.struct(F.when(n == 2, "rpath").when(n == 4, "runpath").when(n % 2 == 0, "needed").otherwise("other").alias("kind"), C("l_linestatus").alias("text"), F.when(n == 1, 0).otherwise(n).cast("long").alias("tag"), L(0).cast("long").alias("value"))
    found = extract.elf_facts_flatten(t.lineitem.groupBy(C("l_orderkey").alias("contents_id")).agg(F.collect_list(symbol).alias("symbols"), F.collect_list(entry).alias("dynamic")))
    parts = [df.select(L(k).alias("fact"), "contents_id", C(c).cast("string").alias("name")) for k, df, c in (("definition", found.definitions, "name"), ("reference", found.references, "name"), ("needed", found.needed, "name"), ("rpath", found.rpath, "path"), ("runpath", found.runpath, "path"), ("dynamic", found.dynamic, "tag"))]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("fact", "contents_id", "name").agg(F.count("*").alias("n"))


@query("soname_pick", "WITH f AS (SELECT l_orderkey AS contents_id, min_by(l_returnflag, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT)) AS soname FROM lineitem GROUP BY 1) SELECT contents_id, soname, (SELECT count(*) FROM lineitem WHERE l_orderkey = contents_id AND l_returnflag <> soname) AS others FROM f")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(C("l_orderkey").alias("contents_id"), C("l_returnflag").alias("soname"), (C("l_linenumber") * L(1000000000000) + C("l_partkey") * 1000000 + C("l_suppkey") * 100 + C("l_quantity").cast("long")).alias("pos"))
    first, errors = extract.soname_pick(rows)
    return first.join(errors.groupBy("contents_id").agg(F.count("*").alias("others")), "contents_id", "left").fillna(0, ["others"])


@query("java_class_facts", "WITH c AS (SELECT DISTINCT l_orderkey AS contents_id, l_partkey AS k FROM lineitem) SELECT 'reference' AS fact, CAST(k AS VARCHAR) AS digest, unnest(['a/I' || CAST(k % 7 AS VARCHAR), 'z/R']) AS name FROM (SELECT DISTINCT k FROM c WHERE k % 5 <> 0) UNION ALL SELECT DISTINCT 'interface', CAST(k AS VARCHAR), 'i' FROM c WHERE k % 5 <> 0 UNION ALL SELECT DISTINCT 'class', CAST(k AS VARCHAR), 'me' || CAST(k AS VARCHAR) FROM c WHERE k % 5 <> 0")
def _(t: Tables) -> DataFrame:
    k = C("l_partkey").cast("string")
    refs = F.array(L("z/R"), L("java/lang/Object"), F.concat(L("a/I"), (C("l_partkey") % 7).cast("string")), L("z/R"), F.concat(L("me"), k))
    classes = t.lineitem.select(C("l_orderkey").alias("contents_id"), k.alias("digest"), F.concat(L("me"), k).alias("name"), L("java/lang/Object").alias("super_class"), L(49).alias("access_flags"), F.array(L("i")).alias("interfaces"), refs.alias("references"))
    existing = t.part.where("p_partkey % 5 = 0").select(C("p_partkey").cast("string").alias("digest"))
    found = extract.java_class_facts(classes, existing)
    tag = lambda df, fact: df.select(L(fact).alias("fact"), "digest", "name")
    return tag(found.references, "reference").unionByName(tag(found.interfaces, "interface")).unionByName(tag(found.classes, "class"))


@query("archive_members", "WITH m AS (SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'header' WHEN turn % 2 = 1 THEN 'bad' ELSE 'ok' END AS status FROM conversations) SELECT conv_id AS contents_id, turn AS path, status FROM m WHERE turn <= 3")
def _(t: Tables) -> DataFrame:
    status = F.when(C("turn") == 3, "header").when(C("turn") % 2 == 1, "bad").otherwise("ok")
    rows = t.conversations.groupBy(C("conv_id").alias("contents_id")).agg(F.sort_array(F.collect_list(F.struct(C("turn").alias("path"), status.alias("status")))).alias("members"))
    members, errors = extract.archive_members(rows)
    return members.select("contents_id", "path", L("ok").alias("status")).unionByName(errors.select("contents_id", "path", "status"))


# Package sets

_LATEST = "SELECT * FROM a_package QUALIFY row_number() OVER (PARTITION BY arch, name ORDER BY coalesce(epoch, 0) DESC, v1 DESC, v2 DESC, r1 DESC, r2 DESC, ordinal) = 1"
query("latest_per_name_arch", f"SELECT name, arch, package_id FROM ({_LATEST})")(lambda t: sets.latest_per_name_arch(t.a_package).select("name", "arch", "package_id"))


@query("version_key", "SELECT a.package_id, (a.v1, a.v2) < (b.v1, b.v2) AS less, (a.v1, a.v2) = (b.v1, b.v2) AS same FROM a_package a JOIN a_package b ON b.package_id = a.package_id + 1")
def _(t: Tables) -> DataFrame:
    keyed = t.a_package.select("package_id", version_key(C("version")).alias("k"))
    after = keyed.select((C("package_id") - 1).alias("package_id"), C("k").alias("k2"))
    return keyed.join(after, "package_id").select("package_id", (C("k") < C("k2")).alias("less"), (C("k") == C("k2")).alias("same"))


@query("evr_compare", "SELECT a.package_id, (coalesce(a.epoch, 0), a.v1, a.v2, a.r1, a.r2) < (coalesce(b.epoch, 0), b.v1, b.v2, b.r1, b.r2) AS less FROM a_package a JOIN a_package b ON b.package_id = a.package_id + 1")
def _(t: Tables) -> DataFrame:
    b = t.a_package.select((C("package_id") - 1).alias("package_id"), C("epoch").alias("e2"), C("version").alias("v2_"), C("release").alias("r2_"))
    return t.a_package.join(b, "package_id").select("package_id", evr_less(C("epoch"), C("version"), C("release"), C("e2"), C("v2_"), C("r2_")).alias("less"))


@query("exclude_names", "SELECT 'kept' AS kind, package_id AS n FROM a_package WHERE NOT regexp_full_match(name, '(red.*)|(.*ring)') UNION ALL SELECT 'excluded', count(*) FROM a_package WHERE regexp_full_match(name, '(red.*)|(.*ring)')")
def _(t: Tables) -> DataFrame:
    kept, n = sets.exclude_names(t.a_package, ["red.*", ".*ring"])
    return kept.select(L("kept").alias("kind"), C("package_id").alias("n")).unionByName(n.select(L("excluded").alias("kind"), C("n_excluded").alias("n")))


@query("set_lookup", "SELECT set_id, count(*) AS n FROM a_set_member WHERE set_id = (SELECT set_id FROM a_set WHERE name = 'ASIA') GROUP BY set_id")
def _(t: Tables) -> DataFrame:
    return t.a_set_member.join(F.broadcast(sets.set_lookup(t.a_set, "ASIA")), "set_id").groupBy("set_id").agg(F.count("*").alias("n"))


@query("set_diff", "SELECT set_id, package_id, CASE WHEN o.package_id IS NULL THEN 'added' WHEN m.package_id IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM a_old_member o FULL JOIN a_set_member m USING (set_id, package_id) UNION ALL SELECT NULL, NULL, CASE WHEN EXISTS (SELECT * FROM a_old_member EXCEPT SELECT * FROM a_set_member) OR EXISTS (SELECT * FROM a_set_member EXCEPT SELECT * FROM a_old_member) THEN 'changed' ELSE 'same' END")
def _(t: Tables) -> DataFrame:
    found, changed = sets.set_diff(t.a_old_member, t.a_set_member, ["set_id", "package_id"])
    none = L(None).cast("long")
    return found.unionByName(changed.select(none.alias("set_id"), none.alias("package_id"), F.when(C("changed"), "changed").otherwise("same").alias("status")))


@query("set_apply", "SELECT set_id, package_id FROM a_old_member WHERE set_id <> 2 UNION ALL SELECT set_id, package_id FROM a_set_member WHERE set_id = 2")
def _(t: Tables) -> DataFrame:
    return sets.set_apply(t.a_old_member, 2, t.a_set_member.where("set_id = 2"))


@query("set_from_repos", f"SELECT package_id, package_id % 9 <> 0 AS member FROM ({_LATEST}) WHERE NOT regexp_full_match(name, 'red.*')")
def _(t: Tables) -> DataFrame:
    done = sets.set_from_repos(t.a_package.withColumn("fetched", C("package_id") % 9 != 0), ["red.*"], ignore_errors=True)
    return done.members.select("package_id", L(True).alias("member")).unionByName(done.failed.select("package_id", L(False).alias("member")))


@query("referenced_digests", "SELECT md5(name) AS digest FROM a_set_member JOIN a_package USING (package_id)")
def _(t: Tables) -> DataFrame:
    return sets.referenced_digests(t.a_set_member, t.a_package.select("package_id", F.md5("name").alias("digest")))


@query("stale_cache", "SELECT sha256(text) AS digest FROM documents EXCEPT ALL SELECT sha256(text) FROM documents JOIN labels USING (doc_id)")
def _(t: Tables) -> DataFrame:
    return sets.stale_cache(_digested(t), _digested(t).join(t.labels, "doc_id", "left_semi"))


@query("source_packages", "SELECT DISTINCT p_name AS name, FALSE AS malformed FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT DISTINCT p_brand, TRUE FROM part WHERE p_partkey % 7 = 0")
def _(t: Tables) -> DataFrame:
    source = F.when(C("p_partkey") % 7 == 0, C("p_brand")).otherwise(F.concat("p_name", L("-1.0-2.fc18.src.rpm")))
    names, malformed = sets.source_packages(t.part.select(source.alias("source")))
    return names.select("name", L(False).alias("malformed")).unionByName(malformed.select(C("source").alias("name"), L(True).alias("malformed")))


# Closure


def _all_members(t: Tables) -> DataFrame:
    return t.part.select(C("p_partkey").alias("package_id"))


@query("soname_providers", "SELECT arch, soname, file_id, path, package FROM a_provider")
def _(t: Tables) -> DataFrame:
    o = t.a_object
    return closure.soname_providers(_all_members(t), t.a_package, o.select("package_id", "file_id", "contents_id", "name"), o.select("contents_id", "e_type", "arch", "soname"))


@query("suppress_conflicts", "WITH m AS (SELECT *, starts_with(path, '/opt/') OR package = 'red widget' AS ig FROM a_provider), w AS (SELECT *, count(*) OVER (PARTITION BY arch, soname) AS n, count(*) FILTER (ig) OVER (PARTITION BY arch, soname) AS i FROM m) SELECT arch, soname, file_id, path, package FROM w WHERE NOT (ig AND i > 0 AND i + 1 = n)")
def _(t: Tables) -> DataFrame:
    return closure.suppress_conflicts(t.a_provider, ["/opt/"], ["red widget"])


_PRIORITY = "CASE WHEN regexp_matches({c}, '^(/lib/|/lib64/|/usr/lib/|/usr/lib64/)') THEN 100000 ELSE 0 END + CASE WHEN regexp_extract({c}, '^(.*)/[^/]*$', 1) = regexp_extract({n}, '^(.*)/[^/]*$', 1) THEN 10000 ELSE 0 END + 2 * len([i for i in range(1, 1 + least(length({c}), length({n}))) if {c}[1:i] = {n}[1:i]]) - length({c})"


@query("provider_priority", "SELECT file_id, " + _PRIORITY.format(c="path", n="'/opt/Brand#1/app'") + " AS score FROM a_provider")
def _(t: Tables) -> DataFrame:
    return t.a_provider.select("file_id", closure.provider_priority(C("path"), L("/opt/Brand#1/app")).alias("score"))


_RESOLVED = f"SELECT file, needed_name, file_id AS provider, row_number() OVER (PARTITION BY file, needed_name ORDER BY score DESC, package, path, file_id) AS rank, path, package FROM (SELECT n.file, needed_name, p.file_id, p.path, package, {_PRIORITY.format(c='p.path', n='n.path')} AS score FROM a_needed n JOIN a_provider p ON p.arch = n.arch AND p.soname = needed_name)"


def _one_arch_needed(t: Tables) -> DataFrame:
    return t.a_needed.groupBy("file", "needed_name").agg(F.min(F.struct("arch", "path")).alias("m")).select("file", "needed_name", "m.arch", "m.path")


_ONE = "a_one AS (SELECT file, needed_name, min((arch, path)) AS m FROM a_needed GROUP BY ALL), b_needed AS (SELECT file, needed_name, m[1] AS arch, m[2] AS path FROM a_one)"
_RESOLVED_SQL = f"WITH {_ONE}, x AS ({_RESOLVED.replace('a_needed', 'b_needed')}) "
query("resolve_needed", _RESOLVED_SQL + "SELECT file, needed_name, provider, rank FROM x WHERE rank = 1")(lambda t: closure.resolve_needed(_one_arch_needed(t), t.a_provider, best_only=True).select("file", "needed_name", "provider", C("rank").cast("long").alias("rank")))
query("missing_needed", "SELECT file, arch, needed_name FROM a_needed n WHERE arch IN (SELECT arch FROM a_provider WHERE file_id % 3 = 1) AND NOT EXISTS (SELECT 1 FROM a_provider p WHERE p.arch = n.arch AND soname = needed_name AND file_id % 3 = 1)")(lambda t: closure.missing_needed(t.a_needed, t.a_provider.where("file_id % 3 = 1")))
query("soname_conflicts", _RESOLVED_SQL + "SELECT file, needed_name, string_agg(package || ':' || path, ',' ORDER BY rank) AS choices FROM x GROUP BY ALL HAVING count(*) > 1")(lambda t: closure.soname_conflicts(_one_arch_needed(t), t.a_provider, ","))
_CLOSE = "c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)"
query("transitive_closure", f"WITH RECURSIVE e AS (SELECT src, dst FROM a_edges_dag UNION SELECT -1 - src, -1 - dst FROM a_edges_cyclic), {_CLOSE} SELECT src, dst FROM c")(
    lambda t: closure.transitive_closure(t.a_edges_dag.unionByName(t.a_edges_cyclic.select((-1 - C("src")).alias("src"), (-1 - C("dst")).alias("dst"))))
)


@query("closure_diff_merge", "SELECT src, dst, CASE WHEN src % 3 = 0 AND src % 2 <> 0 THEN 'deleted' WHEN src % 3 <> 0 AND src % 2 = 0 THEN 'inserted' ELSE 'kept' END AS status FROM a_edges_dag WHERE src % 3 = 0 OR src % 2 = 0")
def _(t: Tables) -> DataFrame:
    m = closure.closure_diff_merge(t.a_edges_dag.where("src % 3 = 0"), t.a_edges_dag.where("src % 2 = 0"))
    tag = lambda df, s: df.select("src", "dst", L(s).alias("status"))
    return tag(m.deleted, "deleted").unionByName(tag(m.inserted, "inserted")).unionByName(tag(m.table.join(m.inserted, ["src", "dst"], "left_anti"), "kept"))


_NEW_EDGES = "SELECT src, dst FROM a_edges_cyclic WHERE src % 11 <> 3 OR dst % 2 = 0 UNION SELECT p_partkey, p_partkey + 31 FROM part WHERE p_partkey % 37 = 5"


@query("closure_maintain", f"""WITH RECURSIVE o AS (SELECT src, dst FROM a_edges_cyclic UNION SELECT c.src, e.dst FROM o c JOIN a_edges_cyclic e ON c.dst = e.src), e AS ({_NEW_EDGES}), {_CLOSE}
    SELECT src, dst, CASE WHEN o.src IS NULL THEN 'inserted' ELSE 'kept' END AS status FROM c LEFT JOIN o USING (src, dst) UNION ALL SELECT src, dst, 'deleted' FROM o WHERE (src, dst) NOT IN (SELECT (src, dst) FROM c)""")
def _(t: Tables) -> DataFrame:
    """A closure kept up to date: an eleventh of the edges loses some, and parts get an edge to another block."""
    old, stays = t.a_edges_cyclic, "src % 11 <> 3 or dst % 2 = 0"
    new = t.part.where("p_partkey % 37 = 5").select(C("p_partkey").alias("src"), (C("p_partkey") + 31).alias("dst"))
    closed = storage.store(closure.transitive_closure(old), "closure")
    done = closure.maintain_closure(closed, old, old.where(f"not ({stays})"), new)
    tag = lambda df, s: df.select("src", "dst", L(s).alias("status"))
    kept = done.table.join(closed, ["src", "dst"], "left_semi")
    return tag(kept, "kept").unionByName(tag(done.deleted, "deleted")).unionByName(tag(done.inserted, "inserted"))


@query("closure_refresh", f"WITH RECURSIVE {_ONE}, x AS ({_RESOLVED.replace('a_needed', 'b_needed')}), e AS (SELECT DISTINCT file AS src, provider AS dst FROM x WHERE rank = 1), {_CLOSE} SELECT src, dst FROM c")
def _(t: Tables) -> DataFrame:
    return closure.closure_refresh(sets.set_diff(t.a_old_member, t.a_set_member, ["set_id", "package_id"])[1], _one_arch_needed(t), t.a_provider)


_NAMED = "/usr/share/maven/"


@query("load_packages", """WITH n AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') AS w FROM part), good AS (SELECT s_suppkey AS k, s_name || CAST(s_suppkey AS VARCHAR) AS n FROM supplier WHERE s_suppkey % 10 <> 3)
    SELECT 'kind' AS fact, '/usr/lib/py/' || CAST(k AS VARCHAR) || '.py' AS name, 'python' AS value FROM n UNION ALL SELECT 'kind', '/usr/share/maven/' || CAST(s_suppkey AS VARCHAR) || '.pom', 'xml' FROM supplier UNION ALL SELECT 'kind', '/srv/' || CAST(doc_id AS VARCHAR), 'none' FROM documents
    UNION ALL SELECT 'import', '/usr/lib/py/' || CAST(k AS VARCHAR) || '.py', unnest(['os', w || '.sub', '..up.' || w]) FROM n WHERE k % 10 NOT IN (1, 2) UNION ALL SELECT 'error', '/usr/lib/py/' || CAST(k AS VARCHAR) || '.py', '2' FROM n WHERE k % 10 IN (1, 2)
    UNION ALL SELECT 'url', '/usr/share/maven/' || CAST(k AS VARCHAR) || '.pom', unnest(['http://home/' || n, 'scm:' || n, 'http://scm/' || n, 'http://dist/' || n, 'http://site/' || n, 'http://repo/' || n]) FROM good UNION ALL SELECT 'error', '/usr/share/maven/' || CAST(s_suppkey AS VARCHAR) || '.pom', '2' FROM supplier WHERE s_suppkey % 10 = 3
    UNION ALL SELECT 'digest', '/srv/' || CAST(doc_id AS VARCHAR), sha256(text) FROM documents UNION ALL SELECT DISTINCT 'directory', '/srv/' || source, NULL FROM documents UNION ALL SELECT DISTINCT 'symlink', '/srv/' || source || '.l', source FROM documents
    UNION ALL SELECT 'attributes', CAST(doc_id % 7 AS VARCHAR), CAST(count(*) AS VARCHAR) FROM documents GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    """Entries of packages into files, contents and facts: sources of parts, POMs of suppliers, documents of mixed attributes, and of each source a directory and a link."""
    def entry(df: DataFrame, name: Column, data: Column, mode: int = 0o100644, target: Column | None = None, flags: Column | None = None) -> DataFrame:
        same = {"package_id": L(1).cast("long"), "mode": L(mode), "nlinks": L(1), "target": (L(None) if target is None else target).cast("string"), "flags": L(0) if flags is None else flags, "inode": L(5), "mtime": L(9).cast("long"), "user_name": L("root"), "group_name": L("root"), "caps": L("")}
        return df.select(name.alias("name"), data.cast("binary").alias("data"), *(v.alias(k) for k, v in same.items()))

    poms = _pom(C("s_name"), C("s_suppkey"))
    poms = F.when(C("s_suppkey") % 10 == 3, F.concat(poms, L("<"))).otherwise(poms)
    named = lambda before, key, after="": F.concat(L(before), C(key).cast("string"), L(after))
    sources, none = t.documents.select("source").distinct(), L(None)
    entries = entry(_python(t), named("/usr/lib/py/", "contents_id", ".py"), C("contents")).unionByName(entry(t.supplier, named(_NAMED, "s_suppkey", ".pom"), poms)).unionByName(entry(t.documents, named("/srv/", "doc_id"), C("text"), flags=(C("doc_id") % 7 * 2).cast("int")))
    entries = entries.unionByName(entry(sources, named("/srv/", "source"), none, 0o040755)).unionByName(entry(sources, named("/srv/", "source", ".l"), none, 0o120777, C("source")))
    known = t.documents.where("doc_id % 5 = 0").select(F.sha2("text", 256).alias("digest")).distinct()
    # Of contents that were known a load adds no facts; here they have none.
    known = ingest.intern_contents(known, known.limit(0)).table
    done = load.load_packages(entries, known)
    files = done.files.select("contents_id", "name", "attribute_id", "digest")
    at = lambda df, fact, value: files.join(df, "contents_id").select(L(fact).alias("fact"), "name", value.cast("string").alias("value"))
    found = files.join(done.kinds, "contents_id", "left").select(L("kind").alias("fact"), "name", F.coalesce("kind", L("none")).alias("value"))
    found = found.unionByName(at(done.python.select("contents_id", F.explode("import").alias("v")), "import", C("v"))).unionByName(at(done.python.where("message is not null"), "error", C("line")))
    found = found.unionByName(at(done.xml.select("contents_id", F.explode("urls.url").alias("v")), "url", C("v"))).unionByName(at(done.xml.where("message is not null"), "error", C("line")))
    docs = files.where(F.startswith("name", L("/srv/")))
    found = found.unionByName(docs.select(L("digest").alias("fact"), "name", C("digest").alias("value"))).unionByName(done.directories.select(L("directory").alias("fact"), "name", L(None).cast("string").alias("value"))).unionByName(done.symlinks.select(L("symlink").alias("fact"), "name", C("target").alias("value")))
    counts = docs.groupBy("attribute_id").agg(F.count("*").alias("n")).join(done.attributes, "attribute_id").select(L("attributes").alias("fact"), (C("flags") / 2).cast("int").cast("string").alias("name"), C("n").cast("string").alias("value"))
    return found.unionByName(counts)


@query("refresh_set", f"""WITH RECURSIVE listed AS (SELECT * FROM ({_LATEST}) WHERE NOT regexp_full_match(name, 'red.*')), w AS (SELECT package_id FROM listed WHERE package_id % 9 <> 0),
    v AS (SELECT coalesce(o.arch, '') AS arch, coalesce(nullif(soname, ''), p_name) AS soname, file_id, o.name AS path, p_name AS package FROM a_object o JOIN part ON file_id = p_partkey WHERE e_type = 3 AND package_id IN (SELECT package_id FROM w)),
    n AS (SELECT * FROM a_object_needed WHERE file IN (SELECT package_id FROM w)),
    x AS ({_RESOLVED.replace("a_needed", "n").replace("a_provider", "v")}), e AS (SELECT DISTINCT file AS src, provider AS dst FROM x WHERE rank = 1), {_CLOSE}
    SELECT 'member' AS kind, set_id AS a, package_id AS b FROM a_old_member WHERE set_id <> 2 UNION ALL SELECT 'member', 2, package_id FROM w UNION ALL SELECT 'load', package_id, NULL FROM listed WHERE package_id % 9 = 0
    UNION ALL SELECT 'added', 2, package_id FROM w WHERE package_id NOT IN (SELECT package_id FROM a_old_member WHERE set_id = 2) UNION ALL SELECT 'removed', 2, package_id FROM a_old_member WHERE set_id = 2 AND package_id NOT IN (SELECT package_id FROM w)
    UNION ALL SELECT 'closure', src, dst FROM c""")
def _(t: Tables) -> DataFrame:
    digest = F.sha2(C("package_id").cast("string"), 256).alias("digest")
    listings = t.a_package.withColumn("digest", digest).withColumnRenamed("package_id", "listed_as")
    o = t.a_object
    done = load.refresh_set(
        listings, t.a_package.where("package_id % 9 <> 0").select("package_id", digest), t.a_old_member, 2, t.a_package, o.select("package_id", "file_id", "contents_id", "name"), o.select("contents_id", "e_type", "arch", "soname"), t.a_object_needed, ["red.*"], ignore_errors=True
    )
    tag = lambda df, kind, a, b: df.select(kind.alias("kind"), a.alias("a"), b.alias("b"))
    changed = done.changes.where("status <> 'unchanged'")
    found = tag(done.members, L("member"), C("set_id"), C("package_id")).unionByName(tag(done.to_load, L("load"), C("listed_as"), L(None).cast("long")))
    return found.unionByName(tag(changed, C("status"), L(2).cast("long"), C("package_id"))).unionByName(tag(done.closure, L("closure"), C("src"), C("dst")))


# Audit


def catalog(t: Tables) -> dict[str, DataFrame]:
    """Programs: orders as files, with references and a closure along each customer's orders."""
    return {"package": t.a_package, "package_set": t.a_set, "package_set_member": t.a_set_member, "file": t.a_program, "file_attribute": t.a_program_attribute, "elf_reference": t.a_reference, "elf_definition": t.a_definition, "elf_program_header": t.a_segment, "elf_file": t.a_program.select("contents_id")}


def libraries(t: Tables) -> dict[str, DataFrame]:
    return catalog(t) | {"file": t.a_library, "elf_file": t.a_library_elf, "elf_definition": t.a_library_definition}


def documents(t: Tables) -> dict[str, DataFrame]:
    return catalog(t) | {"file": t.a_file, "file_attribute": t.a_attribute, "file_contents": t.a_document.select("contents_id", utf8().alias("contents"), F.octet_length("text").cast("long").alias("length"), F.sha2("text", 256).alias("digest"))}


ASIA = "p.package_id IN (SELECT package_id FROM a_set_member WHERE set_id = (SELECT set_id FROM a_set WHERE name = 'ASIA'))"
_PROG = f"SELECT p.name AS package, {NEVRA_SQL.replace('name', 'p.name', 1)} AS nevra, f.name AS file, f.file_id, f.contents_id, f.attribute_id FROM a_package p JOIN a_program f ON f.package_id = p.package_id WHERE {ASIA}"
_DOCS = _PROG.replace("a_program", "a_file")
query("calls_any", f"SELECT DISTINCT package FROM ({_PROG}) WHERE contents_id IN (SELECT contents_id FROM a_reference WHERE name IN ('red widget', 'small ring'))")(lambda t: audit.calls_any(catalog(t), "ASIA", ["red widget", "small ring"]))
query("calls_matching", f"SELECT DISTINCT package, file, r.name FROM ({_PROG}) JOIN a_reference r USING (contents_id) WHERE regexp_matches(r.name, '^(red|small) .*[gt]$')")(lambda t: audit.calls_matching(catalog(t), "ASIA", "^(red|small) .*[gt]$"))
query("calls_without", f"SELECT package, file FROM ({_PROG}) WHERE contents_id IN (SELECT contents_id FROM a_reference WHERE name = 'red widget') AND contents_id NOT IN (SELECT contents_id FROM a_reference WHERE name IN ('small ring', 'large bolt'))")(lambda t: audit.calls_without(catalog(t), "ASIA", "red widget", ["small ring", "large bolt"]))


def _with_needs(t: Tables) -> dict[str, DataFrame]:
    return catalog(t) | {"elf_dependency": t.a_edges_dag.select(C("src").alias("file_id"), C("dst").alias("needed"))}


_REACH = f"WITH RECURSIVE e AS (SELECT src, dst FROM a_edges_dag), {_CLOSE} SELECT DISTINCT nevra, b.file AS program, l.name AS library FROM ({_PROG}) b JOIN c ON c.src = b.file_id JOIN a_program l ON l.file_id = c.dst JOIN a_reference r ON r.contents_id = l.contents_id WHERE r.name = 'red widget' AND "
query("privileged_reach", _REACH + "b.attribute_id IN (SELECT attribute_id FROM a_program_attribute WHERE (mode & 3072) <> 0)")(lambda t: audit.privileged_reach(_with_needs(t), "ASIA", "red widget"))
query("plugin_reach_list", _REACH + "b.contents_id IN (SELECT contents_id FROM a_definition WHERE name IN ('small ring', 'large bolt'))")(lambda t: audit.plugin_reach_list(_with_needs(t), "ASIA", ["small ring", "large bolt"], "red widget"))
query("plugin_reach_regex", _REACH + "b.contents_id IN (SELECT contents_id FROM a_definition WHERE regexp_matches(name, '^small'))")(lambda t: audit.plugin_reach_regex(_with_needs(t), "ASIA", "^small", "red widget"))
query("symbol_collisions", f"""WITH l AS (SELECT {NEVRA_SQL.replace('name', 'p.name', 1)} AS nevra, f.name AS file, f.contents_id, f.package_id, e.arch AS a, soname FROM a_package p JOIN a_library f ON f.package_id = p.package_id JOIN a_library_elf e USING (contents_id) WHERE {ASIA} AND regexp_matches(f.name, '^/usr/lib(|64)/[^/]*.so[^/]*$')),
    d AS (SELECT DISTINCT contents_id, name FROM a_library_definition)
    SELECT d1.name, l1.nevra AS nevra_1, l1.file AS path_1, l2.nevra AS nevra_2, l2.file AS path_2 FROM l l1 JOIN d d1 ON d1.contents_id = l1.contents_id JOIN d d2 ON d2.name = d1.name JOIN l l2 ON l2.contents_id = d2.contents_id
    WHERE l1.contents_id < l2.contents_id AND l1.package_id <> l2.package_id AND l1.a = l2.a AND l1.soname <> l2.soname""".replace("CASE WHEN kind = 'source' THEN 'src' ELSE arch END", "CASE WHEN kind = 'source' THEN 'src' ELSE p.arch END"))(lambda t: audit.symbol_collisions(libraries(t), "ASIA"))
_SCRIPTS = f"SELECT {NEVRA_SQL.replace('name', 'p.name', 1).replace('kind', 'p.kind')} AS nevra, s.kind, s.turn, s.script FROM a_package p JOIN a_script s USING (package_id) WHERE {ASIA.replace('p.package_id', 'package_id', 1)}"
query("unexpanded_macros_scripts", f"SELECT nevra, kind, md5(script) AS script FROM ({_SCRIPTS}) WHERE regexp_matches(script, '(?m)(^%|^[^#\\n]*%(\\{{|[a-z]{{2}}))')")(lambda t: audit.unexpanded_macros_scripts(catalog(t) | {"package_script": t.a_script}, "ASIA").withColumn("script", F.md5("script")))
query("unexpanded_macros_paths", f"SELECT nevra, file || '%{{x' AS file FROM ({_DOCS}) WHERE file LIKE '/etc/%'")(lambda t: audit.unexpanded_macros_paths(catalog(t) | {"file": t.a_file.withColumn("name", F.when(C("name").startswith("/etc/"), F.concat("name", L("%{x"))).otherwise(C("name")))}, "ASIA"))
_BYTE = "(instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1"
_OCTAL = f"CASE WHEN h = '5C' THEN '\\\\' WHEN h = '00' OR h >= '80' THEN '\\' || CAST(({_BYTE}) // 64 AS VARCHAR) || CAST(({_BYTE}) // 8 % 8 AS VARCHAR) || CAST(({_BYTE}) % 8 AS VARCHAR) ELSE chr(CAST({_BYTE} AS INTEGER)) END"
query("config_grep", f"SELECT nevra, file, md5(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: {_OCTAL}), '')) AS contents FROM ({_DOCS}) JOIN a_document USING (contents_id) WHERE file LIKE '/etc/%' AND contains(text, 'e')")(lambda t: audit.config_grep(documents(t), "ASIA", "/etc/", "e").withColumn("contents", F.md5("contents")))


@query("permission_audit", """SELECT path, CASE WHEN k = 1 THEN 'different' WHEN k = 2 THEN 'unexpected' ELSE 'missing' END AS status, CASE WHEN k < 3 THEN nation END AS actual_user_name, CASE WHEN k <> 2 THEN CASE WHEN k = 1 THEN 'x' ELSE nation END END AS expected_user_name
    FROM (SELECT s_name AS path, s_suppkey % 4 AS k, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier) WHERE k > 0""")
def _(t: Tables) -> DataFrame:
    k = C("s_suppkey") % 4
    rows = t.supplier.select(C("s_name").alias("path"), k.alias("k"), C("s_nationkey").cast("string").alias("user_name"), L("g").alias("group_name"), L("-rw").alias("permissions"))
    expected = rows.where("k <> 2").withColumn("user_name", F.when(C("k") == 1, "x").otherwise(C("user_name")))
    return audit.permission_audit(expected, rows.where("k <> 3")).select("path", "status", "actual_user_name", "expected_user_name")


query("writable_executable", f"SELECT nevra, file, type FROM ({_PROG}) JOIN a_segment USING (contents_id) WHERE writable AND executable")(lambda t: audit.writable_executable(catalog(t), "ASIA"))
query("missing_marker", f"SELECT nevra, file FROM ({_PROG}) WHERE contents_id NOT IN (SELECT contents_id FROM a_segment WHERE type = 1685382481 AND NOT (writable AND executable))")(lambda t: audit.missing_marker(catalog(t), "ASIA"))


@query("file_listing", f"""SELECT {NVRA_SQL.replace('name', 'p.name', 1)} AS nvra, {mode_full_sql('mode')} AS mode, {flags_sql('flags')} AS flags, length, x.name FROM (SELECT package_id, attribute_id, f.name, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM a_file f JOIN a_document USING (contents_id, package_id)
    UNION ALL SELECT package_id, attribute_id, name || '.d', 0 FROM a_file UNION ALL SELECT package_id, attribute_id, name || '.l -> ../x', 4 FROM a_file) x JOIN a_package p USING (package_id) JOIN a_attribute USING (attribute_id)""")
def _(t: Tables) -> DataFrame:
    f = t.a_file.select("package_id", "attribute_id", "name")
    cat = documents(t) | {"directory": f.withColumn("name", F.concat("name", L(".d"))), "symlink": f.select("package_id", "attribute_id", F.concat("name", L(".l")).alias("name"), L("../x").alias("target"))}
    return audit.file_listing(cat).select("nvra", "mode", "flags", "length", "name")


query("locate_by_digest", "SELECT md5(CAST(package_id AS VARCHAR)) || '00000000' AS digest, f.name AS path FROM a_file f JOIN a_document USING (contents_id, package_id) WHERE text = (SELECT text FROM documents ORDER BY doc_id LIMIT 1)")(
    lambda t: audit.locate_by_digest(documents(t) | {"package_digest": t.a_package.select("package_id", F.concat(F.md5(C("package_id").cast("string")), L("00000000")).alias("digest"))}, t.documents.agg(F.min_by(F.sha2("text", 256), "doc_id")).first()[0])
)
query("dependency_listing", f"SELECT {NEVRA_SQL.replace('name', 'p.name', 1).replace('version', 'p.version').replace('kind', 'p.kind')} AS nevra, d.kind, capability, {op_sql('flags')} AS op, d.version FROM a_dependency d JOIN a_package p USING (package_id)")(lambda t: audit.dependency_listing(catalog(t) | {"package_dependency": t.a_dependency}))
query("script_listing", f"SELECT {NVRA_SQL.replace('name', 'p.name', 1).replace('kind', 'p.kind')} AS nvra, s.kind, md5(replace(script, chr(10), '^J')) AS script FROM a_script s JOIN a_package p USING (package_id)")(lambda t: audit.script_listing(catalog(t) | {"package_script": t.a_script}).select("nvra", "kind", F.md5("script").alias("script")))
query("metadata_search", "SELECT package_id FROM a_package WHERE contains(lower(name), 'ring') OR contains(lower(summary), 'ring') OR contains(lower(license), 'ring')")(lambda t: audit.metadata_search(t.a_package, "RING", mode="ilike").select("package_id"))
query("arch_mismatch", "SELECT DISTINCT p.arch AS package_arch, o.arch AS file_arch FROM a_package p JOIN a_object o ON o.package_id = p.package_id + 1 WHERE p.arch <> o.arch")(lambda t: audit.arch_mismatch({"package": t.a_package, "file": t.a_object.select((C("package_id") - 1).alias("package_id"), "contents_id"), "elf_file": t.a_object}))
query("capability_lookup", "SELECT DISTINCT package_id, version FROM a_dependency WHERE kind = 'provide' AND capability = 'cap7'")(lambda t: audit.capability_lookup({"package_dependency": t.a_dependency}, "provide", "cap7"))
query("class_hierarchy", "SELECT class_id, c.name FROM a_class c JOIN a_interface i USING (class_id) WHERE super_class = 'PROMO' AND i.name = 'Brand#2'")(lambda t: audit.class_hierarchy({"java_class": t.a_class, "java_interface": t.a_interface}, "PROMO", "Brand#2"))

# Retention


@query("expire_packages", "SELECT 'package' AS kind, package_id AS id FROM a_package WHERE package_id IN (SELECT package_id FROM a_set_member) UNION ALL SELECT 'file', file_id FROM a_program WHERE package_id IN (SELECT package_id FROM a_set_member)")
def _(t: Tables) -> DataFrame:
    new = retention.expire_packages({"package": t.a_package, "package_set_member": t.a_set_member, "file": t.a_program})
    return new["package"].select(L("package").alias("kind"), C("package_id").alias("id")).unionByName(new["file"].select(L("file").alias("kind"), C("file_id").alias("id")))


@query("expire_contents", "SELECT doc_id AS contents_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t: Tables) -> DataFrame:
    return retention.expire_contents({"file_contents": t.documents.select(C("doc_id").alias("contents_id"), F.length("text").cast("long").alias("n")), "file": t.labels.select(C("doc_id").alias("contents_id"))})["file_contents"]


@query("expire_classes", "SELECT class_id, i.name FROM a_interface i WHERE class_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t: Tables) -> DataFrame:
    held = t.lineitem.where("l_returnflag = 'R'").select(C("l_partkey").alias("class_id"))
    return retention.expire_classes({"java_class": t.a_class, "java_interface": t.a_interface, "java_class_contents": held})["java_interface"]


_AS_OF = "TIMESTAMP '2024-02-01 12:00:00'"
query("expire_urls", f"SELECT url, last_access < date_trunc('day', {_AS_OF}) - INTERVAL 3 DAY AS expired FROM a_access")(lambda t: _expired(t))


def _expired(t: Tables) -> DataFrame:
    kept, expired = retention.expire_urls(t.a_access, F.to_timestamp(L("2024-02-01 12:00:00")))
    return kept.select("url", L(False).alias("expired")).unionByName(expired.select("url", L(True).alias("expired")))


@query("expire_all", "SELECT 'package' AS kind, count(DISTINCT package_id) AS n FROM a_set_member JOIN a_package USING (package_id) UNION ALL SELECT 'stale', (SELECT count(*) FROM (SELECT md5(CAST(package_id AS VARCHAR)) FROM a_package EXCEPT ALL SELECT md5(CAST(package_id AS VARCHAR)) FROM a_set_member))")
def _(t: Tables) -> DataFrame:
    digests = t.a_package.select("package_id", F.md5(C("package_id").cast("string")).alias("digest"))
    cat, stale = retention.expire_all({"package": t.a_package, "package_set_member": t.a_set_member, "package_digest": digests, "file": t.a_program, "url_cache": t.a_access}, F.to_timestamp(L("2024-02-01")), digests)
    return cat["package"].agg(F.count("*").alias("n")).select(L("package").alias("kind"), "n").unionByName(stale.agg(F.count("*").alias("n")).select(L("stale").alias("kind"), "n"))


@query("url_cache_lookup", "SELECT page_id, page_id % 3 <> 1 OR octet_length(encode(html)) % 2 = 0 AS hit FROM pages")
def _(t: Tables) -> DataFrame:
    cache = t.pages.select(C("page_id").cast("string").alias("url"), F.encode("html", "UTF-8").alias("data"), C("page_id").alias("http_time"), F.to_timestamp(L("2024-01-01")).alias("last_access"))
    wanted = F.when(C("page_id") % 3 == 1, F.when(F.octet_length("html") % 2 == 0, F.octet_length("html")).otherwise(-1).cast("long"))
    hits, misses, _ = retention.url_cache_lookup(cache, t.pages.select("page_id", C("page_id").cast("string").alias("url"), wanted.alias("length"), C("page_id").alias("http_time")), F.to_timestamp(L("2024-01-02")))
    return hits.select("page_id", L(True).alias("hit")).unionByName(misses.select("page_id", L(False).alias("hit")))


@query("url_cache_upsert", "SELECT CAST(user_id AS VARCHAR) AS url, max(event_id) AS http_time, bool_or(event_type = 'click') AS fresh FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY event_id DESC) AS n, bool_or(event_type = 'click') OVER (PARTITION BY user_id) AS c FROM events) WHERE n = 1 AND (event_type = 'click' OR NOT c) GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    rows = t.events.select(C("user_id").cast("string").alias("url"), C("event_id").alias("http_time"), F.encode("event_type", "UTF-8").alias("data"), C("ts").alias("last_change"), C("ts").alias("last_access"), "event_type")
    old = rows.where("event_type <> 'click'").drop("event_type")
    out = retention.url_cache_upsert(old, rows.where("event_type = 'click'"), F.to_timestamp(L("2025-01-01")))
    return out.select("url", "http_time", (F.decode("data", "UTF-8") == "click").alias("fresh"))


@query("url_cache_log", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS url, event_type, max(event_id) AS k FROM events GROUP BY ALL), u AS (SELECT url, max(k) FILTER (event_type = 'click') AS c, max(k) FILTER (event_type = 'purchase') AS p, max(k) FILTER (event_type = 'view') AS v FROM e GROUP BY url)
    SELECT url, coalesce(p, c) AS http_time, CASE WHEN p IS NOT NULL THEN 3 WHEN v % 2 = 0 THEN 2 ELSE 1 END AS day FROM u WHERE c IS NOT NULL OR p IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    """Three days of a URL cache: clicks are put, views look up, then, after the log was merged, purchases are put."""
    rows = t.events.select(C("user_id").cast("string").alias("url"), C("event_id").alias("http_time"), F.encode("event_type", "UTF-8").alias("data"), "event_type")
    day = lambda n: F.to_timestamp(L(f"2024-03-0{n} 00:00:00"))
    cache = retention.UrlCache(t.spark, storage.new_path(t.spark, "url-cache"))
    cache.put(rows.where("event_type = 'click'"), day(1))
    views = rows.where("event_type = 'view'").groupBy("url").agg(F.max("http_time").alias("k")).where("k % 2 = 0")
    cache.lookup(views.select("url", L(None).cast("long").alias("length"), L(None).cast("long").alias("http_time")), day(2))
    cache.compact()
    cache.put(rows.where("event_type = 'purchase'"), day(3))
    return cache.read().select("url", "http_time", F.dayofmonth("last_access").cast("long").alias("day"))


# Quality

query("check_constraints", "SELECT 'quantity' AS rule, l_orderkey FROM lineitem WHERE NOT l_quantity <= 45 UNION ALL SELECT 'flag', l_orderkey FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'linked', l_orderkey FROM lineitem WHERE (l_linestatus = 'F') <> (l_returnflag = 'A')")(
    lambda t: quality.check_constraints(t.lineitem, {"quantity": C("l_quantity") <= 45, "flag": C("l_returnflag").isin("A", "N"), "linked": (C("l_linestatus") == "F") == (C("l_returnflag") == "A")}, "l_orderkey")
)
query("check_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")(lambda t: quality.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"]))
query("check_foreign_keys", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")(lambda t: quality.check_foreign_keys(t.lineitem, t.part.where("p_size < 25"), "l_partkey", "p_partkey").select("l_partkey", "l_orderkey", "l_linenumber"))
_BROKEN = "p AS (SELECT package_id, CASE WHEN package_id % 11 = 0 THEN '' ELSE name END AS name, version, release, CASE WHEN package_id % 17 = 0 THEN NULL ELSE arch END AS arch, CASE WHEN package_id % 13 = 0 THEN -1 ELSE epoch END AS epoch FROM a_package WHERE package_id % 10 <> 3), f AS (SELECT file_id, package_id, contents_id, '/x/' || source AS name, file_id - 5 AS mtime FROM a_file JOIN documents ON doc_id = file_id)"


@query("check_contract", f"""WITH {_BROKEN} SELECT 'package' AS "table", 'check' AS kind, 'name' AS rule, CAST(package_id AS VARCHAR) AS key FROM p WHERE name = '' UNION ALL SELECT 'package', 'check', 'epoch', CAST(package_id AS VARCHAR) FROM p WHERE epoch < 0
    UNION ALL SELECT 'package', 'missing', 'arch', CAST(package_id AS VARCHAR) FROM p WHERE arch IS NULL UNION ALL SELECT 'file', 'check', 'mtime', CAST(file_id AS VARCHAR) FROM f WHERE mtime < 0
    UNION ALL SELECT 'file', 'unique', 'package_id, name', CAST(package_id AS VARCHAR) || ', ' || name FROM f GROUP BY package_id, name HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'file', 'reference', 'package_id', CAST(package_id AS VARCHAR) FROM f WHERE package_id NOT IN (SELECT package_id FROM p)
    UNION ALL SELECT DISTINCT 'package_set_member', 'reference', 'package_id', CAST(package_id AS VARCHAR) FROM a_set_member WHERE package_id NOT IN (SELECT package_id FROM p)
    UNION ALL SELECT DISTINCT 'package_set_member', 'reference', 'set_id', CAST(set_id AS VARCHAR) FROM a_set_member WHERE set_id = 4""")
def _(t: Tables) -> DataFrame:
    spoilt = t.a_package.where("package_id % 10 <> 3").select("package_id", F.when(C("package_id") % 11 == 0, "").otherwise(C("name")).alias("name"), "version", "release", F.when(C("package_id") % 17 != 0, C("arch")).alias("arch"), F.when(C("package_id") % 13 == 0, -1).otherwise(C("epoch")).alias("epoch"))
    files = t.a_file.join(t.documents.select(C("doc_id").alias("file_id"), "source"), "file_id").select("file_id", "package_id", "contents_id", F.concat(L("/x/"), "source").alias("name"), (C("file_id") - 5).alias("mtime"))
    return quality.check_contract({"package": spoilt, "file": files, "package_set": t.a_set.where("set_id <> 4"), "package_set_member": t.a_set_member})


query("attribute_consistency", "SELECT count(*) AS n, count(DISTINCT (l_returnflag, l_linestatus, l_linenumber, l_partkey)) AS n_distinct FROM lineitem")(lambda t: quality.attribute_consistency(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber", "l_partkey"]))

# Streams


def _stream(t: Tables, name: str) -> DataFrame:
    """A file stream over a table; as a glob, so that the table may be a file or a folder."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/[{name[0]}]{name[1:]}.parquet")


@query("stream_intern", "SELECT DISTINCT md5(CAST(user_id AS VARCHAR) || event_type) AS digest FROM events")
def _(t: Tables) -> DataFrame:
    rows = _stream(t, "events").select(F.md5(F.concat(C("user_id").cast("string"), "event_type")).alias("digest"), C("ts").cast("timestamp").alias("ts"))
    path = storage.new_path(t.spark, "interned")
    jobs.run_available(jobs.stream_intern(rows).select("digest"), path, storage.new_path(t.spark, "interning"))
    return t.spark.read.schema("digest string").parquet(f"{path}/epoch=*")


@query("stream_latest", "SELECT name, arch, ordinal FROM a_release QUALIFY row_number() OVER (PARTITION BY name, arch ORDER BY v1 DESC, r1 DESC, ordinal) = 1")
def _(t: Tables) -> DataFrame:
    e = _stream(t, "events")
    rows = e.select(C("event_type").alias("name"), C("user_id").cast("string").alias("arch"), L(None).cast("int").alias("epoch"), F.floor("value").cast("int").cast("string").alias("version"), (C("event_id") % 10).cast("string").alias("release"), C("event_id").alias("ordinal"))
    path = storage.new_path(t.spark, "latest")
    jobs.stream_latest(rows, path, storage.new_path(t.spark, "latest-stream")).awaitTermination()
    return jobs.latest_state(t.spark, path).select("name", "arch", "ordinal")


@query("stream_cache_activity", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS first, CAST(epoch_us(max(ts)) AS BIGINT) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def _(t: Tables) -> DataFrame:
    rows = _stream(t, "events").select("user_id", C("ts").cast("timestamp").alias("ts"))
    path = storage.new_path(t.spark, "activity")
    jobs.run_available(jobs.stream_cache_activity(rows, "user_id", gap="6 hours"), path, storage.new_path(t.spark, "activity-stream"), "complete")
    return t.spark.read.parquet(path).select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")
