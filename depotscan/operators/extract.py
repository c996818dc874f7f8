"""Facts from file contents: kinds, POM URLs, Python names, image and class facts, archive members."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import NamedTuple
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotscan.functions import scalar as S

CONTEXT = 50
URL_PARENTS = ("repository", "pluginRepository", "snapshotRepository", "distributionManagement", "scm")


class ElfFacts(NamedTuple):
    definitions: DataFrame
    references: DataFrame
    needed: DataFrame
    rpath: DataFrame
    runpath: DataFrame
    dynamic: DataFrame


class ClassFacts(NamedTuple):
    classes: DataFrame
    interfaces: DataFrame
    references: DataFrame
    contents: DataFrame


def _head(data: Column, n: int) -> Column:
    return F.hex(F.substring(data, 1, n))


def contents_kind(data: Column, python_path: Column) -> Column:
    """elf, xml, python, java or null, tested in this order, from the first bytes and the size. XML begins with a '<' after
    any white space and byte order marks; where the first bytes are only these, the rest is read as well."""
    size = F.octet_length(data)
    as_text = F.decode(F.substring(data, 1, 100), "ISO-8859-1")
    lead = r"\A[\x20\x09\x0D\x0A]*+(?:ï»¿[\x20\x09\x0D\x0A]*+)*+"
    head = F.decode(F.substring(data, 1, 256), "ISO-8859-1")
    xml = F.when(head.rlike(lead + r"[^\x20\x09\x0D\x0Aï]"), head.rlike(lead + "<")).otherwise(F.decode(data, "ISO-8859-1").rlike(lead + "<"))
    python = ((size > 10) & (_head(data, 1) == "23") & F.contains(as_text, F.lit("python"))) | F.coalesce(python_path, F.lit(False))
    java = (size >= 32) & (_head(data, 4) == "CAFEBABE") & (F.conv(F.hex(F.substring(data, 7, 2)), 16, 10).cast("int") < 100)
    return F.when((size > 4) & (_head(data, 4) == "7F454C46"), "elf").when(xml, "xml").when(python, "python").when(java, "java")


def classify_contents(contents: DataFrame, paths: DataFrame, key: str = "contents_id", data: str = "contents", name: str = "name") -> DataFrame:
    """(key, kind, is_zip) of contents; any path that ends in .py makes a content Python if nothing before it did."""
    py = paths.groupBy(key).agg(F.bool_or(F.endswith(name, F.lit(".py"))).alias("py"))
    rows = contents.join(py, key, "left")
    return rows.select(key, contents_kind(F.col(data), F.col("py")).alias("kind"), ((F.octet_length(data) > 4) & (_head(F.col(data), 4) == "504B0304")).alias("is_zip"))


# XML

class _Entity(Exception):
    pass


class _Typed:
    """Follows a POM document's tags and keeps the typed URLs, in document order; of another root, none.

    stack has the tags above; kind the type of the outermost known one among them. The text of a URL is what comes before
    its element's first child; nothing inside such an element is looked at."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.kinds: list[str | None] = []
        self.found: list[tuple[str, str]] = []
        self.text: list[str] | None = None
        self.inside = 0

    def start(self, tag: str, _: object) -> None:
        if self.inside:
            self.close()
            self.inside += 1
            return
        kind = self.kinds[-1] if self.kinds else None
        if self.stack and self.stack[0] == "project":
            if tag in ("downloadUrl", "connection", "developerConnection"):
                self.open(tag)
            elif tag == "url":
                self.open("site" if len(self.stack) > 1 and self.stack[-1] == "site" else kind or "other")
        self.stack.append(tag)
        self.kinds.append(kind or (tag if len(self.stack) > 1 and tag in URL_PARENTS else None))

    def open(self, kind: str) -> None:
        self.kind, self.text, self.inside = kind, [], 1

    def close(self) -> None:
        if self.text is not None:
            url = "".join(self.text).strip(" \t\n\r\v\f")
            if url:
                self.found.append((url, self.kind))
            self.text = None

    def end(self, _: str) -> None:
        if self.inside:
            self.close()
            self.inside -= 1
            if self.inside:
                return
        self.stack.pop()
        self.kinds.pop()

    def data(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)


def _parse_xml(text: bytes) -> tuple[list[tuple[str, str]], tuple[str, int, bytes, bytes] | None]:
    """(typed URLs, (message, line, bytes before, bytes after) of the first error); an entity declaration is one. With an error there are no URLs."""
    parser, typed = expat.ParserCreate(), _Typed()

    def entity(*_: object) -> None:
        raise _Entity

    parser.EntityDeclHandler = entity
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = typed.start, typed.end, typed.data
    try:
        parser.Parse(text, True)
    except _Entity:
        message, line, at = "entity declaration", parser.CurrentLineNumber, parser.CurrentByteIndex
    except expat.ExpatError as e:
        message, line, at = expat.errors.messages[e.code], e.lineno, parser.ErrorByteIndex
    else:
        return typed.found, None
    return [], (message, line, text[max(0, at - CONTEXT) : at], text[at : at + CONTEXT])


def xml_facts(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(key, urls array<struct<url, type>>, message, line, before, after): each document is read once, for its typed URLs and its first error, and doesn't come back. A null document gives no row."""
    schema = f"{key} {dict(docs.dtypes)[key]}, urls array<struct<url string, type string>>, message string, line int, before binary, after binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("url", pa.string()), ("type", pa.string())]))
        for batch in batches:
            found = [_parse_xml(t.as_py()) for t in batch.column(1)]
            urls = pa.array([[{"url": u, "type": k} for u, k in x] for x, _ in found], kind)
            error = [e or (None,) * 4 for _, e in found]
            columns = [pa.array([e[i] for e in error], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), urls, *columns], names=[key, "urls", "message", "line", "before", "after"])

    return docs.select(key, F.col(xml).cast("binary").alias(xml)).where(F.col(xml).isNotNull()).mapInArrow(run, schema)


def xml_errors(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(keys of valid documents, errors with message, line and 50 bytes on both sides). A null document is neither."""
    facts = xml_facts(docs, key, xml)
    return facts.where("message is null").select(key), facts.where("message is not null").drop("urls")


def pom_urls(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(key, url, type, pos) of the typed URLs of POM documents whose root is project, in document order; malformed ones give no row.

    A url below a site is `site`; else its outermost ancestor of a known kind names it; else it is `other`."""
    return xml_facts(docs, key, xml).select(key, F.posexplode("urls").alias("pos", "u")).select(key, "u.url", "u.type", "pos")


# Python

def _python_facts(source: bytes) -> tuple[list[str], list[str], list[str], list[str], int | None, str | None]:
    """(imports, attributes, functions, classes, error line, error message)."""
    if b"\0" in source:
        return [], [], [], [], source[: source.index(b"\0")].count(b"\n") + 1, "source contains a NUL byte"
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except SyntaxError as e:
        return [], [], [], [], e.lineno, e.msg
    except (ValueError, RecursionError, MemoryError) as e:
        return [], [], [], [], None, str(e) or type(e).__name__
    imports = []
    for node in sorted((n for n in nodes if isinstance(n, ast.Import | ast.ImportFrom)), key=lambda n: (n.lineno, n.col_offset)):
        head = "" if isinstance(node, ast.Import) else "." * node.level + (f"{node.module}." if node.module else "")
        imports += [head + a.name for a in node.names]
    names = [sorted({getattr(n, field) for n in nodes if type(n) is kind}) for kind, field in ((ast.Attribute, "attr"), (ast.FunctionDef, "name"), (ast.ClassDef, "name"))]
    return imports, *names, None, None


def python_facts(sources: DataFrame, key: str = "contents_id", data: str = "contents") -> DataFrame:
    """(key, import, attribute, function, class, line, message), parsed once per distinct key."""
    schema = f"{key} {dict(sources.dtypes)[key]}, import array<string>, attribute array<string>, function array<string>, class array<string>, line int, message string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_python_facts(x.as_py()) for x in batch.column(1)]
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            lists = [pa.array(c, pa.list_(pa.string())) for c in columns[:4]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.string())], names=[key, "import", "attribute", "function", "class", "line", "message"])

    once = sources.select(key, F.col(data).cast("binary").alias(data)).where(F.col(data).isNotNull()).dropDuplicates([key])
    return once.mapInArrow(run, schema)


def python_symbols(sources: DataFrame, key: str = "contents_id", data: str = "contents") -> DataFrame:
    """(key, kind, name, pos): imports in source order with repeats, and the distinct attribute, function and class names."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("names")) for k in ("import", "attribute", "function", "class")))
    return python_facts(sources, key, data).select(key, F.explode(kinds).alias("k")).select(key, F.col("k.kind").alias("kind"), F.posexplode("k.names").alias("pos", "name"))


def python_errors(sources: DataFrame, key: str = "contents_id", data: str = "contents") -> DataFrame:
    """(key, line, message) of sources that don't parse; a NUL byte is an error on its line."""
    return python_facts(sources, key, data).where("message is not null").select(key, "line", "message")


def python_pending(files: DataFrame, facts: list[DataFrame], key: str = "contents_id", name: str = "name") -> DataFrame:
    """Contents with a Python path under any name and no row in any fact table; an error row alone doesn't count as done."""
    todo = files.where(F.endswith(name, F.lit(".py"))).select(key).distinct()
    for f in facts:
        todo = todo.join(f.select(key), key, "left_anti")
    return todo


# Images, classes, archives

def elf_facts_flatten(images: DataFrame, key: str = "contents_id") -> ElfFacts:
    """Fact tables from images with arrays of symbols <name, version, defined, section, other> and of dynamic
    entries <kind, text, tag, value>. Unnamed symbols and dynamic (0, 0) entries are dropped."""
    symbols = images.select(key, F.inline("symbols")).where("name <> ''").withColumn("visibility", S.elf_visibility(F.col("other")))
    entries = images.select(key, F.inline("dynamic"))
    text = lambda kind, name: entries.where(F.col("kind") == kind).select(key, F.col("text").alias(name))
    defined = symbols.where("defined").select(key, "name", "version", "section", S.has_xsection(F.col("section")).alias("has_xsection"), "visibility")
    return ElfFacts(defined, symbols.where("not defined").select(key, "name", "version", "visibility"), text("needed", "name"), text("rpath", "path"), text("runpath", "path"), entries.where("kind = 'other' and not (tag = 0 and value = 0)").select(key, "tag", "value"))


def soname_pick(dynamic: DataFrame, key: str = "contents_id", soname: str = "soname", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(first soname of each image, later ones that differ)."""
    first = dynamic.groupBy(key).agg(F.min_by(soname, pos).alias("first"))
    errors = dynamic.join(first, key).where(F.col(soname) != F.col("first")).select(key, pos, soname, "first")
    return first.withColumnRenamed("first", soname), errors


def java_class_facts(classes: DataFrame, existing: DataFrame, digest: str = "digest") -> ClassFacts:
    """Classes by digest that aren't known yet, their interfaces, their references (sorted, distinct, without the
    universal ones and themselves), and every containing content."""
    new = classes.join(existing.select(digest), digest, "left_anti").dropDuplicates([digest])
    others = F.array_except(F.col("references"), F.array(F.lit("java/lang/Object"), F.lit("java/lang/String"), F.col("name")))
    return ClassFacts(new.select(digest, "name", "super_class", "access_flags"), new.select(digest, F.explode("interfaces").alias("name")), new.select(digest, F.explode(F.array_sort(F.array_distinct(others))).alias("name")), classes.select("contents_id", digest).distinct())


def archive_members(archives: DataFrame, key: str = "contents_id") -> tuple[DataFrame, DataFrame]:
    """(members, errors) of archives with an array of members <path, status>: ok, bad (the listing goes on) or header (it ends)."""
    rows = archives.select(key, F.posexplode("members").alias("pos", "m")).select(key, "pos", "m.path", "m.status")
    end = F.min(F.when(F.col("status") == "header", F.col("pos"))).over(Window.partitionBy(key))
    seen = rows.withColumn("end", end).where(F.col("end").isNull() | (F.col("pos") <= F.col("end"))).drop("end")
    return seen.where("status = 'ok'").drop("status"), seen.where("status <> 'ok'")
