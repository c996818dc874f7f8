"""Interning, verification and normalisation of packages, contents and attributes.

Identifiers derive from digests, so the same input gives the same identifiers in any run and no counter is shared.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotscan import storage
from depotscan.functions import scalar as S

# Names whose files are kept in full, and the size of other previews.
KEEP_PREFIXES = ("/etc/", "/usr/lib/binfmt.d/", "/usr/lib/sysctl.d/", "/usr/lib/tmpfiles.d/", "/usr/lib/udev/rules.d/", "/usr/share/dbus-1/services/", "/usr/share/dbus-1/system-services/", "/usr/share/polkit-1/actions/", "/usr/share/polkit-1/rules.d/")
KEEP_SUFFIXES = (".conf", ".desktop", ".pkla", ".policy", ".protocol", ".service", ".spec")
PREVIEW_SIZE = 64
GHOST = 64
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
SCRIPT_KINDS = S.ENUMERATIONS["script"]


class Interned(NamedTuple):
    table: DataFrame
    mapping: DataFrame
    marked: DataFrame | None = None


class Split(NamedTuple):
    good: DataFrame
    bad: DataFrame


class Routed(NamedTuple):
    files: DataFrame
    directories: DataFrame
    symlinks: DataFrame
    errors: DataFrame


class Triggers(NamedTuple):
    scripts: DataFrame
    conditions: DataFrame
    errors: DataFrame


def surrogate(digest: Column) -> Column:
    return F.xxhash64(digest)


def surrogate_clashes(table: DataFrame, key: str = "contents_id", digest: str = "digest") -> DataFrame:
    """(key, n) of identifiers that several digests share; none, in tables that interning has made."""
    return table.select(key, digest).distinct().groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def assign_ids(new: DataFrame, taken: DataFrame, key: str, digest: str, number: Callable[[Column], Column] = surrogate) -> tuple[DataFrame, DataFrame]:
    """((digest, key) of the distinct new digests, those of them whose identifier isn't the number of their digest).

    taken has the (digest, key) in use, none of them of a new digest. A digest gets its own number, a 64-bit hash, unless
    that is in use or another new digest, which is smaller, has it too; then it gets the number of itself and a first,
    second, ... mark. From billions of digests on some clash, so the second table stays tiny; no two share an identifier."""
    left = storage.store(new.select(digest, number(F.col(digest)).alias(key)), "ids-wanted")
    used, given, n = taken.select(key), None, 0
    while True:
        first = left.groupBy(key).agg(F.min(digest).alias(digest))
        free = storage.store(first.join(used, key, "left_anti").select(digest, key), "ids-given")
        given = free if given is None else given.unionByName(free)
        used, n = used.unionByName(free.select(key)), n + 1
        left = storage.store(left.join(free, digest, "left_anti").select(digest, number(F.struct(digest, F.lit(n))).alias(key)), "ids-wanted")
        if left.isEmpty():
            return given, given.where(F.col(key) != number(F.col(digest)))


def ids_of(rows: DataFrame, marked: DataFrame, key: str = "contents_id", digest: str = "digest", number: Callable[[Column], Column] = surrogate) -> DataFrame:
    """rows with the identifier of their digest: its number, but for the few marked (digest, key) ones. A null digest has none."""
    few = marked.select(F.col(digest).alias("_digest"), F.col(key).alias("_id"))
    own = F.when(F.col(digest).isNotNull(), number(F.col(digest)))
    return rows.join(few, F.col(digest) == F.col("_digest"), "left").withColumn(key, F.coalesce("_id", own)).drop("_digest", "_id")


def intern_contents(new: DataFrame, existing: DataFrame, digest: str = "digest", key: str = "contents_id", number: Callable[[Column], Column] = surrogate) -> Interned:
    """One row per distinct digest. mapping has each new digest with its id and whether it was added now; equal
    digests meet in the map-side half of the aggregation, so a content with many copies costs one row per task.

    existing has digest and, where it was made by interning, its key; marked has the rows of the table whose key isn't the
    number of their digest, for ids_of."""
    if key not in existing.columns:
        start = existing.select(digest).distinct()
        existing, _ = assign_ids(start, start.select(digest, F.lit(None).cast("long").alias(key)).limit(0), key, digest, number)
    known = existing.select(digest, key).dropDuplicates([digest])
    distinct = storage.store(new.groupBy(digest).agg(F.count("*").alias("copies")).join(known, digest, "left"), "interned")
    added, _ = assign_ids(distinct.where(F.col(key).isNull() & F.col(digest).isNotNull()), known, key, digest, number)
    fresh = added.select(digest, F.col(key).alias("_new"))
    mapping = distinct.join(fresh, digest, "left").select(F.coalesce(key, "_new").alias(key), digest, "copies", F.col("_new").isNotNull().alias("added"))
    table = known.unionByName(added)
    return Interned(table, mapping, table.where(F.col(key) != number(F.col(digest))))


def keeps_full(name: Column) -> Column:
    tests = [F.startswith(name, F.lit(p)) for p in KEEP_PREFIXES] + [F.endswith(name, F.lit(s)) for s in KEEP_SUFFIXES]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def contents_preview(files: DataFrame, contents: DataFrame, key: str = "contents_id", name: str = "name", data: str = "contents", size: int = PREVIEW_SIZE) -> DataFrame:
    """(key, preview): all bytes where any name of the content asks for it, else the first `size`."""
    full = files.groupBy(key).agg(F.bool_or(keeps_full(F.col(name))).alias("full"))
    return contents.join(full, key, "left").select(key, F.when(F.col("full"), F.col(data)).otherwise(F.substring(F.col(data), 1, size)).alias("preview"))


def preview_upgrade(old: DataFrame, new: DataFrame, key: str = "contents_id", preview: str = "preview") -> DataFrame:
    """The longer preview of each content."""
    both = old.select(key, preview).unionByName(new.select(key, preview))
    return both.groupBy(key).agg(F.max_by(preview, F.octet_length(preview)).alias(preview))


def attribute_hash(columns: list[str]) -> Column:
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns)))


def intern_attributes(files: DataFrame, columns: list[str], number: Callable[[Column], Column] = surrogate) -> tuple[DataFrame, DataFrame]:
    """(distinct attribute rows with their hash and id, files with attribute_id). The id is a function of the row; only hashes whose number another has are joined."""
    keyed = files.withColumn("row_hash", attribute_hash(columns))
    dimension = storage.store(keyed.select("row_hash", *columns).dropDuplicates(["row_hash"]), "attributes")
    given, marked = assign_ids(dimension.select("row_hash"), dimension.select("row_hash", F.lit(None).cast("long").alias("attribute_id")).limit(0), "attribute_id", "row_hash", number)
    return dimension.join(given, "row_hash").select("attribute_id", "row_hash", *columns), ids_of(keyed, marked, "attribute_id", "row_hash", number).drop("row_hash")


def intern_packages(new: DataFrame, existing: DataFrame, digest: str = "hash", ordinal: str = "ordinal") -> Interned:
    """Packages whose header hash isn't known, the first of equal ones; mapping names, for each new row, the one that stands for it."""
    first = new.groupBy(digest).agg(F.min(ordinal).alias("first"))
    mapping = new.select(digest, ordinal).join(first, digest).join(existing.select(digest, F.lit(True).alias("known")).distinct(), digest, "left")
    mapping = mapping.select(ordinal, "first", (F.col("known").isNull() & (F.col(ordinal) == F.col("first"))).alias("added"))
    table = new.join(first.withColumnRenamed("first", ordinal), [digest, ordinal], "left_semi").dropDuplicates([digest, ordinal]).join(existing.select(digest), digest, "left_anti")
    return Interned(table, mapping)


def package_digests(packages: DataFrame, key: str = "package_id", data: str = "data") -> DataFrame:
    """(key, digest hex, length): SHA-256 and SHA-1 of each archive, without repeats."""
    rows = packages.select(key, F.explode(F.array(F.sha2(F.col(data), 256), F.sha1(F.col(data)))).alias("digest"), F.octet_length(data).cast("long").alias("length"))
    return rows.distinct()


def package_by_digest(listing: DataFrame, digests: DataFrame, digest: str = "digest") -> Split:
    """(known with package_id, to load)."""
    known = listing.join(digests.select(digest, "package_id").dropDuplicates([digest]), digest)
    return Split(known, listing.join(digests.select(digest), digest, "left_anti"))


def add_urls(existing: DataFrame, new: DataFrame) -> Interned:
    """(all (package_id, url) rows, the new distinct ones with whether each was added)."""
    key = ["package_id", "url"]
    distinct = new.select(key).distinct()
    marked = distinct.join(existing.select(*key, F.lit(True).alias("known")).distinct(), key, "left").select(*key, F.col("known").isNull().alias("added"))
    return Interned(existing.select(key).unionByName(marked.where("added").select(key)), marked)


def verify_checksums(df: DataFrame, data: str, kind: str, expected: str, length: str | None = None) -> DataFrame:
    """Rows whose digest of the named type, or whose length where one is given, differs from the expected; with `actual`."""
    actual = S.digest(F.col(kind), F.col(data))
    wrong = F.col("actual") != F.lower(F.col(expected))
    if length:
        wrong = wrong | F.coalesce(F.octet_length(data) != F.col(length), F.lit(False))
    return df.withColumn("actual", actual).where(wrong)


def normalize_text(df: DataFrame, column: str) -> DataFrame:
    """Bytes to text: valid UTF-8 as it is, else read as Latin-1 and marked normalized."""
    valid = F.is_valid_utf8(column)
    return df.withColumn("normalized", ~valid).withColumn(column, F.when(valid, F.decode(column, "UTF-8")).otherwise(S.latin1_to_utf8(F.col(column))))


def hardlink_groups(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, errors) of regular, non-ghost, non-empty files with several links, by package and inode: the digests of a group must agree."""
    linked = files.where((F.shiftright("mode", 12) == 8) & ~S.has(F.col("flags"), GHOST) & (F.col("length") > 0) & (F.col("nlinks") > 1))
    groups = linked.groupBy("package_id", "inode").agg(F.count("*").alias("names"), F.min("digest").alias("digest"), F.max("digest").alias("other"))
    return groups.where("digest = other").drop("other"), groups.where("digest <> other")


def ghost_normalize(files: DataFrame) -> DataFrame:
    """Ghost entries have inode 0, length 0 and the digest of nothing."""
    ghost = S.has(F.col("flags"), GHOST)
    return files.withColumns({c: F.when(ghost, F.lit(v)).otherwise(F.col(c)) for c, v in (("inode", 0), ("length", 0), ("digest", EMPTY_SHA256))})


def entry_router(entries: DataFrame) -> Routed:
    """Entries by type bits; an entry with several links is a file; a symlink without target or another type is an error."""
    kind = F.shiftright("mode", 12)
    route = F.when(F.col("nlinks") > 1, "file").when(kind == 8, "file").when(kind == 4, "directory").when((kind == 10) & (F.coalesce("target", F.lit("")) != ""), "symlink").otherwise("error")
    routed = entries.withColumn("route", route)
    return Routed(*(routed.where(F.col("route") == r).drop("route") for r in ("file", "directory", "symlink", "error")))


def dependency_rows(headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) from parallel arrays <kind>_flags, <kind>_name, <kind>_version; require must be there, the others may be null."""
    kinds = S.ENUMERATIONS["dependency"]
    parts = [F.struct(F.lit(k).alias("kind"), F.col(f"{k}_flags").alias("flags"), F.col(f"{k}_name").alias("name"), F.col(f"{k}_version").alias("version")) for k in kinds]
    each = headers.select("package_id", F.explode(F.array(*parts)).alias("p")).select("package_id", "p.*")
    none = F.col("flags").isNull() & F.col("name").isNull() & F.col("version").isNull()
    good = (F.size("flags") == F.size("name")) & (F.size("name") == F.size("version"))
    rows = each.where(~none & good).select("package_id", "kind", F.inline(F.arrays_zip("flags", "name", "version"))).toDF("package_id", "kind", "flags", "capability", "version")
    errors = each.where((none & (F.col("kind") == "require")) | (~none & ~F.coalesce(good, F.lit(False)))).select("package_id", "kind")
    return rows, errors


def script_rows(headers: DataFrame, kinds: tuple[str, ...] = SCRIPT_KINDS) -> DataFrame:
    """One row per kind that has a body or an interpreter, from columns <kind>_script and <kind>_prog (array)."""
    parts = [F.struct(F.lit(k).alias("kind"), F.col(f"{k}_script").alias("script"), F.col(f"{k}_prog").alias("prog")) for k in kinds]
    rows = headers.select("package_id", F.explode(F.array(*parts)).alias("p")).select("package_id", "p.*")
    return rows.where(F.col("script").isNotNull() | (F.coalesce(F.size("prog"), F.lit(0)) > 0))


def trigger_rows(headers: DataFrame) -> Triggers:
    """Trigger scripts by position, and the conditions that name them; headers have arrays scripts, progs, and
    condition arrays names, versions, flags, indexes. A condition whose index names no script is an error."""
    scripts = headers.select("package_id", F.size("scripts").alias("n"), F.posexplode(F.arrays_zip("scripts", "progs")).alias("script_idx", "s"))
    scripts = scripts.select("package_id", "script_idx", F.col("s.scripts").alias("script"), F.col("s.progs").alias("prog"))
    conditions = headers.select("package_id", F.coalesce(F.size("scripts"), F.lit(0)).alias("n"), F.inline(F.arrays_zip("indexes", "flags", "names", "versions"))).toDF("package_id", "n", "script_idx", "flags", "name", "version")
    good = (F.col("script_idx") >= 0) & (F.col("script_idx") < F.col("n"))
    return Triggers(scripts, conditions.where(good).drop("n"), conditions.where(~F.coalesce(good, F.lit(False))).drop("n"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
