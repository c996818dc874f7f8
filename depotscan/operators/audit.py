"""Audit queries over a catalog: a mapping from table names to DataFrames.

Tables: package, package_set, package_set_member, file, file_attribute, elf_file, elf_reference, elf_definition,
elf_closure, elf_program_header, and others as named below. Results are sorted as a user reads them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotscan import storage
from depotscan.functions import scalar as S
from depotscan.operators.graph import plain_edges, reach_pairs

Catalog = Mapping[str, DataFrame]
SETID = 3072
STACK_MARKER = 1685382481
#: Libraries of a symbol that meet in one join key; with more of them there are more keys.
BLOCK = 1000
#: Join keys of all symbols together, about: enough to keep a cluster busy. With so many, blocks grow instead.
CELLS = 4096
LIBRARY_PATHS = r"^/usr/lib(|64)/[^/]*.so[^/]*$"
MACRO_TEXT = r"(?m)(^%|^[^#\n]*%(\{|[a-z]{2}))"
MACRO_NAME = r"%(\{|[a-z]{2})"
# Names that most libraries define.
COMMON_SYMBOLS = ("_init", "_fini", "__bss_start", "_edata", "_end", "crtstuff.c", "deregister_tm_clones", "__do_global_dtors_aux", "__do_global_dtors_aux_fini_array_entry", "__dso_handle", "_DYNAMIC", "kde_plugin_verification_data", "qt_plugin_instance", "qt_plugin_query_verification_data", "__TMC_END__", "__x86.get_pc_thunk.bx", "__x86.get_pc_thunk.cx", "register_tm_clones", "gst_plugin_desc", "frame_dummy", "__FRAME_END__", "__frame_dummy_init_array_entry", "_GLOBAL_OFFSET_TABLE_", "__JCR_END__", "__JCR_LIST__", "kde_plugin_version", "kdemain")


def nevra_of(p: DataFrame) -> Column:
    return S.nevra(p["name"], p["epoch"], p["version"], p["release"], p["kind"], p["arch"])


def set_packages(cat: Catalog, name: str) -> DataFrame:
    """(package_id, package, nevra, arch) of a set's members; the set is found by a one-row join, so a member table
    partitioned by set_id is pruned."""
    chosen = cat["package_set"].where(F.col("name") == name).select("set_id")
    ids = cat["package_set_member"].join(F.broadcast(chosen), "set_id", "left_semi").select("package_id").distinct()
    p = cat["package"].join(ids, "package_id", "left_semi")
    return p.select("package_id", F.col("name").alias("package"), nevra_of(p).alias("nevra"), F.col("arch").alias("package_arch"))


def set_files(cat: Catalog, name: str) -> DataFrame:
    """set_packages with their files: file_id, contents_id, file, and the attribute and inode where the table has them."""
    return set_packages(cat, name).join(cat["file"].withColumnRenamed("name", "file"), "package_id")


def _referring(cat: Catalog, test: Column) -> DataFrame:
    return cat["elf_reference"].where(test).select("contents_id").distinct()


def calls_any(cat: Catalog, set_name: str, names: Sequence[str]) -> DataFrame:
    """Packages with a file that refers to any of the names."""
    return set_files(cat, set_name).join(_referring(cat, F.col("name").isin(list(names))), "contents_id", "left_semi").select("package").distinct().orderBy("package")


def calls_matching(cat: Catalog, set_name: str, regex: str) -> DataFrame:
    """(package, file, name) of references that match."""
    found = cat["elf_reference"].where(F.col("name").rlike(regex)).select("contents_id", "name")
    return set_files(cat, set_name).join(found, "contents_id").select("package", "file", "name").distinct().orderBy("package", "file", "name")


def calls_without(cat: Catalog, set_name: str, has: str, lacks: Sequence[str]) -> DataFrame:
    """(package, file) of files that refer to one name and to none of the others. The anti join is made on contents,
    before files fan out."""
    contents = _referring(cat, F.col("name") == has).join(_referring(cat, F.col("name").isin(list(lacks))), "contents_id", "left_anti")
    return set_files(cat, set_name).join(contents, "contents_id", "left_semi").select("package", "file").orderBy("package", "file")


def reach(cat: Catalog, set_name: str, base: DataFrame, reference: str) -> DataFrame:
    """(nevra, program, library): base files (package_id, file_id, name) of the set that need, through any number of
    libraries, one that refers to the name.

    With a table elf_closure (file_id, needed) its pairs are used; else the pairs between the base files and the referring
    libraries are found from elf_dependency (file_id, needed), direct needs, and nothing else is closed."""
    own = F.broadcast(cat["package_set"].where(F.col("name") == set_name).select("set_id"))
    needs = cat["elf_closure" if "elf_closure" in cat else "elf_dependency"]
    if "set_id" in needs.columns:
        needs = needs.join(own, "set_id", "left_semi")
    libraries = cat["file"].join(_referring(cat, F.col("name") == reference), "contents_id", "left_semi").select(F.col("file_id").alias("needed"), F.col("name").alias("library"))
    programs = base.select("package_id", "file_id", F.col("name").alias("program")).join(set_packages(cat, set_name), "package_id")
    if "elf_closure" not in cat:
        node = lambda df, c: df.select(F.col(c).alias("node"))
        needs = reach_pairs(plain_edges(needs, "file_id", "needed"), node(programs, "file_id"), node(libraries, "needed")).select(F.col("src").alias("file_id"), F.col("dst").alias("needed"))
    return programs.join(needs.select("file_id", "needed"), "file_id").join(libraries, "needed").select("nevra", "program", "library").distinct().orderBy("nevra", "program", "library")


def privileged_reach(cat: Catalog, set_name: str, reference: str, mask: int = SETID) -> DataFrame:
    """Programs with a set-id bit that can reach the name."""
    privileged = cat["file_attribute"].where(S.has(F.col("mode"), mask)).select("attribute_id")
    return reach(cat, set_name, cat["file"].join(privileged, "attribute_id", "left_semi"), reference)


def plugin_reach_list(cat: Catalog, set_name: str, defines: Sequence[str], reference: str) -> DataFrame:
    """Files that define any of the names and can reach the reference."""
    plugins = cat["elf_definition"].where(F.col("name").isin(list(defines))).select("contents_id")
    return reach(cat, set_name, cat["file"].join(plugins, "contents_id", "left_semi"), reference)


def plugin_reach_regex(cat: Catalog, set_name: str, regex: str, reference: str) -> DataFrame:
    """Files that define a name that matches and can reach the reference."""
    plugins = cat["elf_definition"].where(F.col("name").rlike(regex)).select("contents_id")
    return reach(cat, set_name, cat["file"].join(plugins, "contents_id", "left_semi"), reference)


def symbol_collisions(cat: Catalog, set_name: str, path_regex: str = LIBRARY_PATHS, exclude: Sequence[str] = COMMON_SYMBOLS, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """Symbols that two libraries of a set define: other package, other soname, same architecture.

    Definitions are cut to the set's libraries, made distinct and stored before they meet, and symbols of one soname drop
    out. What is left of a symbol is dealt to blocks of about `block` libraries, and each pair of blocks is a join key of
    its own: a symbol that every library defines is spread over as many tasks as its pairs need. A row is copied once for
    each block of its symbol and once more. Symbols share some `cells` keys by their pairs, blocks growing beyond that, so
    copies grow with the rows; the pairs, which are the result, grow with their square."""
    objects = cat["elf_file"].select("contents_id", "arch", "soname").where("soname is not null and arch is not null")
    libraries = storage.store(set_files(cat, set_name).where(F.col("file").rlike(path_regex)).join(objects, "contents_id").select("contents_id", "arch", "soname", "package_id", "nevra", "file"), "libraries")
    defined = cat["elf_definition"].select("contents_id", "name").where(~F.col("name").isin(list(exclude)))
    defined = defined.join(libraries.select("contents_id"), "contents_id", "left_semi").distinct()
    rows = storage.store(libraries.join(defined, "contents_id"), "defined")
    n = F.count("*").cast("double")
    shared = rows.groupBy("name", "arch").agg(F.min("soname").alias("a"), F.max("soname").alias("b"), n.alias("n")).where("a <> b").select("name", "arch", "n")
    total = shared.agg(F.sqrt(F.sum(F.col("n") * F.col("n")) / cells).alias("side"))
    blocks = F.least(F.floor(F.col("n") / block) + 1, F.ceil(F.col("n") / F.col("side"))).alias("blocks")
    dealt = rows.join(shared.join(F.broadcast(total)).select("name", "arch", blocks), ["name", "arch"]).withColumn("own", F.pmod(F.xxhash64("contents_id", "package_id", "file"), F.col("blocks")))
    # A pair of blocks meets once, the lower one on the left; within a block, and then within a pair, contents decide. Tasks
    # follow the keys, not the bytes that come in, which are few beside the pairs that go out.
    key = ["name", "arch", "low", "high"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = dealt.withColumn("low", F.col("own")).withColumn("high", F.explode(F.sequence("own", F.col("blocks") - 1))).repartition(tasks, *key).alias("a")
    b = dealt.withColumn("high", F.col("own")).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), "own"))).repartition(tasks, *key).alias("b")
    on = reduce(and_, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in key))
    less = F.col("a.contents_id") < F.col("b.contents_id")
    on = on & (less | (F.col("a.low") < F.col("a.high"))) & (F.col("a.contents_id") != F.col("b.contents_id")) & (F.col("a.package_id") != F.col("b.package_id")) & (F.col("a.soname") != F.col("b.soname"))
    first = lambda c: F.when(less, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    second = lambda c: F.when(less, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return a.join(b, on).select(F.col("a.name").alias("name"), first("nevra").alias("nevra_1"), first("file").alias("path_1"), second("nevra").alias("nevra_2"), second("file").alias("path_2"))


def unexpanded_macros_scripts(cat: Catalog, set_name: str, table: str = "package_script") -> DataFrame:
    """Script bodies with what looks like a macro left in, line by line outside comments."""
    kinds = [c for c in ("kind", "script_idx") if c in cat[table].columns]
    return set_packages(cat, set_name).join(cat[table].where(F.col("script").rlike(MACRO_TEXT)), "package_id").select("nevra", *kinds, "script").orderBy("nevra", *kinds)


def unexpanded_macros_paths(cat: Catalog, set_name: str) -> DataFrame:
    """File names with what looks like a macro left in."""
    return set_files(cat, set_name).where(F.col("file").rlike(MACRO_NAME)).select("nevra", "file").orderBy("nevra", "file")


def config_grep(cat: Catalog, set_name: str, path_prefix: str, needle: str) -> DataFrame:
    """Full contents with a needle, of files below a path, with bytes outside printable ASCII escaped as octal."""
    kept = cat["file_contents"].select("contents_id", F.decode("contents", "ISO-8859-1").alias("text")).where(F.contains("text", F.lit(needle)))
    found = set_files(cat, set_name).where(F.startswith("file", F.lit(path_prefix))).join(kept, "contents_id")
    octal = lambda c: F.when(c == "\\", F.lit("\\\\")).when((F.ascii(c) == 0) | (F.ascii(c) > 127), F.concat(F.lit("\\"), F.lpad(F.conv(F.ascii(c).cast("string"), 10, 8), 3, "0"))).otherwise(c)
    plain = ~F.col("text").rlike(r"[\x00\\\u0080-ÿ]")
    return found.select("nevra", "file", F.when(plain, F.col("text")).otherwise(F.array_join(F.transform(F.split("text", ""), octal), "")).alias("contents")).orderBy("nevra", "file")


def permission_audit(expected: DataFrame, actual: DataFrame, key: str = "path", columns: Sequence[str] = ("user_name", "group_name", "permissions")) -> DataFrame:
    """(key, status, actual_*, expected_*): differing, unexpected and missing rows, from one full join."""
    a = actual.select(key, *(F.col(c).alias(f"actual_{c}") for c in columns), F.lit(True).alias("_a"))
    e = expected.select(key, *(F.col(c).alias(f"expected_{c}") for c in columns), F.lit(True).alias("_e"))
    same = F.struct(*(f"actual_{c}" for c in columns)).eqNullSafe(F.struct(*(F.col(f"expected_{c}").alias(f"actual_{c}") for c in columns)))
    status = F.when(F.col("_e").isNull(), "unexpected").when(F.col("_a").isNull(), "missing").when(~same, "different")
    both = a.join(e, key, "full_outer").withColumn("status", status).where("status is not null")
    return both.drop("_a", "_e").orderBy(key)


def writable_executable(cat: Catalog, set_name: str) -> DataFrame:
    """(nevra, file, type) of segments that are both."""
    both = cat["elf_program_header"].where("writable and executable").select("contents_id", "type")
    return set_files(cat, set_name).join(both, "contents_id").select("nevra", "file", "type").orderBy("nevra", "file", "type")


def missing_marker(cat: Catalog, set_name: str, type_: int = STACK_MARKER, condition: str = "not (writable and executable)") -> DataFrame:
    """(nevra, file) of image files without a segment of a type that meets a condition."""
    marked = cat["elf_program_header"].where((F.col("type") == type_) & F.expr(condition)).select("contents_id")
    images = cat["elf_file"].select("contents_id").join(marked, "contents_id", "left_anti")
    return set_files(cat, set_name).join(images, "contents_id", "left_semi").select("nevra", "file").orderBy("nevra", "file")


def file_listing(cat: Catalog, nvra: str | None = None) -> DataFrame:
    """Files, directories and symlinks of a package (or of all) with mode and flag text, by name."""
    files = cat["file"].join(cat["file_contents"].select("contents_id", "length"), "contents_id").select("package_id", "attribute_id", "name", "length", "inode")
    directories = cat["directory"].select("package_id", "attribute_id", "name", F.lit(0).cast("long").alias("length"), F.lit(0).alias("inode"))
    links = cat["symlink"].select("package_id", "attribute_id", F.concat("name", F.lit(" -> "), "target").alias("name"), F.length("target").cast("long").alias("length"), F.lit(0).alias("inode"))
    p = cat["package"]
    chosen = p.select("package_id", S.nvra(p["name"], p["version"], p["release"], p["kind"], p["arch"]).alias("nvra"))
    if nvra is not None:
        chosen = chosen.where(F.col("nvra") == nvra)
    rows = files.unionByName(directories).unionByName(links).join(chosen, "package_id").join(cat["file_attribute"], "attribute_id")
    return rows.select("nvra", S.file_mode_full(F.col("mode")).alias("mode"), "caps", S.file_flags(F.col("flags")).alias("flags"), "inode", "user_name", "group_name", "length", "name").orderBy("nvra", "name")


def locate_by_digest(cat: Catalog, digest: str, cached: DataFrame | None = None) -> DataFrame:
    """(package digest, path) of every file whose contents have the digest; only 20- and 32-byte package digests, and cached ones where a cache is given."""
    files = cat["file"].join(cat["file_contents"].where(F.col("digest") == digest).select("contents_id"), "contents_id", "left_semi").select("package_id", F.col("name").alias("path"))
    packages = cat["package_digest"].where(F.length("digest").isin(40, 64)).select("package_id", "digest")
    if cached is not None:
        packages = packages.join(cached.select("digest"), "digest", "left_semi")
    return files.join(packages, "package_id").select("digest", "path")


def dependency_listing(cat: Catalog) -> DataFrame:
    """(nevra, kind, capability, op, version), sorted, kinds in their own order."""
    p = cat["package"]
    named = p.select("package_id", nevra_of(p).alias("nevra"))
    rows = cat["package_dependency"].join(named, "package_id").select("nevra", "kind", "capability", S.version_comparison(F.col("flags")).alias("op"), "version")
    return rows.orderBy("nevra", S.enum_ordinal("dependency", F.col("kind")), "capability", "op", "version")


def script_listing(cat: Catalog, table: str = "package_script") -> DataFrame:
    """Scripts, trigger scripts or conditions with their package, newlines shown as ^J."""
    p = cat["package"]
    named = p.select("package_id", S.nvra(p["name"], p["version"], p["release"], p["kind"], p["arch"]).alias("nvra"))
    rows = cat[table].join(named, "package_id")
    if "script" in rows.columns:
        rows = rows.withColumn("script", F.replace("script", F.lit("\n"), F.lit("^J")))
    order = [S.enum_ordinal("script", F.col("kind"))] if "kind" in rows.columns else []
    return rows.drop("package_id").orderBy("nvra", *order, *(["script_idx"] if "script_idx" in rows.columns else []))


def metadata_search(packages: DataFrame, needle: str, columns: Sequence[str] = ("name", "summary", "description", "license", "rpm_group"), mode: str = "contains") -> DataFrame:
    """Packages with a column that contains, matches (regex) or contains regardless of case (ilike) the needle."""
    test = {"contains": lambda c: F.contains(c, F.lit(needle)), "regex": lambda c: F.col(c).rlike(needle), "ilike": lambda c: F.contains(F.lower(c), F.lit(needle.lower()))}[mode]
    found = F.lit(False)
    for c in columns:
        if c in packages.columns:
            found = found | F.coalesce(test(c), F.lit(False))
    return packages.where(found)


def arch_mismatch(cat: Catalog) -> DataFrame:
    """Distinct (package arch, file arch) pairs that differ."""
    rows = cat["package"].select("package_id", F.col("arch").alias("package_arch")).join(cat["file"].select("package_id", "contents_id"), "package_id").join(cat["elf_file"].select("contents_id", F.col("arch").alias("file_arch")), "contents_id")
    return rows.where("package_arch <> file_arch").select("package_arch", "file_arch").distinct().orderBy("package_arch", "file_arch")


def capability_lookup(cat: Catalog, kind: str, capability: str) -> DataFrame:
    """(package_id, version) of packages with a dependency of a kind on a capability."""
    return cat["package_dependency"].where((F.col("kind") == kind) & (F.col("capability") == capability)).select("package_id", "version").distinct()


def class_hierarchy(cat: Catalog, super_class: str | None = None, interface: str | None = None, reference: str | None = None) -> DataFrame:
    """(class_id, name) of classes with a super class, an interface or a reference; several conditions must all hold."""
    found = cat["java_class"]
    if super_class is not None:
        found = found.where(F.col("super_class") == super_class)
    for table, name in (("java_interface", interface), ("java_class_reference", reference)):
        if name is not None:
            found = found.join(cat[table].where(F.col("name") == name).select("class_id"), "class_id", "left_semi")
    return found.select("class_id", "name")
