"""Library dependencies: who provides a name, which provider is meant, and everything reachable."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotscan.functions import scalar as S
from depotscan.operators.graph import Change, maintain_closure, plain_edges, transitive_closure

# Preferred directories and weights of the ranking.
LIBRARY_DIRECTORIES = ("/lib/", "/lib64/", "/usr/lib/", "/usr/lib64/")
LIBRARY_WEIGHT, DIRECTORY_WEIGHT, LETTER_WEIGHT = 100_000, 10_000, 2
SHARED_OBJECT = 3


class Merge(NamedTuple):
    deleted: DataFrame
    inserted: DataFrame
    table: DataFrame


def soname_providers(members: DataFrame, packages: DataFrame, files: DataFrame, elf: DataFrame) -> DataFrame:
    """(arch, soname, file_id, path, package) of the shared objects of a set's packages; no soname reads as the base
    name, no architecture as the empty one."""
    objects = elf.where(F.col("e_type") == SHARED_OBJECT).select("contents_id", "arch", "soname")
    named = members.select("package_id").distinct().join(packages.select("package_id", F.col("name").alias("package")), "package_id").join(files.select("package_id", "file_id", "contents_id", F.col("name").alias("path")), "package_id").join(objects, "contents_id")
    return named.select(F.coalesce("arch", F.lit("")).alias("arch"), F.coalesce(F.nullif("soname", F.lit("")), S.base_name(F.col("path"))).alias("soname"), "file_id", "path", "package")


def suppress_conflicts(providers: DataFrame, path_prefixes: list[str], packages: list[str]) -> DataFrame:
    """Without the ignored candidates of a name, where just one other remains."""
    ignored = F.col("package").isin(packages) if packages else F.lit(False)
    for p in path_prefixes:
        ignored = ignored | F.startswith("path", F.lit(p))
    marked = providers.withColumn("_ignored", ignored)
    counts = marked.groupBy("arch", "soname").agg(F.count("*").alias("_n"), F.count_if("_ignored").alias("_i"))
    single = counts.where("_i > 0 and _i + 1 = _n").select("arch", "soname", F.lit(True).alias("_single"))
    return marked.join(single, ["arch", "soname"], "left").where(~(F.col("_ignored") & F.coalesce("_single", F.lit(False)))).select(providers.columns)


def provider_priority(candidate: Column, needing: Column) -> Column:
    """How well a library's path fits the file that needs it."""
    library = F.lit(False)
    for d in LIBRARY_DIRECTORIES:
        library = library | F.startswith(candidate, F.lit(d))
    return F.when(library, LIBRARY_WEIGHT).otherwise(0) + F.when(S.same_directory(candidate, needing), DIRECTORY_WEIGHT).otherwise(0) + LETTER_WEIGHT * S.common_prefix_length(candidate, needing) - F.length(candidate)


def resolve_needed(needed: DataFrame, providers: DataFrame, best_only: bool = False) -> DataFrame:
    """(file, needed_name, provider, rank, path, package): candidates of the same architecture, the best with rank 1.

    needed has file, path, arch, needed_name, each (file, needed_name) once. A single candidate wins unscored, by a join
    alone; then the higher score, the smaller package, path and file decide, so the order is total. Where there is a
    choice, files with one path are scored together. With best_only just rank 1 is made, by an aggregate that keeps one
    candidate of each name in each task.
    """
    wanted = needed.select("file", F.col("path").alias("needing"), F.coalesce("arch", F.lit("")).alias("arch"), F.col("needed_name").alias("soname"))
    several = providers.groupBy("arch", "soname").agg(F.count("*").alias("n"), F.first(F.struct("file_id", "path", "package")).alias("only"))
    named = wanted.join(several, ["arch", "soname"])
    columns = ["file", F.col("soname").alias("needed_name"), F.col("r.file_id").alias("provider"), "rank", "r.path", "r.package"]
    alone = named.where("n = 1").select("file", "soname", F.col("only").alias("r"), F.lit(1).alias("rank"))
    choices = named.where("n > 1").select("file", "needing", "arch", "soname")
    pairs = choices.select("needing", "arch", "soname").distinct().join(providers, ["arch", "soname"])
    place = F.struct((-provider_priority(F.col("path"), F.col("needing"))).alias("s"), "package", "path", "file_id").alias("r")
    scored = pairs.select("needing", "arch", "soname", place)
    key = ["needing", "arch", "soname"]
    if best_only:
        ranked = scored.groupBy(*key).agg(F.min("r").alias("r")).withColumn("rank", F.lit(1))
    else:
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("r")))
    return alone.select(*columns).unionByName(choices.join(ranked, key).select(*columns))


def missing_needed(needed: DataFrame, providers: DataFrame) -> DataFrame:
    """Needed names without a provider, of architectures that have providers at all."""
    wanted = needed.select("file", F.coalesce("arch", F.lit("")).alias("arch"), F.col("needed_name").alias("soname"))
    short = wanted.join(F.broadcast(providers.select("arch").distinct()), "arch", "left_semi")  # a row per architecture
    return short.join(providers.select("arch", "soname"), ["arch", "soname"], "left_anti").select("file", "arch", F.col("soname").alias("needed_name"))


def soname_conflicts(needed: DataFrame, providers: DataFrame, separator: str | None = None) -> DataFrame:
    """(file, needed_name, choices): names with several candidates, the chosen one first, as package and path; one text,
    where a separator is given.

    needed has each (file, needed_name) once. Candidates of one package and path are counted, not repeated, until a list
    is written out. A list is made once for each path that needs a name and joined to the files last, so what is shuffled
    follows the lists and the files, not their product."""
    key = ["needing", "arch", "soname"]
    wanted = needed.select("file", F.col("path").alias("needing"), F.coalesce("arch", F.lit("")).alias("arch"), F.col("needed_name").alias("soname"))
    alike = providers.groupBy("arch", "soname", "package", "path").agg(F.count("*").cast("int").alias("n"))
    place = F.struct((-provider_priority(F.col("path"), F.col("needing"))).alias("s"), "package", "path", "n")
    ranked = wanted.select(*key).distinct().join(alike, ["arch", "soname"]).groupBy(*key).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(place)).alias("c")).where("n > 1")
    choices = F.flatten(F.transform("c", lambda x: F.array_repeat(F.concat(x["package"], F.lit(":"), x["path"]), x["n"])))
    lists = ranked.select(*key, (choices if separator is None else F.array_join(choices, separator)).alias("choices"))
    return wanted.join(lists, key).select("file", F.col("soname").alias("needed_name"), "choices")


def closure_diff_merge(old: DataFrame, new: DataFrame) -> Merge:
    """Pairs to delete and to insert; the merged table rewrites nothing else."""
    deleted, inserted = old.join(new, old.columns, "left_anti"), new.join(old, old.columns, "left_anti").select(old.columns)
    return Merge(deleted, inserted, old.join(new, old.columns, "left_semi").unionByName(inserted))


def closure_refresh(changed: DataFrame, needed: DataFrame, providers: DataFrame) -> DataFrame | None:
    """The set's closure, or None when changed (one row, from set_diff) says that nothing did."""
    if not changed.first()["changed"]:
        return None
    chosen = resolve_needed(needed, providers, best_only=True)
    return transitive_closure(chosen, "file", "provider")


def closure_update(old: DataFrame, old_edges: DataFrame, needed: DataFrame, providers: DataFrame) -> tuple[DataFrame, Change]:
    """(the set's resolved edges, its closure with what changed): old, the closure of old_edges, is kept up to date, so the
    work follows the files whose libraries resolve otherwise than before."""
    edges = plain_edges(resolve_needed(needed, providers, best_only=True), "file", "provider")
    before = plain_edges(old_edges)
    return edges, maintain_closure(old, before, before.join(edges, ["src", "dst"], "left_anti"), edges.join(before, ["src", "dst"], "left_anti"))
