"""A load in two jobs: the entries of new packages into files, contents and facts; then the set, from the newest listed
packages and what of them is loaded to the changed set and its closure."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotscan import storage

from .closure import closure_refresh, soname_providers, suppress_conflicts
from .extract import classify_contents, python_facts, xml_facts
from .ingest import contents_preview, entry_router, ghost_normalize, ids_of, intern_attributes, intern_contents, package_by_digest
from .sets import exclude_names, latest_per_name_arch, set_apply, set_diff


class SetRefresh(NamedTuple):
    members: DataFrame
    to_load: DataFrame
    changes: DataFrame
    closure: DataFrame | None


ATTRIBUTES = ["mode", "flags", "user_name", "group_name", "caps"]


class Loaded(NamedTuple):
    files: DataFrame
    directories: DataFrame
    symlinks: DataFrame
    attributes: DataFrame
    contents: DataFrame
    marked: DataFrame
    kinds: DataFrame
    python: DataFrame
    xml: DataFrame
    errors: DataFrame


def load_packages(entries: DataFrame, contents: DataFrame) -> Loaded:
    """Rows to add for the entries (package_id, name, mode, nlinks, target, flags, inode, mtime, user_name, group_name, caps,
    data) of new packages; contents (digest, contents_id) are those known.

    Each entry goes by its type to files, directories, symlinks or errors. Files share a row for each content and for each set
    of attributes. Only contents that weren't known are kept (contents_id, digest, length, preview), told their kind and
    parsed, once each however many files have them: python has names and errors, xml typed URLs and errors (see
    python_facts, xml_facts). Bytes travel once, one copy of each new content; files go on without them."""
    routed = entry_router(entries)
    files = ghost_normalize(routed.files.withColumns({"digest": F.sha2("data", 256), "length": F.octet_length("data").cast("long")}))
    slim = storage.store(files.drop("data", "nlinks", "target"), "load-files")
    interned = intern_contents(slim, contents)
    marked = storage.store(interned.marked, "load-marked")
    attributes, keyed = intern_attributes(slim, ATTRIBUTES)
    keyed = storage.store(ids_of(keyed, marked).drop(*ATTRIBUTES), "load-files")

    added = storage.store(interned.mapping.where("added").select("digest", "contents_id"), "load-added")
    data = F.when(F.col("length") > 0, F.col("data")).otherwise(F.lit(b""))  # a ghost has no bytes, whatever its entry holds
    bodies = files.join(added, "digest").groupBy("contents_id", "digest").agg(F.first("length").alias("length"), F.first(data).alias("contents"))
    bodies = storage.store(bodies, "load-contents")
    names = keyed.select("contents_id", "name")
    kinds = storage.store(classify_contents(bodies, names), "load-kinds")
    of = lambda kind: bodies.join(kinds.where(F.col("kind") == kind).select("contents_id"), "contents_id", "left_semi").select("contents_id", "contents")
    python = storage.store(python_facts(of("python")), "load-python")
    xml = storage.store(xml_facts(of("xml"), "contents_id", "contents"), "load-xml")
    previews = contents_preview(names.join(added.select("contents_id"), "contents_id", "left_semi"), bodies)
    new = bodies.select("contents_id", "digest", "length").join(previews, "contents_id")
    others = [df.drop("data", "nlinks", "inode", *(() if keep else ("target",))) for df, keep in ((routed.directories, False), (routed.symlinks, True))]
    return Loaded(keyed, *others, attributes, new, marked, kinds, python, xml, routed.errors.drop("data"))


def refresh_set(listings: DataFrame, digests: DataFrame, members: DataFrame, set_id: int, packages: DataFrame, files: DataFrame, elf: DataFrame, needed: DataFrame, patterns: list[str] | None = None, ignore_errors: bool = False, ignored_paths: list[str] | None = None, ignored_packages: list[str] | None = None) -> SetRefresh:
    """One set brought up to the listings: (member table, listed packages still to load, changes, closure or None).

    listings are entries of all repositories with a digest; the newest of each name and architecture less the excluded
    ones make up the set, as far as their digests are those of loaded packages. With any left to load the set stays as
    it is, unless ignore_errors. A set that didn't change keeps its closure, so None is returned for it. needed has
    file, path, arch and needed_name of all files; those of the set's packages count.
    """
    listed, _ = exclude_names(latest_per_name_arch(listings), patterns or [])
    known, to_load = package_by_digest(listed, digests)
    wanted = known.select("package_id").distinct()
    mine = members.where(F.col("set_id") == set_id).select("package_id")
    if not ignore_errors and not to_load.isEmpty():
        wanted = mine.distinct()
    changes, changed = set_diff(mine, wanted, ["package_id"])
    providers = suppress_conflicts(soname_providers(wanted, packages, files, elf), ignored_paths or [], ignored_packages or [])
    own = needed.join(files.join(wanted, "package_id", "left_semi").select(F.col("file_id").alias("file")).distinct(), "file", "left_semi")
    return SetRefresh(set_apply(members, set_id, wanted), to_load, changes, closure_refresh(changed, own, providers))
