"""Package sets: newest versions, differences, members, and what they refer to."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotscan.functions.versions import evr_key


class SetUpdate(NamedTuple):
    members: DataFrame
    failed: DataFrame


def latest_per_name_arch(df: DataFrame, name: str = "name", arch: str = "arch", epoch: str = "epoch", version: str = "version", release: str = "release", ordinal: str = "ordinal") -> DataFrame:
    """The newest row of each (arch, name); no epoch counts as 0; of equal versions the first by ordinal stays.

    An aggregate, not a window: each task keeps one row per name before the shuffle."""
    rank = F.struct(evr_key(F.col(epoch), F.col(version), F.col(release)).alias("k"), (-F.col(ordinal)).alias("o"))
    best = df.groupBy(arch, name).agg(F.max_by(F.struct(*(c for c in df.columns if c not in (arch, name))), rank).alias("r"))
    return best.select(arch, name, "r.*").select(df.columns)


def exclude_names(df: DataFrame, patterns: list[str], name: str = "name", ignore_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row with n_excluded); the patterns must match whole names."""
    if not patterns:
        return df, df.agg(F.lit(0).cast("long").alias("n_excluded"))
    out = F.coalesce(F.col(name).rlike(("(?i)" if ignore_case else "") + "^(?:" + "|".join(f"(?:{p})" for p in patterns) + r")\z"), F.lit(False))
    return df.where(~out), df.agg(F.count_if(out).alias("n_excluded"))


def set_lookup(sets: DataFrame, name: str) -> DataFrame:
    """(set_id) of a name: one row, null when there is none."""
    return sets.where(F.col("name") == name).agg(F.max("set_id").alias("set_id"))


def set_diff(current: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys and status: added, removed or unchanged; one row with changed)."""
    a = current.select(*keys).distinct().withColumn("_old", F.lit(True))
    b = wanted.select(*keys).distinct().withColumn("_new", F.lit(True))
    both = a.join(b, keys, "full_outer")
    rows = both.select(*keys, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("unchanged").alias("status"))
    return rows, rows.agg(F.coalesce(F.bool_or(F.col("status") != "unchanged"), F.lit(False)).alias("changed"))


def set_apply(members: DataFrame, set_id: int, wanted: DataFrame, action: str = "update") -> DataFrame:
    """The member table after an action on one set: update replaces its members, add and delete change them, empty removes all."""
    mine, others = members.where(F.col("set_id") == set_id), members.where(F.col("set_id") != set_id)
    new = wanted.select(F.lit(set_id).cast(members.schema["set_id"].dataType).alias("set_id"), "package_id").distinct()
    if action == "update":
        return others.unionByName(new)
    if action == "add":
        return members.unionByName(new.join(mine, ["set_id", "package_id"], "left_anti"))
    if action == "delete":
        return others.unionByName(mine.join(new, ["set_id", "package_id"], "left_anti"))
    if action == "empty":
        return others
    raise ValueError(f"unknown action: {action}")


def set_from_repos(listings: DataFrame, patterns: list[str], fetched: str = "fetched", ignore_errors: bool = False) -> SetUpdate:
    """Newest packages over all repositories less excluded names; what failed to arrive is listed. With ignore_errors
    those are left out, otherwise one failure leaves no members at all: one row, whether any failed, is broadcast for that."""
    kept, _ = exclude_names(latest_per_name_arch(listings), patterns)
    here = F.coalesce(F.col(fetched), F.lit(False))
    failed = kept.where(~here)
    members = kept.where(here)
    if not ignore_errors:
        none = failed.agg((F.count("*") == 0).alias("ok"))
        members = members.join(F.broadcast(none.where("ok")), F.lit(True), "left_semi")  # one row
    return SetUpdate(members, failed)


def referenced_digests(members: DataFrame, digests: DataFrame) -> DataFrame:
    """Digests of packages in any set, sorted; a package in two sets counts twice."""
    return members.join(digests, "package_id").select("digest").orderBy("digest")


def stale_cache(cached: DataFrame, referenced: DataFrame) -> DataFrame:
    """Cached digests less referenced ones, as a multiset difference, sorted."""
    return cached.select("digest").exceptAll(referenced.select("digest")).orderBy("digest")


def source_packages(listing: DataFrame, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(distinct names, sorted; distinct malformed sources): the archive's name without its last two dash-separated fields."""
    good = F.coalesce(F.col(source).rlike(r"(?s)^.+-[^-]*-[^-]*\z"), F.lit(False))
    names = listing.where(good).select(F.regexp_extract(source, r"(?s)^(.+)-[^-]*-[^-]*\z", 1).alias("name")).distinct().orderBy("name")
    return names, listing.where(~good).select(source).distinct()
