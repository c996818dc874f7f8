"""Checks of constraints, keys and references."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotscan.sources.schemas import schemas


def check_constraints(df: DataFrame, rules: Mapping[str, Column], key: str) -> DataFrame:
    """(rule, key) of rows that break a rule; as in SQL a null outcome passes. One scan for all rules."""
    broken = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())))
    return df.select(F.explode(broken).alias("rule"), key)


def check_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts; keys with a null don't count as equal."""
    return df.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def check_foreign_keys(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose key has no parent; null keys pass."""
    keys = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(keys, key, "left_anti")


def attribute_consistency(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, n_distinct): equal when no row of attributes repeats. Two aggregations, the first combined map-side."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("c"))
    return counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct"))


# What the tables' columns must hold, besides being present where the schema says so.
CHECKS = {
    "package": {"epoch": "epoch >= 0", "name": "length(name) > 0", "version": "length(version) > 0", "release": "length(release) > 0", "arch": "length(arch) > 0", "hash": "length(hash) = 20", "source": "length(source) > 0", "build_host": "length(build_host) > 0"},
    "package_digest": {"digest": "length(digest) IN (20, 32)", "length": "length > 0"},
    "package_url": {"url": "length(url) > 0"},
    "package_dependency": {"flags": "flags >= 0"},
    "package_trigger_script": {"script_idx": "script_idx >= 0"},
    "package_trigger_condition": {"name": "length(name) > 0"},
    "file_contents": {"length": "length >= 0", "digest": "length(digest) = 32"},
    "file_attribute": {"mode": "mode >= 0", "user_name": "length(user_name) > 0", "group_name": "length(group_name) > 0", "row_hash": "length(row_hash) = 16"},
    "file": {"mtime": "mtime >= 0", "name": "length(name) > 0"},
    "symlink": {"name": "length(name) > 0", "target": "length(target) > 0", "mtime": "mtime >= 0"},
    "directory": {"name": "length(name) > 0", "mtime": "mtime >= 0"},
    "elf_file": {"ei_class": "ei_class BETWEEN 0 AND 255", "ei_data": "ei_data BETWEEN 0 AND 255", "e_type": "e_type BETWEEN 0 AND 65536", "e_machine": "e_machine BETWEEN 0 AND 65536", "build_id": "length(build_id) > 0"},
    "elf_definition": {"name": "length(name) > 0", "version": "length(version) > 0", "symbol_type": "symbol_type BETWEEN 0 AND 15", "binding": "binding BETWEEN 0 AND 15", "primary_version": "version IS NOT NULL OR NOT primary_version", "xsection": "(xsection IS NOT NULL) = (section = -1)"},
    "elf_reference": {"name": "length(name) > 0", "version": "length(version) > 0", "symbol_type": "symbol_type BETWEEN 0 AND 15", "binding": "binding BETWEEN 0 AND 15"},
    "java_class": {"access_flags": "access_flags BETWEEN 0 AND 65536", "name": "length(name) > 0", "digest": "length(digest) = 32"},
    "java_interface": {"name": "length(name) > 0"},
    "java_class_reference": {"name": "length(name) > 0"},
    "java_error": {"message": "length(message) > 0"},
    "xml_error": {"line": "line >= 0"},
    "python_import": {"name": "length(name) > 0"},
    "python_attribute": {"name": "length(name) > 0"},
    "python_function_def": {"name": "length(name) > 0"},
    "python_class_def": {"name": "length(name) > 0"},
    "python_error": {"line": "line > 0", "message": "length(message) > 0"},
    "url_cache": {"url": "url LIKE '%:%'"},
}
# Columns that are unique together.
KEYS = {
    "package": [["package_id"], ["hash"]],
    "package_digest": [["digest"]],
    "package_url": [["package_id", "url"]],
    "package_script": [["package_id", "kind"]],
    "package_trigger_script": [["package_id", "script_idx"]],
    "package_set": [["set_id"], ["name"]],
    "file_contents": [["contents_id"], ["digest"]],
    "file_attribute": [["attribute_id"], ["row_hash"]],
    "file": [["file_id"], ["package_id", "name"]],
    "symlink": [["package_id", "name"]],
    "directory": [["package_id", "name"]],
    "elf_file": [["contents_id"]],
    "elf_needed": [["contents_id", "name"]],
    "elf_rpath": [["contents_id", "path"]],
    "elf_runpath": [["contents_id", "path"]],
    "java_class": [["class_id"], ["digest"]],
    "java_interface": [["class_id", "name"]],
    "java_class_reference": [["name", "class_id"]],
    "java_class_contents": [["contents_id", "class_id"]],
    "url_cache": [["url"]],
}
# The table that a column names a row of, wherever else it stands, and where it does so under another name.
OWNERS = {"package_id": "package", "set_id": "package_set", "contents_id": "file_contents", "attribute_id": "file_attribute", "file_id": "file", "class_id": "java_class"}
OTHER_OWNERS = {("elf_closure", "needed"): ("file", "file_id")}


def _key(columns: list[str]) -> Column:
    return F.array_join(F.array(*(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in columns)), ", ").alias("key")


def check_contract(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, kind, rule, key) of what breaks the contract in tables, by name: kind is `missing` (a null that may not be),
    `check`, `unique` or `reference`. Rules hold for the columns that a table has, references for the tables that are given.

    A table is scanned once for its rules; each key is an aggregate and each reference an anti join of distinct values.
    """
    contract, found = schemas(), []
    for name, df in tables.items():
        columns = set(df.columns) & set(contract[name].names)
        known = [k for k in KEYS.get(name, ()) if columns.issuperset(k)]
        shown = known[0] if known else [c for c in contract[name].names if c in columns][:2]
        rules = {("missing", f.name): F.col(f.name).isNotNull() for f in contract[name] if not f.nullable and f.name in columns}
        rules |= {("check", c): F.expr(rule) for c, rule in CHECKS.get(name, {}).items() if columns.issuperset(set(re.findall("[a-z_]+", rule)) & set(contract[name].names))}
        broken = F.array_compact(F.array(*(F.when(~ok, F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("rule"))) for (kind, c), ok in rules.items())))
        where = F.lit(name).alias("table")
        found.append(df.select(where, F.explode(broken).alias("b"), _key(shown)).select("table", "b.kind", "b.rule", "key"))
        for k in known:
            found.append(check_unique(df, k).select(where, F.lit("unique").alias("kind"), F.lit(", ".join(k)).alias("rule"), _key(k)))
        for c in sorted(columns):
            parent, key = OTHER_OWNERS.get((name, c), (OWNERS.get(c), c))
            if parent in tables and parent != name:
                lost = check_foreign_keys(df.select(c).distinct(), tables[parent], c, key)
                found.append(lost.select(where, F.lit("reference").alias("kind"), F.lit(c).alias("rule"), _key([c])))
    return reduce(DataFrame.unionByName, found)
