"""Version order of the RPM package manager as sortable columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """An array of structs whose order is the version's: ~ before the end, the end before ^, letters before numbers,
    numbers by value (length, then digits, without leading zeros); separators only part segments.
    """

    def part(token: Column) -> Column:
        digits = F.regexp_replace(token, "^0+(?=.)", "")
        number = token.rlike("^[0-9]")
        rank = F.when(token == "~", 0).when(token == "^", 2).when(number, 4).otherwise(3)
        return F.struct(rank.alias("rank"), F.when(number, F.length(digits)).otherwise(0).alias("len"), F.when(number, digits).otherwise(token).alias("text"))

    end = F.struct(F.lit(1).alias("rank"), F.lit(0).alias("len"), F.lit("").alias("text"))
    return F.concat(F.transform(F.regexp_extract_all(version, F.lit(r"([0-9]+|[a-zA-Z]+|~|\^)"), F.lit(1)), part), F.array(end))


def evr_key(epoch: Column, version: Column, release: Column) -> Column:
    """Sortable (epoch, version, release); no epoch counts as 0."""
    return F.struct(F.coalesce(epoch.cast("long"), F.lit(0).cast("long")).alias("e"), version_key(version).alias("v"), version_key(release).alias("r"))


def evr_less(e1: Column, v1: Column, r1: Column, e2: Column, v2: Column, r2: Column) -> Column:
    return evr_key(e1, v1, r1) < evr_key(e2, v2, r2)
