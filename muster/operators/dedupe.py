"""Keep-first de-duplication and distinct variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions import text as tx


def keep_first(df: DataFrame, keys: list[Column | str], row_id: str = "row_id",
               keep_keyless: bool = False) -> DataFrame:
    """First row, by ``row_id``, of each combination of keys; nulls are equal.

    The rank filter becomes a group limit that runs before the shuffle, so a
    hot key sends one row per input partition, not all of its rows.
    ``keep_keyless`` keeps every row whose keys are all null.
    """
    cols = [tx.col(k) for k in keys]
    ranked = df.select("*", F.row_number().over(Window.partitionBy(*cols).orderBy(row_id)).alias("_nth"))
    if not keep_keyless:
        return ranked.filter("_nth = 1").drop("_nth")
    keyless = cols[0].isNull()
    for c in cols[1:]:
        keyless = keyless & c.isNull()
    first = df.filter(~keyless).select(
        "*", F.row_number().over(Window.partitionBy(*cols).orderBy(row_id)).alias("_nth")
    ).filter("_nth = 1").drop("_nth")
    return first.unionByName(df.filter(keyless))


def distinct_variants(df: DataFrame, name: str, row_id: str = "row_id") -> DataFrame:
    """Alternatives of every cell, one row per case-insensitive spelling."""
    parts = df.select(row_id, F.posexplode(tx.alternatives(name)).alias("_pos", "variant"))
    first = F.min_by("variant", F.struct(row_id, "_pos"))
    place = F.min(F.struct(row_id, "_pos"))
    return parts.groupBy(F.lower("variant").alias("key")).agg(first.alias("variant"), place.alias("first_seen"))


def distinct_names(df: DataFrame, name: str, row_id: str = "row_id") -> DataFrame:
    """Trimmed, non-blank names, one per case-insensitive spelling, first kept."""
    clean = df.select(F.col(row_id), tx.strip(name).alias(name)).filter(F.col(name) != "")
    return clean.groupBy(F.lower(name).alias("_key")).agg(
        F.min(row_id).alias(row_id), F.min_by(name, row_id).alias(name)
    ).drop("_key")
