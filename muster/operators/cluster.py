"""Company name standardisation by clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions import text as tx
from muster.operators.fuzzy_join import scored_pairs
from muster.plans.storage import cut_lineage


def ordered_names(df: DataFrame, name: str) -> DataFrame:
    """Distinct names in case-insensitive order: ``(name, place)``.

    ``place`` sorts like the name itself.  Only comparisons and maxima of places
    are ever needed, so names are not numbered.
    """
    return df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(
        F.min(F.struct(F.lower(name).alias("low"), F.col(name).alias("raw"))).alias("place")
    )


def by_core(names: DataFrame) -> DataFrame:
    """``(core, place, first_name)``: one row per core, placed at its first name."""
    cored = names.withColumn("core", tx.company_core("name"))
    return cored.groupBy("core").agg(F.min("place").alias("place"), F.min_by("name", "place").alias("first_name"))


def core_keys(cores: DataFrame) -> DataFrame:
    """Non-empty cores as keys of a similarity join."""
    return cores.filter("core <> ''").select(F.col("core").alias("key"), F.col("place").alias("pos"))


def core_standard(cores: DataFrame) -> DataFrame:
    """Standard name shared by all spellings of a core."""
    named = F.when(F.col("core") != "", tx.title_case("core")).otherwise(tx.title_case("first_name"))
    return cores.withColumn("standard", named)


def merged_cores(cores: DataFrame, threshold: float = 94) -> DataFrame:
    """``(core, standard)`` of cores renamed by a similar one.

    Similar pairs are taken in order of (first, second) place and a later pair
    overwrites an earlier one, without transitive closure.  The last pair of a
    core is the one with its highest placed partner: a partner placed after it
    makes the core itself the first member, which beats any pair in which it is
    the second.  So one maximum per core replaces the list of all pairs.
    """
    keys = core_keys(cores)
    pairs = scored_pairs(keys, keys, "token_set", threshold, "last").filter("lpos <> rpos")
    # Of the pairs above the threshold keep the highest partner; pairs below it
    # lose against any other and are dropped afterwards.
    ok = F.when(F.col("score") >= threshold, F.struct("rpos", "rkey"))
    best = pairs.groupBy(F.col("lkey").alias("core"), "lpos").agg(F.max(ok).alias("p")).filter("p IS NOT NULL")
    # Of two cores of the same length the earlier one names the pair.
    own, other = F.char_length("core"), F.char_length("p.rkey")
    first = F.when(F.col("lpos") < F.col("p.rpos"), own <= other).otherwise(own < other)
    return best.select("core", tx.title_case(F.when(first, F.col("core")).otherwise(F.col("p.rkey"))).alias("standard"))


def standard_names(df: DataFrame, name: str, threshold: float = 94, fuzzy: bool = True) -> DataFrame:
    """``(original, standard)`` for every distinct name."""
    names = ordered_names(df, name)
    cores = core_standard(cut_lineage(by_core(names)))
    cored = names.select("name", tx.company_core("name").alias("core"))
    table = cores.select("core", "standard")
    if fuzzy:
        merged = merged_cores(cores, threshold).withColumnRenamed("standard", "_merged")
        table = table.join(merged, "core", "left").select("core", F.coalesce("_merged", "standard").alias("standard"))
    return cored.join(table, "core").select(F.col("name").alias("original"), "standard")
