"""Writing tables, segments and reports as partitioned folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions import text as tx
from muster.operators.report import counts_by, values
from muster.operators.schema import drop_helpers
from muster.plans.storage import cut_lineage


# White space is content; an absent value is an empty field.
CSV = {
    "header": True, "escape": '"', "emptyValue": "", "nullValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str, helpers: bool = False) -> None:
    """One table as CSV; working columns are left out unless asked for."""
    out = df if helpers else drop_helpers(df)
    out.write.mode("errorifexists").options(**CSV).csv(path)


def write_split(df: DataFrame, path: str, segment: str, rows_per_file: int = 1_000_000) -> None:
    """One folder per segment.

    Nothing is shuffled: a task writes to the folders of the segments it reads,
    so a segment that holds most rows is written by many tasks.
    """
    df.write.mode("errorifexists").partitionBy(segment).options(**CSV, maxRecordsPerFile=rows_per_file).csv(path)


def manifest(df: DataFrame, segment: str, known: list[str]) -> DataFrame:
    """Rows per known segment, empty ones included."""
    listed = values(df.sparkSession, [(s,) for s in known], segment)
    return listed.join(counts_by(df, segment), segment, "left").select(segment, F.coalesce("n", F.lit(0)).alias("n"))


def write_tables(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """A bundle of named tables, one folder each; returns the folders."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{path}/{name}"
        write_csv(df, out[name])
    return out


def write_sections(coverage: DataFrame, path: str, sponsor: str = "sponsor") -> None:
    """Report folders by sponsor and section: all targets, included, excluded."""
    flag = F.when(F.col("included") == "Yes", "included").otherwise("excluded")
    each = coverage.withColumn("section", F.explode(F.array(F.lit("all"), flag)))
    each.write.mode("errorifexists").partitionBy(sponsor, "section").option("header", True).csv(path)


def file_name(c) -> Column:
    """Name without characters a file system refuses, single spaces."""
    return tx.collapse(F.regexp_replace(tx.col(c), r'[\\/:*?"<>|]', " "))


def folder_name(c) -> Column:
    """Letters, digits, hyphens and underscores; spaces become underscores."""
    return F.replace(F.trim(F.regexp_replace(tx.col(c), r"[^A-Za-z0-9\-_ ]+", "")), F.lit(" "), F.lit("_"))


def loose_name(c) -> Column:
    """Anything but word characters and ``-.() `` becomes an underscore."""
    return F.replace(F.trim(F.regexp_replace(tx.col(c), r"(?U)[^\w\-\.\(\) ]+", "_")), F.lit("  "), F.lit(" "))


def sheet_names(names: DataFrame, name: str, pos: str, size: int = 31) -> DataFrame:
    """``(name, sheet)``: at most ``size`` characters, no two alike.

    ``names`` holds distinct names.  Of names that shorten to the same text the
    first keeps it and the others get a number.  Where a numbered text is
    already another sheet, its name tries the next numbers, until none clashes:
    a round settles at least one name of every clash, and the driver only learns
    whether any are left.
    """
    short = F.substring(F.regexp_replace(F.col(name), r"[\[\]\:\*\?\/\\]", "_"), 1, size)
    base = F.when(short != "", short).otherwise("Sheet")
    first = F.row_number().over(Window.partitionBy("_base").orderBy("_pos")) - 1
    rows = names.select(F.col(name).alias("_name"), F.col(pos).alias("_pos"), base.alias("_base")).withColumn("_nth", first)
    suffix = F.concat(F.lit("_"), F.col("_nth").cast("string"))
    numbered = F.concat(F.substring(F.col("_base"), F.lit(1), F.lit(size) - F.char_length(suffix)), suffix)
    label = F.when(F.col("_nth") == 0, F.col("_base")).otherwise(numbered)
    while True:
        rows = rows.withColumn("_sheet", label)
        # Plain texts stand; then those with the smaller number, then the earlier name.
        place = F.row_number().over(Window.partitionBy("_sheet").orderBy("_nth", "_base", "_pos"))
        judged = cut_lineage(rows.withColumn("_lost", place > 1))
        if judged.filter("_lost").isEmpty():
            return judged.select(F.col("_name").alias(name), F.col("_sheet").alias("sheet"))
        # What lost tries numbers above all that its base has used, in order.
        used = F.max("_nth").over(Window.partitionBy("_base"))
        again = F.row_number().over(Window.partitionBy("_base", "_lost").orderBy("_pos"))
        rows = judged.withColumn("_nth", F.when(F.col("_lost"), used + again).otherwise(F.col("_nth"))).drop("_lost", "_sheet")


def file_label(base: str, member: Column, count: Column) -> Column:
    return F.concat_ws(" - ", F.lit(base), member, count.cast("string"))
