"""Records of delimited text, whatever files they come from.

Files are read line by line, so large ones are split.  Quoted values may hold
line breaks: whether a line begins inside quotes follows from the number of
quotes before it, which is a prefix scan: lines of a block first, then blocks of
a file.  Lines outside any such value are records as they stand; only the lines
of a record that spans several are brought together.

Facts of a file (encoding, delimiter, header) are rows joined to its lines on
the executors.  The driver sees distinct headers only, and one plan reads all
files, however many there are.

Quotes count where they open or close a value: beside a delimiter or the end of
a line, and not doubled.  Line breaks inside values come back as line feeds.  A
value that is never closed leaves the lines from its first one on as they are.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.plans.storage import cut_lineage

_ODD = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def decoded_path(path: Column) -> Column:
    """A file's path without its scheme, percent signs decoded."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*(?=/))?/*", "/")


def lines_of(spark: SparkSession, path) -> DataFrame:
    """``(file, block, line, value)``: lines with their place; ``line`` orders those of a block."""
    return spark.read.text(path).select(
        decoded_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")


def _set(seps: list[str]) -> str:
    return "[" + "".join("\\t" if s == "\t" else "\\" + s for s in seps) + "]"


def records_of(lines: DataFrame, seps: list[str]) -> DataFrame:
    """``lines`` with the lines of a record joined by line feeds; ``block`` and ``line`` are those of its first one."""
    keep = [c for c in lines.columns if c not in ("file", "block", "line", "value")]
    edge = F.lit(f'(?:^|{_set(seps)})"|"(?={_set(seps)}|$)')
    marked = lines.withColumn("odd", F.regexp_count(F.replace("value", F.lit('""'), F.lit("")), edge) % 2)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block of a file.
    blocks = marked.groupBy("file", "block").agg(F.sum("odd").alias("odds")).select(
        "file", "block", F.coalesce(F.sum("odds").over(earlier), F.lit(0)).alias("before"), F.sum("odds").over(Window.partitionBy("file")).alias("all"))
    inside = Window.partitionBy("file", "block").orderBy("line")
    so_far = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The n-th odd line opens a value if n is odd, and the next one closes it.
    placed = marked.join(blocks, ["file", "block"]).withColumn("nth", F.col("before") + so_far + F.col("odd"))
    opens = (F.col("odd") == 1) & (F.col("nth") % 2 == 1)
    held = F.when(F.col("odd") == 1, True).otherwise(F.col("nth") % 2 == 1)
    closed = F.col("nth") < F.when(F.col("all") % 2 == 1, F.col("all")).otherwise(F.col("all") + 1)
    placed = placed.withColumn("record", F.when(held & closed, F.when(opens, F.col("nth")).otherwise(F.col("nth") - F.col("odd"))))
    columns = ["file", "block", "line", "value", *keep]
    single = placed.filter("record IS NULL").select(*columns)
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    long = placed.filter("record IS NOT NULL").groupBy("file", "record").agg(parts.alias("parts"), *[F.first(c).alias(c) for c in keep])
    long = long.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["line"].alias("line"),
                       F.array_join(F.col("parts")["value"], "\n").alias("value"), *keep)
    return single.unionByName(long).filter(F.trim("value") != "")


def fields_of(value: Column, sep: str, width: int) -> Column:
    """The first ``width`` fields of a record as an array; null where there are fewer."""
    schema = ", ".join(f"f{k} STRING" for k in range(width))
    row = F.from_csv(value, schema, {"escape": '"', "sep": sep, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    return F.array(*[row[f"f{k}"] for k in range(width)])


def encoding_of(lines: DataFrame) -> DataFrame:
    """``(file, encoding)`` from the bytes of the lines; a byte order mark makes no difference."""
    raw = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    facts = lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(raw.rlike("[\u0081\u008d\u008f\u0090\u009d]")).alias("undefined"))
    name = F.when(F.col("utf8"), "utf-8")
    return facts.select("file", name.when(F.col("undefined"), "latin1").otherwise("cp1252").alias("encoding"))


def decoded(value: Column, encoding: Column) -> Column:
    """Text of a raw line; the 27 Windows characters that differ from Latin-1 are exchanged."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    was, now = "".join(map(chr, _ODD)), bytes(_ODD).decode("cp1252")
    return F.when(encoding == "utf-8", value).when(encoding == "cp1252", F.translate(latin, was, now)).otherwise(latin)


def column_names(header: str, sep: str) -> tuple[str, ...]:
    """Names of a header's columns: blank ones are numbered, repeated ones get their count."""
    out: list[str] = []
    for k, name in enumerate(next(csv.reader([header], delimiter=sep))):
        name, n = name if name.strip() else f"_c{k}", 0
        while (f"{name}.{n}" if n else name) in out:
            n += 1
        out.append(f"{name}.{n}" if n else name)
    return tuple(out)


def read_files(lines: DataFrame, facts: DataFrame | None = None, seps: list[str] | None = None) -> DataFrame:
    """All files of ``lines`` as one text table, each by its own header.

    ``facts`` may hold ``file``, ``encoding`` and ``delimiter``.  Columns stand in
    order of the sorted headers; what a file does not have is null, an empty
    field is ``""``.  The last column, ``_file``, is the path; blank files add
    nothing.
    """
    seps = seps or [","]
    if facts is not None:
        # One row per file meets the blocks of that file, which then meet its lines.
        blocks = lines.select("file", "block").distinct().join(facts, "file")
        lines = lines.join(blocks, ["file", "block"])
    if "encoding" in lines.columns:
        lines = lines.withColumn("value", decoded(F.col("value"), F.col("encoding"))).drop("encoding")
    lines = lines.withColumn("value", F.ltrim("value", F.lit("﻿"))) if "delimiter" in lines.columns else lines.select(
        "file", "block", "line", F.ltrim("value", F.lit("﻿")).alias("value"), F.lit(seps[0]).alias("delimiter"))
    records = cut_lineage(records_of(lines, seps))
    first = records.groupBy("file").agg(F.min(F.struct("block", "line", "value", "delimiter")).alias("h")).select(
        "file", F.col("h.block").alias("hblock"), F.col("h.line").alias("hline"), F.col("h.value").alias("header"), F.col("h.delimiter").alias("delimiter"))
    # Distinct headers only, however many files have them.
    shapes = sorted((column_names(r.header, r.delimiter), r.header, r.delimiter) for r in first.select("header", "delimiter").distinct().collect())
    names = list(dict.fromkeys(c for fields, _, _ in shapes for c in fields))
    spark = lines.sparkSession
    if not names:
        return spark.createDataFrame([], "_file string")
    width = max(len(fields) for fields, _, _ in shapes)
    known = spark.createDataFrame([(h, d, k) for k, (_, h, d) in enumerate(shapes)], "header string, delimiter string, shape int")
    numbered = first.join(known, ["header", "delimiter"]).select("file", "hblock", "hline", "shape")
    body = records.join(numbered, "file").filter("(block, line) <> (hblock, hline)")
    parsed = F.coalesce(*[F.when(F.col("delimiter") == s, fields_of(F.col("value"), s, width)) for s in sorted({d for _, _, d in shapes})])
    # Bind the fields once for all columns.
    rows = body.select("file", "shape", F.explode(F.array(F.struct(parsed.alias("v")))).alias("r"))
    at = lambda c: F.array(*[F.lit(fields.index(c) if c in fields else None).cast("int") for fields, _, _ in shapes])
    out = []
    for c in names:
        place = F.get(at(c), F.col("shape"))
        out.append(F.when(place.isNotNull(), F.coalesce(F.get(F.col("r.v"), place), F.lit(""))).alias(c))
    return rows.select(*out, F.col("file").alias("_file"))
