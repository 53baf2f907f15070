"""Reading differently shaped text exports.

Records are cut by ``records``, so large files are split even where quoted
values hold line breaks, and any number of files makes one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from muster import fixed_values as fv
from muster.functions import text as tx
from muster.sources import records as rc

PROVENANCE = ("_source_file", "_source_sheet_or_type")
WORKBOOK = "_source_workbook"


#: Types a column may have, first one that all its values fit; patterns are what a cast alone would be too lenient about.
TYPES = [
    ("int", r"^\s*[-+]?\d+\s*$"), ("bigint", r"^\s*[-+]?\d+\s*$"), ("double", r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"), ("timestamp", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"), ("boolean", r"(?i)^(true|false)$"),
]


def inferred_types(df: DataFrame) -> dict[str, str]:
    """Type of every text column from all its non-blank values, in one pass."""
    def fits(c: str, kind: str, pattern: str) -> Column:
        value = F.col(f"`{c}`")
        return F.coalesce(F.bool_and(F.when(value != "", value.rlike(pattern) & value.try_cast(kind).isNotNull())), F.lit(False))

    facts = df.agg(*[F.array(*[fits(c, *t) for t in TYPES]).alias(f"c{i}") for i, c in enumerate(df.columns)]).first() if df.columns else []
    return {c: next((kind for (kind, _), good in zip(TYPES, row) if good), "string") for c, row in zip(df.columns, facts)}


def read_typed(spark: SparkSession, path, schema: StructType | str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header; types are inferred unless a schema is given. Blanks, and what its type cannot hold, are null."""
    df = read_text(spark, path, sep=sep)
    if schema is None:
        types = inferred_types(df)
    else:
        fields = _parse_datatype_string(schema) if isinstance(schema, str) else schema
        types = {f.name: f.dataType.simpleString() for f in fields}
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).try_cast(kind).alias(c) for c, kind in types.items()])


def read_text(spark: SparkSession, path, na_text: bool = False, sep: str = ",") -> DataFrame:
    """CSV with every column as text, each file by its own header; blanks stay ``""``.

    With ``na_text`` the usual spellings of a missing value become null.
    """
    df = rc.read_files(rc.lines_of(spark, path), seps=[sep]).drop("_file")
    if not na_text:
        return df
    return df.select(*[F.when(~F.col(f"`{c}`").isin("", *fv.NA_TEXT), F.col(f"`{c}`")).alias(c) for c in df.columns])


def file_encodings(spark: SparkSession, path) -> DataFrame:
    """``(file, encoding)`` from the bytes of the lines, however large the file."""
    return rc.encoding_of(rc.lines_of(spark, path))


def read_any_encoding(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """Files of mixed encodings as one text table, each by its own header."""
    lines = rc.lines_of(spark, path)
    out = rc.read_files(lines, rc.encoding_of(lines)).drop("_file")
    return out if columns is None else out.select(*columns)


def split_bad_lines(spark: SparkSession, path, columns: list[str], header: bool = True, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)``: rows of the expected shape, and raw bad records, whole even where a quoted value spans lines."""
    records = rc.records_of(rc.lines_of(spark, path), [sep])
    if header:
        records = records.filter(F.col("value") != sep.join(columns))
    schema = ", ".join(f"`{c}` STRING" for c in [*columns, "_bad"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": '"', "sep": sep, "maxCharsPerColumn": "-1"}
    rows = records.select(F.from_csv("value", schema, options).alias("row"))
    return rows.filter("row._bad IS NULL").select(*[f"row.`{c}`" for c in columns]), rows.filter("row._bad IS NOT NULL").select(
        F.col("row._bad").alias("line")
    )


DELIMITERS = [",", ";", "\t"]


def _delimiter_of(lines: DataFrame, candidates: list[str]) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(-i).alias("i"), F.lit(d).alias("delimiter"), F.regexp_count("value", F.lit(tx.literal(d))).alias("times"))
        for i, d in enumerate(candidates)
    ])
    shares = lines.select("file", F.inline(entries)).groupBy("file", "i", "delimiter", "times").agg(F.count(F.lit(1)).alias("n"))
    # A file without any candidate has one column; the first one does for it.
    return shares.groupBy("file").agg(F.max_by("delimiter", F.struct(F.col("times") > 0, "n", "times", "i")).alias("delimiter"))


def delimiters(spark: SparkSession, path, candidates: list[str] = DELIMITERS) -> DataFrame:
    """``(file, delimiter)``: the candidate found equally often on most lines."""
    return _delimiter_of(rc.lines_of(spark, path), candidates)


def read_sniffed(spark: SparkSession, path) -> DataFrame:
    """Files of different delimiters as one text table, each by its own header."""
    lines = rc.lines_of(spark, path)
    return rc.read_files(lines, _delimiter_of(lines, DELIMITERS), DELIMITERS).drop("_file")


def read_sheets(spark: SparkSession, sheets: dict[tuple[str, str], str], sep: str = ",", workbook: bool = False) -> DataFrame:
    """Several tables as one, tagged with file and sheet; empty ones add nothing.

    ``sheets`` maps (file, sheet) to the folder or file holding that sheet.  All
    are read by one scan, whose rows find their sheet by their file's path.
    ``workbook`` adds the file once more as ``_source_workbook``.
    """
    lines = rc.lines_of(spark, sorted(set(sheets.values())))
    rows = rc.read_files(lines, seps=[sep])
    tags = spark.createDataFrame([(path, f, s) for (f, s), path in sheets.items()], f"path string, {PROVENANCE[0]} string, {PROVENANCE[1]} string")
    # Given paths are not percent-encoded as those of a scan are.
    tags = tags.withColumn("path", F.regexp_replace(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*(?=/))?/*", "/"), "(?<=.)/+$", ""))
    files = lines.select(F.col("file").alias("_file")).distinct()
    either = files.select("_file", F.explode(F.array_distinct(F.array("_file", F.regexp_replace("_file", "/[^/]*$", "")))).alias("path"))
    named = either.join(tags, "path").drop("path")
    extra = [F.col(PROVENANCE[0]).alias(WORKBOOK)] if workbook else []
    columns = [F.col(f"`{c}`") for c in rows.columns if c != "_file"]
    return rows.join(named, "_file").select(*PROVENANCE, *extra, *columns)


def read_list(spark: SparkSession, path, out: str = "name") -> DataFrame:
    """Pasted names: trimmed, non-blank, one per case-insensitive spelling, first kept."""
    lines = ordered_lines(spark, path).select(tx.strip("value").alias(out), "order").filter(F.col(out) != "")
    return lines.groupBy(F.lower(out).alias("_k")).agg(F.min_by(out, "order").alias(out)).drop("_k")


def ordered_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with their place: file, block in the file, line in the block."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return spark.read.text(path).select("value", place.alias("order"))


def name_column(df: DataFrame, known: list[str] = fv.COMPANY_LIST_HEADERS, position: int | None = None, out: str = "name") -> DataFrame:
    """The column of names: a known header, a given position, or the first one."""
    if position is not None:
        chosen = df.columns[position]
    else:
        chosen = next((c for c in df.columns if c.strip().lower() in known), df.columns[0])
    return df.select(F.col(f"`{chosen}`").cast("string").alias(out)).dropna()


def parse_aliases(lines: DataFrame, value: str = "value", order: str = "order") -> DataFrame:
    """``(variant, canonical)`` from ``Variant => Canonical`` lines, last one wins."""
    parts = F.split(F.col(value), "=>", 2)
    pairs = lines.filter(F.contains(F.col(value), F.lit("=>"))).select(
        F.lower(tx.strip(parts[0])).alias("variant"), tx.strip(parts[1]).alias("canonical"), F.col(order)
    ).filter("variant <> '' AND canonical <> ''")
    return pairs.groupBy("variant").agg(F.max_by("canonical", order).alias("canonical"))


def read_prior_mapping(spark: SparkSession, path, columns: tuple[str, str] = ("original_companyName", "proposed_standard")) -> DataFrame:
    """Reviewed mapping; both columns have to be there."""
    df = read_text(spark, path)
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"mapping lacks {', '.join(absent)}")
    return df.select(F.col(columns[0]).alias("original"), F.col(columns[1]).alias("standard"))
