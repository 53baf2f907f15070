"""Queries that write derived tables as files and read them back."""

from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.catalog import sql as q
from muster.catalog.matching import COVERAGE_CTES, coverage
from muster.catalog.registry import query
from muster.catalog.rules import segment_ctes
from muster.functions import classify as cl
from muster.functions import text as tx
from muster.operators.report import counts_by
from muster.plans import relations as rel
from muster.plans.relations import COMPANIES_WIDE_SQL, CONTACTS_SQL, with_ctes
from muster.plans.storage import scratch_path
from muster.sinks import files as sk
from muster.sources import files as sr

CELLS = ["row_id", "firstname", "lastname", "company", "title", "url"]
CELLS_SQL = ", ".join(CELLS)


def _cells(spark, sf):
    return rel.contacts(spark, sf).select(*CELLS)


@query("src_csv_typed", with_ctes(f"SELECT {CELLS_SQL} FROM contacts", CONTACTS_SQL))
def src_csv_typed(spark, sf):
    path = scratch_path(spark, "typed")
    sk.write_csv(_cells(spark, sf), path)
    return sr.read_typed(spark, path).withColumn("row_id", F.col("row_id").cast("bigint"))


@query("src_csv_text", with_ctes("SELECT CAST(row_id AS VARCHAR) AS row_id, coalesce(company, '') AS company, coalesce(url, '') AS url FROM contacts", CONTACTS_SQL))
def src_csv_text(spark, sf):
    path = scratch_path(spark, "text")
    sk.write_csv(_cells(spark, sf).select("row_id", "company", "url"), path)
    return sr.read_text(spark, path)


@query(
    "src_encoding_fallback",
    with_ctes(
        "SELECT row_id, origin, name || CASE origin WHEN 'utf' THEN ' é' WHEN 'win' THEN ' ’é' ELSE ' é' || chr(129) END AS name FROM tagged",
        COMPANIES_WIDE_SQL, "tagged AS (SELECT row_id, name, CASE row_id % 3 WHEN 0 THEN 'utf' WHEN 1 THEN 'win' ELSE 'lat' END AS origin FROM companies_wide)",
    ),
)
def src_encoding_fallback(spark, sf):
    """One folder per origin, each in another encoding, read as one table."""
    path = scratch_path(spark, "encodings")
    origin = F.when(F.col("row_id") % 3 == 0, "utf").when(F.col("row_id") % 3 == 1, "win").otherwise("lat")
    df = rel.companies_wide(spark, sf).select("row_id", origin.alias("origin"), "name")
    # Windows bytes are written through the Latin-1 character of the same code.
    texts = {
        "utf": ("UTF-8", F.concat("name", F.lit(" é"))),
        "win": ("ISO-8859-1", F.concat("name", F.lit(" \u0092é"))),
        "lat": ("ISO-8859-1", F.concat("name", F.lit(" é\u0081"))),
    }
    for name, (charset, value) in texts.items():
        df.filter(F.col("origin") == name).withColumn("name", value).write.options(header=True, encoding=charset).csv(f"{path}/{name}")
    read = sr.read_any_encoding(spark, [f"{path}/{n}" for n in texts], ["row_id", "origin", "name"])
    return read.withColumn("row_id", F.col("row_id").cast("bigint"))


@query(
    "src_bad_lines",
    with_ctes(
        """SELECT 'good' AS part, row_id || '|' || CASE WHEN row_id % 7 = 0 THEN name || chr(10) || 'a, "b"' ELSE name END AS line FROM companies_wide WHERE row_id % 10 <> 0
        UNION ALL SELECT 'bad' AS part, row_id || ',' || CASE WHEN row_id % 7 = 0 THEN '"' || name || chr(10) || 'a, ""b""' || '"' ELSE name END || ',extra' AS line
        FROM companies_wide WHERE row_id % 10 = 0""",
        COMPANIES_WIDE_SQL,
    ),
)
def src_bad_lines(spark, sf):
    """Every tenth row has a field too many, every seventh a line break in quotes."""
    path = scratch_path(spark, "bad")
    extra = F.when(F.col("row_id") % 10 == 0, F.lit(",extra")).otherwise(F.lit(""))
    quoted = F.concat(F.lit('"'), "name", F.lit('\na, ""b"""'))
    cell = F.when(F.col("row_id") % 7 == 0, quoted).otherwise(F.col("name"))
    rel.companies_wide(spark, sf).select(F.concat(F.col("row_id").cast("string"), F.lit(","), cell, extra)).write.text(path)
    good, bad = sr.split_bad_lines(spark, path, ["row_id", "name"], header=False)
    return good.select(F.lit("good").alias("part"), F.concat_ws("|", "row_id", "name").alias("line")).unionByName(
        bad.select(F.lit("bad").alias("part"), "line")
    )


@query("src_delimiter_sniff", with_ctes("SELECT CAST(row_id AS VARCHAR) AS row_id, name FROM companies_wide", COMPANIES_WIDE_SQL))
def src_delimiter_sniff(spark, sf):
    path = scratch_path(spark, "delimited")
    df = rel.companies_wide(spark, sf)
    for i, sep in enumerate(sr.DELIMITERS):
        df.filter(F.col("row_id") % 3 == i).write.options(header=True, sep=sep).csv(f"{path}/{i}")
    return sr.read_sniffed(spark, [f"{path}/{i}" for i in range(3)])


@query(
    "src_multi_table",
    with_ctes(
        "SELECT source_file AS _source_file, source_sheet AS _source_sheet_or_type, source_file AS _source_workbook, CAST(row_id AS VARCHAR) AS row_id, coalesce(company, '') AS company, CASE WHEN source_sheet = 's2' THEN degree END AS degree FROM contacts",
        CONTACTS_SQL,
    ),
)
def src_multi_table(spark, sf):
    """Sheets of two files; one sheet has a column more, one is empty."""
    path = scratch_path(spark, "sheets")
    df = rel.contacts(spark, sf).select("source_file", "source_sheet", "row_id", "company", "degree")
    sheets = {}
    for file in rel.FILES:
        for sheet in rel.SHEETS + ["empty"]:
            part = df.filter((F.col("source_file") == file) & (F.col("source_sheet") == sheet)).drop("source_file", "source_sheet")
            part = part if sheet == "s2" else part.drop("degree")
            sheets[file, sheet] = f"{path}/{file}/{sheet}"
            sk.write_csv(part, sheets[file, sheet])
    return sr.read_sheets(spark, sheets, workbook=True)


@query("src_single_sheet", with_ctes("SELECT CAST(row_id AS VARCHAR) AS row_id, coalesce(company, '') AS company FROM contacts WHERE source_sheet = 's1'", CONTACTS_SQL))
def src_single_sheet(spark, sf):
    path = scratch_path(spark, "book")
    sk.write_split(rel.contacts(spark, sf).select("row_id", "company", "source_sheet"), path, "source_sheet")
    return sr.read_text(spark, f"{path}/source_sheet=s1")


@query("src_pasted_list", with_ctes("SELECT DISTINCT trim(name) AS name FROM (SELECT company AS name FROM contacts UNION ALL SELECT name FROM companies_wide) WHERE trim(coalesce(name, '')) <> ''", CONTACTS_SQL, COMPANIES_WIDE_SQL))
def src_pasted_list(spark, sf):
    path = scratch_path(spark, "list")
    names = rel.contacts(spark, sf).select(F.concat(F.lit("  "), F.coalesce("company", F.lit(""))).alias("v"))
    names.unionByName(rel.companies_wide(spark, sf).select(F.col("name").alias("v"))).write.text(path)
    return sr.read_list(spark, path)


@query("src_single_column", with_ctes("SELECT company AS name FROM contacts WHERE company IS NOT NULL", CONTACTS_SQL))
def src_single_column(spark, sf):
    path = scratch_path(spark, "column")
    sk.write_csv(rel.contacts(spark, sf).select("row_id", F.col("company").alias("Company ")), path)
    return sr.name_column(sr.read_text(spark, path, na_text=True))


@query("src_alias_pairs", "SELECT lower(s_name) AS variant, 'Nation ' || max(CAST(s_nationkey AS VARCHAR)) AS canonical FROM supplier GROUP BY 1")
def src_alias_pairs(spark, sf):
    path = scratch_path(spark, "aliases")
    supplier = rel.table(spark, sf, "supplier")
    pairs = supplier.select(F.concat_ws(" => ", "s_name", F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))).alias("v"))
    pairs.unionByName(supplier.select(F.concat(F.lit("no arrow "), "s_name").alias("v"))).write.text(path)
    return sr.parse_aliases(sr.ordered_lines(spark, path))


@query("src_prior_mapping", with_ctes(f"SELECT DISTINCT name AS original, {q.proposed('name')} AS standard FROM companies_wide", COMPANIES_WIDE_SQL))
def src_prior_mapping(spark, sf):
    path = scratch_path(spark, "mapping")
    names = rel.companies_wide(spark, sf).select(F.col("name").alias("original_companyName")).distinct()
    sk.write_csv(names.withColumn("proposed_standard", tx.proposed_name("original_companyName")), path)
    return sr.read_prior_mapping(spark, path)


# ------------------------------------------------------------------------ sinks

@query("sink_csv", with_ctes("SELECT CAST(row_id AS VARCHAR) AS row_id, coalesce(lastname, '') AS lastname, coalesce(title, '') AS title FROM contacts", CONTACTS_SQL))
def sink_csv(spark, sf):
    path = scratch_path(spark, "out")
    people = rel.contacts(spark, sf).select("row_id", "lastname", "title", F.lit(1).alias("_helper"))
    sk.write_csv(people, path)
    return sr.read_text(spark, path)


def _segmented(spark, sf):
    return cl.with_segment(rel.contacts(spark, sf), "title", "seniority", "company").select(
        "row_id", F.concat_ws(" - ", "org_type", "segment").alias("segment")
    )


@query("sink_split_by_segment", with_ctes("SELECT org_type || ' - ' || segment AS segment, row_id FROM segmented", CONTACTS_SQL, segment_ctes()))
def sink_split_by_segment(spark, sf):
    path = scratch_path(spark, "segments")
    sk.write_split(_segmented(spark, sf), path, "segment")
    return spark.read.option("header", True).schema("row_id bigint, segment string").csv(path)


ALL_SEGMENTS = [f"Bank - {s}" for s in fv.BANK_SEGMENT_ORDER] + [f"Credit Union - {s}" for s in fv.CREDIT_UNION_SEGMENT_ORDER]


@query(
    "sink_empty_segments",
    with_ctes(
        "SELECT k.segment, count(s.row_id) AS n FROM known k LEFT JOIN segmented s ON s.org_type || ' - ' || s.segment = k.segment GROUP BY 1",
        CONTACTS_SQL, segment_ctes(), f"known(segment) AS (VALUES {', '.join('(' + rel.sql_text(s) + ')' for s in ALL_SEGMENTS)})",
    ),
)
def sink_empty_segments(spark, sf):
    return sk.manifest(_segmented(spark, sf), "segment", ALL_SEGMENTS)


@query("sink_multi_table", with_ctes("SELECT 'people' AS name, count(*) AS rows FROM contacts UNION ALL SELECT 'companies' AS name, count(*) AS rows FROM companies_wide", CONTACTS_SQL, COMPANIES_WIDE_SQL))
def sink_multi_table(spark, sf):
    tables = {"people": rel.contacts(spark, sf), "companies": rel.companies_wide(spark, sf)}
    paths = sk.write_tables(tables, scratch_path(spark, "bundle"))
    people, companies = [
        sr.read_text(spark, p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, p in paths.items()
    ]
    return people.unionByName(companies)


@query(
    "sink_report_sections",
    with_ctes(
        """SELECT sponsor, section, target, best_match FROM (SELECT sponsor, 'all' AS section, target, best_match FROM coverage
        UNION ALL SELECT sponsor, CASE WHEN included = 'Yes' THEN 'included' ELSE 'excluded' END AS section, target, best_match FROM coverage)""",
        *COVERAGE_CTES,
    ),
)
def sink_report_sections(spark, sf):
    path = scratch_path(spark, "report")
    report = coverage(spark, sf).select("sponsor", "target", "best_match", "included")
    sk.write_sections(report, path)
    read = spark.read.option("header", True).schema("target string, best_match string, included string, sponsor string, section string").csv(path)
    return read.select("sponsor", "section", "target", F.coalesce("best_match", F.lit("")).alias("best_match"))


@query(
    "sink_safe_name",
    with_ctes(
        r"""SELECT name, trim(regexp_replace(regexp_replace(raw, '[\\/:*?"<>|]', ' ', 'g'), '\s+', ' ', 'g')) AS file,
          replace(trim(regexp_replace(raw, '[^A-Za-z0-9\-_ ]+', '', 'g')), ' ', '_') AS folder,
          replace(trim(regexp_replace(raw, '[^\w\-\.\(\) ]+', '_', 'g')), '  ', ' ') AS loose,
          CASE WHEN nth = 0 THEN base ELSE substr(base, 1, 31 - length('_' || nth)) || '_' || nth END AS sheet
        FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) - 1 AS nth
          FROM (SELECT name, pos, raw, substr(regexp_replace(raw, '[\[\]\:\*\?\/\\]', '_', 'g'), 1, 31) AS base
            FROM (SELECT name, min(row_id) AS pos, 'Contacts: all of "' || name || '" / part' AS raw FROM companies_wide GROUP BY 1)))""",
        COMPANIES_WIDE_SQL,
    ),
)
def sink_safe_name(spark, sf):
    names = rel.companies_wide(spark, sf).groupBy("name").agg(F.min("row_id").alias("pos"))
    names = names.withColumn("raw", F.concat(F.lit('Contacts: all of "'), "name", F.lit('" / part')))
    sheets = sk.sheet_names(names, "raw", "pos")
    return names.join(sheets, "raw").select(
        "name", sk.file_name("raw").alias("file"), sk.folder_name("raw").alias("folder"), sk.loose_name("raw").alias("loose"), "sheet"
    )


@query("sink_file_label", with_ctes("SELECT source_sheet AS member, 'Contacts - ' || source_sheet || ' - ' || count(*) AS label FROM contacts GROUP BY 1", CONTACTS_SQL))
def sink_file_label(spark, sf):
    counts = counts_by(rel.contacts(spark, sf), "source_sheet")
    return counts.select(F.col("source_sheet").alias("member"), sk.file_label("Contacts", F.col("source_sheet"), F.col("n")).alias("label"))
