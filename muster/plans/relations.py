"""Contact-list relations derived from the given tables.

Each relation exists twice: as a DataFrame and as a SQL common table
expression, so a result can be checked against an independent engine.
Rows come one to one from a base table; nothing is generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_NAMES = ["Ana", "Ben", "Chloe", "Dev", "Eli", "Fay", "Gus"]
LAST_NAMES = ["Reed", "Stone, CPA", "Turner", "Usman", "Vale, PhD"]
MAIL_NAMES = ["reed", "stone", "turner", "usman", "vale"]
TITLES = [
    "Chief Risk Officer", "Chief Data Officer", "SVP Digital Product", "EVP Payments",
    "VP Cloud Infrastructure", "Head of AI", "Director of Risk Analytics", "IT Business Analyst",
    "Data Engineer", "IAM Lead", "AML Manager", "Internal Audit Manager", "Innovation Director",
    "Network Administrator", "Mobile Banking Manager", "Global Lead Strategy", "Senior Consultant",
    "Managing Director", "Retail Branch Manager", "Graduate Trainee", "Recruiter", "  ", None,
]
COMPANIES = [
    "Nordea Bank", "Nordea Bank Abp", "Nordea", "North Star Credit Union", "North Star FCU",
    "The Blue Ring Group", "Blue Ring Ltd", "Blue-Ring (UK) Limited", "Acme & Sons",
    "Acme and Sons Inc", "Citra Bank NA", "Citra Bank (Texas)", "Citra", "Zenith Capital Markets",
    "Zenith", "HSBC plc", "HSBC", "The Bank Group", None,
]
PLACES = [
    "Charlotte, NC", "Raleigh NC", "North Carolina, United States", "Nashville, TN", "Tennessee",
    "Virginia", "West Virginia", "Richmond, VA", "Georgia", "Atlanta, GA", "South Carolina",
    "Nevada", "NYC", "United States", "Paris, France", "  ", None,
]
SENIORITIES = [
    "C-Suite", "Chair/Board Member", "Vice President", "Head", "Director", "Leadership", "Manager",
    "Senior", "Consultant", "Non-Senior Banker", "Entry-Level", "vp", None,
]
RELEVANCES = ["Relevant", "relevant", "Not relevant"]
FOCUS_AREAS = ["Data", "Payments and Cloud", "Sales", None]
SHARED = ["5", "20", "45", "n/a", None, "19", "100", "0", "7", "21", "33"]
DEGREES = ["1st", "2nd"]
URL_TAILS = ["", "/", "?src=x"]
FILES = ["a.csv", "b.csv"]
SHEETS = ["s1", "s2", "s3"]
NAME_TAILS = ["", " Ltd", " plc", " Group", " Holdings"]
REFERENCE_FIRMS = [
    "Nordea Bank", "North Star Credit Union", "Blue Ring", "Acme & Sons", "Citra Bank",
    "Zenith Capital", "HSBC", "Bank Group", "Absent Partners", "Lunar Finance", "Quartz Ltd",
    "Omega Trust", "Delta Union",
]
TARGET_FIRMS = [
    "Nordea Bank", "North Star CU", "Blue Rng", "ACME & Sons", "Citra", "Zenith Captial Markets",
    "HSBC plc", "The Bank Group", "Absent Partners", "Lunar Finance", "Quartz", None,
]
SPONSORS = ["Aldergate", "Brightmoor", "Copperline", "Dunfield"]
SPONSOR_TARGETS = [
    "Nordea", "Citra Bank (Banamex USA)", "Zenith Markets", "HSBC Holdings", "blue ring ltd",
    "Norda", "Absent Partners", "Lunar Finance", "Acme Sons", "Citra NA", "Star North Credit Union",
    "Quartz Ltd", "HSBC",
]
ALIASES = [("HSBC plc", "HSBC"), ("north star fcu", "North Star"), ("blue ring ltd", "Blue Ring Group")]
PRIOR_MAPPING = [("Nordea Bank Abp", "Nordea"), ("HSBC plc", "HSBC Group"), ("Not There", "Nowhere")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str | None], key: str) -> Column:
    """Element ``key mod len(values)`` of a fixed list; ``key`` is a column name."""
    return F.expr(f"element_at(array({', '.join(spark_text(v) for v in values)}), cast({key} % {len(values)} as int) + 1)")


def spark_text(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_pick(values: list[str | None], key: str) -> str:
    return f"(({sql_list(values)})[1 + ({key}) % {len(values)}])"


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contact per customer; ``row_id`` is the customer key."""
    key, k = "c_custkey", F.col("c_custkey")
    first, last, mail = pick(FIRST_NAMES, key), pick(LAST_NAMES, key), pick(MAIL_NAMES, key)
    swapped = (k % 4) == 1
    address = F.concat(F.lower(first), F.lit("."), mail, k.cast("string"), F.lit("@example.com"))
    url = F.concat(
        F.lit("https://www.linkedin.com/in/u"), (k % 700).cast("string"), pick(URL_TAILS, key)
    )
    return table(spark, sf_dir, "customer").select(
        k.alias("row_id"),
        F.when(swapped, last).otherwise(first).alias("firstname"),
        F.when(swapped, first).otherwise(last).alias("lastname"),
        F.when(k % 29 != 0, address).alias("email"),
        pick(TITLES, key).alias("title"),
        pick(COMPANIES, key).alias("company"),
        pick(PLACES, key).alias("location"),
        pick(SENIORITIES, key).alias("seniority"),
        pick(RELEVANCES, key).alias("relevance"),
        pick(FOCUS_AREAS, key).alias("focus_area"),
        pick(SHARED, key).alias("shared"),
        pick(DEGREES, key).alias("degree"),
        F.when(k % 31 != 0, url).alias("url"),
        pick(FILES, key).alias("source_file"),
        pick(SHEETS, key).alias("source_sheet"),
    )


CONTACTS_SQL = f"""contacts AS (
  SELECT c_custkey AS row_id,
    CASE WHEN c_custkey % 4 = 1 THEN {sql_pick(LAST_NAMES, 'c_custkey')} ELSE {sql_pick(FIRST_NAMES, 'c_custkey')} END AS firstname,
    CASE WHEN c_custkey % 4 = 1 THEN {sql_pick(FIRST_NAMES, 'c_custkey')} ELSE {sql_pick(LAST_NAMES, 'c_custkey')} END AS lastname,
    CASE WHEN c_custkey % 29 <> 0 THEN lower({sql_pick(FIRST_NAMES, 'c_custkey')}) || '.' || {sql_pick(MAIL_NAMES, 'c_custkey')}
      || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
    {sql_pick(TITLES, 'c_custkey')} AS title,
    {sql_pick(COMPANIES, 'c_custkey')} AS company,
    {sql_pick(PLACES, 'c_custkey')} AS location,
    {sql_pick(SENIORITIES, 'c_custkey')} AS seniority,
    {sql_pick(RELEVANCES, 'c_custkey')} AS relevance,
    {sql_pick(FOCUS_AREAS, 'c_custkey')} AS focus_area,
    {sql_pick(SHARED, 'c_custkey')} AS shared,
    {sql_pick(DEGREES, 'c_custkey')} AS degree,
    CASE WHEN c_custkey % 31 <> 0 THEN 'https://www.linkedin.com/in/u' || CAST(c_custkey % 700 AS VARCHAR)
      || {sql_pick(URL_TAILS, 'c_custkey')} END AS url,
    {sql_pick(FILES, 'c_custkey')} AS source_file,
    {sql_pick(SHEETS, 'c_custkey')} AS source_sheet
  FROM customer)"""


def companies_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large set of company-like names, one per part."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("row_id"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), pick(NAME_TAILS, "p_partkey")).alias("name"),
    )


COMPANIES_WIDE_SQL = f"""companies_wide AS (
  SELECT p_partkey AS row_id, p_name || ' ' || p_brand || {sql_pick(NAME_TAILS, 'p_partkey')} AS name FROM part)"""


def reference_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.cast("bigint").alias("pos"), F.col("n_name").alias("code"), pick(REFERENCE_FIRMS, "n_nationkey").alias("name")
    )


REFERENCE_SQL = f"""reference_companies AS (
  SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS code, {sql_pick(REFERENCE_FIRMS, 'n_nationkey')} AS name FROM nation)"""


def target_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted companies, one per supplier; names repeat."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("target_id"),
        pick(TARGET_FIRMS, "s_suppkey").alias("company"),
        pick(["Retail", "Corporate"], "s_suppkey").alias("sector"),
    )


TARGETS_SQL = f"""target_companies AS (
  SELECT s_suppkey AS target_id, {sql_pick(TARGET_FIRMS, 's_suppkey')} AS company,
    {sql_pick(["Retail", "Corporate"], 's_suppkey')} AS sector FROM supplier)"""


def sponsor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested companies per sponsor, one request per order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("row_id"),
        pick(SPONSORS, "o_custkey").alias("sponsor"),
        pick(SPONSOR_TARGETS, "o_orderkey").alias("target"),
    )


SPONSOR_TARGETS_SQL = f"""sponsor_targets AS (
  SELECT o_orderkey AS row_id, {sql_pick(SPONSORS, 'o_custkey')} AS sponsor,
    {sql_pick(SPONSOR_TARGETS, 'o_orderkey')} AS target FROM orders)"""


def member_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile URLs known to four members; some are known to two of them."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (k % 4).cast("int").alias("member_idx"),
        F.concat(
            F.lit("https://www.LinkedIn.com/in/u"), ((k * 3) % 250).cast("string"), pick(URL_TAILS, "s_suppkey")
        ).alias("url"),
    )


MEMBERS_SQL = f"""member_connections AS (
  SELECT CAST(s_suppkey % 4 AS INTEGER) AS member_idx, 'https://www.LinkedIn.com/in/u'
    || CAST((s_suppkey * 3) % 250 AS VARCHAR) || {sql_pick(URL_TAILS, 's_suppkey')} AS url FROM supplier)"""


def literal_pairs(spark: SparkSession, pairs, first: str, second: str) -> DataFrame:
    rows = ", ".join(f"({i}, {sql_text(a)}, {sql_text(b)})" for i, (a, b) in enumerate(pairs))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(row_id, {first}, {second})")


def literal_pairs_sql(name: str, pairs, first: str, second: str) -> str:
    rows = ", ".join(f"({i}, {sql_text(a)}, {sql_text(b)})" for i, (a, b) in enumerate(pairs))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS t(row_id, {first}, {second}))"


ALIASES_SQL = literal_pairs_sql("aliases", ALIASES, "variant", "canonical")
PRIOR_SQL = literal_pairs_sql("prior_mapping", PRIOR_MAPPING, "original", "standard")


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


HEADERS = [
    "First Name", "first name", "LinkedIn URL", "Company", "company_name", "Employer", "Job Title", "jobtitle",
    "title", "Location", "City", "E-mail", "email", "Last  Name", "Surname", "lastName", "profileUrl",
    "Profile URL", "Seniority", "level", "State", "state/region", "Country", "Focus Area", "Relevance",
    "is relevant", "Organisation Type", "Compny Name", " Company  Name", "fullName", "Full Name", "name_full",
    "industry", "timestmp", "owner", "Bank Size", "Segment",
]


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header catalogue of many files: a file per customer, a header per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("pos"), pick(HEADERS, "o_orderkey").alias("header")
    )


HEADERS_SQL = f"""headers AS (
  SELECT o_custkey AS file_id, o_orderkey AS pos, {sql_pick(HEADERS, 'o_orderkey')} AS header FROM orders)"""
