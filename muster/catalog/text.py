"""Queries over the text normalisers and scalar functions."""

from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.catalog import sql as q
from muster.catalog.registry import query
from muster.functions import classify as cl
from muster.functions import text as tx
from muster.plans import relations as rel
from muster.plans.relations import COMPANIES_WIDE_SQL, CONTACTS_SQL, with_ctes

# Every company spelling of contacts and of the wide name set, with its row id.
NAMES_SQL = """names AS (
  SELECT 'contact' AS origin, row_id, company AS name FROM contacts
  UNION ALL SELECT 'wide' AS origin, row_id, name FROM companies_wide)"""


def names(spark, sf):
    a = rel.contacts(spark, sf).select(F.lit("contact").alias("origin"), "row_id", F.col("company").alias("name"))
    b = rel.companies_wide(spark, sf).select(F.lit("wide").alias("origin"), "row_id", "name")
    return a.unionByName(b)


def _name_query(key, spark_fn, sql_fn):
    body = f"SELECT origin, row_id, {sql_fn('name')} AS value FROM names"

    @query(key, with_ctes(body, CONTACTS_SQL, COMPANIES_WIDE_SQL, NAMES_SQL))
    def run(spark, sf):
        return names(spark, sf).select("origin", "row_id", spark_fn(F.col("name")).alias("value"))


_name_query("nm_light_company", tx.light_company, q.light_company)
_name_query("nm_company_suffix", tx.match_key, q.match_key)
_name_query("nm_brand", tx.brand, q.brand)
_name_query("nm_brand_core", tx.brand_core, q.brand_core)
_name_query("nm_company_core", tx.company_core, q.company_core)
_name_query("nm_title_case", lambda c: tx.title_case(tx.company_core(c)), lambda x: q.title_case(q.company_core(x)))
_name_query("nm_propose", tx.proposed_name, q.proposed)


@query("nm_space_lower", f"SELECT doc_id, md5({q.space_lower('text')}) AS digest, length({q.space_lower('text')}) AS n FROM documents")
def nm_space_lower(spark, sf):
    low = tx.space_lower("text")
    return rel.table(spark, sf, "documents").select(
        "doc_id", F.md5(low).alias("digest"), F.char_length(low).cast("bigint").alias("n")
    )


@query("nm_nfkc", f"SELECT doc_id, md5(lower({q.collapse('nfc_normalize(text)')})) AS digest FROM documents")
def nm_nfkc(spark, sf):
    # The documents hold no compatibility characters, so NFC gives the same.
    return rel.table(spark, sf, "documents").select("doc_id", F.md5(tx.nfkc_lower("text")).alias("digest"))


@query(
    "nm_nfkd_text",
    f"""SELECT doc_id, lower({q.collapse("strip_accents(text)")}) = '' AS empty,
        md5(regexp_replace(lower({q.collapse("strip_accents(text)")}), '[^a-z0-9 ]', '', 'g')) AS digest FROM documents""",
)
def nm_nfkd_text(spark, sf):
    # Base letters compared: the decomposed marks are not letters or digits.
    low = tx.nfkd_lower("text")
    return rel.table(spark, sf, "documents").select(
        "doc_id", (low == "").alias("empty"), F.md5(F.regexp_replace(low, "[^a-z0-9 ]", "")).alias("digest")
    )


@query(
    "nm_url",
    with_ctes(
        f"""SELECT 'page' AS origin, page_id AS id, {q.profile_url('url')} AS value FROM pages
        UNION ALL SELECT 'contact' AS origin, row_id AS id, {q.profile_url('url')} AS value FROM contacts""",
        CONTACTS_SQL,
    ),
)
def nm_url(spark, sf):
    pages = rel.table(spark, sf, "pages").select(
        F.lit("page").alias("origin"), F.col("page_id").alias("id"), tx.profile_url("url").alias("value")
    )
    people = rel.contacts(spark, sf).select(
        F.lit("contact").alias("origin"), F.col("row_id").alias("id"), tx.profile_url("url").alias("value")
    )
    return pages.unionByName(people)


@query(
    "nm_variants",
    with_ctes(
        """, parts AS (SELECT source, row_id, unnest(list_transform(string_split_regex(name, '[/–-]'), lambda t: trim(t))) AS part,
            generate_subscripts(string_split_regex(name, '[/–-]'), 1) AS pos
          FROM (SELECT 0 AS source, row_id, company AS name FROM contacts WHERE company IS NOT NULL UNION ALL
                SELECT 1 AS source, p_partkey AS row_id, p_name || ' / ' || p_type || '-' || upper(p_name) AS name FROM part))
        SELECT lower(part) AS key, part AS variant FROM parts WHERE part <> '' QUALIFY row_number() OVER (PARTITION BY lower(part) ORDER BY source, row_id, pos) = 1""".lstrip(" ,"),
        CONTACTS_SQL,
    ).replace("FROM customer)\nparts AS", "FROM customer),\nparts AS"),
)
def nm_variants(spark, sf):
    from muster.operators.dedupe import distinct_variants

    place = lambda source, id: F.struct(F.lit(source).alias("source"), F.col(id).cast("bigint").alias("id")).alias("row_id")
    a = rel.contacts(spark, sf).select(place(0, "row_id"), F.col("company").alias("name"))
    b = rel.table(spark, sf, "part").select(
        place(1, "p_partkey"),
        F.concat(F.col("p_name"), F.lit(" / "), F.col("p_type"), F.lit("-"), F.upper("p_name")).alias("name"),
    )
    return distinct_variants(a.unionByName(b), "name", "row_id").select("key", "variant")


@query(
    "tx_expand_acronyms",
    with_ctes("SELECT row_id, jt FROM expanded", CONTACTS_SQL, q.expand_ctes("contacts", "title", "row_id")),
)
def tx_expand_acronyms(spark, sf):
    return rel.contacts(spark, sf).select("row_id", tx.expand_title("title").alias("jt"))


PHRASES = ["risk officer", "data engineer", "mobile banking", "cloud infrastructure"]


@query(
    "tx_phrase_regex",
    with_ctes(
        "SELECT row_id, " + ", ".join(
            f"{q.matches('lower(coalesce(title, chr(0)))', q.phrase(p))} AS {p.replace(' ', '_')}" for p in PHRASES
        ) + " FROM contacts",
        CONTACTS_SQL,
    ),
)
def tx_phrase_regex(spark, sf):
    low = F.lower(tx.text("title"))
    return rel.contacts(spark, sf).select(
        "row_id", *[low.rlike(tx.phrase_pattern(p)).alias(p.replace(" ", "_")) for p in PHRASES]
    )


@query(
    "tx_any_regex",
    with_ctes(f"SELECT row_id, {q.has_pattern('company', fv.CREDIT_UNION_HINTS)} AS hit FROM contacts", CONTACTS_SQL),
)
def tx_any_regex(spark, sf):
    return rel.contacts(spark, sf).select("row_id", tx.has_pattern("company", fv.CREDIT_UNION_HINTS).alias("hit"))


@query("tx_any_substring", f"SELECT doc_id, {q.has_substring('text', fv.FOCUS_RISK)} AS hit FROM documents")
def tx_any_substring(spark, sf):
    return rel.table(spark, sf, "documents").select("doc_id", tx.has_substring("text", fv.FOCUS_RISK).alias("hit"))


@query(
    "tx_keyword_score",
    with_ctes(f"SELECT row_id, {q.keyword_score('title', fv.TITLE_KEYWORDS, fv.TITLE_PENALTIES)} AS score FROM contacts", CONTACTS_SQL),
)
def tx_keyword_score(spark, sf):
    score = tx.keyword_score("title", fv.TITLE_KEYWORDS, fv.TITLE_PENALTIES)
    return rel.contacts(spark, sf).select("row_id", score.cast("bigint").alias("score"))


@query(
    "tx_keyword_hits",
    with_ctes(
        f"""SELECT 'doc' AS origin, doc_id AS id, {q.keyword_hits('text')} AS hits FROM documents
        UNION ALL SELECT 'contact' AS origin, row_id AS id, {q.keyword_hits('title')} + {q.keyword_hits('focus_area')} AS hits FROM contacts""",
        CONTACTS_SQL,
    ),
)
def tx_keyword_hits(spark, sf):
    docs = rel.table(spark, sf, "documents").select(
        F.lit("doc").alias("origin"), F.col("doc_id").alias("id"), tx.keyword_hits("text").cast("bigint").alias("hits")
    )
    people = rel.contacts(spark, sf).select(
        F.lit("contact").alias("origin"), F.col("row_id").alias("id"),
        (tx.keyword_hits("title") + tx.keyword_hits("focus_area")).cast("bigint").alias("hits"),
    )
    return docs.unionByName(people)


COUNTED = ["data", "bi", "ai", "the", "audit", "it"]


@query(
    "tx_regex_count",
    # Word boundaries are Unicode aware, so the oracle splits at non-word characters.
    f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'),
        lambda w: list_contains({rel.sql_list(COUNTED)}, w))) AS BIGINT) AS n FROM documents""",
)
def tx_regex_count(spark, sf):
    low = rel.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", tx.phrase_count("low", COUNTED).cast("bigint").alias("n"))


@query(
    "tx_template",
    with_ctes(
        f"""SELECT row_id,
          'Hi {{FirstName}},' || chr(10) || chr(10) || 'I’m connecting with ' || one || ' leaders across ' || place
            || ' who are driving projects in AI, data and automation. It would be great to connect and share insights ahead of a summit in Charlotte this November.'
            || chr(10) || chr(10) || 'Best regards, Mark' AS connection,
          'Hi {{FirstName}},' || chr(10) || chr(10) || 'We organise Banking Transformation Summit – the leading AI and transformation event for ' || many
            || '. Given your role with ' || work || ', I thought this would be highly relevant and wanted to share a VIP guest pass to attend.'
            || chr(10) || chr(10) || 'Best regards, Mark' AS follow_up_2
        FROM (SELECT row_id, CASE WHEN {q.company_type('company')} = 'Credit Union' THEN 'credit union' ELSE 'banking' END AS one,
            CASE WHEN {q.company_type('company')} = 'Credit Union' THEN 'credit unions' ELSE 'banks' END AS many,
            CASE WHEN {q.geo_bucket('location')} = 'US' THEN 'the US' ELSE {q.geo_bucket('location')} END AS place,
            {q.lookup(q.focus('title'), fv.MESSAGE_FOCUS, "'your work'")} AS work FROM contacts)""",
        CONTACTS_SQL,
    ),
)
def tx_template(spark, sf):
    place = F.when(F.col("bucket") == "US", fv.OTHER_STATES).otherwise(F.col("bucket"))
    texts = cl.messages(place, F.col("kind"), F.col("focus"))
    return (
        rel.contacts(spark, sf)
        .select("row_id", cl.geo_bucket("location").alias("bucket"), cl.company_type("company").alias("kind"), cl.focus("title").alias("focus"))
        .select("row_id", texts["connection"].alias("connection"), texts["follow_up_2"].alias("follow_up_2"))
    )


@query(
    "tx_email_tokens",
    with_ctes(
        """SELECT row_id, CASE WHEN email LIKE '%@%' THEN array_to_string(list_filter(list_transform(
            string_split_regex(lower(split_part(email, '@', 1)), '[._]'), lambda t: regexp_replace(t, '[^a-z]', '', 'g')), lambda t: t <> ''), '|')
          ELSE '' END AS tokens FROM contacts""",
        CONTACTS_SQL,
    ),
)
def tx_email_tokens(spark, sf):
    return rel.contacts(spark, sf).select("row_id", F.array_join(tx.email_tokens("email"), "|").alias("tokens"))


SQL_CORE = "regexp_replace(lower(split_part(trim({}), ' ', 1)), '[^a-z]', '', 'g')"


@query(
    "tx_name_core",
    with_ctes(
        f"""SELECT row_id, {SQL_CORE.format('firstname')} AS first_core,
          {SQL_CORE.format("split_part(lastname, ',', 1)")} AS last_core FROM contacts""",
        CONTACTS_SQL,
    ),
)
def tx_name_core(spark, sf):
    return rel.contacts(spark, sf).select(
        "row_id", tx.first_name_core("firstname").alias("first_core"), tx.last_name_core("lastname").alias("last_core")
    )


@query(
    "tx_strip_credentials",
    with_ctes("SELECT row_id, split_part(firstname, ',', 1) AS first, split_part(lastname, ',', 1) AS last FROM contacts", CONTACTS_SQL),
)
def tx_strip_credentials(spark, sf):
    return rel.contacts(spark, sf).select(
        "row_id", tx.strip_credentials("firstname").alias("first"), tx.strip_credentials("lastname").alias("last")
    )


@query(
    "num_rate",
    """SELECT o_custkey AS id, coalesce(round_even(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 3), 0.0::DOUBLE) AS rate,
        coalesce(round_even(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100, 2), 0.0::DOUBLE) AS pct FROM orders GROUP BY 1""",
)
def num_rate(spark, sf):
    finished = F.count_if(F.col("o_orderstatus") == "F")
    return rel.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        tx.rate(finished, F.count(F.lit(1)), 3).alias("rate"),
        tx.rate(finished, F.count(F.lit(1)), 2, 100.0).alias("pct"),
    )


SQL_COMPOSITE = (
    f"{q.lookup('{s}', fv.SENIORITY_WEIGHTS, '0')} * 0.5::DOUBLE + {q.keyword_score('title', fv.TITLE_KEYWORDS, fv.TITLE_PENALTIES)} * 0.35::DOUBLE"
    f" + ({q.keyword_hits('title')} + {q.keyword_hits('focus_area')}) * 0.12::DOUBLE"
    " + CASE WHEN degree IN ('1', '1st', 'First', 'first') THEN 1 ELSE 0 END * 0.03::DOUBLE"
)


def composite_sql(seniority: str) -> str:
    return SQL_COMPOSITE.replace("{s}", seniority)


def composite(seniority="seniority"):
    return cl.composite_score(
        cl.seniority_weight(F.col(seniority)),
        tx.keyword_score("title", fv.TITLE_KEYWORDS, fv.TITLE_PENALTIES),
        tx.keyword_hits("title") + tx.keyword_hits("focus_area"),
        tx.close_connection("degree"),
    )


@query("num_composite", with_ctes(f"SELECT row_id, round_even({composite_sql('seniority')}, 6) AS score FROM contacts", CONTACTS_SQL))
def num_composite(spark, sf):
    return rel.contacts(spark, sf).select("row_id", F.bround(composite(), 6).alias("score"))


@query(
    "flag_connection",
    with_ctes("SELECT row_id, CAST(CASE WHEN degree IN ('1', '1st', 'First', 'first') THEN 1 ELSE 0 END AS BIGINT) AS close FROM contacts", CONTACTS_SQL),
)
def flag_connection(spark, sf):
    return rel.contacts(spark, sf).select("row_id", tx.close_connection("degree").cast("bigint").alias("close"))


@query(
    "blank_to_null",
    with_ctes("SELECT row_id, CASE WHEN trim(title) <> '' THEN title END AS title, CASE WHEN trim(location) <> '' THEN location END AS location FROM contacts", CONTACTS_SQL),
)
def blank_to_null(spark, sf):
    return rel.contacts(spark, sf).select(
        "row_id", tx.blank_to_null("title").alias("title"), tx.blank_to_null("location").alias("location")
    )


@query("num_coerce", with_ctes("SELECT row_id, TRY_CAST(shared AS DOUBLE) AS shared FROM contacts", CONTACTS_SQL))
def num_coerce(spark, sf):
    return rel.contacts(spark, sf).select("row_id", tx.number("shared").alias("shared"))


@query(
    "coalesce_columns",
    with_ctes(
        "SELECT row_id, coalesce(CASE WHEN trim(location) <> '' THEN location END, CASE WHEN trim(title) <> '' THEN title END, url) AS value FROM contacts",
        CONTACTS_SQL,
    ),
)
def coalesce_columns(spark, sf):
    return rel.contacts(spark, sf).select("row_id", tx.first_present("location", "title", "url").alias("value"))


@query(
    "split_full_name",
    with_ctes(
        """SELECT row_id, CASE WHEN trim(n) <> '' THEN split_part(trim(n), ' ', 1) END AS first,
          CASE WHEN position(' ' IN trim(n)) > 0 THEN substr(trim(n), position(' ' IN trim(n)) + 1) END AS rest
        FROM (SELECT row_id, coalesce(title, company) AS n FROM contacts)""",
        CONTACTS_SQL,
    ),
)
def split_full_name(spark, sf):
    first, rest = tx.split_full_name(F.coalesce("title", "company"))
    return rel.contacts(spark, sf).select("row_id", first.alias("first"), rest.alias("rest"))


@query(
    "seniority_prefer_given",
    with_ctes(f"SELECT row_id, coalesce(seniority, {q.inferred_seniority('title')}) AS seniority FROM contacts", CONTACTS_SQL),
)
def seniority_prefer_given(spark, sf):
    return rel.contacts(spark, sf).select("row_id", cl.seniority_or_inferred("seniority", "title").alias("seniority"))
