"""Queries over counts, rates and summaries."""

from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.catalog import sql as q
from muster.catalog.registry import query
from muster.catalog.rules import ELIGIBLE_SQL, FIX_SQL, eligible_contacts, geo_fuzzy_sql, segment_ctes
from muster.functions import classify as cl
from muster.functions import text as tx
from muster.operators import report as rp
from muster.plans import relations as rel
from muster.plans.relations import COMPANIES_WIDE_SQL, CONTACTS_SQL, MEMBERS_SQL, sql_text, with_ctes

GEO_SQL = f"""
  placed AS (SELECT *, {q.geo_bucket('location')} AS bucket, {q.influencer('title', 'shared')} AS flag FROM contacts)"""


def placed(spark, sf):
    return rel.contacts(spark, sf).withColumn("bucket", cl.geo_bucket("location")).withColumn(
        "flag", cl.influencer("title", tx.number("shared"))
    )


@query(
    "agg_group_rate",
    with_ctes(
        """SELECT bucket, count(url) AS total, CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) AS BIGINT) AS influencers,
        coalesce(round_even(CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(url), 0), 3), 0.0::DOUBLE) AS influencer_rate FROM placed GROUP BY 1""",
        CONTACTS_SQL, GEO_SQL,
    ),
)
def agg_group_rate(spark, sf):
    return rp.group_rate(placed(spark, sf), "bucket", "url", "flag")


@query(
    "agg_min_size_rollup",
    with_ctes(
        """SELECT CASE WHEN n < 180 THEN 'US' ELSE bucket END AS bucket, CAST(sum(n) AS BIGINT) AS n
        FROM (SELECT bucket, count(*) AS n FROM placed GROUP BY 1) GROUP BY 1""",
        CONTACTS_SQL, GEO_SQL,
    ),
)
def agg_min_size_rollup(spark, sf):
    return rp.counts_by(rp.roll_up_small(placed(spark, sf), "bucket", fv.MAIN_BUCKETS, min_rows=180), "bucket")


def _rank_sql():
    def rank(order):
        return q.lookup("segment", {s: i for i, s in enumerate(order)}, "999")

    return f"CASE WHEN org_type = 'Credit Union' THEN {rank(fv.CREDIT_UNION_SEGMENT_ORDER)} ELSE {rank(fv.BANK_SEGMENT_ORDER)} END"


@query(
    "agg_two_key_count",
    with_ctes(
        f"SELECT org_type, segment, count(*) AS n, CAST({_rank_sql()} AS BIGINT) AS rank FROM segmented GROUP BY 1, 2, 4",
        CONTACTS_SQL, segment_ctes(),
    ),
)
def agg_two_key_count(spark, sf):
    df = cl.with_segment(rel.contacts(spark, sf), "title", "seniority", "company")
    return rp.segment_counts(df).withColumn("rank", F.col("rank").cast("bigint"))


STATES = list(fv.FUZZY_STATES) + [fv.OTHER_STATES]
GRID_VALUES = ", ".join(
    f"({sql_text(s)}, {sql_text(k)}, {sql_text(f)})" for s in STATES for k in fv.COMPANY_TYPES for f in fv.FOCUS_LABELS
)


@query(
    "agg_dense_grid",
    with_ctes(
        """SELECT g.state || ' - ' || g.kind || ' - ' || g.focus AS segment, count(c.row_id) AS count,
          'Hi {FirstName},' || chr(10) || chr(10) || 'I’m connecting with ' || CASE WHEN g.kind = 'Bank' THEN 'banking' ELSE 'credit union' END
            || ' leaders across ' || CASE WHEN g.state = 'Other States' THEN 'the US' ELSE g.state END
            || ' who are driving projects in AI, data and automation. It would be great to connect and share insights ahead of a summit in Charlotte this November.'
            || chr(10) || chr(10) || 'Best regards, Mark' AS connection
        FROM grid g LEFT JOIN typed c USING (state, kind, focus) GROUP BY g.state, g.kind, g.focus""",
        CONTACTS_SQL, geo_fuzzy_sql("contacts", "location"),
        f"""typed AS (SELECT row_id, coalesce(state, 'Other States') AS state, {q.company_type('company')} AS kind, {q.focus('title')} AS focus
          FROM contacts LEFT JOIN fuzzy_state ON lower(location) = low)""",
        f"grid(state, kind, focus) AS (VALUES {GRID_VALUES})",
    ),
)
def agg_dense_grid(spark, sf):
    df = rel.contacts(spark, sf).select(
        cl.geo_fuzzy("location").alias("state"), cl.company_type("company").alias("kind"), cl.focus("title").alias("focus")
    )
    grid = rp.dense_grid(df, "state", "kind", "focus", STATES)
    return grid.select("segment", "count", "connection")


@query(
    "agg_distinct_by_id",
    with_ctes("SELECT company, count(DISTINCT url) AS contacts FROM contacts GROUP BY 1", CONTACTS_SQL),
)
def agg_distinct_by_id(spark, sf):
    df = rel.contacts(spark, sf).withColumn("record_id", F.lit(None).cast("string"))
    return rp.distinct_by_id(df, "company", ["record_id", "url", "email"], ["email", "firstname", "lastname"])


@query(
    "agg_nunique",
    with_ctes(
        """SELECT count(DISTINCT company) AS companies, count(*) AS selected,
        round_even(CAST(count(*) AS DOUBLE) / greatest(count(DISTINCT company), 1), 1) AS per_company FROM eligible""",
        CONTACTS_SQL, ELIGIBLE_SQL,
    ),
)
def agg_nunique(spark, sf):
    companies = F.countDistinct("company")
    return eligible_contacts(spark, sf).agg(
        companies.alias("companies"), F.count(F.lit(1)).alias("selected"),
        tx.rate(F.count(F.lit(1)), F.greatest(companies, F.lit(1)), 1).alias("per_company"),
    )


@query(
    "agg_variants",
    with_ctes(
        f"""SELECT key, arg_min(name, row_id) AS display, count(*) AS variants,
          array_to_string(list_slice(list(name ORDER BY row_id), 1, 6), ', ') || CASE WHEN count(*) > 6 THEN ' ...' ELSE '' END AS preview
        FROM (SELECT {q.brand_core('name')} AS key, name, min(row_id) AS row_id FROM companies_wide GROUP BY name) GROUP BY 1""",
        COMPANIES_WIDE_SQL,
    ),
)
def agg_variants(spark, sf):
    names = rel.companies_wide(spark, sf).groupBy("name").agg(F.min("row_id").alias("row_id"))
    return rp.variants(names.withColumn("key", tx.brand_core("name")), "key", "name")


@query(
    "agg_top_values",
    with_ctes("SELECT coalesce(title, '(blank)') AS value, count(*) AS n FROM contacts GROUP BY 1 ORDER BY n DESC, value LIMIT 20", CONTACTS_SQL),
)
def agg_top_values(spark, sf):
    return rp.top_values(rel.contacts(spark, sf), "title", 20)


@query(
    "agg_rule_counts",
    with_ctes("SELECT source_sheet AS sheet, rule, count(*) AS n FROM fixed GROUP BY 1, 2", CONTACTS_SQL, FIX_SQL),
)
def agg_rule_counts(spark, sf):
    df = rel.contacts(spark, sf).select(
        F.col("source_sheet").alias("sheet"), cl.fixed_name("email", "firstname", "lastname")["rule"].alias("rule")
    )
    return rp.counts_by(df, "sheet", "rule")


@query(
    "agg_bucket_counts",
    with_ctes(
        f"SELECT CASE WHEN {q.is_nc('location')} THEN 'North Carolina' ELSE 'Other' END AS bucket, count(*) AS n FROM contacts WHERE {q.has_pattern('title', fv.VIP_TITLE_PATTERNS)} GROUP BY 1",
        CONTACTS_SQL,
    ),
)
def agg_bucket_counts(spark, sf):
    vip = rel.contacts(spark, sf).filter(cl.vip_title("title"))
    return rp.counts_by(vip.withColumn("bucket", cl.nc_label(cl.is_nc("location"))), "bucket")


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


@query(
    "agg_table_inventory",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS rows, (SELECT count(*) FROM (DESCRIBE {t})) AS cols" for t in TABLES
    ),
)
def agg_table_inventory(spark, sf):
    return rp.inventory({t: rel.table(spark, sf, t) for t in TABLES})


@query(
    "agg_dedupe_report",
    with_ctes(
        f"""SELECT count(*) AS before, count(DISTINCT coalesce({q.profile_url('url')}, '')) AS after,
        count(*) - count(DISTINCT coalesce({q.profile_url('url')}, '')) AS removed FROM contacts""",
        CONTACTS_SQL,
    ),
)
def agg_dedupe_report(spark, sf):
    return rp.dedupe_report(rel.contacts(spark, sf), [tx.profile_url("url")])


@query(
    "agg_quality_counts",
    with_ctes(
        f"""SELECT CAST(sum(CASE WHEN {q.seniority_score(q.canonical_seniority('seniority'))} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ranked,
        count(company) AS with_company, count(*) AS total FROM contacts""",
        CONTACTS_SQL,
    ),
)
def agg_quality_counts(spark, sf):
    scored = rel.contacts(spark, sf).select("company", cl.canonical_seniority("seniority").alias("label"))
    return scored.agg(
        F.count_if(cl.seniority_score(F.col("label")) > 0).alias("ranked"), F.count("company").alias("with_company"),
        F.count(F.lit(1)).alias("total"),
    )


RATIO_COLUMNS = ["company", "email", "url"]


@query(
    "agg_column_ratio",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", avg(CASE WHEN contains(lower(coalesce({c}, '')), 'linkedin.com/') THEN 1 ELSE 0 END) AS share FROM contacts"
            for c in RATIO_COLUMNS
        ),
        CONTACTS_SQL,
    ),
)
def agg_column_ratio(spark, sf):
    return rp.column_ratio(rel.contacts(spark, sf), "linkedin.com/", RATIO_COLUMNS).select("column", "share")


OWNER_SQL = f"""
  first_owner AS (SELECT {q.profile_url('url')} AS u, min(member_idx) AS owner FROM member_connections
    WHERE contains({q.profile_url('url')}, 'linkedin.com/') GROUP BY 1),
  owned AS (SELECT c.*, o.owner FROM contacts c LEFT JOIN first_owner o ON {q.profile_url('c.url')} = o.u)"""


@query(
    "agg_prematched",
    with_ctes("SELECT owner AS member_idx, count(*) AS n FROM owned WHERE owner IS NOT NULL GROUP BY 1", CONTACTS_SQL, MEMBERS_SQL, OWNER_SQL),
)
def agg_prematched(spark, sf):
    from muster.operators.select import owners_of

    owned = owners_of(rel.contacts(spark, sf).select("row_id", "url"), rel.member_connections(spark, sf))
    return rp.counts_by(owned.filter(F.col("owner").isNotNull()).withColumnRenamed("owner", "member_idx"), "member_idx")


@query(
    "agg_distinct_sorted",
    with_ctes("SELECT DISTINCT name FROM companies_wide WHERE name IS NOT NULL", COMPANIES_WIDE_SQL),
)
def agg_distinct_sorted(spark, sf):
    return rp.distinct_sorted(rel.companies_wide(spark, sf), "name")
