"""Queries over ranking, selection, splitting and allocation."""

from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.catalog import sql as q
from muster.catalog.aggregates import OWNER_SQL, _rank_sql
from muster.catalog.registry import query
from muster.catalog.rules import ELIGIBLE_SQL, eligible_contacts, segment_ctes
from muster.functions import classify as cl
from muster.functions import text as tx
from muster.operators import dedupe as dd
from muster.operators import select as sl
from muster.operators.position import shuffled, sorted_by, with_position
from muster.plans import relations as rel
from muster.plans.relations import CONTACTS_SQL, MEMBERS_SQL, sql_text, with_ctes
from muster.plans.storage import cut_lineage

SCORED_SQL = f"""
  labelled AS (SELECT *, {q.canonical_seniority('seniority')} AS label, {q.proposed('company')} AS standard FROM contacts),
  scored AS (SELECT *, {q.seniority_score('label')} AS points FROM labelled)"""


def scored(spark, sf):
    """Contacts with standard company, seniority label and points."""
    return (
        rel.contacts(spark, sf)
        .withColumn("standard", tx.proposed_name("company"))
        .withColumn("label", cl.canonical_seniority("seniority"))
        .withColumn("points", cl.seniority_score(F.col("label")))
    )


@query(
    "win_topn_group",
    with_ctes(
        """SELECT standard, row_id, rn AS rank FROM (SELECT standard, row_id,
          row_number() OVER (PARTITION BY standard ORDER BY points DESC, row_id) AS rn FROM scored) WHERE rn <= 5""",
        CONTACTS_SQL, SCORED_SQL,
    ),
)
def win_topn_group(spark, sf):
    return sl.top_per_company(scored(spark, sf), "standard", "points").select(
        "standard", "row_id", F.col("rank").cast("bigint").alias("rank")
    )


SPREAD_TURN = q.lookup("label", {b: i for i, b in enumerate(fv.PREFERRED_SPREAD)}, "5")


@query(
    "win_topn_spread",
    with_ctes(
        f"""SELECT standard, row_id, label, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY standard
            ORDER BY CASE WHEN place = 1 THEN {SPREAD_TURN} ELSE 5 END, points DESC, row_id) AS rn
          FROM (SELECT *, row_number() OVER (PARTITION BY standard, label ORDER BY points DESC, row_id) AS place FROM scored
            WHERE trim(coalesce(standard, '')) <> '')) WHERE rn <= 5""",
        CONTACTS_SQL, SCORED_SQL,
    ),
)
def win_topn_spread(spark, sf):
    people = scored(spark, sf).filter(tx.strip("standard") != "")
    return sl.top_with_spread(people, "standard", "label", "points").select(
        "standard", "row_id", "label", F.col("rank").cast("bigint").alias("rank")
    )


QUOTA_MAX, QUOTA_MIN = 40, 25
QUOTAS = sl.bucket_quotas(QUOTA_MAX)


@query(
    "win_quota_topn",
    with_ctes(
        f"""SELECT company, row_id, bucket, round_even(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY company
            ORDER BY CASE WHEN place <= {q.lookup('bucket', QUOTAS, '0')} THEN {q.lookup('bucket', {b: i for i, b in enumerate(QUOTAS)}, '3')} ELSE 3 END, score DESC, row_id) AS rn
          FROM (SELECT *, row_number() OVER (PARTITION BY company, bucket ORDER BY score DESC, row_id) AS place,
            count(*) OVER (PARTITION BY company) AS n FROM eligible WHERE trim(coalesce(company, '')) <> ''))
          WHERE n <= {QUOTA_MIN} OR rn <= {QUOTA_MAX}""",
        CONTACTS_SQL, ELIGIBLE_SQL,
    ),
)
def win_quota_topn(spark, sf):
    people = eligible_contacts(spark, sf).filter(tx.strip("company") != "")
    picked = sl.select_with_quotas(people, "company", "bucket", "score", QUOTA_MAX, QUOTA_MIN)
    return picked.select("company", "row_id", "bucket", F.bround("score", 3).alias("score"))


@query(
    "win_dedupe_first",
    with_ctes(f"SELECT min(row_id) AS row_id, {q.profile_url('url')} AS key FROM contacts GROUP BY 2", CONTACTS_SQL),
)
def win_dedupe_first(spark, sf):
    df = rel.contacts(spark, sf).select("row_id", tx.profile_url("url").alias("key"), "email", "title")
    return dd.keep_first(df, ["key"]).select("row_id", "key")


PARTS = 7


@query(
    "win_split_even",
    f"SELECT o_orderkey AS row_id, CAST(ntile({PARTS}) OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS part FROM orders",
)
def win_split_even(spark, sf):
    orders = rel.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    return sl.split_even(orders, PARTS).select("row_id", F.col("part").cast("bigint").alias("part"))


@query("gen_row_id", "SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def gen_row_id(spark, sf):
    return with_position(rel.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id")))


MEMBERS = 4
ALLOCATED_SQL = OWNER_SQL + f""",
  held AS (SELECT i, coalesce(n, 0) AS n, (SELECT count(*) FROM contacts) AS total
    FROM range({MEMBERS}) m(i) LEFT JOIN (SELECT owner, count(*) AS n FROM owned WHERE owner IS NOT NULL GROUP BY 1) ON owner = i),
  room AS (SELECT i, total // {MEMBERS} + CASE WHEN i < total % {MEMBERS} THEN 1 ELSE 0 END - n AS h FROM held),
  slots AS (SELECT i, level, row_number() OVER (ORDER BY level DESC, i) AS k
    FROM (SELECT i, unnest(range(1, h + 1)) AS level FROM room WHERE h > 0)),
  rest AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS k FROM owned WHERE owner IS NULL),
  allocated AS (SELECT row_id, CAST(owner AS BIGINT) AS member_idx FROM owned WHERE owner IS NOT NULL
    UNION ALL SELECT row_id, CAST(i AS BIGINT) AS member_idx FROM rest JOIN slots USING (k))"""


def allocated(spark, sf):
    people = rel.contacts(spark, sf).select("row_id", "url", "company")
    return sl.allocate(sl.owners_of(people, rel.member_connections(spark, sf)), MEMBERS)


@query("win_allocate_balanced", with_ctes("SELECT row_id, member_idx FROM allocated", CONTACTS_SQL, MEMBERS_SQL, ALLOCATED_SQL))
def win_allocate_balanced(spark, sf):
    return allocated(spark, sf).select("row_id", F.col("member_idx").cast("bigint").alias("member_idx"))


TEAM = sl.cycled_names(["Amy", "Bo", "Cy"], PARTS)


@query(
    "win_cycle_names",
    f"SELECT part, (['Amy', 'Bo', 'Cy'])[1 + part % 3] AS member, count(*) AS rows FROM (SELECT CAST(ntile({PARTS}) OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS part FROM orders) GROUP BY 1, 2",
)
def win_cycle_names(spark, sf):
    names = F.array(*[F.lit(n) for n in TEAM])
    parts = sl.split_even(rel.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id")), PARTS)
    return parts.groupBy(F.col("part").cast("bigint").alias("part"), F.get(names, F.col("part")).alias("member")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "win_running_range",
    with_ctes(
        """SELECT member_idx, rows, CAST(upto - rows + 1 AS VARCHAR) || ' - ' || CAST(upto AS VARCHAR) AS row_range
        FROM (SELECT member_idx, rows, CAST(sum(rows) OVER (ORDER BY member_idx) AS BIGINT) AS upto
          FROM (SELECT member_idx, count(*) AS rows FROM allocated GROUP BY 1))""",
        CONTACTS_SQL, MEMBERS_SQL, ALLOCATED_SQL,
    ),
)
def win_running_range(spark, sf):
    parts = allocated(spark, sf).groupBy(F.col("member_idx").cast("bigint").alias("member_idx")).agg(F.count(F.lit(1)).alias("rows"))
    return sl.part_ranges(parts, "member_idx")


@query(
    "smp_shuffle",
    """SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '-42'), 1, 15))::BIGINT, o_orderkey) - 1 AS position FROM orders""",
)
def smp_shuffle(spark, sf):
    return shuffled(rel.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id")), seed=42)


@query(
    "srt_multi",
    with_ctes("SELECT row_id, company, lastname FROM contacts ORDER BY company ASC NULLS LAST, lastname DESC NULLS LAST, row_id", CONTACTS_SQL),
)
def srt_multi(spark, sf):
    return sorted_by(rel.contacts(spark, sf), company=True, lastname=False, row_id=True).select("row_id", "company", "lastname")


@query(
    "srt_business_rank",
    with_ctes(
        f"SELECT row_id, org_type, segment, company, CAST({_rank_sql()} AS BIGINT) AS rank FROM segmented", CONTACTS_SQL, segment_ctes()
    ),
)
def srt_business_rank(spark, sf):
    df = cl.with_segment(rel.contacts(spark, sf), "title", "seniority", "company")
    ranked = df.withColumn("rank", cl.segment_rank(F.col("org_type"), F.col("segment")).cast("bigint"))
    # A sort reads its rows twice, once for the borders of its ranges.
    kept = cut_lineage(ranked.select("row_id", "org_type", "segment", "company", "rank", "lastname", "firstname"))
    return kept.orderBy(
        "org_type", "rank", F.asc_nulls_last("company"), F.asc_nulls_last("lastname"), F.asc_nulls_last("firstname"), "row_id"
    ).select("row_id", "org_type", "segment", "company", "rank")


@query(
    "lim_head",
    with_ctes("SELECT row_id, title FROM contacts ORDER BY row_id LIMIT 20", CONTACTS_SQL),
)
def lim_head(spark, sf):
    return rel.contacts(spark, sf).select("row_id", "title").orderBy("row_id").limit(20)


# ------------------------------------------------------------------------ sets

@query(
    "set_union_all",
    with_ctes("SELECT 1 AS src, row_id, company FROM contacts UNION ALL SELECT 2 AS src, p_partkey AS row_id, p_name AS company FROM part", CONTACTS_SQL),
)
def set_union_all(spark, sf):
    a = rel.contacts(spark, sf).select(F.lit(1).alias("src"), "row_id", "company")
    b = rel.table(spark, sf, "part").select(F.lit(2).alias("src"), F.col("p_partkey").alias("row_id"), F.col("p_name").alias("company"))
    return a.unionByName(b)


UNION_SQL = """SELECT 0 AS source, row_id::BIGINT AS id, trim(company) AS name FROM contacts WHERE trim(coalesce(company, '')) <> ''
  UNION ALL SELECT 1 AS source, p_partkey::BIGINT AS id, upper(p_name) AS name FROM part
  UNION ALL SELECT 2 AS source, p_partkey::BIGINT AS id, p_name AS name FROM part"""


@query("set_union_distinct", with_ctes(f"SELECT name, source, id FROM ({UNION_SQL}) QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY source, id) = 1", CONTACTS_SQL))
def set_union_distinct(spark, sf):
    """The first spelling of every name over three sources, in order of source and id."""
    part = rel.table(spark, sf, "part")
    place = lambda source, id: F.struct(F.lit(source).alias("source"), F.col(id).cast("bigint").alias("id")).alias("row_id")
    a = rel.contacts(spark, sf).select(place(0, "row_id"), F.col("company").alias("name"))
    b = part.select(place(1, "p_partkey"), F.upper("p_name").alias("name"))
    c = part.select(place(2, "p_partkey"), F.col("p_name").alias("name"))
    return dd.distinct_names(a.unionByName(b).unionByName(c), "name").select("name", "row_id.source", "row_id.id")


@query(
    "set_complement",
    with_ctes(
        f"SELECT row_id, CASE WHEN {q.is_nc('location')} THEN 'North Carolina' ELSE 'Other' END AS side FROM contacts WHERE {q.has_pattern('title', fv.VIP_TITLE_PATTERNS)}",
        CONTACTS_SQL,
    ),
)
def set_complement(spark, sf):
    vip = rel.contacts(spark, sf).filter(cl.vip_title("title"))
    return vip.select("row_id", F.when(cl.is_nc("location"), "North Carolina").otherwise("Other").alias("side"))


@query(
    "set_difference",
    with_ctes("SELECT row_id FROM owned WHERE owner IS NULL", CONTACTS_SQL, MEMBERS_SQL, OWNER_SQL),
)
def set_difference(spark, sf):
    people = rel.contacts(spark, sf).select("row_id", "url")
    owned = sl.owners_of(people, rel.member_connections(spark, sf)).filter(F.col("owner").isNotNull())
    return people.join(owned.select("row_id"), "row_id", "left_anti").select("row_id")
