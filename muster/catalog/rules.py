"""Queries over the row classifiers and row filters."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.catalog import sql as q
from muster.catalog.registry import query
from muster.catalog.text import composite, composite_sql
from muster.functions import classify as cl
from muster.functions import text as tx
from muster.plans import relations as rel
from muster.plans.relations import COMPANIES_WIDE_SQL, CONTACTS_SQL, sql_text, with_ctes


def _simple(key, value, sql):
    """Query of one column expression over all contacts."""

    @query(key, with_ctes(f"SELECT row_id, {sql} AS value FROM contacts", CONTACTS_SQL))
    def run(spark, sf):
        return rel.contacts(spark, sf).select("row_id", value().alias("value"))


_simple("cls_focus", lambda: cl.focus("title"), q.focus("title"))
_simple("cls_geo_bucket", lambda: cl.geo_bucket("location"), q.geo_bucket("location"))
_simple("cls_is_nc", lambda: cl.is_nc("location"), q.is_nc("location"))
_simple("cls_bucket_label", lambda: cl.nc_label(cl.is_nc("location")),
        f"CASE WHEN {q.is_nc('location')} THEN 'North Carolina' ELSE 'Other' END")
_simple("cls_influencer", lambda: cl.influencer("title", tx.number("shared")), q.influencer("title", "shared"))
_simple("cls_infer_seniority", lambda: cl.inferred_seniority("title"), q.inferred_seniority("title"))
_simple("cls_seniority_weight", lambda: cl.seniority_weight(F.col("seniority")).cast("bigint"),
        f"CAST({q.lookup('seniority', fv.SENIORITY_WEIGHTS, '0')} AS BIGINT)")
_simple("cls_balance_bucket", lambda: cl.balance_bucket(F.col("seniority")), q.balance_bucket("seniority"))
_simple("cls_most_senior", lambda: cl.most_senior("seniority", "title"),
        f"(lower(coalesce(seniority, '')) IN ({', '.join(sql_text(s) for s in fv.SENIOR_FOR_OTHERS)}) OR {q.has_pattern('title', [fv.SENIOR_TITLE_PATTERN])})")
_simple("flt_isin_policy",
        lambda: cl.allowed_or(F.split_part(F.col("location"), F.lit(","), F.lit(1)), fv.MAIN_BUCKETS, "US"),
        f"CASE WHEN split_part(location, ',', 1) IN ({', '.join(sql_text(s) for s in fv.MAIN_BUCKETS)}) THEN split_part(location, ',', 1) ELSE 'US' END")


@query(
    "cls_org_type",
    with_ctes(
        f"""SELECT 'contact' AS origin, row_id, {q.org_type('company')} AS value FROM contacts
        UNION ALL SELECT 'wide' AS origin, row_id, {q.org_type('name')} AS value FROM companies_wide""",
        CONTACTS_SQL, COMPANIES_WIDE_SQL,
    ),
)
def cls_org_type(spark, sf):
    a = rel.contacts(spark, sf).select(F.lit("contact").alias("origin"), "row_id", cl.org_type("company").alias("value"))
    b = rel.companies_wide(spark, sf).select(F.lit("wide").alias("origin"), "row_id", cl.org_type("name").alias("value"))
    return a.unionByName(b)


@query(
    "cls_company_type",
    with_ctes(
        f"SELECT row_id, {q.company_type('company')} AS value, {q.company_type('company', 'Unknown')} AS strict FROM contacts",
        CONTACTS_SQL,
    ),
)
def cls_company_type(spark, sf):
    return rel.contacts(spark, sf).select(
        "row_id", cl.company_type("company").alias("value"), cl.company_type("company", "Unknown").alias("strict")
    )


def segment_ctes(source: str = "contacts") -> str:
    """Oracle CTEs ending in ``segmented(row_id, …, org_type, segment)``."""
    union = "org_type = 'Credit Union'"

    def gated(seg, hit):
        gate = {
            "Technology": q.matches("jt", q.alt(fv.TECHNOLOGY_ANCHORS)),
            "Data": q.matches("jt", fv.DATA_GATE),
            "Innovation": q.matches("jt", fv.INNOVATION_GATE),
        }.get(seg)
        return f"({hit})" if gate is None else f"({hit} AND {gate})"

    def core(rules):
        return q.case([(gated(s, q.has_phrase("jt", c)), sql_text(s)) for s, c, _ in rules], "NULL")

    def counts(rules, prefix):
        return ", ".join(
            f"CASE WHEN {gated(s, 'true')} THEN {q.phrase_count('jt', g)} ELSE 0 END AS {prefix}{i}"
            for i, (s, _, g) in enumerate(rules)
        )

    def best(rules, prefix):
        n = len(rules)
        out = []
        for i, (s, _, _) in enumerate(rules):
            beats = [f"{prefix}{i} > {prefix}{j}" for j in range(i)] + [f"{prefix}{i} >= {prefix}{j}" for j in range(i + 1, n)]
            out.append((" AND ".join([f"{prefix}{i} > 0"] + beats), sql_text(s)))
        return q.case(out, "NULL")

    override = q.case(
        [
            (f"{q.matches('jt', fv.RISK_WORD)} AND {q.matches('jt', fv.ANALYTICS_WORD)}", "'Risk'"),
            (q.matches("jt", fv.IDENTITY_ACCESS), "'Compliance'"),
            (f"NOT ({union}) AND {q.matches('jt', fv.DIGITAL_WORD)} AND {q.matches('jt', fv.PRODUCT_WORD)}", "'Innovation'"),
            (f"{union} AND {q.matches('jt', fv.CHANNEL_BANKING)}", "'Digital Banking'"),
            (f"{q.matches('jt', fv.LEADING_IT)} AND {q.matches('jt', fv.BUSINESS_ANALYST)}", "'Technology'"),
        ],
        "NULL",
    )
    senior = ", ".join(sql_text(s) for s in fv.SENIOR_FOR_OTHERS)
    return f"""{q.expand_ctes(source, 'title')},
  typed AS (SELECT *, {q.org_type('company')} AS org_type FROM expanded),
  counted AS (SELECT *, {counts(fv.CREDIT_UNION_SEGMENTS, 'u')}, {counts(fv.BANK_SEGMENTS, 'b')} FROM typed),
  segmented AS (SELECT *, coalesce({override},
      CASE WHEN {union} THEN {core(fv.CREDIT_UNION_SEGMENTS)} ELSE {core(fv.BANK_SEGMENTS)} END,
      CASE WHEN {union} THEN {best(fv.CREDIT_UNION_SEGMENTS, 'u')} ELSE {best(fv.BANK_SEGMENTS, 'b')} END,
      CASE WHEN lower(coalesce(seniority, '')) IN ({senior}) THEN '{fv.SENIOR_SEGMENT}' END, '{fv.UNASSIGNED_SEGMENT}') AS segment FROM counted)"""


@query("cls_segment", with_ctes("SELECT row_id, org_type, segment FROM segmented", CONTACTS_SQL, segment_ctes()))
def cls_segment(spark, sf):
    return cl.with_segment(rel.contacts(spark, sf), "title", "seniority", "company").select("row_id", "org_type", "segment")


def geo_fuzzy_sql(source: str, value: str, other: str = fv.OTHER_STATES, threshold: int = 85) -> str:
    """CTEs ending in ``fuzzy_state(value, state)`` over distinct values of a column."""
    tokens = ", ".join(
        f"({i}, {sql_text(s)}, {sql_text(t.lower())})" for i, (s, ts) in enumerate(fv.FUZZY_STATES.items()) for t in ts
    )
    return f"""
  places AS (SELECT DISTINCT lower({value}) AS low FROM {source} WHERE coalesce({value}, '') <> ''),
  tokens(i, state, token) AS (VALUES {tokens}),
  sides AS (SELECT low, i, state, token, s, l FROM (
      SELECT *, CASE WHEN length(token) <= length(low) THEN token ELSE low END AS s,
        CASE WHEN length(token) <= length(low) THEN low ELSE token END AS l FROM places, tokens)
    UNION ALL SELECT low, i, state, token, low AS s, token AS l FROM places, tokens WHERE length(token) = length(low)),
  windows AS (SELECT low, i, state, s, unnest(list_transform(range(1 - length(s), length(l)),
      lambda k: substr(l, (greatest(k, 0) + 1)::BIGINT, (least(k + length(s), length(l)) - greatest(k, 0))::BIGINT))) AS w FROM sides),
  scored AS (SELECT low, i, state, max({q.ratio('s', 'w')}) AS score FROM windows GROUP BY 1, 2, 3),
  fuzzy_state AS (SELECT low, CASE WHEN max(score) >= {threshold} THEN arg_max(state, score * 100 - i) ELSE {sql_text(other)} END AS state
    FROM scored GROUP BY 1)"""


@query(
    "cls_geo_fuzzy",
    with_ctes(
        f"SELECT row_id, coalesce(state, {sql_text(fv.OTHER_STATES)}) AS state FROM contacts LEFT JOIN fuzzy_state ON lower(location) = low",
        CONTACTS_SQL, geo_fuzzy_sql("contacts", "location"),
    ),
)
def cls_geo_fuzzy(spark, sf):
    return rel.contacts(spark, sf).select("row_id", cl.geo_fuzzy("location").alias("state"))


def _multi_sql(x):
    low = f"lower({q.strip(x)})"
    out = []
    for state, codes in fv.SPLIT_STATES.items():
        name = sql_text(state.lower())
        eq = ", ".join(sql_text(v) for c in codes for v in (c, c + "."))
        out.append(
            f"SELECT row_id, {sql_text(state)} AS state FROM contacts WHERE {x} IS NOT NULL AND (contains({low}, {name}) OR {low} IN ({eq})"
            f" OR {q.ratio(q.sorted_tokens(low), q.sorted_tokens(name))} >= 80)"
        )
    return " UNION ALL ".join(out)


@query("cls_geo_multi", with_ctes(_multi_sql("location"), CONTACTS_SQL))
def cls_geo_multi(spark, sf):
    return rel.contacts(spark, sf).select("row_id", F.explode(cl.geo_multi("location")).alias("state"))


def title_seniority_sql(x: str, part: int) -> str:
    t = f"(' ' || lower({q.strip(q.nz(x))}) || ' ')"
    rules = [fv.GLOBAL_LEAD_RULE] + fv.TITLE_SENIORITY_RULES
    lit = (lambda r: str(r[1])) if part == 1 else (lambda r: sql_text(r[2]))
    # The oracle's regex engine has no lookahead.
    return q.case([(q.matches(t, r[0].replace("(?![a-z])", "(?:$|[^a-z])")), lit(r)) for r in rules], "0" if part == 1 else "'Unknown'")


@query(
    "cls_title_seniority",
    with_ctes(f"SELECT row_id, CAST({title_seniority_sql('title', 1)} AS BIGINT) AS score, {title_seniority_sql('title', 2)} AS label FROM contacts", CONTACTS_SQL),
)
def cls_title_seniority(spark, sf):
    graded = cl.title_seniority("title")
    return rel.contacts(spark, sf).select("row_id", graded.alias("g")).select(
        "row_id", F.col("g.score").cast("bigint").alias("score"), F.col("g.label").alias("label")
    )


@query(
    "cls_canon_seniority",
    with_ctes(
        f"SELECT row_id, label, CAST({q.seniority_score('label')} AS BIGINT) AS score FROM (SELECT row_id, {q.canonical_seniority('seniority')} AS label FROM contacts)",
        CONTACTS_SQL,
    ),
)
def cls_canon_seniority(spark, sf):
    return rel.contacts(spark, sf).select("row_id", cl.canonical_seniority("seniority").alias("label")).select(
        "row_id", "label", cl.seniority_score(F.col("label")).cast("bigint").alias("score")
    )


def _name_core(x):
    return f"regexp_replace(lower(split_part(trim({x}), ' ', 1)), '[^a-z]', '', 'g')"


FIX_SQL = f"""
  mail AS (SELECT *, CASE WHEN email LIKE '%@%' THEN list_filter(list_transform(string_split_regex(lower(split_part(email, '@', 1)), '[._]'),
      lambda t: regexp_replace(t, '[^a-z]', '', 'g')), lambda t: t <> '') ELSE [] END AS tk,
      split_part(firstname, ',', 1) AS fc, split_part(lastname, ',', 1) AS lc,
      {_name_core('firstname')} AS cf, {_name_core("split_part(lastname, ',', 1)")} AS cll FROM contacts),
  ruled AS (SELECT *, CASE WHEN len(tk) < 2 THEN 'original_cleaned'
      WHEN cf = tk[1] AND cll = tk[-1] THEN 'matched_email_orientation'
      WHEN cf = tk[-1] AND cll = tk[1] THEN 'swapped_based_on_email'
      WHEN cf = tk[1] AND contains(cll, tk[-1]) THEN 'lastname_trimmed_to_core'
      WHEN cf = tk[1] THEN 'lastname_overwritten_from_email'
      WHEN cll = tk[-1] AND contains(cf, tk[1]) THEN 'firstname_trimmed_to_core'
      WHEN cll = tk[-1] THEN 'firstname_overwritten_from_email' ELSE 'original_cleaned' END AS rule FROM mail),
  fixed AS (SELECT *, CASE rule WHEN 'swapped_based_on_email' THEN lc
        WHEN 'firstname_overwritten_from_email' THEN upper(tk[1][1:1]) || tk[1][2:] ELSE fc END AS first,
      CASE rule WHEN 'swapped_based_on_email' THEN fc
        WHEN 'lastname_overwritten_from_email' THEN upper(tk[-1][1:1]) || tk[-1][2:] ELSE lc END AS last FROM ruled)"""


@query(
    "cls_fix_names",
    with_ctes(
        """SELECT row_id, first, last, rule FROM fixed WHERE source_sheet <> 's2'
        UNION ALL SELECT row_id, firstname AS first, '' AS last, 'missing_required_columns' AS rule FROM fixed WHERE source_sheet = 's2'""",
        CONTACTS_SQL, FIX_SQL,
    ),
)
def cls_fix_names(spark, sf):
    """Contacts of two kinds of sheets; one kind has no last names."""
    people = rel.contacts(spark, sf).select("row_id", "email", F.col("firstname").alias("First Name"), F.col("lastname").alias("last_name"), "source_sheet")
    parts = [people.filter("source_sheet <> 's2'"), people.filter("source_sheet = 's2'").drop("last_name")]
    return reduce(DataFrame.unionByName, [cl.with_fixed_names(part).select(
        "row_id", F.col("firstname_fixed").alias("first"), F.col("lastname_fixed").alias("last"), F.col("name_fix_rule").alias("rule")) for part in parts])


# --------------------------------------------------------------------- filters

@query("flt_vip_title", with_ctes(f"SELECT row_id, title FROM contacts WHERE {q.has_pattern('title', fv.VIP_TITLE_PATTERNS)}", CONTACTS_SQL))
def flt_vip_title(spark, sf):
    return rel.contacts(spark, sf).filter(cl.vip_title("title")).select("row_id", "title")


SENIORITY_FINAL_SQL = f"coalesce(seniority, {q.inferred_seniority('title')})"
ELIGIBLE_SQL = f"""
  features AS (SELECT *, {SENIORITY_FINAL_SQL} AS final_seniority, {q.keyword_hits('title')} + {q.keyword_hits('focus_area')} AS hits FROM contacts),
  eligible AS (SELECT *, {composite_sql('final_seniority')} AS score, {q.balance_bucket('final_seniority')} AS bucket FROM features
    WHERE lower(coalesce(relevance, '')) = 'relevant' AND (hits > 0 OR final_seniority IN
      ({', '.join(sql_text(s) for s in fv.LEADERSHIP_LABELS + fv.MANAGER_LABELS)})))"""


def eligible_contacts(spark, sf):
    """Contacts passing relevance and focus rules, with score and bucket."""
    return (
        rel.contacts(spark, sf)
        .withColumn("final_seniority", cl.seniority_or_inferred("seniority", "title"))
        .withColumn("hits", tx.keyword_hits("title") + tx.keyword_hits("focus_area"))
        .filter(cl.eligible("relevance", F.col("hits"), F.col("final_seniority")))
        .withColumn("score", composite("final_seniority"))
        .withColumn("bucket", cl.balance_bucket(F.col("final_seniority")))
    )


@query("flt_eligibility", with_ctes("SELECT row_id, final_seniority, CAST(hits AS BIGINT) AS hits FROM eligible", CONTACTS_SQL, ELIGIBLE_SQL))
def flt_eligibility(spark, sf):
    return eligible_contacts(spark, sf).select("row_id", "final_seniority", F.col("hits").cast("bigint").alias("hits"))


@query(
    "flt_equals_bucket",
    with_ctes("SELECT row_id FROM segmented WHERE org_type = 'Bank' AND segment = 'Risk'", CONTACTS_SQL, segment_ctes()),
)
def flt_equals_bucket(spark, sf):
    df = cl.with_segment(rel.contacts(spark, sf), "title", "seniority", "company")
    return df.filter((F.col("org_type") == "Bank") & (F.col("segment") == "Risk")).select("row_id")


@query("flt_nonempty_key", with_ctes("SELECT row_id, company FROM contacts WHERE trim(coalesce(company, '')) <> ''", CONTACTS_SQL))
def flt_nonempty_key(spark, sf):
    return rel.contacts(spark, sf).filter(tx.strip("company") != "").select("row_id", "company")


@query("flt_contains_url", with_ctes(f"SELECT row_id, {q.profile_url('url')} AS url FROM contacts WHERE contains({q.profile_url('url')}, 'linkedin.com/')", CONTACTS_SQL))
def flt_contains_url(spark, sf):
    df = rel.contacts(spark, sf).select("row_id", tx.profile_url("url").alias("url"))
    return df.filter(F.contains("url", F.lit("linkedin.com/")))
