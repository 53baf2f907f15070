"""Queries over similarity scores, joins and clustering."""

from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.catalog import sql as q
from muster.catalog.registry import query
from muster.catalog.text import NAMES_SQL, names
from muster.functions import similarity as sim
from muster.functions import text as tx
from muster.operators import cluster as cu
from muster.operators import fuzzy_join as fj
from muster.operators import match as mt
from muster.operators import report as rp
from muster.operators import select as sl
from muster.plans import relations as rel
from muster.plans.storage import cut_lineage
from muster.plans.relations import (
    ALIASES_SQL, COMPANIES_WIDE_SQL, CONTACTS_SQL, MEMBERS_SQL, PRIOR_SQL, REFERENCE_SQL, SPONSOR_TARGETS_SQL, TARGETS_SQL,
    sql_text, with_ctes,
)

# ---------------------------------------------------------------------- scores

PAIRS_SQL = "pairs AS (SELECT p_partkey AS row_id, p_name || ' ' || p_brand AS a, lower(p_type) || ' ' || p_name AS b FROM part)"


def pairs(spark, sf):
    part = rel.table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("row_id"), F.concat_ws(" ", "p_name", "p_brand").alias("a"),
        F.concat_ws(" ", F.lower("p_type"), "p_name").alias("b"),
    )


def _score_query(key, fn, body, *ctes):
    @query(key, with_ctes(body, PAIRS_SQL, *ctes))
    def run(spark, sf):
        return pairs(spark, sf).select("row_id", F.bround(fn("a", "b"), 6).alias("score"))


_score_query("fz_ratio", sim.ratio, f"SELECT row_id, round_even({q.ratio('a', 'b')}, 6) AS score FROM pairs")
_score_query("fz_lev_ratio", sim.lev_ratio, f"SELECT row_id, round_even({q.ratio('a', 'b')} / 100, 6) AS score FROM pairs")
_score_query(
    "fz_token_sort", sim.token_sort_ratio,
    f"SELECT row_id, round_even({q.ratio('sa', 'sb')}, 6) AS score FROM sorted",
    f"sorted AS (SELECT row_id, {q.sorted_tokens('a')} AS sa, {q.sorted_tokens('b')} AS sb FROM pairs)",
)
_score_query(
    "fz_token_set", sim.token_set_ratio, "SELECT row_id, round_even(score, 6) AS score FROM z", q.token_set_ctes("pairs", "a", "b", "z")
)


@query(
    "fz_partial",
    with_ctes(
        "SELECT a, b, max(round_even(score, 6)) AS score FROM scored GROUP BY 1, 2",
        CONTACTS_SQL,
        f"""cells AS (SELECT DISTINCT lower(company) AS a, lower({rel.sql_pick(rel.REFERENCE_FIRMS, 'row_id')}) AS b FROM contacts WHERE company IS NOT NULL),
  sides AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM cells
    UNION ALL SELECT a, b, b AS s, a AS l FROM cells WHERE length(a) = length(b)),
  windows AS (SELECT DISTINCT a, b, s, unnest(list_transform(range(1 - length(s), length(l)),
      lambda k: substr(l, (greatest(k, 0) + 1)::BIGINT, (least(k + length(s), length(l)) - greatest(k, 0))::BIGINT))) AS w FROM sides),
  scored AS (SELECT a, b, {q.ratio('s', 'w')} AS score FROM windows)""",
    ),
)
def fz_partial(spark, sf):
    cells = rel.contacts(spark, sf).filter("company IS NOT NULL").select(
        F.lower("company").alias("a"), F.lower(rel.pick(rel.REFERENCE_FIRMS, "row_id")).alias("b")
    ).distinct()
    return cells.select("a", "b", F.bround(sim.partial_ratio("a", "b"), 6).alias("score"))


@query(
    "fz_score_cast",
    with_ctes("SELECT row_id, CAST(floor(score) AS BIGINT) AS whole, round_even(score, 1) AS tenth FROM z", PAIRS_SQL, q.token_set_ctes("pairs", "a", "b", "z")),
)
def fz_score_cast(spark, sf):
    scored = pairs(spark, sf).select("row_id", sim.token_set_ratio("a", "b").alias("score"))
    return scored.select("row_id", F.floor("score").alias("whole"), F.bround("score", 1).alias("tenth"))


# ------------------------------------------------------------- best reference

REF_KEYS_SQL = f"""
  ckeys AS (SELECT {q.light_company('company')} AS key, count(*) AS n FROM contacts GROUP BY 1),
  rkeys AS (SELECT {q.light_company('name')} AS rkey, min(pos) AS pos FROM reference_companies GROUP BY 1),
  cross_keys AS (SELECT key, rkey, pos FROM ckeys, rkeys WHERE key <> '' AND rkey <> ''),
  {q.token_set_ctes('cross_keys', 'key', 'rkey', 'ref_scores')},
  ref_best AS (SELECT key, max(score) AS score, arg_max(rkey, score * 100000 - pos) AS match, arg_max(pos, score * 100000 - pos) AS pos
    FROM ref_scores GROUP BY 1)"""


def reference_keys(spark, sf):
    ref = rel.reference_companies(spark, sf).withColumn("k", tx.light_company("name"))
    return mt.first_positions(ref, "k", "pos")


def contact_keys(spark, sf):
    return rel.contacts(spark, sf).select(tx.light_company("company").alias("key")).filter("key <> ''").distinct()


@query(
    "join_fuzzy_best",
    with_ctes("SELECT key, match, pos, round_even(score, 6) AS score FROM ref_best WHERE score >= 92", CONTACTS_SQL, REFERENCE_SQL, REF_KEYS_SQL),
)
def join_fuzzy_best(spark, sf):
    best = fj.best_match(contact_keys(spark, sf), reference_keys(spark, sf), "token_set", 92)
    return best.select("key", "match", "pos", F.bround("score", 6).alias("score"))


@query(
    "fz_extract_one",
    with_ctes("SELECT key, match, pos, round_even(score, 6) AS score FROM ref_best", CONTACTS_SQL, REFERENCE_SQL, REF_KEYS_SQL),
)
def fz_extract_one(spark, sf):
    best = fj.best_match_any(contact_keys(spark, sf), reference_keys(spark, sf), "token_set")
    return best.select("key", "match", "pos", F.bround("score", 6).alias("score"))


@query(
    "flt_threshold",
    with_ctes("SELECT row_id, round_even(score, 6) AS score FROM z WHERE score >= 60", PAIRS_SQL, q.token_set_ctes("pairs", "a", "b", "z")),
)
def flt_threshold(spark, sf):
    # The generator binds the score to a column, so the filter reads it back
    # instead of computing it a second time.
    bound = pairs(spark, sf).select("row_id", F.explode(F.array(sim.token_set_ratio("a", "b"))).alias("score"))
    return bound.filter("score >= 60").select("row_id", F.bround("score", 6).alias("score"))


@query(
    "join_exact_first",
    with_ctes("SELECT c.row_id, r.pos FROM contacts c JOIN rkeys r ON {k} = r.rkey WHERE {k} <> ''".replace("{k}", q.light_company("c.company")), CONTACTS_SQL, REFERENCE_SQL, REF_KEYS_SQL),
)
def join_exact_first(spark, sf):
    from muster.operators.skew import lookup_join

    people = rel.contacts(spark, sf).select("row_id", tx.light_company("company").alias("key"))
    return lookup_join(people, reference_keys(spark, sf), "key", how="inner").select("row_id", "pos")


@query(
    "agg_match_count_pct",
    with_ctes(
        """SELECT r.pos, r.code, r.name, CAST(coalesce(m.n, 0) AS BIGINT) AS matched_contacts,
          coalesce(round_even(CAST(coalesce(m.n, 0) AS DOUBLE) / (SELECT count(*) FROM contacts) * 100, 2), 0.0::DOUBLE) AS pct_of_contacts
        FROM reference_companies r LEFT JOIN (SELECT b.pos, sum(n) AS n FROM ref_best b JOIN ckeys USING (key) WHERE score >= 92 GROUP BY 1) m USING (pos)""",
        CONTACTS_SQL, REFERENCE_SQL, REF_KEYS_SQL,
    ),
)
def agg_match_count_pct(spark, sf):
    return mt.match_counts(
        rel.contacts(spark, sf), tx.light_company("company"), rel.reference_companies(spark, sf), tx.light_company("name")
    )


@query(
    "join_match_audit",
    with_ctes(
        f"""SELECT c.row_id, c.company, r.name AS matched_name, CAST(floor(b.score) AS BIGINT) AS score FROM contacts c
        JOIN ref_best b ON {q.light_company('c.company')} = b.key JOIN reference_companies r USING (pos) WHERE b.score >= 92""",
        CONTACTS_SQL, REFERENCE_SQL, REF_KEYS_SQL,
    ),
)
def join_match_audit(spark, sf):
    audit = mt.match_audit(
        rel.contacts(spark, sf).select("row_id", "company"), tx.light_company("company"),
        rel.reference_companies(spark, sf), tx.light_company("name"),
    )
    return audit.orderBy(F.desc("score"), "row_id").select("row_id", "company", "matched_name", "score")


# ------------------------------------------------------------- two-list filter

TITLE_PARTS = [p.strip() for t in fv.WANTED_TITLES for p in t.replace("–", "/").replace("-", "/").split("/") if p.strip()]


def _wanted_sql(name, values):
    rows = ", ".join(f"({i}, {sql_text(v)})" for i, v in enumerate(values))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS t(pos, name))"


def _flag_sql(col, wanted, threshold, out):
    return f"""
  {out}_k AS (SELECT DISTINCT {q.space_lower(col)} AS key FROM contacts),
  {out}_w AS (SELECT {q.space_lower('name')} AS wkey, min(pos) AS pos FROM {wanted} GROUP BY 1),
  {out}_x AS (SELECT key, wkey, pos FROM {out}_k, {out}_w WHERE key <> ''),
  {q.token_set_ctes(out + '_x', 'key', 'wkey', out + '_s')},
  {out} AS (SELECT key, wkey AS best, score, score >= {threshold} AS ok FROM {out}_s QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, pos) = 1)"""


DUAL_SQL = ",\n".join([
    _wanted_sql("wanted_titles", TITLE_PARTS), _wanted_sql("wanted_companies", fv.WANTED_COMPANIES),
    _flag_sql("title", "wanted_titles", 86, "good_titles"), _flag_sql("company", "wanted_companies", 90, "good_companies"),
    f"""dual AS (SELECT c.*, coalesce(t.ok, false) AS title_ok, t.best AS best_title, coalesce(t.score, 0.0::DOUBLE) AS title_score,
      coalesce(o.ok, false) AS company_ok, o.best AS best_company, coalesce(o.score, 0.0::DOUBLE) AS company_score
      FROM contacts c LEFT JOIN good_titles t ON {q.space_lower('c.title')} = t.key LEFT JOIN good_companies o ON {q.space_lower('c.company')} = o.key)""",
])


def dual(spark, sf, below=True):
    """Contacts flagged against the wanted titles and the wanted companies."""
    from muster.operators.dedupe import distinct_variants

    raw = rp.values(spark, list(enumerate(fv.WANTED_TITLES)), "row_id", "name")
    titles = distinct_variants(raw, "name").select(
        F.col("variant").alias("name"), (F.col("first_seen.row_id") * 100 + F.col("first_seen._pos")).alias("pos")
    )
    companies = rp.values(spark, list(enumerate(fv.WANTED_COMPANIES)), "pos", "name")
    df = rel.contacts(spark, sf).select("row_id", "title", "company")
    return mt.with_list_scores(df, {"title_ok": ("title", titles, 86), "company_ok": ("company", companies, 90)}, below=below)


@query(
    "join_fuzzy_dual",
    with_ctes("SELECT row_id, title_ok, best_title, round_even(title_score, 6) AS title_score, company_ok, best_company, round_even(company_score, 6) AS company_score FROM dual", CONTACTS_SQL, DUAL_SQL),
)
def join_fuzzy_dual(spark, sf):
    return dual(spark, sf).select(
        "row_id", "title_ok", F.col("title_ok_best").alias("best_title"), F.bround("title_ok_score", 6).alias("title_score"),
        "company_ok", F.col("company_ok_best").alias("best_company"), F.bround("company_ok_score", 6).alias("company_score"))


@query("flt_two_attr", with_ctes("SELECT row_id, title, company FROM dual WHERE title_ok AND company_ok", CONTACTS_SQL, DUAL_SQL))
def flt_two_attr(spark, sf):
    return dual(spark, sf, below=False).filter("title_ok AND company_ok").select("row_id", "title", "company")


# ------------------------------------------------------------- target cascade

COMPANY_COLUMNS = ["company", "employer"]
EMPLOYER_SQL = "CASE WHEN row_id % 3 = 0 THEN upper(company) WHEN row_id % 3 = 1 THEN company || ' Holdings' ELSE firstname || ' Partners' END"
CASCADE_SQL = f"""
  cells AS (SELECT row_id, 0 AS nth, 'company' AS source, company AS raw FROM contacts
    UNION ALL SELECT row_id, 1 AS nth, 'employer' AS source, {EMPLOYER_SQL} AS raw FROM contacts),
  keyed AS (SELECT *, {q.match_key('raw')} AS key FROM cells WHERE trim(coalesce(raw, '')) <> ''),
  idx AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY row_id, key ORDER BY nth) = 1),
  known AS (SELECT key, min(row_id * 2 + nth) AS pos FROM idx WHERE key <> '' GROUP BY 1),
  wanted AS (SELECT *, {q.match_key('company')} AS tkey FROM target_companies WHERE company IS NOT NULL),
  open_keys AS (SELECT DISTINCT tkey FROM wanted WHERE tkey <> '' AND tkey NOT IN (SELECT key FROM known)),
  open_pairs AS (SELECT tkey, key, pos FROM open_keys, known),
  {q.token_set_ctes('open_pairs', 'tkey', 'key', 'open_scores')},
  chosen AS (SELECT tkey, arg_max(key, score * 10000000 - pos) AS key, 'fuzzy:token_set_ratio:' || CAST(max(score) AS VARCHAR) AS match_type
      FROM open_scores GROUP BY 1 HAVING max(score) >= 88
    UNION ALL SELECT DISTINCT tkey, tkey AS key, 'exact' AS match_type FROM wanted WHERE tkey IN (SELECT key FROM known)),
  matched AS (SELECT w.target_id, w.company AS target, c.match_type, i.source, i.raw, i.row_id
    FROM wanted w JOIN chosen c USING (tkey) JOIN idx i ON i.key = c.key)"""


def cascade_contacts(spark, sf):
    employer = F.when(F.col("row_id") % 3 == 0, F.upper("company")).when(
        F.col("row_id") % 3 == 1, F.concat("company", F.lit(" Holdings"))
    ).otherwise(F.concat("firstname", F.lit(" Partners")))
    return rel.contacts(spark, sf).withColumn("employer", employer)


def cascade(spark, sf, people=None):
    targets = rel.target_companies(spark, sf).select("target_id", F.col("company").alias("target"))
    return mt.match_targets(targets, cascade_contacts(spark, sf), COMPANY_COLUMNS, "target", people=people)


@query(
    "join_exact_then_fuzzy",
    with_ctes("SELECT target_id, target, match_type, source, raw, row_id FROM matched", CONTACTS_SQL, TARGETS_SQL, CASCADE_SQL),
)
def join_exact_then_fuzzy(spark, sf):
    return cascade(spark, sf).select("target_id", "target", "match_type", "source", "raw", "row_id")


@query("join_unpivot_keys", with_ctes("SELECT row_id, source, raw, key FROM idx", CONTACTS_SQL, TARGETS_SQL, CASCADE_SQL))
def join_unpivot_keys(spark, sf):
    return mt.key_index(cascade_contacts(spark, sf), COMPANY_COLUMNS).select("row_id", "source", "raw", "key")


@query(
    "join_row_back",
    with_ctes("SELECT m.target_id, m.row_id, m.source, c.lastname, c.title FROM matched m LEFT JOIN contacts c USING (row_id)", CONTACTS_SQL, TARGETS_SQL, CASCADE_SQL),
)
def join_row_back(spark, sf):
    people = rel.contacts(spark, sf).select("row_id", "lastname", "title")
    return cascade(spark, sf, people).select("target_id", "row_id", "source", "lastname", "title")


COUNTS_SQL = """
  summary AS (SELECT t.target_id, t.company, CAST(coalesce(n, 0) AS BIGINT) AS number_of_matches FROM target_companies t
    LEFT JOIN (SELECT m.target AS company, count(DISTINCT c.email) AS n FROM matched m JOIN contacts c USING (row_id) GROUP BY 1) USING (company))"""


def match_summary(spark, sf):
    emails = rel.contacts(spark, sf).select("row_id", "email")
    targets = rel.target_companies(spark, sf).select("target_id", "company")
    counts = mt.match_people(targets, cascade_contacts(spark, sf), COMPANY_COLUMNS, emails, ["email"])
    return mt.with_match_counts(targets, counts, "company")


@query("join_counts_back", with_ctes("SELECT target_id, company, number_of_matches FROM summary", CONTACTS_SQL, TARGETS_SQL, CASCADE_SQL, COUNTS_SQL))
def join_counts_back(spark, sf):
    return match_summary(spark, sf).select("target_id", "company", "number_of_matches")


@query("join_no_match", with_ctes("SELECT target_id, company FROM summary WHERE number_of_matches = 0", CONTACTS_SQL, TARGETS_SQL, CASCADE_SQL, COUNTS_SQL))
def join_no_match(spark, sf):
    return mt.without_match(match_summary(spark, sf)).select("target_id", "company")


# ------------------------------------------------------------ mappings, aliases

def aliases(spark):
    return rel.literal_pairs(spark, rel.ALIASES, "variant", "canonical")


def prior_mapping(spark):
    return rel.literal_pairs(spark, rel.PRIOR_MAPPING, "original", "standard").select("original", "standard")


@query(
    "join_mapping_apply",
    with_ctes(f"SELECT row_id, coalesce(p.standard, {q.proposed('company')}) AS standard FROM contacts c LEFT JOIN prior_mapping p ON c.company = p.original".replace("row_id, coalesce", "c.row_id, coalesce"), CONTACTS_SQL, PRIOR_SQL),
)
def join_mapping_apply(spark, sf):
    people = rel.contacts(spark, sf).select("row_id", "company")
    return mt.apply_mapping(people, "company", prior_mapping(spark), "standard", tx.proposed_name("company")).select("row_id", "standard")


@query(
    "join_mapping_override",
    with_ctes(
        f"""SELECT n.name AS original, coalesce(p.standard, {q.proposed('n.name')}) AS standard
        FROM (SELECT DISTINCT name FROM names WHERE name IS NOT NULL) n LEFT JOIN prior_mapping p ON n.name = p.original""",
        CONTACTS_SQL, COMPANIES_WIDE_SQL, NAMES_SQL, PRIOR_SQL,
    ),
)
def join_mapping_override(spark, sf):
    distinct = names(spark, sf).filter("name IS NOT NULL").select("name").distinct()
    mapping = distinct.select(F.col("name").alias("original"), tx.proposed_name("name").alias("standard"))
    return mt.override_mapping(mapping, prior_mapping(spark)).select("original", "standard")


@query(
    "join_alias",
    with_ctes("SELECT c.row_id, coalesce(a.canonical, c.company) AS company FROM contacts c LEFT JOIN aliases a ON lower(c.company) = lower(a.variant)", CONTACTS_SQL, ALIASES_SQL),
)
def join_alias(spark, sf):
    people = rel.contacts(spark, sf).select("row_id", "company")
    return mt.apply_alias(people, "company", aliases(spark), "named").select("row_id", F.col("named").alias("company"))


ENTITY_SQL = f"""
  clean AS (SELECT lower({q.strip('name')}) AS low, arg_min({q.strip('name')}, ord) AS name, min(ord) AS ord
    FROM (SELECT name, CASE origin WHEN 'contact' THEN row_id ELSE row_id + 100000000 END AS ord FROM names WHERE name IS NOT NULL) GROUP BY 1 HAVING low <> ''),
  named AS (SELECT c.name, c.ord, {q.brand_core('coalesce(a.canonical, c.name)')} AS key FROM clean c LEFT JOIN aliases a ON c.low = lower(a.variant)),
  entities AS (SELECT key, arg_min(name, ord) AS display, min(ord) AS pos, count(*) AS variants FROM named GROUP BY 1)"""


def universe(spark, sf):
    order = F.when(F.col("origin") == "contact", F.col("row_id")).otherwise(F.col("row_id") + 100000000)
    return names(spark, sf).filter("name IS NOT NULL").select("name", order.alias("row_id"))


@query(
    "clu_brand_entities",
    with_ctes("SELECT key, display, pos, variants FROM entities", CONTACTS_SQL, COMPANIES_WIDE_SQL, NAMES_SQL, ALIASES_SQL, ENTITY_SQL),
)
def clu_brand_entities(spark, sf):
    return mt.brand_entities(universe(spark, sf), "name", aliases(spark)).select("key", "display", "pos", "variants")


COVERAGE_SQL = f"""
  asked AS (SELECT sponsor, lower(target) AS low, arg_min(target, row_id) AS target, min(row_id) AS row_id FROM sponsor_targets GROUP BY 1, 2),
  cored AS (SELECT s.sponsor, s.row_id, s.target, {q.brand_core('coalesce(a.canonical, s.target)')} AS target_core
    FROM asked s LEFT JOIN aliases a ON s.low = lower(a.variant)),
  tcores AS (SELECT DISTINCT target_core FROM cored WHERE target_core <> ''),
  tpairs AS (SELECT target_core, key, pos, display FROM tcores, entities WHERE key <> ''),
  {q.token_set_ctes('tpairs', 'target_core', 'key', 'tscores')},
  tbest AS (SELECT target_core, arg_max(display, score * 10000000000 - pos) AS best_match, max(score) AS score FROM tscores GROUP BY 1),
  coverage AS (SELECT sponsor, row_id, target, target_core, coalesce(best_match, '') AS best_match, round_even(coalesce(score, 0.0::DOUBLE), 1) AS match_score,
    CASE WHEN best_match IS NOT NULL AND score >= 88 THEN 'Yes' ELSE 'No' END AS included FROM cored LEFT JOIN tbest USING (target_core))"""
COVERAGE_CTES = (CONTACTS_SQL, COMPANIES_WIDE_SQL, NAMES_SQL, ALIASES_SQL, SPONSOR_TARGETS_SQL, ENTITY_SQL, COVERAGE_SQL)


def coverage(spark, sf):
    entities = cut_lineage(mt.brand_entities(universe(spark, sf), "name", aliases(spark)))
    return mt.target_coverage(rel.sponsor_targets(spark, sf), entities, aliases(spark))


@query("join_best_with_score", with_ctes("SELECT * FROM coverage", *COVERAGE_CTES))
def join_best_with_score(spark, sf):
    return coverage(spark, sf).orderBy("included", F.desc("match_score"), "row_id")


@query(
    "agg_missing_by",
    with_ctes("SELECT target AS missing_company, string_agg(DISTINCT sponsor, ', ' ORDER BY sponsor) AS requested_by FROM coverage WHERE included = 'No' GROUP BY 1", *COVERAGE_CTES),
)
def agg_missing_by(spark, sf):
    return mt.missing_by(coverage(spark, sf))


@query(
    "join_owner_priority",
    with_ctes(
        f"""SELECT c.row_id, CAST(o.owner AS BIGINT) AS owner FROM contacts c LEFT JOIN (SELECT {q.profile_url('url')} AS u, min(member_idx) AS owner
          FROM member_connections GROUP BY 1) o ON {q.profile_url('c.url')} = o.u""",
        CONTACTS_SQL, MEMBERS_SQL,
    ),
)
def join_owner_priority(spark, sf):
    owned = sl.owners_of(rel.contacts(spark, sf).select("row_id", "url"), rel.member_connections(spark, sf))
    return owned.select("row_id", F.col("owner").cast("bigint").alias("owner"))


@query(
    "join_remainder",
    with_ctes(
        f"""SELECT row_id, company FROM contacts WHERE trim(coalesce(company, '')) <> '' QUALIFY row_number() OVER (PARTITION BY company
          ORDER BY {q.seniority_score(q.canonical_seniority('seniority'))} DESC, row_id) > 5""",
        CONTACTS_SQL,
    ),
)
def join_remainder(spark, sf):
    from muster.functions import classify as cl

    people = rel.contacts(spark, sf).filter(tx.strip("company") != "").select(
        "row_id", "company", cl.seniority_score(cl.canonical_seniority("seniority")).alias("points")
    )
    return sl.beyond_top(people, "company", "points").select("row_id", "company")


# ------------------------------------------------------------------- clustering

CORES_SQL = f"""
  uniq AS (SELECT DISTINCT name FROM names WHERE name IS NOT NULL),
  cored_names AS (SELECT name, {q.company_core('name')} AS core FROM uniq),
  cores AS (SELECT core, arg_min(name, lower(name) || chr(1) || name) AS first_name, min(lower(name) || chr(1) || name) AS place FROM cored_names GROUP BY 1),
  ranked AS (SELECT *, row_number() OVER (ORDER BY place) AS rank,
    CASE WHEN core <> '' THEN {q.title_case('core')} ELSE {q.title_case('first_name')} END AS standard FROM cores)"""


def similar_ctes(threshold: int) -> str:
    """CTEs ending in ``alike(a, b, ra, rb, score)`` over pairs of cores, ra < rb.

    Alignment is run only where an edit distance, which is never larger than
    the insert/delete distance, leaves the threshold in reach.
    """
    lev = 1 - threshold / 100
    return f"""
  tk AS (SELECT core, rank, {q.token_set('core')} AS t FROM ranked WHERE core <> ''),
  pr AS (SELECT x.core AS a, y.core AS b, x.rank AS ra, y.rank AS rb, list_intersect(x.t, y.t) AS i, x.t AS ta, y.t AS tb
    FROM tk x, tk y WHERE x.rank < y.rank),
  near AS (SELECT a, b, ra, rb FROM pr WHERE (len(i) > 0) OR levenshtein(array_to_string(ta, ' '), array_to_string(tb, ' ')) <= {lev} * (length(a) + length(b)) + 0.001),
  dif AS (SELECT *, array_to_string(list_filter({q.token_set('a')}, lambda t: NOT list_contains({q.token_set('b')}, t)), ' ') AS x,
      array_to_string(list_filter({q.token_set('b')}, lambda t: NOT list_contains({q.token_set('a')}, t)), ' ') AS y FROM near),
  near2 AS (SELECT a, b, ra, rb FROM dif WHERE x = '' OR y = '' OR levenshtein(x, y) <= {lev} * (length(a) + length(b) + 2) + 0.001
      OR (length(a) - length(x)) >= 0.6 * length(a) OR (length(b) - length(y)) >= 0.6 * length(b)),
  {q.token_set_ctes('near2', 'a', 'b', 'alike_all')},
  alike AS (SELECT * FROM alike_all WHERE score >= {threshold})"""


CLUSTER_CTES = (CONTACTS_SQL, COMPANIES_WIDE_SQL, NAMES_SQL, CORES_SQL)


@query(
    "clu_group_by_core",
    with_ctes("SELECT n.name AS original, r.standard FROM cored_names n JOIN ranked r USING (core)", *CLUSTER_CTES),
)
def clu_group_by_core(spark, sf):
    return cu.standard_names(names(spark, sf), "name", fuzzy=False)


@query(
    "join_self_similarity",
    with_ctes("SELECT a, b, round_even(score, 6) AS score FROM alike", *CLUSTER_CTES, similar_ctes(94)),
)
def join_self_similarity(spark, sf):
    keys = cu.core_keys(cu.by_core(cu.ordered_names(names(spark, sf), "name")))
    found = fj.similar_pairs(cut_lineage(keys), "token_set", 94)
    return found.select(F.col("lkey").alias("a"), F.col("rkey").alias("b"), F.bround("score", 6).alias("score"))


@query(
    "clu_pair_merge",
    with_ctes(
        f"""SELECT n.name AS original, coalesce(m.canon, r.standard) AS standard FROM cored_names n JOIN ranked r USING (core)
        LEFT JOIN (SELECT core, arg_max({q.title_case('shorter')}, ra * 1000000 + rb) AS canon FROM (
            SELECT a AS core, ra, rb, CASE WHEN length(b) < length(a) THEN b ELSE a END AS shorter FROM alike
            UNION ALL SELECT b AS core, ra, rb, CASE WHEN length(b) < length(a) THEN b ELSE a END AS shorter FROM alike) GROUP BY 1) m USING (core)""",
        *CLUSTER_CTES, similar_ctes(94),
    ),
)
def clu_pair_merge(spark, sf):
    return cu.standard_names(names(spark, sf), "name", 94)
