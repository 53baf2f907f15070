"""Queries over headers, column mapping, projection and validation."""

from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.catalog import sql as q
from muster.catalog.registry import query
from muster.functions import text as tx
from muster.operators import schema as sc
from muster.plans import relations as rel
from muster.plans.relations import CONTACTS_SQL, HEADERS_SQL, sql_text, with_ctes

SNAKE = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(lower(" + q.strip("{x}") + r"), '[\s\-]+', '_', 'g'), '[^0-9a-z_]', '', 'g'), '_+', '_', 'g'), '_')"
)


def _snake(x):
    return SNAKE.replace("{x}", x)


def _header_query(key, fn, sql):
    @query(key, with_ctes(f"SELECT file_id, pos, {sql} AS header FROM headers", HEADERS_SQL))
    def run(spark, sf):
        return rel.headers(spark, sf).select("file_id", "pos", fn("header").alias("header"))


_header_query("hdr_trim", sc.trimmed, q.strip("header"))
_header_query("hdr_squash", sc.squashed, q.space_lower("header"))
_header_query("hdr_snake", sc.snake, _snake("header"))


def _values(name, cols, rows):
    body = ", ".join("(" + ", ".join(sql_text(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS t({cols}))"


EXACT_TARGETS = fv.OUTREACH_COLUMNS + ["Company Name", "Email", "Job Title", "Last Name", "First Name"]


@query(
    "map_exact",
    with_ctes(
        f"""SELECT file_id, target, header AS source FROM (SELECT h.*, w.target, CASE WHEN lower(h.header) = lower(w.target) THEN 0 ELSE 1 END AS level
          FROM headers h JOIN wanted w ON lower(h.header) = lower(w.target) OR {q.space_lower('h.header')} = {q.space_lower('w.target')})
        QUALIFY row_number() OVER (PARTITION BY file_id, target ORDER BY level, CASE WHEN level = 0 THEN -pos ELSE pos END) = 1""",
        HEADERS_SQL, _values("wanted", "target", [(t,) for t in EXACT_TARGETS]),
    ),
)
def map_exact(spark, sf):
    return sc.map_exact(rel.headers(spark, sf), EXACT_TARGETS)


def _alias_rows():
    rows = []
    for t in fv.OUTREACH_COLUMNS:
        key = t.lower()
        rows += [(t, n, i) for i, n in enumerate([key] + fv.OUTREACH_ALIASES.get(key, []))]
    return rows


@query(
    "map_alias",
    with_ctes(
        f"""SELECT file_id, target, header AS source FROM headers h JOIN wanted w ON {q.space_lower('h.header')} = w.norm
        QUALIFY row_number() OVER (PARTITION BY file_id, target ORDER BY rank, pos DESC) = 1""",
        HEADERS_SQL, _values("wanted", "target, norm, rank", _alias_rows()),
    ),
)
def map_alias(spark, sf):
    return sc.map_alias(rel.headers(spark, sf))


BONUS = "0.0::DOUBLE"
for _targets, _word in [(("linkedInProfileUrl", "ProfileUrl"), "profile"), (("companyName",), "company")]:
    BONUS += f" + CASE WHEN target IN ({', '.join(sql_text(t) for t in _targets)}) AND contains(lower(header), '{_word}') THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END"
for _t in ["firstName", "lastName", "fullName", "title", "location", "industry"]:
    BONUS += f" + CASE WHEN target = '{_t}' AND contains(lower(header), '{_t.replace('Name', '').lower()}') THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END"


def _low(s):
    return " ".join(s.split()).lower()


@query(
    "map_similarity",
    with_ctes(
        """SELECT mode, file_id, target, source FROM (
          SELECT 'a' AS mode, f.file_id, b.target, f.header AS source, row_number() OVER (PARTITION BY f.file_id, b.target ORDER BY b.score DESC, f.header) AS rn
            FROM (SELECT DISTINCT file_id, header FROM headers) f JOIN best_a b USING (header)
          UNION ALL SELECT 'b' AS mode, f.file_id, b.target, f.header AS source, row_number() OVER (PARTITION BY f.file_id, b.target ORDER BY b.score DESC, f.pos) AS rn
            FROM headers f JOIN best_b b USING (header)
          UNION ALL SELECT 'c' AS mode, f.file_id, b.target, f.header AS source, row_number() OVER (PARTITION BY f.file_id, b.target ORDER BY b.level, b.score DESC, f.pos) AS rn
            FROM headers f JOIN best_c b USING (header)
          UNION ALL SELECT 'd' AS mode, f.file_id, b.target, f.header AS source, row_number() OVER (PARTITION BY f.file_id, b.target ORDER BY b.score DESC, f.pos) AS rn
            FROM headers f JOIN best_d b USING (header)) WHERE rn = 1""",
        HEADERS_SQL, "texts AS (SELECT DISTINCT header FROM headers)",
        _values("names_a", "target, raw", [(t, a) for t in fv.SCRAPED_COLUMNS for a in [t] + fv.SCRAPED_ALIASES.get(t, [])]),
        f"""off_a AS (SELECT header, target, {_snake('header')} AS h, {_snake('raw')} AS n FROM texts, names_a),
  best_a AS (SELECT header, target, max({q.ratio('h', 'n')} / 100) AS score FROM off_a GROUP BY 1, 2 HAVING max({q.ratio('h', 'n')} / 100) >= 0.72::DOUBLE)""",
        _values("names_b", "target", [(t,) for t in fv.SELECTION_COLUMNS]),
        f"""off_b AS (SELECT header, target, lower(header) AS h, lower(target) AS n FROM texts, names_b),
  sc_b AS (SELECT header, target, {q.ratio('h', 'n')} / 100 + {BONUS} AS score FROM off_b), best_b AS (SELECT * FROM sc_b WHERE score >= 0.45::DOUBLE)""",
        _values("names_c", "target, n", [(t, _low(t)) for t in fv.SEGMENTED_COLUMNS]),
        _values("alias_c", "target, n", [(t, a) for t, v in fv.SEGMENTED_ALIASES.items() for a in v]),
        f"""limit_c AS (SELECT a.target, max({q.ratio('c.n', 'a.n')}) AS top FROM alias_c a JOIN names_c c USING (target) GROUP BY 1),
  off_c AS (SELECT header, c.target, {q.space_lower('header')} AS h, c.n, l.top FROM texts CROSS JOIN names_c c LEFT JOIN limit_c l USING (target)),
  off_c2 AS (SELECT *, {q.sorted_tokens('h')} AS hs, {q.sorted_tokens('n')} AS ns FROM off_c),
  sc_c AS (SELECT header, target, h = n AS same, {q.ratio('h', 'n')} AS r, {q.ratio('hs', 'ns')} AS s, top FROM off_c2),
  best_c AS (SELECT header, target, CASE WHEN same THEN 0 WHEN r >= top THEN 1 ELSE 2 END AS level, CASE WHEN same THEN 0.0::DOUBLE WHEN r >= top THEN r ELSE s END AS score
    FROM sc_c WHERE same OR r >= top OR s >= 85)""",
        _values("names_d", "target", [(t,) for t in fv.STATE_SPLIT_COLUMNS]),
        f"""off_d AS (SELECT header, target, {q.sorted_tokens('header')} AS hs, {q.sorted_tokens('target')} AS ns FROM texts, names_d),
  sc_d AS (SELECT header, target, CASE WHEN lower(header) = lower(target) THEN 1000.0::DOUBLE ELSE {q.ratio('hs', 'ns')} END AS score FROM off_d),
  best_d AS (SELECT * FROM sc_d WHERE score >= 50)""",
    ),
)
def map_similarity(spark, sf):
    h = rel.headers(spark, sf)
    tagged = lambda df, m: df.select(F.lit(m).alias("mode"), "file_id", "target", "source")
    out = tagged(sc.map_similarity(h), "a")
    for m, fn in [("b", sc.map_similarity_bonus), ("c", sc.map_similarity_alias), ("d", sc.map_similarity_loose)]:
        out = out.unionByName(tagged(fn(h), m))
    return out


def _substring_rank(patterns):
    return q.case([(f"contains(lower(header), {sql_text(p)})", str(i)) for i, p in enumerate(patterns)], str(len(patterns)))


@query(
    "map_substring",
    with_ctes(
        " UNION ALL ".join(
            f"(SELECT file_id, '{t}' AS target, header AS source FROM headers QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY {_substring_rank(p)}, pos) = 1)"
            for t, p in fv.SUBSTRING_HEADERS.items()
        ),
        HEADERS_SQL,
    ),
)
def map_substring(spark, sf):
    return sc.map_substring(rel.headers(spark, sf))


SAVED_SQL = """saved AS (SELECT file_id, min(header) AS a, max(header) AS b FROM headers GROUP BY 1)"""


def saved_mappings(spark, sf):
    """A stored mapping per file; one entry names a column that is not there."""
    per_file = rel.headers(spark, sf).groupBy("file_id").agg(F.min("header").alias("a"), F.max("header").alias("b"))
    rows = F.array(
        F.struct(F.lit("title").alias("target"), F.col("a").alias("source")),
        F.struct(F.lit("location").alias("target"), F.concat("b", F.lit(" gone")).alias("source")),
        F.struct(F.lit("companyName").alias("target"), F.col("b").alias("source")),
    )
    return sc.mapping_json(per_file.select("file_id", F.inline(rows)))


@query(
    "src_mapping_json",
    with_ctes("SELECT file_id, 'title' AS target, a AS source FROM saved UNION ALL SELECT file_id, 'companyName' AS target, b AS source FROM saved", HEADERS_SQL, SAVED_SQL),
)
def src_mapping_json(spark, sf):
    return sc.load_mapping(saved_mappings(spark, sf), rel.headers(spark, sf))


@query(
    "sink_mapping",
    with_ctes(
        """SELECT file_id, '{"companyName":"' || b || '","location":"' || b || ' gone","title":"' || a || '"}' AS mapping FROM saved""", HEADERS_SQL, SAVED_SQL
    ),
)
def sink_mapping(spark, sf):
    return saved_mappings(spark, sf)


@query(
    "val_required_columns",
    with_ctes(
        f"""SELECT f.file_id, r.name AS missing FROM (SELECT DISTINCT file_id FROM headers) f CROSS JOIN required r
        WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.file_id = f.file_id AND lower({q.strip('h.header')}) = lower(r.name))""",
        HEADERS_SQL, _values("required", "name", [(c,) for c in fv.EVENT_COLUMNS]),
    ),
)
def val_required_columns(spark, sf):
    return sc.missing_columns(rel.headers(spark, sf), fv.EVENT_COLUMNS)


@query(
    "val_required_values",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN trim(coalesce({c}, '')) = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM contacts" for c in ["url", "firstname", "company", "title"]
        ),
        CONTACTS_SQL,
    ),
)
def val_required_values(spark, sf):
    return sc.empty_required(rel.contacts(spark, sf), ["url", "firstname", "company", "title"])


@query(
    "val_url_pattern",
    with_ctes("SELECT CAST(sum(CASE WHEN regexp_matches(coalesce(url, ''), '^https?://', 'i') THEN 0 ELSE 1 END) AS BIGINT) AS bad, count(*) AS total FROM contacts", CONTACTS_SQL),
)
def val_url_pattern(spark, sf):
    return sc.bad_urls(rel.contacts(spark, sf), "url")


@query(
    "detect_url_column",
    with_ctes("SELECT CASE WHEN avg(CASE WHEN contains(lower(coalesce(url, '')), 'linkedin.com/') THEN 1 ELSE 0 END) > 0.3 THEN 'url' END AS \"column\" FROM contacts", CONTACTS_SQL),
)
def detect_url_column(spark, sf):
    return sc.url_column(rel.contacts(spark, sf))


# ---------------------------------------------------------------- projections

TO_SCRAPED = {
    "profileUrl": "url", "firstName": "firstname", "lastName": "lastname", "companyName": "company", "title": "title",
    "location": "location", "connectionDegree": "degree", "sharedConnectionsCount": "shared",
}


@query(
    "prj_fixed_schema",
    with_ctes(
        "SELECT " + ", ".join(f'{TO_SCRAPED[c]} AS "{c}"' if c in TO_SCRAPED else f'CAST(NULL AS VARCHAR) AS "{c}"' for c in fv.SCRAPED_COLUMNS) + " FROM contacts",
        CONTACTS_SQL,
    ),
)
def prj_fixed_schema(spark, sf):
    return sc.to_schema(rel.contacts(spark, sf), fv.SCRAPED_COLUMNS, TO_SCRAPED)


@query("prj_rename_mapped", with_ctes('SELECT row_id, company AS "Company Name", title AS jobtitle, location AS "State" FROM contacts', CONTACTS_SQL))
def prj_rename_mapped(spark, sf):
    df = rel.contacts(spark, sf).select("row_id", "company", "title", "location")
    return sc.rename_mapped(df, {"Company Name": "company", "jobtitle": "title", "State": "location", "country": None})


@query("prj_reorder_export", with_ctes("SELECT email, title, row_id, company FROM contacts", CONTACTS_SQL))
def prj_reorder_export(spark, sf):
    return sc.reorder(rel.contacts(spark, sf).select("row_id", "company", "title", "email"), ["email", "absent", "title"])


@query(
    "prj_insert_front",
    with_ctes("SELECT source_file AS _source_file, source_sheet AS _source_sheet_or_type, row_id, title FROM contacts", CONTACTS_SQL),
)
def prj_insert_front(spark, sf):
    df = rel.contacts(spark, sf)
    out = sc.insert_front(df, _source_file=F.col("source_file"), _source_sheet_or_type=F.col("source_sheet"))
    return out.select("_source_file", "_source_sheet_or_type", "row_id", "title")


@query(
    "prj_union_columns",
    with_ctes(
        """SELECT row_id, title, NULL AS brand, email FROM contacts
        UNION ALL SELECT p_partkey AS row_id, p_name AS title, p_brand AS brand, NULL AS email FROM part""",
        CONTACTS_SQL,
    ),
)
def prj_union_columns(spark, sf):
    a = rel.contacts(spark, sf).select("row_id", "title", "email")
    b = rel.table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"))
    return sc.union_columns([a, b])


@query("sink_drop_helpers", with_ctes("SELECT row_id, title FROM contacts", CONTACTS_SQL))
def sink_drop_helpers(spark, sf):
    df = rel.contacts(spark, sf).select("row_id", "title", F.lower("title").alias("_low"), tx.words("title").alias("__words"))
    return sc.drop_helpers(df)
