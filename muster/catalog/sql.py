"""SQL building blocks for the oracle side, written for an independent engine."""

from __future__ import annotations

import re

from muster import fixed_values as fv
from muster.plans.relations import sql_list, sql_text

WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def nz(x: str) -> str:
    return f"coalesce({x}, '')"


def words(x: str) -> str:
    return f"list_filter(string_split({collapse(x)}, ' '), lambda w: w <> '')"


def space_lower(x: str) -> str:
    return f"lower({collapse(nz(x))})"


def light_company(x: str) -> str:
    return f"lower({collapse(f'''replace({nz(x)}, '&', 'and')''')})"


def keep_tokens(x: str, stop) -> str:
    return f"array_to_string(list_filter({words(x)}, lambda t: NOT list_contains({sql_list(stop)}, t)), ' ')"


def match_key(x: str) -> str:
    a = f"regexp_replace(lower({strip(nz(x))}), '[’''`]', '', 'g')"
    return keep_tokens(f"regexp_replace({a}, '[^a-z0-9& ]+', ' ', 'g')", fv.MATCH_STOP_TOKENS)


def brand(x: str) -> str:
    a = rf"regexp_replace({strip(nz(x))}, '\s*\([^)]*\)', '', 'g')"
    a = f"regexp_replace({a}, {sql_text(fv.BRAND_PUNCTUATION)}, ' ', 'g')"
    suffix = "(" + "|".join(fv.BRAND_SUFFIX_PATTERNS) + r")\s*$"
    return f"lower({collapse(f'''regexp_replace({a}, {sql_text(suffix)}, '', 'gi')''')})"


def brand_core(x: str) -> str:
    return f"coalesce(nullif({keep_tokens(brand(x), fv.BRAND_STOP_TOKENS)}, ''), {brand(x)})"


def company_core(x: str) -> str:
    a = rf"regexp_replace({strip(nz(x))}, '\(.*?\)|\[.*?\]|\{{.*?\}}', ' ', 'g')"
    a = rf"replace(regexp_replace({a}, '[+/,_\.]', ' ', 'g'), '&', ' and ')"
    a = rf"regexp_replace(lower({a}), '^the\s+', '')"
    drop = sql_list(fv.CORE_SUFFIX_TOKENS + fv.CORE_COUNTRY_TOKENS)
    plain = rf"list_transform({words(a)}, lambda t: regexp_replace(t, '[^a-z0-9\-]', '', 'g'))"
    kept = f"list_filter({plain}, lambda t: t <> '' AND NOT list_contains({drop}, t))"
    return f"replace(array_to_string({kept}, ' '), ' - ', '-')"


def title_case(x: str) -> str:
    one = f"CASE WHEN list_contains({sql_list(fv.COMPANY_ACRONYMS)}, t) THEN upper(t) ELSE upper(t[1:1]) || lower(t[2:]) END"
    return f"array_to_string(list_transform({words(x)}, lambda t: {one}), ' ')"


def proposed(x: str) -> str:
    return f"CASE WHEN {company_core(x)} <> '' THEN {title_case(company_core(x))} ELSE {x} END"


def profile_url(x: str) -> str:
    return f"lower(regexp_replace(split_part({strip(nz(x))}, '?', 1), '/+$', ''))"


def alt(patterns) -> str:
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def quote(phrase: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", phrase)


def phrase(p: str) -> str:
    return r"\b" + r"[\s\-/]+".join(quote(w) for w in p.lower().split()) + r"\b"


def matches(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {sql_text(pattern)}" + (f", '{flags}')" if flags else ")")


def has_phrase(x: str, phrases) -> str:
    return matches(x, alt(phrase(p) for p in phrases))


def phrase_count(x: str, phrases) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({x}, {sql_text(phrase(p))}))" for p in phrases) + ")"


def has_pattern(x: str, patterns) -> str:
    return matches(nz(x), alt(patterns), "i")


def has_substring(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({space_lower(x)}, {sql_text(n)})" for n in needles) + ")"


def keyword_score(x: str, *tables) -> str:
    low = f"lower({nz(x)})"
    parts = [f"CASE WHEN contains({low}, {sql_text(k)}) THEN {w} ELSE 0 END" for t in tables for k, w in t.items()]
    return "CAST(" + " + ".join(parts) + " AS BIGINT)"


def keyword_hits(x: str, keys=fv.FOCUS_KEYWORDS) -> str:
    return keyword_score(x, {k: 1 for k in keys})


def expand_base(x: str) -> str:
    return rf"regexp_replace(regexp_replace({space_lower(x)}, '[|/&(),+]', ' ', 'g'), '-+', ' ', 'g')"


def expand_ctes(source: str, x: str, keep: str = "*") -> str:
    """Chain of CTEs ending in ``expanded(…, jt)``: one step per rule, in order."""
    steps = [f"x0 AS (SELECT {keep}, {expand_base(x)} AS jt FROM {source})"]
    rules = [(p, " " + a) for p, a in fv.TITLE_EXPANSIONS] + [fv.TITLE_TYPO]
    for i, (p, a) in enumerate(rules, 1):
        steps.append(
            f"x{i} AS (SELECT * REPLACE (CASE WHEN {matches('jt', p)} THEN jt || {sql_text(a)} ELSE jt END AS jt) FROM x{i - 1})"
        )
    steps.append(f"expanded AS (SELECT * FROM x{len(rules)})")
    return ",\n".join(steps)


def case(rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


def lookup(x: str, table: dict, default: str) -> str:
    def lit(v):
        return sql_text(v) if isinstance(v, str) else str(v)

    return case([(f"{x} = {sql_text(k)}", lit(v)) for k, v in table.items()], default)


def org_type(x: str) -> str:
    kept = f"lower(array_to_string(regexp_extract_all({nz(x)}, '[A-Za-z0-9&.''\\-]+'), ' '))"
    return case([(matches(kept, alt(fv.CREDIT_UNION_ORG_PATTERNS)), "'Credit Union'")], "'Bank'")


def company_type(x: str, unknown: str | None = None) -> str:
    rules = [(has_pattern(x, fv.CREDIT_UNION_HINTS), "'Credit Union'")]
    if unknown:
        rules.append((f"{nz(x)} = ''", sql_text(unknown)))
    return case(rules, "'Bank'")


def focus(x: str) -> str:
    return case(
        [
            (has_substring(x, fv.FOCUS_DATA), "'Data / AI / Automation'"),
            (has_substring(x, fv.FOCUS_RISK), "'Risk and Compliance'"),
            (has_substring(x, fv.FOCUS_TRANSFORMATION), "'Transformation, digital, innovation'"),
        ],
        "'All Others'",
    )


def geo_bucket(x: str) -> str:
    low = f"lower({collapse(nz(x))})"
    any_in = lambda ns: "(" + " OR ".join(f"contains({low}, {sql_text(n)})" for n in ns) + ")"
    rules = [
        (matches(low, fv.GENERIC_US_PATTERN), "'US'"),
        (any_in(fv.CHARLOTTE_TOKENS), sql_text(fv.CHARLOTTE_BUCKET)),
        (f"contains({low}, 'north carolina') OR {matches(low, fv.NC_TOKEN_PATTERN)}", sql_text(fv.NC_BUCKET)),
    ]
    rules += [(any_in(n), sql_text(s)) for s, n in fv.STATE_NEEDLES.items()]
    return case(rules, "'US'")


def is_nc(x: str) -> str:
    low = f"lower({strip(nz(x))})"
    cities = " OR ".join(f"contains({low}, {sql_text(c)})" for c in ["north carolina"] + fv.NC_CITIES)
    token = f"list_contains(list_transform(string_split({low}, ','), lambda t: trim(t, ' ,()')), 'nc')"
    return (
        f"({cities} OR {low} = 'nc' OR ends_with({low}, ', nc') OR ends_with({low}, ' nc')"
        f" OR contains({low}, '(nc)') OR {token})"
    )


def canonical_seniority(x: str) -> str:
    s = rf"lower(trim(regexp_replace({x}, '[\s/_-]+', ' ', 'g')))"
    rules = [(f"{x} IS NULL", "'Unknown'")]
    rules += [(f"{s} = {sql_text(k.lower())}", sql_text(k)) for k in fv.SENIORITY_SCORES]
    rules += [(f"list_contains({sql_list(v)}, {s})", sql_text(k)) for k, v in fv.SENIORITY_SYNONYMS.items()]
    rules += [(f"starts_with({s}, 'head ')", "'Head'")]
    rules += [(f"list_contains({sql_list(v)}, {s})", sql_text(k)) for k, v in fv.SENIORITY_LATE_SYNONYMS.items()]
    return case(rules, strip(x))


def seniority_score(x: str) -> str:
    return lookup(x, fv.SENIORITY_SCORES, "0")


def inferred_seniority(x: str) -> str:
    t = f"(' ' || lower({x}) || ' ')"
    rules = []
    for label, hints in fv.SENIORITY_TITLE_HINTS:
        rules.append(("(" + " OR ".join(f"contains({t}, {sql_text(h)})" for h in hints) + ")", sql_text(label)))
    return f"CASE WHEN {nz(x)} <> '' THEN {case(rules, 'NULL')} END"


def balance_bucket(x: str) -> str:
    return case(
        [(f"list_contains({sql_list(fv.LEADERSHIP_LABELS)}, {x})", "'leadership'"),
         (f"list_contains({sql_list(fv.MANAGER_LABELS)}, {x})", "'manager'")],
        "'specialist'",
    )


def influencer(title: str, shared: str) -> str:
    return f"({has_pattern(title, [fv.INFLUENCER_TITLE_PATTERN])} OR coalesce(TRY_CAST({shared} AS DOUBLE) >= 20, false))"


# ---------------------------------------------------------------- similarity

def chars(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s).')"


def lcs_expr(a: str, b: str) -> str:
    """Row-by-row table recurrence of the longest common subsequence.

    The state is the current table row; each step folds over the columns.
    """
    inner = (
        "list_reduce(range(1, length({a}) + 1), lambda r, j: list_append(r, "
        "CASE WHEN ({a})[j] = ch THEN prev[j] + 1 ELSE greatest(r[j], prev[j + 1]) END), [0::BIGINT])"
    ).format(a=a)
    start = f"list_transform(range(0, length({a}) + 1), lambda j: 0::BIGINT)"
    return f"(list_reduce({chars(b)}, lambda prev, ch: {inner}, {start}))[length({a}) + 1]"


def indel(lcs: str, total: str) -> str:
    return f"CASE WHEN {total} = 0 THEN 100.0::DOUBLE ELSE (1.0::DOUBLE - ({total} - 2 * {lcs})::DOUBLE / {total}) * 100.0::DOUBLE END"


def ratio(a: str, b: str) -> str:
    return indel(lcs_expr(a, b), f"(length({a}) + length({b}))")


def sorted_tokens(x: str) -> str:
    return f"array_to_string(list_sort({words(x)}), ' ')"


def token_set(x: str) -> str:
    return f"list_sort(list_distinct({words(x)}))"


def percent(d: str, total: str) -> str:
    return f"(100.0::DOUBLE - (100 * ({d}))::DOUBLE / ({total}))"


def token_set_ctes(pairs: str, a: str, b: str, out: str) -> str:
    """CTEs scoring the token sets of two columns of ``pairs`` as ``score``."""
    return f"""
  {out}_t AS (SELECT *, {token_set(a)} AS _ta, {token_set(b)} AS _tb FROM {pairs}),
  {out}_j AS (SELECT *, array_to_string(list_filter(_ta, lambda t: list_contains(_tb, t)), ' ') AS _s,
      array_to_string(list_filter(_ta, lambda t: NOT list_contains(_tb, t)), ' ') AS _x,
      array_to_string(list_filter(_tb, lambda t: NOT list_contains(_ta, t)), ' ') AS _y FROM {out}_t),
  {out}_l AS (SELECT *, CASE WHEN _s <> '' THEN 1 ELSE 0 END AS _g,
      CASE WHEN len(_ta) = 0 OR len(_tb) = 0 OR (_s <> '' AND (_x = '' OR _y = '')) THEN 0 ELSE {lcs_expr('_x', '_y')} END AS _lcs FROM {out}_j),
  {out} AS (SELECT * EXCLUDE (_ta, _tb, _s, _x, _y, _g, _lcs),
      CASE WHEN len(_ta) = 0 OR len(_tb) = 0 THEN 0.0::DOUBLE
           WHEN _s <> '' AND (_x = '' OR _y = '') THEN 100.0::DOUBLE
           ELSE greatest({percent('length(_x) + length(_y) - 2 * _lcs', '2 * length(_s) + 2 * _g + length(_x) + length(_y)')},
             CASE WHEN _s <> '' THEN {percent('_g + length(_x)', '2 * length(_s) + _g + length(_x)')} ELSE 0.0::DOUBLE END,
             CASE WHEN _s <> '' THEN {percent('_g + length(_y)', '2 * length(_s) + _g + length(_y)')} ELSE 0.0::DOUBLE END) END AS score
      FROM {out}_l)"""
