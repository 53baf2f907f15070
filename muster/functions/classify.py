"""Row classifiers: ordered rule sets as CASE expressions over rule data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.functions import text as tx
from muster.functions.similarity import best_partial, length_compatible, text_literal, token_sort_ratio
from muster.operators.skew import spread


def first_match(rules: list[tuple[Column, object]], default=None) -> Column:
    """Value of the first rule whose condition holds."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if default is None else out.otherwise(default)


def lookup(c: Column, table: dict, default) -> Column:
    """Value of a label in a fixed table; the label is evaluated once."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(default))


# ------------------------------------------------------------- organisations

def org_type(company) -> Column:
    """"Credit Union" or "Bank" from the name's letters, digits and ``&.'-``."""
    kept = F.array_join(F.regexp_extract_all(tx.text(company), F.lit(r"([A-Za-z0-9&.'\-]+)"), F.lit(1)), " ")
    return F.when(F.lower(kept).rlike(tx.any_of(fv.CREDIT_UNION_ORG_PATTERNS)), "Credit Union").otherwise("Bank")


def company_type(company, unknown: str | None = None) -> Column:
    """Outreach company type; ``unknown`` labels empty names, else they are banks."""
    out = F.when(tx.has_pattern(company, fv.CREDIT_UNION_HINTS), "Credit Union")
    if unknown is not None:
        out = out.when(tx.text(company) == "", unknown)
    return out.otherwise("Bank")


def focus(title, word_boundary: bool = False) -> Column:
    """Focus bucket of a title; data before risk before transformation."""
    return first_match(
        [
            (tx.has_substring(title, fv.FOCUS_DATA, word_boundary), "Data / AI / Automation"),
            (tx.has_substring(title, fv.FOCUS_RISK, word_boundary), "Risk and Compliance"),
            (tx.has_substring(title, fv.FOCUS_TRANSFORMATION, word_boundary), "Transformation, digital, innovation"),
        ],
        F.lit("All Others"),
    )


# ------------------------------------------------------------------ segments

def _gate(segment: str, t: Column) -> Column | None:
    return {
        "Technology": t.rlike(tx.any_of(fv.TECHNOLOGY_ANCHORS)),
        "Data": t.rlike(fv.DATA_GATE),
        "Innovation": t.rlike(fv.INNOVATION_GATE),
    }.get(segment)


def segment_of(t: Column, seniority, org: Column) -> Column:
    """Segment of an expanded title ``t``; ``t`` should be a plain column."""
    union = org == "Credit Union"
    overrides = first_match(
        [
            (t.rlike(fv.RISK_WORD) & t.rlike(fv.ANALYTICS_WORD), "Risk"),
            (t.rlike(fv.IDENTITY_ACCESS), "Compliance"),
            (~union & t.rlike(fv.DIGITAL_WORD) & t.rlike(fv.PRODUCT_WORD), "Innovation"),
            (union & t.rlike(fv.CHANNEL_BANKING), "Digital Banking"),
            (t.rlike(fv.LEADING_IT) & t.rlike(fv.BUSINESS_ANALYST), "Technology"),
        ]
    )

    def gated(segment: str, hit: Column) -> Column:
        gate = _gate(segment, t)
        return hit if gate is None else hit & gate

    # Both organisation types rank the segments they share alike; the one
    # segment that differs is offered only where it applies.
    only = {"Digital Banking": union, "Innovation": ~union}
    rules = list(fv.BANK_SEGMENTS)
    place = [s for s, _, _ in fv.CREDIT_UNION_SEGMENTS].index("Digital Banking")
    rules.insert(place, fv.CREDIT_UNION_SEGMENTS[place])

    def offered(segment: str, hit: Column) -> Column:
        return only[segment] & hit if segment in only else hit

    by_core = first_match([(offered(s, gated(s, tx.has_phrase(t, core))), s) for s, core, _ in rules])
    # Most phrase hits wins; the earlier segment wins a tie.
    scores = [
        F.struct(
            F.when(offered(s, gated(s, tx.has_phrase(t, general))), tx.phrase_count(t, general)).otherwise(0).alias("n"),
            F.lit(-i).alias("i"),
            F.lit(s).alias("s"),
        )
        for i, (s, _, general) in enumerate(rules)
    ]
    by_score = tx.let(F.array_max(F.array(*scores)), lambda best: F.when(best["n"] > 0, best["s"]))
    senior = F.when(tx.space_lower(seniority).isin(*fv.SENIOR_FOR_OTHERS), fv.SENIOR_SEGMENT)
    return F.coalesce(
        overrides,
        by_core,
        by_score,
        senior,
        F.lit(fv.UNASSIGNED_SEGMENT),
    )


def with_segment(df: DataFrame, title: str, seniority: str, company: str,
                 org_out: str = "org_type", out: str = "segment") -> DataFrame:
    """Add organisation type and segment.

    The expanded title is a column of its own so that the many rules read it
    instead of each computing it again.  The rows are spread first: their bytes
    are few for so many rules.
    """
    return (
        spread(df).withColumn(org_out, org_type(company))
        .withColumn("_expanded", tx.expand_title(title))
        .withColumn(out, segment_of(F.col("_expanded"), seniority, F.col(org_out)))
        .drop("_expanded")
    )


def segment_rank(org: Column, segment: Column) -> Column:
    """Business order of a segment, which depends on the organisation type."""
    def rank(order):
        return lookup(segment, {s: i for i, s in enumerate(order)}, 999)

    return F.when(org == "Credit Union", rank(fv.CREDIT_UNION_SEGMENT_ORDER)).otherwise(rank(fv.BANK_SEGMENT_ORDER))


def most_senior(seniority, title) -> Column:
    return tx.space_lower(seniority).isin(*fv.SENIOR_FOR_OTHERS) | tx.has_pattern(title, [fv.SENIOR_TITLE_PATTERN])


# ----------------------------------------------------------------- geography

def geo_bucket(location) -> Column:
    low = F.lower(tx.location_text(location))
    contains = lambda needles: low.rlike(tx.any_of(tx.literal(n) for n in needles))
    rules = [
        (low.rlike(fv.GENERIC_US_PATTERN), fv.DEFAULT_BUCKET),
        (contains(fv.CHARLOTTE_TOKENS), fv.CHARLOTTE_BUCKET),
        (F.contains(low, F.lit("north carolina")) | low.rlike(fv.NC_TOKEN_PATTERN), fv.NC_BUCKET),
    ]
    rules += [(contains(needles), state) for state, needles in fv.STATE_NEEDLES.items()]
    return first_match(rules, F.lit(fv.DEFAULT_BUCKET))


def allowed_or(c: Column, allowed, fallback: str) -> Column:
    """Values outside an allow-list, null included, become ``fallback``."""
    return F.when(c.isin(*allowed), c).otherwise(fallback)


def geo_fuzzy(location: str, threshold: float = fv.STATE_FUZZ_THRESHOLD, other: str = fv.OTHER_STATES,
              states: dict[str, list[str]] = fv.FUZZY_STATES, whole_codes: bool = False) -> Column:
    """State whose best name or code scores highest, first state on ties.

    A contained token scores 100, the maximum, so containment is settled first
    and in state order.  Only locations that pass a cheap necessary condition
    go on to be scored.
    """
    low = F.lower(tx.text(location))

    def contained(token: str) -> Column:
        if whole_codes and len(token) == 2:
            return low.rlike(r"\b" + tx.literal(token.lower()) + r"\b")
        return F.contains(low, F.lit(token.lower()))

    exact = []
    for state, tokens in states.items():
        hit = contained(tokens[0])
        for t in tokens[1:]:
            hit = hit | contained(t)
        exact.append((hit, state))
    # A two-letter code reaches a high threshold only by being contained.
    names = [(t.lower(), state) for state, tokens in states.items() for t in tokens if len(t) > 2 or threshold < 67]
    fuzzy = best_partial(f"lower(coalesce({location}, ''))", names, threshold)
    # An empty location matches nothing.
    return F.when(low == "", F.lit(other)).otherwise(F.coalesce(first_match(exact), fuzzy, F.lit(other)))


def geo_multi(value: str, threshold: float = 80, states: dict[str, list[str]] = fv.SPLIT_STATES) -> Column:
    """Array of all states a value names; independent test per state."""
    low = F.lower(tx.strip(value))
    found = []
    for state, codes in states.items():
        name = state.lower()
        hit = F.contains(low, F.lit(name)) | low.isin(*[x for c in codes for x in (c, c + ".")])
        score = token_sort_ratio(f"lower({value})", text_literal(name))
        hit = hit | (length_compatible(F.lower(tx.collapse(value)), F.lit(name), threshold) & (score >= threshold))
        found.append(F.when(hit, F.lit(state)))
    return F.array_compact(F.array(*found))


def is_nc(location, word_boundary: bool = False) -> Column:
    """North Carolina by name, code or city."""
    low = F.lower(tx.strip(tx.text(location)))
    edge = r"\b" if word_boundary else ""
    name = edge + tx.any_of([tx.literal(c) for c in ["north carolina"] + fv.NC_CITIES]) + edge
    code = (low == "nc") | low.endswith(", nc") | low.endswith(" nc") | F.contains(low, F.lit("(nc)"))
    token = F.exists(F.split(low, ","), lambda t: F.btrim(t, F.lit(" ,()")) == "nc")
    return low.rlike(name) | code | token


def nc_label(flag: Column) -> Column:
    return F.when(flag, "North Carolina").otherwise("Other")


# ------------------------------------------------------ titles and seniority

def vip_title(title) -> Column:
    return tx.has_pattern(title, fv.VIP_TITLE_PATTERNS)


def influencer(title, shared: Column, shared_min: float = 20) -> Column:
    """Senior title, or enough shared connections."""
    return tx.has_pattern(title, [fv.INFLUENCER_TITLE_PATTERN]) | F.coalesce(shared >= shared_min, F.lit(False))


def title_seniority(title) -> Column:
    """``struct(score, label)`` from the first matching title rule."""
    t = F.concat(F.lit(" "), F.lower(tx.strip(tx.text(title))), F.lit(" "))

    def graded(score, label):
        return F.struct(F.lit(score).alias("score"), F.lit(label).alias("label"))

    pattern, score, label = fv.GLOBAL_LEAD_RULE
    rules = [(t.rlike(pattern), graded(score, label))]
    rules += [(t.rlike(p), graded(s, b)) for p, s, b in fv.TITLE_SENIORITY_RULES]
    return first_match(rules, graded(0, "Unknown"))


def canonical_seniority(value) -> Column:
    """Canonical label; unknown values stay as they are, null is "Unknown"."""
    raw = tx.col(value)
    s = F.lower(F.trim(F.regexp_replace(raw, r"[\s/_-]+", " ")))
    # A label with a slash or hyphen cannot equal the cleaned text.
    rules = [(raw.isNull(), "Unknown")]
    rules += [(s == k.lower(), k) for k in fv.SENIORITY_SCORES]
    rules += [(s.isin(*v), k) for k, v in fv.SENIORITY_SYNONYMS.items()]
    rules += [(s.startswith("head "), "Head")]
    rules += [(s.isin(*v), k) for k, v in fv.SENIORITY_LATE_SYNONYMS.items()]
    return first_match(rules, tx.strip(raw))


def seniority_score(label: Column) -> Column:
    return lookup(label, fv.SENIORITY_SCORES, 0)


def inferred_seniority(title) -> Column:
    """Label suggested by a title, or null."""
    t = F.concat(F.lit(" "), F.lower(tx.col(title)), F.lit(" "))
    rules = []
    for label, hints in fv.SENIORITY_TITLE_HINTS:
        rules.append((t.rlike(tx.any_of(tx.literal(h) for h in hints)), label))
    return F.when(tx.text(title) != "", first_match(rules))


def seniority_or_inferred(seniority, title) -> Column:
    return F.coalesce(tx.col(seniority), inferred_seniority(title))


def seniority_weight(label: Column) -> Column:
    return lookup(label, fv.SENIORITY_WEIGHTS, 0)


def balance_bucket(label: Column) -> Column:
    return first_match(
        [(label.isin(*fv.LEADERSHIP_LABELS), "leadership"), (label.isin(*fv.MANAGER_LABELS), "manager")],
        F.lit("specialist"),
    )


def composite_score(seniority_w: Column, title_score: Column, focus: Column, close: Column,
                    weights: dict[str, float] = fv.SCORE_WEIGHTS) -> Column:
    return (
        seniority_w * F.lit(weights["seniority"]) + title_score * F.lit(weights["title"])
        + focus * F.lit(weights["focus"]) + close * F.lit(weights["connection"])
    )


def eligible(relevance, focus_hits: Column, seniority: Column, require_relevance: bool = True,
             allow_seniority: bool = True) -> Column:
    wanted = focus_hits > 0
    if allow_seniority:
        wanted = wanted | F.coalesce(seniority.isin(*fv.LEADERSHIP_LABELS, *fv.MANAGER_LABELS), F.lit(False))
    if require_relevance:
        wanted = wanted & (F.lower(tx.text(relevance)) == "relevant")
    return wanted


# --------------------------------------------------------------- name repair

def fixed_name(email, first, last) -> Column:
    """``struct(first, last, rule)``: names repaired with the address as guide."""
    parts = tx.email_tokens(email)
    return tx.let(
        F.struct(
            parts.alias("tokens"),
            F.get(parts, F.lit(0)).alias("mail_first"),
            F.element_at(F.concat(F.array(F.lit("")), parts), -1).alias("mail_last"),
            tx.first_name_core(first).alias("first_core"),
            tx.last_name_core(last).alias("last_core"),
            tx.strip_credentials(first).alias("first_clean"),
            tx.strip_credentials(last).alias("last_clean"),
        ),
        _repair,
    )


def with_fixed_names(df: DataFrame) -> DataFrame:
    """``firstname_fixed``, ``lastname_fixed`` and ``name_fix_rule`` from the columns that hold names and address.

    Columns are known by their header without spaces, underscores and case.
    Where one of the three is missing the names stay as they are, a missing one
    empty, and the rule says so.
    """
    known = {re.sub(r"[\s_]+", "", c).lower(): c for c in reversed(df.columns)}
    email, first, last = (known.get(c) for c in ("email", "firstname", "lastname"))
    own = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit("")
    if email and first and last:
        renamed = df.withColumn("_names", fixed_name(*[f"`{c}`" for c in (email, first, last)]))
    else:
        absent = F.struct(own(first).alias("first"), own(last).alias("last"), F.lit("missing_required_columns").alias("rule"))
        renamed = df.withColumn("_names", absent)
    return renamed.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_names.first").alias("firstname_fixed"),
                          F.col("_names.last").alias("lastname_fixed"), F.col("_names.rule").alias("name_fix_rule"))


def _repair(v: Column) -> Column:
    def named(a, b, rule):
        return F.struct(a.alias("first"), b.alias("last"), F.lit(rule).alias("rule"))

    kept, first_ok, last_ok = (v["first_clean"], v["last_clean"]), v["first_core"] == v["mail_first"], v["last_core"] == v["mail_last"]
    swapped = (v["first_core"] == v["mail_last"]) & (v["last_core"] == v["mail_first"])
    original = named(*kept, "original_cleaned")
    return first_match(
        [
            (F.size(v["tokens"]) < 2, original),
            (first_ok & last_ok, named(*kept, "matched_email_orientation")),
            (swapped, named(v["last_clean"], v["first_clean"], "swapped_based_on_email")),
            (first_ok & F.contains(v["last_core"], v["mail_last"]), named(*kept, "lastname_trimmed_to_core")),
            (first_ok, named(v["first_clean"], tx.capitalised(v["mail_last"]), "lastname_overwritten_from_email")),
            (last_ok & F.contains(v["first_core"], v["mail_first"]), named(*kept, "firstname_trimmed_to_core")),
            (last_ok, named(tx.capitalised(v["mail_first"]), v["last_clean"], "firstname_overwritten_from_email")),
        ],
        original,
    )


# ------------------------------------------------------------------ messages

def messages(state: Column, kind: Column, focus_label: Column, anywhere: str | None = fv.MESSAGE_ANYWHERE) -> dict[str, Column]:
    """Outreach texts of a segment; other states read as ``anywhere``."""
    place = state if anywhere is None else F.when(state == fv.OTHER_STATES, anywhere).otherwise(state)
    one = F.when(kind == "Credit Union", fv.MESSAGE_INDUSTRY["Credit Union"][0]).otherwise(fv.MESSAGE_INDUSTRY["Bank"][0])
    many = F.when(kind == "Credit Union", fv.MESSAGE_INDUSTRY["Credit Union"][1]).otherwise(fv.MESSAGE_INDUSTRY["Bank"][1])
    work = lookup(focus_label, fv.MESSAGE_FOCUS, fv.MESSAGE_FOCUS["All Others"])
    return {
        "connection": F.format_string(fv.MESSAGE_CONNECTION, one, place),
        "follow_up_1": F.format_string(fv.MESSAGE_FOLLOW_UP_1, one, place),
        "follow_up_2": F.format_string(fv.MESSAGE_FOLLOW_UP_2, many, work),
    }
