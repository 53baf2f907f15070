"""Text normalisers and small scalar expressions.

Every function takes a column (or column name) and returns a ``Column`` that
stays inside the JVM.  A null input normalises to ``""`` unless stated
otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from muster import fixed_values as fv

# Unicode white space, written so that it means the same in every regex engine.
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim any white space at both ends; null stays null."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(strip(c) != "", c)


def collapse(c: Column | str) -> Column:
    """Trim and turn every run of white space into one space; null stays null."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def words(c: Column | str) -> Column:
    """Non-empty tokens separated by white space."""
    return F.filter(F.split(collapse(c), " "), lambda t: t != "")


def any_of(patterns: Iterable[str]) -> str:
    """One alternation out of several patterns."""
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def literal(phrase: str) -> str:
    """Pattern matching a phrase literally (valid in Java and RE2)."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", phrase)


def space_lower(c) -> Column:
    return F.lower(collapse(text(c)))


def location_text(c) -> Column:
    return collapse(text(c))


def light_company(c) -> Column:
    return F.lower(collapse(F.replace(text(c), F.lit("&"), F.lit("and"))))


def unicode_form(c: Column | str, form: str) -> Column:
    """Unicode normalisation form NFC, NFD, NFKC or NFKD; null stays null.

    The ICU classes that Spark itself ships for collations do the work, called
    by ``reflect``; ASCII values are their own form and skip the call.
    """
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown Unicode form {form!r}")
    c = col(c)
    step = F.lit("compose" if form.endswith("C") else "decompose")
    # The call takes no null, also where the branch is not taken.
    formed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), step, text(c), F.lit("K" in form))
    return F.when(c.rlike(r"[^\x00-\x7F]"), formed).otherwise(c)


def nfkc_lower(c) -> Column:
    return F.lower(collapse(unicode_form(text(c), "NFKC")))


def nfkd_lower(c) -> Column:
    return F.lower(collapse(unicode_form(text(c), "NFKD")))


def keep_tokens(c: Column, drop: Iterable[str]) -> Column:
    """Join the tokens of ``c`` that are not in ``drop``."""
    stop = F.array(*[F.lit(t) for t in drop])
    return F.array_join(F.filter(words(c), lambda t: ~F.array_contains(stop, t)), " ")


def match_key(c, stop=fv.MATCH_STOP_TOKENS) -> Column:
    """Company key for matching: letters, digits and ``&`` without legal words."""
    c = F.regexp_replace(F.lower(strip(unicode_form(text(c), "NFKD"))), "[’'`]", "")
    return keep_tokens(F.regexp_replace(c, "[^a-z0-9& ]+", " "), stop)


BRAND_SUFFIX = "(?i)(" + "|".join(fv.BRAND_SUFFIX_PATTERNS) + r")\s*$"


def brand(c) -> Column:
    """Name without bracketed parts, punctuation and one trailing legal form."""
    c = F.regexp_replace(strip(text(c)), r"\s*\([^)]*\)", "")
    c = F.regexp_replace(c, fv.BRAND_PUNCTUATION, " ")
    return F.lower(collapse(F.regexp_replace(c, BRAND_SUFFIX, "")))


def brand_core(c, stop=fv.BRAND_STOP_TOKENS) -> Column:
    name = brand(c)
    core = keep_tokens(name, stop)
    return F.when(core != "", core).otherwise(name)


def company_core(c) -> Column:
    """Name reduced to its distinguishing words."""
    c = F.regexp_replace(strip(text(c)), r"\(.*?\)|\[.*?\]|\{.*?\}", " ")
    c = F.replace(F.regexp_replace(c, r"[+/,_\.]", " "), F.lit("&"), F.lit(" and "))
    c = F.regexp_replace(F.lower(c), r"^the\s+", "")
    plain = F.transform(words(c), lambda t: F.regexp_replace(t, r"[^a-z0-9\-]", ""))
    drop = F.array(*[F.lit(t) for t in fv.CORE_SUFFIX_TOKENS + fv.CORE_COUNTRY_TOKENS])
    kept = F.filter(plain, lambda t: (t != "") & ~F.array_contains(drop, t))
    return F.replace(F.array_join(kept, " "), F.lit(" - "), F.lit("-"))


def title_case(c, acronyms=fv.COMPANY_ACRONYMS) -> Column:
    known = F.array(*[F.lit(t) for t in acronyms])
    return F.array_join(
        F.transform(words(c), lambda t: F.when(F.array_contains(known, t), F.upper(t)).otherwise(F.initcap(t))), " "
    )


def proposed_name(c) -> Column:
    core = company_core(c)
    return F.when(core != "", title_case(core)).otherwise(col(c))


def profile_url(c) -> Column:
    """Comparable form of a profile URL."""
    return F.lower(F.regexp_replace(F.split_part(strip(text(c)), F.lit("?"), F.lit(1)), "/+$", ""))


def alternatives(c) -> Column:
    """Alternatives written in one cell, split at slashes and dashes."""
    parts = F.transform(F.split(text(c), "[/\\-–]"), strip)
    return F.filter(parts, lambda t: t != "")


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def expand_title(c, expansions=fv.TITLE_EXPANSIONS, typo=fv.TITLE_TYPO) -> Column:
    """Lower-cased title with the long form of known acronyms appended.

    Rules apply in order to a growing string.  Appended texts are constants, so
    which rule can set off a later one is settled here; what is left for the
    rows is one test per rule on the unexpanded title.
    """
    base = F.regexp_replace(F.regexp_replace(space_lower(c), r"[|/&(),+]", " "), r"-+", " ")
    rules = list(expansions) + [typo]

    def expanded(t: Column) -> Column:
        fired: list[Column] = []
        for i, (pattern, _) in enumerate(rules):
            hit = t.rlike(pattern)
            for j in range(i):
                if re.search(pattern, rules[j][1]):
                    hit = hit | fired[j]
            fired.append(hit)
        # Expansions are joined with a space of their own, the typo fix is not.
        extras = [" " + added for _, added in expansions] + [typo[1]]
        return F.concat(t, *[F.when(h, F.lit(x)).otherwise(F.lit("")) for h, x in zip(fired, extras)])

    return let(base, expanded)


def phrase_pattern(phrase: str) -> str:
    """Whole-word pattern; inner spaces also match a slash or hyphen."""
    return r"\b" + r"[\s\-/]+".join(literal(w) for w in phrase.lower().split()) + r"\b"


def has_phrase(c, phrases: Iterable[str]) -> Column:
    return col(c).rlike(any_of(phrase_pattern(p) for p in phrases))


def has_pattern(c, patterns: Iterable[str]) -> Column:
    """Case-insensitive match of any pattern; null counts as empty."""
    return text(c).rlike("(?i)" + any_of(patterns))


def has_substring(c, needles: Iterable[str], word_boundary: bool = False) -> Column:
    """Any needle occurs in the normalised text (as a whole word if asked)."""
    edge = r"\b" if word_boundary else ""
    return space_lower(c).rlike(edge + any_of(literal(n) for n in needles) + edge)


def keyword_score(c, *weights: dict[str, int]) -> Column:
    """Sum of the weights of all keywords that occur; 0 for null."""
    low = F.lower(text(c))
    total = F.lit(0)
    for table in weights:
        for word, weight in table.items():
            total = total + F.when(F.contains(low, F.lit(word)), weight).otherwise(0)
    return total


def keyword_hits(c, words_: Iterable[str] = fv.FOCUS_KEYWORDS) -> Column:
    """How many of the keywords occur; 0 for null."""
    low = F.lower(text(c))
    total = F.lit(0)
    for word in words_:
        total = total + F.contains(low, F.lit(word.strip().lower())).cast("int")
    return total


def _can_overlap(a: str, b: str) -> bool:
    """Whether two phrases can share a word of the text they match in."""
    wa, wb = re.findall(r"\w+", a.lower()), re.findall(r"\w+", b.lower())
    if len(wa) < len(wb):
        wa, wb = wb, wa
    inside = any(wa[i : i + len(wb)] == wb for i in range(len(wa) - len(wb) + 1))
    chained = any(wa[-k:] == wb[:k] or wb[-k:] == wa[:k] for k in range(1, len(wb) + 1))
    return inside or chained


def phrase_groups(phrases: Iterable[str]) -> list[list[str]]:
    """Split phrases into groups whose members can never overlap."""
    groups: list[list[str]] = []
    for p in phrases:
        for g in groups:
            if not any(_can_overlap(p, x) for x in g):
                g.append(p)
                break
        else:
            groups.append([p])
    return groups


def phrase_count(c, phrases: Iterable[str]) -> Column:
    """Occurrences of all phrases together, as if each were counted alone.

    Phrases that cannot overlap share one pass over the text.
    """
    total = F.lit(0)
    for group in phrase_groups(phrases):
        total = total + F.regexp_count(col(c), F.lit(any_of(phrase_pattern(p) for p in group)))
    return total


def email_tokens(c) -> Column:
    """Name-like parts of the address before the at sign; none without one."""
    local = F.lower(F.split_part(col(c), F.lit("@"), F.lit(1)))
    parts = F.transform(F.split(local, "[._]"), lambda t: F.regexp_replace(t, "[^a-z]", ""))
    none = F.array().cast("array<string>")
    return F.when(F.contains(col(c), F.lit("@")), F.filter(parts, lambda t: t != "")).otherwise(none)


def first_name_core(c) -> Column:
    """Letters of the first word, lower case."""
    return F.regexp_replace(F.lower(F.split_part(collapse(text(c)), F.lit(" "), F.lit(1))), "[^a-z]", "")


def last_name_core(c) -> Column:
    """Letters of the first word before any comma, lower case."""
    return first_name_core(F.split_part(text(c), F.lit(","), F.lit(1)))


def strip_credentials(c) -> Column:
    """Text before the first comma."""
    return F.split_part(strip(text(c)), F.lit(","), F.lit(1))


def capitalised(c) -> Column:
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def number(c) -> Column:
    """Parse a number, null where that fails."""
    return col(c).try_cast("double")


def rate(part: Column, whole: Column, digits: int, scale: float = 1.0) -> Column:
    """``scale * part / whole`` rounded half-even; 0 when there is no whole."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double")) * scale
    return F.coalesce(F.bround(ratio, digits), F.lit(0.0))


def close_connection(c, degrees=fv.CLOSE_DEGREES) -> Column:
    return F.coalesce(strip(c).isin(*degrees), F.lit(False)).cast("int")


def first_present(*columns) -> Column:
    """First value that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def split_full_name(c) -> tuple[Column, Column]:
    """First word, and the remaining words or null."""
    w = words(text(c))
    first = F.when(F.size(w) > 0, F.get(w, F.lit(0)))
    rest = F.when(F.size(w) > 1, F.array_join(F.slice(w, F.lit(2), F.size(w)), " "))
    return first, rest
