"""String similarity scores (0-100) as native column expressions.

All scores rest on the longest common subsequence.  Its length comes from the
bit-vector recurrence over the characters of the second string, held in words
of 62 bits so that sums never overflow a bigint; no Python worker is involved
and there is no length limit.

The expressions are written as SQL text: they nest many lambdas, and one parsed
string reaches the session in a single call where a tree of ``Column`` calls
takes thousands.  Arguments are column names or SQL expressions.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 62
FULL = (1 << WORD) - 1
_names = itertools.count()


def _fresh(stem: str) -> str:
    """A lambda variable no enclosing expression uses."""
    return f"{stem}_{next(_names)}"


def let_sql(value: str, body) -> str:
    """Evaluate ``value`` once and hand its name to ``body``."""
    v = _fresh("v")
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def text_literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPACE_SQL = text_literal(r"[\t-\r\x1c-\x1f\x85\p{Z}]+")


def words_sql(s: str) -> str:
    return f"filter(split(trim(regexp_replace({s}, {SPACE_SQL}, ' ')), ' '), w -> w <> '')"


def sorted_tokens_sql(s: str) -> str:
    return f"array_join(array_sort({words_sql(s)}), ' ')"


def token_set_sql(s: str) -> str:
    """Distinct tokens in order."""
    return f"array_sort(array_distinct({words_sql(s)}))"


def chars_sql(s: str) -> str:
    """Code points of a string as an array."""
    return f"regexp_extract_all({s}, '(?s)(.)', 1)"


def masks_sql(cs: str) -> str:
    """``map(char -> words)``: bit p of word w is set where char 62w+p matches."""
    def build(a: str) -> str:
        ch, w = _fresh("ch"), _fresh("w")
        word = (
            f"aggregate(slice({a}, {w} * {WORD} + 1, {WORD}), named_struct('m', 0L, 'bit', 1L), "
            f"(acc, x) -> named_struct('m', if(x = {ch}, acc.m | acc.bit, acc.m), 'bit', shiftleft(acc.bit, 1)), acc -> acc.m)"
        )
        last = f"greatest(1, cast(ceil(size({a}) / {WORD}.0D) as int)) - 1"
        return (
            f"map_from_entries(transform(array_distinct({a}), {ch} -> "
            f"named_struct('c', {ch}, 'w', transform(sequence(0, {last}), {w} -> {word}))))"
        )

    return let_sql(cs, build)


def lcs_masked_sql(masks: str, n: str, other: str) -> str:
    """LCS length from position masks of one side and characters of the other."""
    short = (
        f"aggregate({other}, {FULL}L, (v, c) -> if({masks}[c] IS NULL, v, "
        f"((v + (v & {masks}[c][0])) | (v & ~{masks}[c][0])) & {FULL}L), v -> {WORD} - bit_count(v))"
    )
    words = f"cast(ceil({n} / {WORD}.0D) as int)"
    total = f"(get(v, w) + (get(v, w) & get({masks}[c], w)) + acc.carry)"
    step = (
        f"aggregate(sequence(0, {words} - 1), named_struct('out', cast(array() as array<bigint>), 'carry', 0L), "
        f"(acc, w) -> named_struct('out', concat(acc.out, array(({total} | (get(v, w) & ~get({masks}[c], w))) & {FULL}L)), "
        f"'carry', if({total} > {FULL}L, 1L, 0L)), acc -> acc.out)"
    )
    long = (
        f"aggregate({other}, transform(sequence(1, {words}), w -> {FULL}L), (v, c) -> if({masks}[c] IS NULL, v, {step}), "
        f"v -> {words} * {WORD} - aggregate(v, 0, (a, w) -> a + bit_count(w)))"
    )
    return f"if({n} <= {WORD}, {short}, {long})"


def lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence length of two strings."""
    both = f"named_struct('a', {chars_sql(a)}, 'b', {chars_sql(b)})"
    return let_sql(
        both,
        lambda s: let_sql(
            f"named_struct('m', {masks_sql(s + '.a')}, 'n', size({s}.a), 'b', {s}.b)",
            lambda p: lcs_masked_sql(f"{p}.m", f"{p}.n", f"{p}.b"),
        ),
    )


def indel_sql(lcs: str, total: str) -> str:
    """``100 * (1 - distance / total)`` with both strings empty scoring 100."""
    return f"if({total} = 0, 100.0D, (1.0D - cast({total} - 2 * {lcs} as double) / {total}) * 100.0D)"


def percent_sql(distance: str, total: str) -> str:
    """Same measure, rounded the way the token scores are."""
    return f"if({total} = 0, 100.0D, 100.0D - cast(100 * ({distance}) as double) / ({total}))"


def ratio_sql(a: str, b: str) -> str:
    def scored(v: str) -> str:
        total = f"(char_length({v}.a) + char_length({v}.b))"
        # Equal strings need no alignment, and neither does a missing side.
        return (
            f"CASE WHEN {v}.a = {v}.b THEN 100.0D WHEN {v}.a = '' OR {v}.b = '' THEN 0.0D "
            f"WHEN {v}.a IS NULL OR {v}.b IS NULL THEN NULL ELSE {indel_sql(lcs_sql(v + '.a', v + '.b'), total)} END"
        )

    return let_sql(f"named_struct('a', {a}, 'b', {b})", scored)


def token_sort_sql(a: str, b: str) -> str:
    return ratio_sql(sorted_tokens_sql(a), sorted_tokens_sql(b))


def token_set_ratio_sql(a: str, b: str) -> str:
    def joined(s: str) -> str:
        parts = (
            f"named_struct('same', array_join(array_intersect({s}.a, {s}.b), ' '), "
            f"'ab', array_join(array_except({s}.a, {s}.b), ' '), 'ba', array_join(array_except({s}.b, {s}.a), ' '))"
        )
        return (
            f"if(size({s}.a) = 0 OR size({s}.b) = 0, 0.0D, "
            + let_sql(parts, lambda j: f"if({j}.same <> '' AND ({j}.ab = '' OR {j}.ba = ''), 100.0D, {scored(j)})") + ")"
        )

    def scored(j: str) -> str:
        same, ab, ba = f"char_length({j}.same)", f"char_length({j}.ab)", f"char_length({j}.ba)"
        gap = f"if({same} > 0, 1, 0)"
        sizes = (
            f"named_struct('same', {same}, 'gap', {gap}, 'ab', {ab}, 'ba', {ba}, "
            f"'d', {ab} + {ba} - 2 * {lcs_sql(j + '.ab', j + '.ba')})"
        )

        def best(x: str) -> str:
            part = lambda d: percent_sql(f"{x}.gap + {x}.{d}", f"2 * {x}.same + {x}.gap + {x}.{d}")
            whole = percent_sql(f"{x}.d", f"2 * ({x}.same + {x}.gap) + {x}.ab + {x}.ba")
            return f"if({x}.same > 0, greatest({whole}, {part('ab')}, {part('ba')}), {whole})"

        return let_sql(sizes, best)

    return let_sql(f"named_struct('a', {token_set_sql(a)}, 'b', {token_set_sql(b)})", joined)


def _windows_sql(short: str, long: str) -> str:
    """Best score of ``short`` against every window of ``long``, ends clipped."""
    prepared = let_sql(
        f"named_struct('s', {chars_sql(short)}, 'l', {chars_sql(long)})",
        lambda v: f"named_struct('n', size({v}.s), 'l', {v}.l, 'm', {masks_sql(v + '.s')})",
    )

    def best(s: str) -> str:
        i = _fresh("i")
        window = f"slice({s}.l, greatest({i}, 0) + 1, least({i} + {s}.n, size({s}.l)) - greatest({i}, 0))"
        one = let_sql(window, lambda w: indel_sql(lcs_masked_sql(f"{s}.m", f"{s}.n", w), f"({s}.n + size({w}))"))
        return f"array_max(transform(sequence(1 - {s}.n, size({s}.l) - 1), {i} -> {one}))"

    return let_sql(prepared, best)


def partial_sql(a: str, b: str) -> str:
    """Best alignment of the shorter string inside the longer one."""
    ordered = let_sql(
        f"named_struct('a', {a}, 'b', {b})",
        lambda v: f"if(char_length({v}.a) <= char_length({v}.b), named_struct('s', {v}.a, 'l', {v}.b), named_struct('s', {v}.b, 'l', {v}.a))",
    )
    return let_sql(
        ordered,
        lambda v: f"CASE WHEN {v}.s = '' THEN if({v}.l = '', 100.0D, 0.0D) WHEN contains({v}.l, {v}.s) THEN 100.0D "
        f"WHEN {v}.s IS NULL OR {v}.l IS NULL THEN NULL "
        f"ELSE greatest({_windows_sql(v + '.s', v + '.l')}, if(char_length({v}.s) = char_length({v}.l), {_windows_sql(v + '.l', v + '.s')}, 0.0D)) END",
    )


def lcs_length(a: str, b: str) -> Column:
    return F.expr(lcs_sql(a, b))


def ratio(a: str, b: str) -> Column:
    return F.expr(ratio_sql(a, b))


def lev_ratio(a: str, b: str) -> Column:
    return F.expr(ratio_sql(a, b)) / 100.0


def token_sort_ratio(a: str, b: str) -> Column:
    return F.expr(token_sort_sql(a, b))


def token_set_ratio(a: str, b: str) -> Column:
    return F.expr(token_set_ratio_sql(a, b))


def partial_ratio(a: str, b: str) -> Column:
    return F.expr(partial_sql(a, b))


def sorted_tokens(a: str) -> Column:
    return F.expr(sorted_tokens_sql(a))


def token_set(a: str) -> Column:
    return F.expr(token_set_sql(a))


def length_compatible(a: Column, b: Column, threshold: float) -> Column:
    """Whether two strings are close enough in length to reach a ratio."""
    la, lb = F.char_length(a), F.char_length(b)
    return 200 * F.least(la, lb) >= F.lit(threshold - 1e-9) * (la + lb)


def _pieces(needle: str, n: int) -> list[str]:
    """Cut a string into ``n`` runs of near-equal length."""
    cut = [round(i * len(needle) / n) for i in range(n + 1)]
    return [needle[a:b] for a, b in zip(cut, cut[1:])]


def best_partial(c: str, needles: list[tuple[str, str]], threshold: float) -> Column:
    """Label of the constant that best aligns with ``c``, null below threshold.

    ``needles`` pairs each constant with a label; earlier entries win ties.  A
    window of ``c`` scoring at least the threshold differs from the needle by
    at most ``e`` single-character edits, so one of ``e + 1`` pieces of the
    needle must occur unchanged.  A value no longer than the needle is slid
    along it instead, and nearly all of its characters must occur in the
    needle.  Only needles passing these tests are aligned.
    """
    t = threshold / 100.0
    entries = []
    for i, (needle, label) in enumerate(needles):
        edits = int((1 - t) * 2 * len(needle) + 1e-9)
        pieces = _pieces(needle, edits + 1) if edits + 1 < len(needle) else [""]
        entries.append(
            f"named_struct('needle', {text_literal(needle)}, 'alphabet', {text_literal(''.join(dict.fromkeys(needle)))}, "
            f"'pieces', array({', '.join(map(text_literal, pieces))}), 'i', {-i}, 'label', {text_literal(label)})"
        )

    def aligned(v: str) -> str:
        n, size = f"char_length({v})", "char_length(e.needle)"
        foreign = f"char_length(translate({v}, e.alphabet, ''))"
        shorter = f"({n} <= {size} AND {foreign} <= {n} * {(2 - 2 * t) / (2 - t)}D + 1e-9D)"
        possible = f"{shorter} OR ({n} >= {size} AND exists(e.pieces, p -> contains({v}, p)))"
        score = f"named_struct('score', {partial_sql('e.needle', v)}, 'i', e.i, 'label', e.label)"
        best = f"array_max(transform(filter(array({', '.join(entries)}), e -> {possible}), e -> {score}))"
        return let_sql(best, lambda b: f"if({b}.score >= {threshold}D, {b}.label, NULL)")

    return F.expr(let_sql(c, aligned))
