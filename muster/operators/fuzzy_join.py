"""Best-match and all-pairs joins on string similarity.

The work is done on distinct keys.  Candidate pairs come from equi-joins on
features that every pair reaching the threshold must share, so nothing is
compared with everything and nothing above the threshold is missed:

* character pairs: an alignment with few edits leaves most character pairs of
  both strings intact.  Two such strings meet in the rarest few of each, and
  the number they share in all is checked before anything is aligned;
* tokens (token set score only): where the shared tokens alone carry the score
  they include one of the rarest tokens of the string they nearly cover, and
  the score follows from lengths without an alignment;
* a string of one token scores 100 against every string holding that token; a
  lookup by token finds the preferred one without listing them all.

Rarity is the document frequency over both sides.  It decides only how many
candidates there are, never which pairs are found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions import similarity as sim
from muster.operators.skew import lookup_join, top_n
from muster.plans.storage import cut_lineage

SCORERS = ("ratio", "token_sort", "token_set", "partial")
# A feature listed by more rows than this is joined in the cells of a grid.
SHARE = 4096
# Slack for thresholds that are not exact in binary; it can only add candidates.
EPS = 1e-6


def _canonical(scorer: str) -> Column:
    """String whose characters the scorer aligns."""
    if scorer == "token_sort":
        return sim.sorted_tokens("key")
    if scorer == "token_set":
        return F.expr(f"array_join({sim.token_set_sql('key')}, ' ')")
    return F.col("key")


def _numbered(parts: str) -> str:
    """Hashed ids of an array of strings; a repeat of a string gets an id of its own.

    Two strings sharing an id by accident can only add a candidate.
    """
    return sim.let_sql(parts, lambda g: f"transform({g}, (x, i) -> xxhash64(x, size(filter(slice({g}, 1, i + 1), y -> y = x))))")


def _grams(s: str, size: int) -> Column:
    """Character n-grams as ids."""
    n = f"(char_length({s}) - {size - 1})"
    cut = f"transform(sequence(1, {n}), i -> substring({s}, i, {size}))"
    return F.expr(f"if({n} >= 1, {_numbered(cut)}, cast(array() as array<bigint>))")


def _skips(s: str) -> Column:
    """Pairs of characters side by side or with one between them, as ids; ``s`` has three characters at least."""
    near = f"transform(sequence(1, char_length({s}) - 1), i -> substring({s}, i, 2))"
    far = f"transform(sequence(1, char_length({s}) - 2), i -> concat(substring({s}, i, 1), substring({s}, i + 2, 1)))"
    return F.expr(_numbered(f"concat({near}, {far})"))


# A row's own threshold is its column ``t``.
LOST_PAIRS = f"cast(floor(n * (4 * (1 - t) / (2 - t)) + {EPS}D) as int)"
LOST_CHARS = f"cast(floor(n * ((2 - 2 * t) / (2 - t)) + {EPS}D) as int)"


# Least number of character pairs two strings of lengths ``ln`` and ``rn`` share
# at ``lt`` or above.  Edits of a pair have the parity of its total length.
_MOST = f"cast(floor((ln + rn) * (1 - lt) + {EPS}D) as int)"
PAIRS_NEEDED = f"(ln + 1 - floor((3 * ({_MOST} - pmod({_MOST} + ln + rn, 2)) + ln - rn) / 2))"
CHARS_NEEDED = f"((ln + rn) * (lt / 2) - {EPS}D)"
#: Enough characters in both strings, in whatever order, as far as their bit sets tell.
CHARS_SHARED = f"bit_count(lheld.bits & rheld.bits) + least(lheld.over, rheld.over) >= {CHARS_NEEDED}"
# An alignment leaves gaps between matched characters, in all as long as what
# is not matched.  A pair of matched neighbours with no gap above one in either
# string is a skip pair of both; every other such pair uses up two.
SKIPS_NEEDED = f"(2 * ceil({CHARS_NEEDED}) + 1 - floor((ln + rn) / 2))"
#: From here on strings that match share character pairs.
PAIRED = 2 / 3


def _character_bits(chars: str) -> str:
    """Counts of characters as a bit set (two bits for each of 31 classes), and how many characters it leaves out."""
    one = "shiftleft(1L, 2 * pmod(ascii(c), 31))"
    step = (
        f"CASE WHEN acc.bits & {one} = 0 THEN named_struct('bits', acc.bits | {one}, 'over', acc.over) "
        f"WHEN acc.bits & (2 * {one}) = 0 THEN named_struct('bits', acc.bits | (2 * {one}), 'over', acc.over) "
        "ELSE named_struct('bits', acc.bits, 'over', acc.over + 1) END"
    )
    return f"aggregate({chars}, named_struct('bits', 0L, 'over', 0), (acc, c) -> {step})"


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranked(listed: DataFrame, *keep: str) -> DataFrame:
    """Features of each key, rarest first, as ``array<struct(df, f)>``."""
    each = listed.select("side", "key", "pos", *keep, F.explode("feats").alias("f"))
    freq = each.groupBy("f").agg(F.count(F.lit(1)).alias("df"))
    # A key lists as many features as it has characters, so a row stays small.
    # Both sides of the join read the result, which is therefore stored.
    return cut_lineage(
        each.join(freq, "f").groupBy("side", "key", "pos", *keep).agg(
            F.array_sort(F.collect_list(F.struct("df", "f"))).alias("feats")
        )
    )


def _listed(ranked: DataFrame, side: int, chosen: Column, bands: list[float], *keep: Column | str) -> DataFrame:
    """One row per listed feature of each key of a side.

    A left key stands in the band of its threshold, a right key in every band,
    listing there what a match at the band's lowest threshold needs.
    """
    p = "l" if side == 0 else "r"
    cols = [F.col(c).alias(p + c) if isinstance(c, str) else c for c in keep]
    rows = ranked.filter(F.col("side") == side)
    if side:
        lowest = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(t).alias("t")) for i, t in enumerate(bands)])
        rows = rows.drop("band", "t").select("*", F.inline(lowest))
    each = rows.select("band", F.col("key").alias(p + "key"), F.col("pos").alias(p + "pos"), F.col("t").alias(p + "t"), *cols, F.explode(chosen).alias("e"))
    return each.select("*", F.col("e.f").alias("f"), F.col("e.df").alias("df")).drop("e")


def _length_band(n: str) -> str:
    return f"cast(floor(ln(greatest({n}, 1)) / ln(1.25D)) as int)"


def _meet(left: DataFrame, right: DataFrame, by_length: bool = False) -> DataFrame:
    """Rows of keys listing the same feature in the same band.

    A feature of more than ``SHARE`` rows gets a grid: a left row goes to all
    cells of one grid row, a right row to all cells of one grid column, so every
    pair meets once.  With ``g`` rows and columns a cell holds a ``g``-th of
    either side and a row is copied ``g`` times, the square root of the number
    of cells.  Where only strings of similar length can match (``by_length``),
    the rows of such a feature are also told apart by length: left rows by
    their own, right rows by those that can match them.

    The number of partitions is fixed because the work per row is an alignment,
    which small row sizes would hide from adaptive coalescing.
    """
    n = _partitions(left)
    a = left.withColumn("g", F.ceil(F.col("df") / F.lit(SHARE)).cast("int")).drop("df")
    b = right.withColumn("g", F.ceil(F.col("df") / F.lit(SHARE)).cast("int")).drop("df")
    if by_length:
        near = [_length_band(f"cast(floor(rn * {x} {y} {EPS}D) as int)") for x, y in (("(rt / (2 - rt))", "-"), ("((2 - rt) / rt)", "+"))]
        a = a.withColumn("size", F.expr(f"if(g > 1, {_length_band('ln')}, 0)"))
        b = b.withColumn("size", F.explode(F.expr(f"if(g > 1, sequence({near[0]}, {near[1]}), array(0))")))
    else:
        a, b = a.withColumn("size", F.lit(0)), b.withColumn("size", F.lit(0))
    cells = F.sequence(F.lit(0), F.col("g") - 1)
    a = a.withColumn("across", F.pmod(F.xxhash64("lkey"), F.col("g")).cast("int")).withColumn("down", F.explode(cells)).drop("g")
    b = b.withColumn("down", F.pmod(F.xxhash64("rkey"), F.col("g")).cast("int")).withColumn("across", F.explode(cells)).drop("g")
    on = ["f", "band", "size", "across", "down"]
    return a.repartition(n, *on).join(b.repartition(n, *on), on)


def _enough(left: str, right: str, needed: str) -> Column:
    """Keep a pair once, at the first feature it shares, if it shares enough."""
    return F.expr(sim.let_sql(f"array_intersect({left}, {right})", lambda c: f"size({c}) >= {needed} AND get({c}, 0) = f"))


PAIR = ["lkey", "lpos", "rkey", "rpos"]


def _gram_pairs(keys: DataFrame, scorer: str, bands: list[float]) -> DataFrame:
    """Candidates at thresholds from two thirds on, by the character pairs they share."""
    s = keys.withColumn("s", _canonical(scorer)).withColumn("n", F.char_length("s")).filter("n > 0")
    s = s.select("side", "key", "pos", "t", "band", "n", F.expr(_character_bits(sim.chars_sql("s"))).alias("held"), _grams("concat(' ', s, ' ')", 2).alias("feats"))
    ranked = _ranked(s, "t", "band", "n", "held")
    rare = F.expr(f"slice(feats, 1, {LOST_PAIRS} + 1)")
    ids = lambda p: F.expr(f"transform(feats, e -> e.f) AS {p}ids")
    met = _meet(*[_listed(ranked, i, rare, bands, "n", "held", ids(p)) for i, p in enumerate("lr")], by_length=True)
    close = F.expr(f"2 * least(ln, rn) >= (lt - {EPS}D) * (ln + rn)")
    return met.filter(close & F.expr(CHARS_SHARED)).filter(_enough("lids", "rids", PAIRS_NEEDED)).select(*PAIR)


def _loose_pairs(keys: DataFrame, scorer: str, bands: list[float]) -> DataFrame:
    """Candidates at lower thresholds.

    Such strings need share no character pair, and lists of single characters
    meet nearly every pair, several times over.  So the keys meet by length,
    in the cells of a grid, and bounds on the alignment decide inside the join:
    the characters both have, read off bit sets, and then their skip pairs.
    """
    s = keys.withColumn("s", _canonical(scorer)).withColumn("n", F.char_length("s")).filter("n > 0")
    s = s.select("side", "key", "pos", "t", "band", "n", F.expr(_character_bits(sim.chars_sql("s"))).alias("held"), _skips("concat(' ', s, ' ')").alias("skips"))
    sizes = s.groupBy("band").agg(F.count(F.lit(1)).alias("many"))
    # One row per band and side.
    most = sizes.agg(F.max("many")).scalar()
    each = cut_lineage(s.withColumn("e", F.array(F.struct(F.lit(0).alias("f"), most.alias("df")))))
    met = _meet(*[_listed(each, i, F.col("e"), bands, "n", "held", "skips") for i in (0, 1)], by_length=True)
    return met.filter(F.expr(CHARS_SHARED)).filter(F.expr(f"size(array_intersect(lskips, rskips)) >= {SKIPS_NEEDED}")).select(*PAIR)


def _partial_pairs(keys: DataFrame, bands: list[float]) -> DataFrame:
    """The shorter string lists its rarest features, the longer one all of them.

    Very short strings have too few character pairs to rely on and list single
    characters instead.
    """
    by_pairs = f"(t >= {PAIRED}D AND {LOST_PAIRS} < n - 1)"
    s = keys.withColumn("n", F.char_length("key")).filter("n > 0")
    s = s.withColumn("pairs", _grams("key", 2)).withColumn("chars", _grams("key", 1)).select(
        "side", "key", "pos", "t", "band", "n", F.concat("pairs", "chars").alias("feats"), "pairs", "chars")
    ranked = _ranked(s, "t", "band", "n", "pairs", "chars")
    # What the shorter string relies on follows its row's threshold, so it is chosen after bands are given.
    mine = f"filter(feats, e -> array_contains(if({by_pairs}, pairs, chars), e.f))"
    lost = f"if({by_pairs}, {LOST_PAIRS}, {LOST_CHARS})"

    def side(i: int, short: bool) -> DataFrame:
        p = "l" if i == 0 else "r"
        if short:
            return _listed(ranked, i, F.expr(f"slice({mine}, 1, {lost} + 1)"), bands, "n", F.expr(f"{lost} AS {p}lost"), F.expr(f"transform({mine}, e -> e.f) AS {p}mine"))
        return _listed(ranked, i, F.col("feats"), bands, "n", F.expr(f"transform(feats, e -> e.f) AS {p}all"))

    a = _meet(side(0, True), side(1, False)).filter(F.expr("ln <= rn") & _enough("lmine", "rall", "size(lmine) - llost"))
    b = _meet(side(0, False), side(1, True)).filter(F.expr("ln > rn") & _enough("rmine", "lall", "size(rmine) - rlost"))
    return a.select(*PAIR).unionByName(b.select(*PAIR))


def _token_scores(keys: DataFrame, bands: list[float], prefer: str | None) -> DataFrame:
    """Pairs whose score rests on shared tokens, with that part of the score.

    A pair that scores more by alignment is also found by its character pairs.
    """
    sets = keys.withColumn("tokens", sim.token_set("key")).withColumn("size", F.size("tokens")).filter("size > 0")
    many = sets.filter("size > 1").withColumn("n", F.expr("char_length(array_join(tokens, ' '))"))
    many = _ranked(many.withColumn("feats", F.col("tokens")), "t", "band", "n", "tokens")
    # Tokens that may all be missing have a bounded length; list rare tokens
    # until they are longer than that, at least one.
    spare = f"n * ((2 - 2 * t) / (2 - t)) + {EPS}D"
    taken = (
        f"aggregate(feats, named_struct('used', 0, 'take', 0), (acc, e) -> if(acc.used <= {spare}, "
        "named_struct('used', acc.used + char_length(e.f) + 1, 'take', acc.take + 1), acc)).take"
    )
    rare, every = F.expr(f"slice(feats, 1, {taken})"), F.col("feats")
    side = lambda i, chosen: _listed(many, i, chosen, bands, "n", "tokens")
    met = _meet(side(0, rare), side(1, every)).unionByName(_meet(side(0, every), side(1, rare)))

    def covered(same: str) -> str:
        n = f"char_length(array_join({same}, ' '))"
        part = lambda p: sim.percent_sql(f"{p}n - {n}", f"{n} + {p}n")
        return f"if(size({same}) = size(ltokens) OR size({same}) = size(rtokens), 100.0D, greatest({part('l')}, {part('r')}))"

    scored = met.select(*PAIR, F.expr(sim.let_sql("array_intersect(ltokens, rtokens)", covered)).alias("score"))
    # Strings of one token: at most one such key per side and token, looked up
    # by the many that hold the token, in shares where they are very many.
    tokens = sets.select("side", "key", "pos", "size", F.explode("tokens").alias("f"))
    single, holders = tokens.filter("size = 1"), tokens.filter("size > 1")
    as_side = lambda df, p: df.select("f", F.col("key").alias(p + "key"), F.col("pos").alias(p + "pos"))
    l_one, r_one = as_side(single.filter("side = 0"), "l"), as_side(single.filter("side = 1"), "r")
    r_hold = as_side(holders.filter("side = 1"), "r")
    if prefer is not None:
        pick = F.min if prefer == "first" else F.max
        r_hold = r_hold.groupBy("f").agg(pick(F.struct("rpos", "rkey")).alias("p")).select("f", "p.rkey", "p.rpos")
    exact = lookup_join(as_side(holders.filter("side = 0"), "l"), r_one, "f", "lkey", how="inner").unionByName(
        lookup_join(r_hold.unionByName(r_one), l_one, "f", "rkey", how="inner"))
    return scored.unionByName(exact.select(*PAIR, F.lit(100.0).alias("score")))


SCORES = {
    "ratio": sim.ratio,
    "token_sort": sim.token_sort_ratio,
    "token_set": sim.token_set_ratio,
    "partial": sim.partial_ratio,
}


def scored_pairs(left: DataFrame, right: DataFrame, scorer: str, threshold: float,
                 prefer: str | None = None, stored: bool = False) -> DataFrame:
    """``(lkey, lpos, rkey, rpos, score)`` holding every pair that reaches ``threshold``.

    ``left(key, pos)`` and ``right(key, pos)`` hold distinct keys, with ``pos`` of
    any one type that can be ordered; empty keys match nothing.  With ``prefer`` ("first" or "last" by ``pos``) only the
    preferred of many perfect partners of a one-token key is listed.  Pairs
    below the threshold and repeated pairs may occur: aggregate, then filter.
    ``stored`` says that the keys are cheap to read again.
    """
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer!r}")
    if not 0 < threshold <= 100:
        raise ValueError("threshold must be above 0 and at most 100")
    t = threshold / 100.0
    as_keys = lambda df, i: df.select(F.lit(i).alias("side"), "key", "pos", F.lit(t).alias("t"), F.lit(0).alias("band"))
    keys = as_keys(left, 0).unionByName(as_keys(right, 1)).filter("key <> ''")
    # Distinct keys may come from a scan of everything: compute them once.
    return _scored(keys if stored else cut_lineage(keys), scorer, [t], prefer)


def _scored(keys: DataFrame, scorer: str, bands: list[float], prefer: str | None) -> DataFrame:
    """Candidates of ``keys(side, key, pos, t, band)`` with their scores: all pairs that reach the left key's ``t``."""
    if scorer == "partial":
        pairs = _partial_pairs(keys, bands)
    else:
        loose = [t for t in bands if t < PAIRED]
        parts = []
        if loose:
            parts.append(_loose_pairs(keys.filter(f"side = 1 OR band < {len(loose)}"), scorer, loose))
        if bands[len(loose):]:
            # Bands are numbered anew from the first one in which pairs can be relied on.
            rest = keys.filter(f"side = 1 OR band >= {len(loose)}").withColumn("band", F.col("band") - len(loose))
            parts.append(_gram_pairs(rest, scorer, bands[len(loose):]))
        pairs = reduce(DataFrame.unionByName, parts)
    scored = pairs.select(*PAIR, SCORES[scorer]("lkey", "rkey").alias("score"))
    return scored.unionByName(_token_scores(keys, bands, prefer)) if scorer == "token_set" else scored


def similar_pairs(keys: DataFrame, scorer: str, threshold: float) -> DataFrame:
    """All pairs of distinct keys at or above ``threshold``, earlier ``pos`` left."""
    scored = scored_pairs(keys, keys, scorer, threshold).filter("lpos < rpos")
    # Filtering an aggregate keeps the optimiser from scoring pairs twice.
    return scored.groupBy(*PAIR).agg(F.max("score").alias("score")).filter(F.col("score") >= threshold)


def best_match(left: DataFrame, right: DataFrame, scorer: str = "token_set", threshold: float = 88,
               stored: bool = False) -> DataFrame:
    """Per left key its best right key at or above ``threshold``.

    ``left(key)``, ``right(key, pos)``.  Returns ``(key, match, pos, score)``; of
    equal scores the lowest ``pos`` wins.
    """
    right = right.select("key", F.col("pos").cast("bigint").alias("pos"))
    scored = scored_pairs(left.select("key", F.lit(0).cast("bigint").alias("pos")), right, scorer, threshold, "first", stored)
    best = scored.groupBy("lkey").agg(F.max(F.struct("score", (-F.col("rpos")).alias("neg"), "rkey")).alias("b"))
    return best.select(
        F.col("lkey").alias("key"), F.col("b.rkey").alias("match"), (-F.col("b.neg")).alias("pos"), F.col("b.score").alias("score")
    ).filter(F.col("score") >= threshold)


#: Lowest thresholds of the bands that left keys with thresholds of their own are told apart by.
BANDS = [0.001, 0.5, 0.6, PAIRED, 0.75, 0.8, 0.85, 0.9, 0.95]
#: Right keys remembered per feature, features a left key looks up, and partners it scores.
PICKS, LOOKS, TRIES = 64, 8, 8


def _first_partners(keys: DataFrame, scorer: str) -> DataFrame:
    """``(lkey, rkey, rpos, score)``: a few likely partners of every left key that shares a character pair with some right key.

    Every feature remembers ``PICKS`` of the right keys that hold it, so a rare
    one remembers all of its.  A left key looks up its ``LOOKS`` rarest and
    scores the ``TRIES`` partners that share the most with it.  These numbers
    decide how good the bounds are, not what is found.
    """
    s = keys.withColumn("s", _canonical(scorer)).filter("s <> ''")
    ranked = _ranked(s.select("side", "key", "pos", _grams("concat(' ', s, ' ')", 2).alias("feats")))
    ids = F.transform("feats", lambda e: e["f"])
    held = ranked.filter("side = 1").select(F.col("key").alias("rkey"), F.col("pos").alias("rpos"), ids.alias("rids"), F.explode(ids).alias("f"))
    held = top_n(held, ["f"], [F.xxhash64("rkey"), F.col("rkey")], PICKS, "nth", salts=32).drop("nth")
    asked = ranked.filter("side = 0").select(F.col("key").alias("lkey"), ids.alias("lids"), F.explode(F.slice("feats", 1, LOOKS)["f"]).alias("f"))
    met = lookup_join(asked, held, "f", "lkey", how="inner")
    shared = F.size(F.array_intersect("lids", "rids")) / (F.size("lids") + F.size("rids"))
    likely = F.array_sort(F.collect_set(F.struct((-shared).alias("less"), "rpos", "rkey")))
    tried = met.groupBy("lkey").agg(F.slice(likely, 1, TRIES).alias("best")).select("lkey", F.inline("best"))
    return tried.select("lkey", "rkey", "rpos", SCORES[scorer]("lkey", "rkey").alias("score"))


def best_match_any(left: DataFrame, right: DataFrame, scorer: str = "token_set") -> DataFrame:
    """Per left key its best right key at whatever score, 0 included.

    ``left(key)``, ``right(key, pos)``.  Returns ``(key, match, pos, score)``; of
    equal scores the lowest ``pos`` wins.

    A few likely partners are scored first.  The best of them is a bound of the
    key's own: only pairs that reach it matter, and one candidate join finds
    all of those, each key listing as many features as its bound leaves open.
    A key without such a partner lists all its characters.  What shares none
    with any right key scores 0 with all of them, and the first one stands.
    """
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer!r}")
    right = right.select("key", F.col("pos").cast("bigint").alias("pos")).filter("key <> ''")
    as_keys = lambda df, i, pos: df.select(F.lit(i).alias("side"), "key", pos.cast("bigint").alias("pos"))
    keys = cut_lineage(as_keys(left.filter("key <> ''"), 0, F.lit(0)).unionByName(as_keys(right, 1, F.col("pos"))))
    tried = cut_lineage(_first_partners(keys, scorer))
    bounds = tried.groupBy(F.col("lkey").alias("key")).agg((F.max("score") / 100).alias("bound"))
    bound = F.greatest("bound", F.lit(BANDS[0]))
    band = F.size(F.filter(F.array(*map(F.lit, BANDS)), lambda b: b <= bound)) - 1
    asked = keys.filter("side = 0").join(bounds, "key", "left").select("side", "key", "pos", bound.alias("t"), band.alias("band"))
    known = keys.filter("side = 1").withColumns({"t": F.lit(None).cast("double"), "band": F.lit(None).cast("int")})
    scored = _scored(cut_lineage(asked.unionByName(known)), scorer, BANDS, "first").select("lkey", "rkey", "rpos", "score")
    best = scored.unionByName(tried).groupBy("lkey").agg(F.max(F.struct("score", (-F.col("rpos")).alias("neg"), "rkey")).alias("b"))
    # The first right key is a single row.
    first = right.agg(F.min(F.struct("pos", "key")).alias("f")).scalar()
    every = keys.filter("side = 0").select("key").join(best.withColumnRenamed("lkey", "key"), "key", "left").withColumn("f", first)
    found = F.coalesce("b.score", F.lit(0.0)) > 0
    return every.filter("f IS NOT NULL").select(
        "key", F.when(found, F.col("b.rkey")).otherwise(F.col("f.key")).alias("match"),
        F.when(found, -F.col("b.neg")).otherwise(F.col("f.pos")).alias("pos"), F.when(found, F.col("b.score")).otherwise(0.0).alias("score"))
